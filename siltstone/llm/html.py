"""Main text of web pages by template deduction.

Tokens of a page are its block elements, named by their path from the root, and its blocks of text. Over the pages of a host every token has an occurrence vector: how often it occurs on each page. Tokens with equal vectors form an equivalence class. A vector enters as counts and sums of hashes of (page, occurrences), so vectors are found by map-side sums over all pages and no host is ever gathered. Classes of two tokens or more that occur on half of a host's pages or more are valid; elements of valid classes that occur once a page are nested by their paths into the template, and what pages hold between them are its slots. A slot's weight is the text outside links that no other page of the host repeats. From the root the template is followed down into whichever slot holds most of that weight; there the article is. Texts that belong to a valid class, and slots that hold mostly links, are the template's own. Names of elements and classes decide only what no template tells: pages of hosts too small for one, and containers inside the article that say they aren't of it.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fits, materialise, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|object|canvas|select|button)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
#: Elements that belong to the running text around them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article's.
OUTSIDE = set("head nav footer aside form menu dialog fieldset".split())
#: Words of class, id and role that name what isn't the article's.
NAMES = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold text themselves; what their class says is about the text, not about its place.
TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption address li dt dd td th caption".split())
HOLDERS = {"ul", "ol", "dl", "table", "article", "section", "div", "body"}


@dataclass
class Block:
    path: str
    text: str
    linked: int


@dataclass
class Page:
    paths: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def parse(html: str) -> Page:
    """The page's block elements and blocks of text, in order. Comments, raw elements and tags are no text; unclosed and stray tags are borne. An element within more than 64 others counts as the 64th, so that paths stay short; its text stays whole."""
    page, stack, parts, linked, links = Page(), [], [], 0, 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                page.blocks.append(Block(stack[-1][1] if stack else "", text, linked))
        parts, linked = [], 0

    for m in _TOKEN.finditer(html):
        s = m[0]
        if s[0] != "<" or s == "<":
            parts.append(s)
            linked += len(s) if links else 0
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1] is None and not s.startswith("<!--"):
                continue
            continue
        ending = bool(m[2] or m[5])
        if name in INLINE:
            if name == "a":
                links = 0 if ending else 1
            elif name == "br":
                parts.append(" ")
            continue
        close_block()
        if ending:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
            continue
        inner = len(stack)
        for i in range(len(stack) - 1, -1, -1):  # what this element closes by its start
            if stack[i][0] in CLOSES.get(name, ()) or stack[i][0] == "p":
                inner = i
                break
            if stack[i][0] in HOLDERS:
                break
        del stack[inner:]
        key = name
        if (raw := m[4] or m[7]) and "=" in raw or raw and "hidden" in raw:
            for a in _ATTRIBUTE.finditer(raw):
                value = (a[2] or a[3] or a[4] or "").lower()
                kind = a[1].lower()
                if kind in ("class", "id", "role"):
                    words = [w for w in _WORDS.findall(value) if not w.isdigit()]
                    key += "." + ".".join(words) if words else ""
                elif kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value)):
                    key += ".-hidden"
        path = f"{stack[-1][1]}/{key}" if stack else key
        if len(stack) < 64:
            page.paths.append(path)
        if name not in VOID:
            stack.append((name, path if len(stack) < 64 else stack[-1][1]))
    close_block()
    return page


def outside(path: str) -> bool:
    """Whether the path's elements or names say that it isn't the article's."""
    within = False
    for step in path.split("/"):
        name, *words = step.split(".")
        if name in OUTSIDE or "-hidden" in words or (name not in TEXT and NAMES.intersection(words)) or (not within and (name == "header" or "header" in words)):
            return True
        within = within or name in MAIN
    return False


def main(path: str) -> bool:
    return any(s.split(".")[0] in MAIN or (MAIN_NAMES.intersection(s.split(".")[1:])) for s in path.split("/"))


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return (m[1] if m else "").lower()


EVERYWHERE = "*"


def token(block: Block) -> str:
    """A block of text as a token: its path and a hash of its text."""
    return f"{block.path}\t{xxhash.xxh64_hexdigest(block.text.encode('utf-8', 'replace'))}"


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, support, total, s1, s2, weight): for each token of a host its occurrence vector, as pages, occurrences and two sums of hashes, and the weight of the text it holds itself: characters outside links less those in them. The token "" stands for the pages themselves; pages without elements and text take no part. The host "*" stands for all pages together; it has elements only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "token", "support", "total", "s1", "s2", "weight"])
            sums.clear()
            return out

        for b in batches:
            for url, raw in zip(b["url"], b["html"], strict=True):
                raw, name = raw or "", host(url)
                page, count, held = parse(raw), defaultdict(int), defaultdict(int)
                if not page.paths and not page.blocks:
                    continue
                for p in page.paths:
                    count[p] += 1
                for block in page.blocks:
                    weight = 0 if outside(block.path) else len(block.text) - 2 * min(block.linked, len(block.text))
                    held[block.path] += weight
                    count[t := token(block)] += 1
                    held[t] += weight
                mark = xxhash.xxh64_digest(raw.encode("utf-8", "replace"))
                for t, n in [("", 1), *count.items()]:
                    h = xxhash.xxh64_intdigest(mark + str(n).encode())
                    for place in (name,) if "\t" in t or name == EVERYWHERE else (name, EVERYWHERE):
                        s = sums.setdefault((place, t), [0] * 5)
                        for i, x in enumerate((1, n, h & 0x3FFFFFFF, h >> 34, held.get(t, 0))):
                            s[i] += x
                if len(sums) > 50_000:
                    yield flush()
        yield flush()

    schema = "host string, token string, support long, total long, s1 long, s2 long, weight long"
    return pages.select("url", "html").mapInPandas(run, schema).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("support", "total", "s1", "s2", "weight")))


def classes(tokens: Iterable[tuple]) -> list[set[str]]:
    """The equivalence classes of (token, *vector), each a set of tokens."""
    found = defaultdict(set)
    for t, *vector in tokens:
        found[tuple(vector)].add(t)
    return [*found.values()]


def nested(elements: Iterable[str]) -> dict[str, list[str]]:
    """The template: elements under the nearest element of the template above each, "" at the root."""
    inside, tree = set(elements), defaultdict(list)
    for e in sorted(inside):
        tree[slot(e.rpartition("/")[0], inside)].append(e)
    return tree


def followed(tree: dict[str, list[str]], weights: dict[str, int], most: float = 0.6) -> str:
    """The slot where the article is: down from the root while one slot with what is nested in it holds `most` of all weight; one that its names call the article needs half of that."""
    whole: dict[str, int] = {}
    for node in sorted({*tree, *(e for v in tree.values() for e in v)}, key=lambda p: -p.count("/") - (p != "")):
        whole[node] = max(0, weights.get(node, 0)) + sum(whole.get(e, 0) for e in tree.get(node, ()))
    at, total = "", whole.get("", 0)
    while total > 0:
        below = [e for e in tree.get(at, ()) if not outside(e) and whole[e] >= total * most * (0.5 if main(e) else 1)]
        if not below:
            break
        at = max(below, key=lambda e: (whole[e], main(e), e))
    return at


def templates(pages: DataFrame, least: int = 4) -> DataFrame:
    """(host, frame, content, links, own): the template's elements, the one whose slot holds the article ("" for the whole page), the slots that hold mostly links, and the template's own texts as tokens. Hosts with fewer than `least` pages with elements get none of their own; "*" has the template of all pages together.

    A class is valid from two tokens and half of the host's pages on. Its elements are slots if they occur once a page; its texts are the template's own if they occur once a page and on more pages than any one page has exact copies. Pages cut short lack closing elements only, so opening elements are counted.
    """
    counted = materialise(occurrences(pages), "occurrences")
    whole = counted.where("token = ''").select(F.col("host").alias("h"), F.col("support").alias("pages")).where((F.col("pages") >= least) | (F.col("host") == EVERYWHERE))
    copies = pages.select(_host(F.col("url")).alias("c_host"), F.xxhash64("html").alias("mark")).groupBy("c_host", "mark").count().groupBy("c_host").agg(F.max("count").alias("copies"))
    whole = materialise(whole.join(copies, F.col("h") == F.col("c_host"), "left").select("h", "pages", F.coalesce("copies", F.lit(0)).alias("copies")), "hosts")
    whole = F.broadcast(whole) if fits(whole, 100_000) else whole
    often = counted.where("token != ''").join(whole, (F.col("host") == F.col("h")) & (F.col("support") * 2 >= F.col("pages")) & (F.col("support") > 1))

    def deduce(part: pd.DataFrame) -> pd.DataFrame:
        of = {t: (s, n, c) for t, s, n, c in zip(part["token"], part["support"], part["total"], part["copies"], strict=True)}
        valid = [t for c in classes(zip(part["token"], part["support"], part["total"], part["s1"], part["s2"], strict=True)) if len(c) > 1 for t in c]
        once = sorted(t for t in valid if of[t][0] == of[t][1])
        return pd.DataFrame({"host": [part["host"].iloc[0]], "frame": [[t for t in once if "\t" not in t]], "own": [[t for t in once if "\t" in t and of[t][0] > of[t][2]]]})

    frames = materialise(often.groupBy("host").applyInPandas(deduce, "host string, frame array<string>, own array<string>"), "frames")
    path, text = F.substring_index("token", "\t", 1), F.col("token").contains("\t")
    held = counted.where(text | (F.col("host") == EVERYWHERE)).where("token != ''").select("host", path.alias("path"), F.when(~text | (F.col("support") == 1), F.col("weight") * 100).otherwise(F.col("weight")).alias("weight"))
    held = held.groupBy("host", "path").agg(F.sum("weight").alias("weight")).withColumnRenamed("host", "_host")
    frame = frames.select("host", "frame")
    held = held.join(F.broadcast(frame) if fits(frames, 50_000) else frame, F.col("_host") == F.col("host")).select("host", "frame", "path", "weight")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inside = {h: set(f) for h, f in zip(b["host"], b["frame"], strict=True)}
            yield pd.DataFrame({"host": b["host"], "slot": [slot(p, inside[h]) for h, p in zip(b["host"], b["path"], strict=True)], "weight": b["weight"]})

    weights = held.mapInPandas(slots, "host string, slot string, weight long").groupBy("host", "slot").agg(F.sum("weight").alias("weight"))

    def choose(key: tuple, own: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["host", "frame", "content", "links", "own"])
        weight, frame = dict(zip(weights["slot"], weights["weight"], strict=True)), list(own["frame"].iloc[0])
        links = sorted(s for s, w in weight.items() if w < 0)
        return pd.DataFrame({"host": [key[0]], "frame": [frame], "content": [followed(nested(frame), weight)], "links": [links], "own": [list(own["own"].iloc[0])]})

    return frames.groupBy("host").cogroup(weights.groupBy("host")).applyInPandas(choose, "host string, frame array<string>, content string, links array<string>, own array<string>")


def slot(path: str, frame: set[str]) -> str:
    """The nearest element of the frame at or above path, or "" for none."""
    while path and path not in frame:
        path = path.rpartition("/")[0]
    return path


def article(page: Page, frame: set[str], content: str, links: set[str], own: set[str]) -> str:
    """The blocks in the slot that holds the article and in what is nested there, without slots of links and the template's own texts (a heading of first order stays). A page that lacks that slot is read by its elements' names alone."""
    inside = [b for b in page.blocks if not outside(b.path)]
    named = [b for b in inside if main(b.path)]
    found = [b for b in inside if f"{b.path}/".startswith(f"{content}/") and slot(b.path, frame) not in links] if content else []
    if content and named and not any(main(b.path) for b in found):
        found = named
    elif not found:
        found = named or [b for b in inside if 2 * b.linked < len(b.text)]
    kept = [b for b in found if not own or token(b) not in own or b.path.rpartition("/")[2].split(".")[0] == "h1"]
    return "\n".join(b.text for b in kept)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, least: int = 4, broadcast_hosts: int = 50_000, template: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: the whole article's text, blocks joined by a line feed.

    Null html counts as empty, whose text is empty; a null url's host is the empty name. Repeated rows and null ids are kept; an empty table gives an empty result; texts are read whole, however long; other columns, whatever their names, are ignored. Templates go to the pages by broadcast where they are small, else by a join on the host whose hot keys Spark splits. Without `template` pages are read by their elements' names alone.
    """
    found = materialise(templates(pages, least) if template else templates(pages.limit(0), least), "templates")
    common = found.where(F.col("host") == EVERYWHERE).first()
    common = _read(common["frame"], common["content"], common["links"], common["own"]) if common else (set(), "", set(), set())
    own = found.where(F.col("host") != EVERYWHERE).withColumnRenamed("host", "_host")
    own = F.broadcast(own) if fits(found, broadcast_hosts) else own
    joined = pages.select("page_id", "url", "html", _host(F.col("url")).alias("_name")).join(own, F.col("_name") == F.col("_host"), "left").select("page_id", "url", "html", "_host", "frame", "content", "links", "own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {None: common}
        for b in batches:
            out = []
            for raw, name, *rows in zip(b["html"], b["_host"], b["frame"], b["content"], b["links"], b["own"], strict=True):
                if name not in known:
                    if len(known) > 10_000:
                        known.clear()
                        known[None] = common
                    known[name] = _read(*rows)
                out.append(article(parse(raw or ""), *known[name]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    ids = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {ids}, url string, text string, n_chars long")


def _read(frame, content: str, links, own) -> tuple[set[str], str, set[str], set[str]]:
    return set(frame), content, set(links), set(own)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
