"""Column functions on words and their forms: spellings, casual writing, further stemmers, codes, aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.arrays import let
from siltstone.functions.labels import within_edits
from siltstone.functions.text import stem

# Words that keep their spelling, and casual spellings with what they stand for.
KEPT = ("hour", "four", "tour", "your", "pour", "sour", "flour", "dour", "scour", "velour", "detour", "contour", "hours", "tours", "yours", "pours", "flours", "detours", "contours", "glamour", "glamours", "amour", "troubadour", "tambour")
CASUAL = {
    "whats": "what's", "hows": "how's", "wheres": "where's", "whos": "who's", "whens": "when's", "im": "I'm", "ive": "I've", "dont": "don't", "doesnt": "doesn't", "didnt": "didn't",
    "isnt": "isn't", "arent": "aren't", "cant": "can't", "wont": "won't", "shouldnt": "shouldn't",
}
# British ending, American one, and what may follow either.
RESPELLED = (("our", "or", "s ed ing ite ites ful hood al ally"), ("tre", "ter", "s"), ("bre", "ber", "s"), ("ogue", "og", "s"), ("^defence", "defense", "s"), ("^licence", "license", "s"), ("^offence", "offense", "s"), ("^pretence", "pretense", "s"))
# Ending, least length of a word that loses it, letters lost.
COARSE = (("ies", 5, 2), ("es", 5, 2), ("s", 4, 1), ("ing", 5, 3), ("ed", 5, 2))


def american(word: Column) -> Column:
    """One spelling for both sides of the Atlantic: the first British ending that fits is rewritten, then ae and oe in words of seven letters or more. Shorter words than six letters, words of KEPT and words with other signs than letters stay."""
    spelled = []
    for british, put, more in RESPELLED:
        ending = rf"{british}({'|'.join(more.split())})?$"
        spelled.append(F.when(word.rlike(ending), F.regexp_replace(word, ending, f"{put}$1")))
    foreign = word.rlike(r"\P{L}") | word.isin(*KEPT) | (F.length(word) < 6)
    vowels = lambda w: F.when(F.length(word) >= 7, F.replace(F.replace(w, F.lit("ae"), F.lit("e")), F.lit("oe"), F.lit("e"))).otherwise(w)
    return F.when(foreign, word).otherwise(vowels(F.coalesce(*spelled, word)))


def contracted(text: Column) -> Column:
    """Casual spellings with their apostrophes: dont -> don't, WHATS -> WHAT'S, Whats -> What's; a capital first letter stays one. A word is looked for only in texts that hold its letters; no spelling makes another's word."""
    low = F.lower(text)
    for word, spelled in CASUAL.items():
        text = let(text, _put_right(low, word, spelled))
    return text


def _put_right(low: Column, word: str, spelled: str) -> Callable[[Column], Column]:
    first, rest = word[0], word[1:]

    def of(text: Column) -> Column:
        new = text
        for found, put in ((word.upper(), spelled.upper()), (f"{first.upper()}(?i:{rest})", spelled[0].upper() + spelled[1:]), (f"(?i:{word})", spelled)):
            new = F.regexp_replace(new, rf"\b{found}\b", put)
        return F.when(F.contains(low, F.lit(word)), new).otherwise(text)

    return of


def coarse_stem(word: Column) -> Column:
    """The search's cruder stem: the first ending of COARSE that a word is long enough for comes off."""
    fits = [F.when(word.endswith(ending) & (F.length(word) >= least), F.left(word, F.length(word) - lost)) for ending, least, lost in COARSE]
    return F.coalesce(*fits, word)


def coded_terms(text: Column) -> Column:
    """Stems of a text's words, one-letter words left out, then its codes with the hyphen closed: K-9 -> k9. A code is up to four letters, up to six digits and a letter or none, with a hyphen or none between."""
    low = F.translate(F.lower(text), "‐–", "--")
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) > 1) | w.between("0", "9"))
    letters, digits, end = r"(?<![\p{L}\p{N}_])(\p{L}{1,4})", r"(\d{1,6}", r"\p{L}?)(?![\p{L}\p{N}_])"
    codes = F.regexp_extract_all(low, F.lit(f"{letters}-?{digits}{end}"), F.lit(0))
    return F.concat(F.transform(words, stem), F.transform(codes, lambda c: F.replace(c, F.lit("-"), F.lit(""))))


def useful_aliases(title: Column, aliases: Column, keep: int = 6) -> Column:
    """Up to keep aliases in order: with a Latin letter, not of the form TwoWords, and, from five letters on, more than two edits from the title and all kept ones, case aside.

    Which names lie near which is worked out first; what stays then follows from the places of the near ones.
    """
    humps = lambda a: F.regexp_extract_all(a, F.lit("[A-Z][a-z]+"), F.lit(0))
    names = F.concat(F.array(title), F.filter(aliases, lambda a: a.rlike("[A-Za-z]") & ~((F.size(humps(a)) > 1) & (F.array_join(humps(a), "") == a))))
    long = lambda a: F.length(a) >= 5
    near = lambda a, b: long(a) & long(b) & (within_edits(F.lower(a), F.lower(b), 2) <= 2)
    rivals = F.transform(names, lambda a, i: F.filter(F.transform(names, lambda b, j: F.when((j < i) & near(a, b), j)), lambda j: j.isNotNull()))
    places = F.sequence(F.lit(1), F.size(names) - 1)
    stays = lambda kept, i: (F.size(kept) <= keep) & ~F.arrays_overlap(kept, F.get(rivals, i))
    kept = F.aggregate(F.when(F.size(names) > 1, places).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), lambda kept, i: F.when(stays(kept, i), F.array_append(kept, i)).otherwise(kept))
    return F.transform(F.slice(kept, F.lit(2), F.size(kept)), lambda i: F.get(names, i))


def compact(value: Column, units: int = 96) -> Column:
    """A label of at most so many UTF-16 units, cut ones with an ellipsis; no character is split."""
    size = lambda c: F.octet_length(F.encode(c, "UTF-16LE")) / 2
    cuts = F.sequence(F.lit(units - 1), F.lit((units - 1) // 2), F.lit(-1))
    kept = F.element_at(F.filter(cuts, lambda k: size(F.left(value, k)) <= units - 1), 1)
    return F.when(size(value) <= units, value).otherwise(F.concat(F.left(value, kept), F.lit("…")))
