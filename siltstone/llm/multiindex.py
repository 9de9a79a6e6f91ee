"""Near-duplicate vectors by cosine: an inverted multi-index.

Vectors are cut in halves, each half with a codebook of its own; the two nearest code words name a cell of the product grid. For a vector, the multi-sequence order walks through cells by the sum of both halves' distances, nearest first. How far it walks is calibrated on pairs whose cosine is the threshold itself, the hardest that must be found, until the target recall; cells that nobody is in are passed over.

Cells are packed into shards of bounded size, a large cell into several. A vector is sent, once for each shard, to those shards after its own that hold a cell it visits, and all pairs that meet are verified in double precision; each pair meets at most once. Within a shard links become sums and spanning edges, never rows of pairs. A very large cell is mostly one group of near copies: those within half the threshold's angle of the cell's centre are linked with one another for sure, by the triangle inequality, and so are they all with a vector near enough to the centre; such links are counted, not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.ann import cosine, unit, valid
from siltstone.llm.common import components, discard, fits, materialise, table

NEARLY = 1e-9


class Ball(NamedTuple):
    """The inner members of a very large cell: the cell's centre and their widest angle from it, how many vectors they stand for, the least of their nodes, and how many they are."""

    centre: np.ndarray
    angle: float
    weight: int
    least: int
    size: int


class Books(NamedTuple):
    """A codebook for each half of vectors of `width` components (shorter ones filled up with zeros), and how far beyond its nearest cell a vector's walk goes."""

    width: int
    halves: tuple[np.ndarray, np.ndarray]
    reach: float

    def beyond(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half from its code words, over that of the nearest."""
        out, at = [], 0
        for words in self.halves:
            half = x[:, at : at + words.shape[1]]
            d = (words * words).sum(axis=1) - 2 * half @ words.T
            out.append(d - d.min(axis=1, keepdims=True))
            at += words.shape[1]
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.beyond(x)
        return one.argmin(axis=1) * len(self.halves[1]) + two.argmin(axis=1)

    def walk(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector, the cells that its multi-sequence walk visits: those whose two distances add up to no more than the reach."""
        one, two = self.beyond(x)
        order = two.argsort(axis=1)
        for a, b, nth in zip(one, np.take_along_axis(two, order, axis=1), order, strict=True):
            rows = np.flatnonzero(a <= self.reach)
            length = np.searchsorted(b, self.reach - a[rows], side="right")
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            yield np.repeat(rows, length) * len(b) + nth[step]


def matrix(vectors, width: int) -> np.ndarray:
    """Unit vectors of any lengths, filled up with zeros or cut to `width`."""
    out = np.zeros((len(vectors), width))
    by = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    for n, rows in by.items():
        out[rows, : min(n, width)] = unit([vectors[i] for i in rows])[:, :width]
    return out


def _codebook(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), words, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((c * c).sum(axis=1) - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums, n = np.zeros_like(c), np.bincount(nearest, minlength=words)
        np.add.at(sums, nearest, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, n: int, least: float, recall: float) -> Books:
    """Codebooks of about the square root of n words (512 at most, and half as many as the sample has vectors), fitted on the sample x, and the reach that finds the share `recall` of pairs whose cosine is `least`: of sample vectors turned in random directions, and of those of the sample's own pairs from `least` to half way to 1."""
    rng, width = np.random.default_rng(12), x.shape[1]
    words = max(1, min(512, len(x) // 2, 2 ** round(math.log2(max(1.0, math.sqrt(n))))))
    cut = width // 2
    books = Books(width, (_codebook(x[:, :cut], words, rng), _codebook(x[:, cut:], words, rng)), 0.0)
    probe = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
    turn = rng.standard_normal(probe.shape)
    turn -= (turn * probe).sum(axis=1, keepdims=True) * probe
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
    sets = [(probe, least * probe + math.sqrt(max(0.0, 1 - least * least)) * turn)]
    u, v = np.nonzero((s := probe @ x.T) >= least)
    own = s[u, v] <= (1 + least) / 2
    if own.sum() >= 20:
        sets.append((probe[u[own]][:20_000], x[v[own]][:20_000]))
    reach = 0.0
    for a, b in sets:
        (one, two), cell = books.beyond(a), books.cells(b)
        at = np.arange(len(a))
        reach = max(reach, float(np.quantile(one[at, cell // words] + two[at, cell % words], recall)))
    return books._replace(reach=reach + NEARLY)


class Links:
    """Links among vectors that meet in one task: sums of the weights linked with each, and groups."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray):
        self.nodes, self.weights = nodes, weights
        self.found, self.root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))

    def add(self, rows: np.ndarray, linked: np.ndarray, columns: np.ndarray) -> None:
        """linked[i, j]: rows[i] and columns[j] are linked, which is told once for each pair."""
        self.found[rows] += linked @ self.weights[columns]
        self.found[columns] += linked.T @ self.weights[rows]
        for i in np.flatnonzero(linked.any(axis=1)):
            roots = np.unique(np.append(self.root[columns[linked[i]]], self.root[rows[i]]))
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]

    def rows(self) -> pd.DataFrame:
        some = np.flatnonzero(self.found)
        least = np.full(len(self.nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.nodes)
        return pd.DataFrame({"node": self.nodes[some], "links": self.found[some], "root": least[self.root[some]]})


def verified(a: np.ndarray, b: np.ndarray, raw_a: list, raw_b: list, least: float) -> np.ndarray:
    """Which of a and b have a cosine of `least` or more; where rounding could decide, the cosine of the vectors as they are."""
    s = a @ b.T
    linked = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < NEARLY), strict=True):
        linked[i, j] = cosine(raw_a[i], raw_b[j]) >= least
    return linked


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample: int = 20_000, recall: float = 0.999, block: int = 4096, balls: int = 10_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding): how many other rows have a cosine of `least` or more with it, the least id that links reach, and whether that is its own.

    Rows with a null or zero vector, or null or non-finite components, link with nothing; nor do rows with a null id, which keep a null component_id and are kept. Vectors of unlike lengths don't link. Equal vectors are one node that stands for all of them; repeated rows link with one another as any equal vectors do. No rows: no rows. Other columns are ignored. The codebooks are fitted on a sample of `sample` vectors at most; every vector is in the index. `balls` bounds the very large cells that have a centre; larger cells beyond that number are split and compared.
    """
    node = F.monotonically_increasing_id().alias("node")
    distinct = valid(vectors).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    distinct = materialise(distinct.select(node, "rep", "m", "embedding", F.size("embedding").alias("dim")), "vectors")
    n, width = distinct.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(2, width)
    some = distinct.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()
    books = fit(matrix(some["embedding"].tolist(), width), n, least, recall)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                yield part.assign(cell=books.cells(matrix(part["embedding"].tolist(), width)).astype(np.int32))

    kind = distinct.schema["embedding"].dataType.simpleString()
    coded = distinct.select("node", "m", "dim", "embedding").mapInPandas(code, f"node long, m long, dim int, embedding {kind}, cell int")
    coded = materialise(coded, "coded")
    counts = coded.groupBy("cell").count().toPandas()  # as many rows as the grid has cells, at most
    held = np.zeros(len(books.halves[0]) * len(books.halves[1]), dtype=np.int64)
    held[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    hot = _balls(coded, held, width, least, block, balls)
    first, outer, inner = _shards(held, hot, block)
    half, full = math.acos(least) / 2, math.acos(least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000].reset_index(drop=True)
                x = matrix(part["embedding"].tolist(), width)
                shard, visits, sure, ball = [], [], [], []
                for i, (seen, own, key, dim) in enumerate(zip(books.walk(x), part["cell"], part["node"] * 2654435761 % 4294967296, part["dim"], strict=True)):
                    inside = own in hot and dim == width and _angle(x[i], hot[own].centre) <= half - NEARLY
                    here = int(first[own] + (outer[own] + key % inner[own] if inside else key % outer[own]))
                    seen = seen[(held[seen] > 0) & (first[seen] + outer[seen] + inner[seen] - 1 > here)]
                    plain = seen[inner[seen] == 0]
                    goes = [first[plain]] if len(plain) else []
                    certain = []
                    for c in np.append(plain[outer[plain] > 1], seen[inner[seen] > 0]):
                        goes.append(np.arange(first[c], first[c] + outer[c]))
                        if inner[c] and dim == width and not (inside and c == own):
                            angle = _angle(x[i], hot[c].centre)
                            if angle + hot[c].angle <= full - NEARLY:
                                certain.append(int(c))
                            elif angle - hot[c].angle <= full + NEARLY:
                                goes.append(np.arange(first[c] + outer[c], first[c] + outer[c] + inner[c]))
                    goes = np.unique(np.concatenate(goes)) if goes else np.zeros(0, dtype=np.int64)
                    shard.append(here)
                    visits.append(goes[goes > here])
                    sure.append(certain)
                    ball.append(int(own) if inside else -1)
                yield part.assign(shard=shard, visits=visits, sure=sure, ball=np.array(ball, dtype=np.int32))[["node", "m", "dim", "embedding", "shard", "visits", "sure", "ball"]]

    placed = coded.mapInPandas(place, f"node long, m long, dim int, embedding {kind}, shard long, visits array<long>, sure array<int>, ball int")
    placed = materialise(placed, "placed")
    met = materialise(_meetings(placed, least, block, kind), "met")
    links, edges = met.select("node", "links"), met.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if hot:
        ball = distinct.sparkSession.createDataFrame([(int(c), b.weight, b.least) for c, b in hot.items()], "_ball int, weight long, least long")
        near = placed.select("node", "m", F.explode("sure").alias("ball")).join(F.broadcast(ball), F.col("ball") == F.col("_ball"))
        more = materialise(ball.join(near.groupBy("ball").agg(F.sum("m").alias("more")), F.col("ball") == F.col("_ball"), "left").select("_ball", "weight", "least", F.coalesce("more", F.lit(0)).alias("more")), "balls")
        within = placed.join(F.broadcast(more), F.col("ball") == F.col("_ball"))
        links = links.unionByName(near.select("node", F.col("weight").alias("links"))).unionByName(within.select("node", (F.col("weight") - F.col("m") + F.col("more")).alias("links")))
        edges = edges.unionByName(near.select(F.col("node").alias("u"), F.col("least").alias("v"))).unionByName(within.select(F.col("node").alias("u"), F.col("least").alias("v")))
    links = links.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    out = materialise(_result(vectors, distinct, links, components(edges)), "near_duplicates")
    discard(distinct, coded, placed, met)
    return out


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    return math.acos(max(-1.0, min(1.0, float(a @ b))))


def _balls(coded: DataFrame, held: np.ndarray, width: int, least: float, block: int, most: int) -> dict[int, Ball]:
    """The balls of the largest cells of more than `block` vectors, `most` at most, by cell. Vectors of one length only make a ball."""
    large = [int(c) for c in np.argsort(-held, kind="stable")[:most] if held[c] > block]
    if not large:
        return {}
    spark = coded.sparkSession
    wanted = spark.createDataFrame([(c,) for c in large], "_cell int")
    rows = coded.where(F.col("dim") == width).join(F.broadcast(wanted), F.col("cell") == F.col("_cell"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sums = rows.select("cell", norm.alias("norm"), F.posexplode("embedding").alias("at", "x")).groupBy("cell", "at").agg(F.avg(F.col("x") / F.col("norm")).alias("x"))
    centre = {}
    for r in sums.where(F.col("x").isNotNull() & ~F.isnan("x")).collect():  # width rows for each large cell
        centre.setdefault(r["cell"], np.zeros(width))[r["at"]] = r["x"]
    centre = {c: v / s for c, v in centre.items() if (s := np.linalg.norm(v)) > 1e-6}
    half = math.acos(least) / 2

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["embedding"].tolist(), width)
            angle = np.array([_angle(v, centre[c]) if c in centre else 9.0 for v, c in zip(x, b["cell"], strict=True)])
            yield b.assign(angle=angle)[angle <= half - NEARLY][["cell", "node", "m", "angle"]]

    inside = rows.select("cell", "node", "m", "embedding").mapInPandas(inner, "cell int, node long, m long, angle double")
    stats = inside.groupBy("cell").agg(F.max("angle").alias("angle"), F.sum("m").alias("weight"), F.min("node").alias("least"), F.count("*").alias("n")).collect()
    return {r["cell"]: Ball(centre[r["cell"]], r["angle"], r["weight"], r["least"], r["n"]) for r in stats}


def _shards(held: np.ndarray, hot: dict[int, Ball], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell its first shard, how many shards its members outside the ball are dealt to, and how many follow for those inside. Small cells share a shard, in order."""
    first, outer, inner = (np.zeros(len(held), dtype=np.int64) for _ in range(3))
    shard, filled = 0, 0
    for c in np.flatnonzero(held):
        if held[c] <= block:
            if filled + held[c] > block:
                shard, filled = shard + 1, 0
            first[c], outer[c], filled = shard, 1, filled + held[c]
        else:
            within = hot[c].size if c in hot else 0
            first[c], outer[c], inner[c] = shard + 1, max(1, -(-(held[c] - within) // block)), -(-within // block)
            shard, filled = first[c] + outer[c] + inner[c], 0
    return first, outer, inner


def _meetings(placed: DataFrame, least: float, block: int, kind: str) -> DataFrame:
    """(node, links, root): what each node gains in each shard that it is in or visits. A shard with many visitors takes them in slices, each with a copy of its members."""
    visits = placed.select(F.explode("visits").alias("shard"), *(F.col(c).alias(c) for c in ("dim", "node", "m", "embedding")))
    crowd = placed.select(F.explode("visits").alias("_shard")).groupBy("_shard").count().where(F.col("count") > 4 * block)
    crowd = materialise(crowd.select("_shard", F.ceil(F.col("count") / (4 * block)).cast("int").alias("slices")), "crowd")
    many = F.broadcast(crowd) if fits(crowd, 1_000_000) else crowd
    slices = F.coalesce("slices", F.lit(1))
    members = placed.select("shard", "dim", "node", "m", "embedding", "ball").join(many, F.col("shard") == F.col("_shard"), "left")
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_shard", "slices")
    visits = visits.join(many, F.col("shard") == F.col("_shard"), "left").withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int")).drop("_shard", "slices")

    def meet(own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        links = Links(np.concatenate([own["node"], guests["node"]]).astype(np.int64), np.concatenate([own["m"], guests["m"]]).astype(np.int64))
        raw, n = own["embedding"].tolist(), len(own)
        x, columns = unit(raw), np.arange(n)
        if own["slice"].iloc[0] == 0 and own["ball"].iloc[0] < 0:
            for at in range(0, n, 512):
                rows = columns[at : at + 512]
                linked = verified(x[rows], x[at:], raw[at : at + 512], raw[at:], least)
                links.add(rows, linked & (columns[None, at:] > rows[:, None]), columns[at:])
        for at in range(0, len(guests), 512):
            asked = guests["embedding"].iloc[at : at + 512].tolist()
            links.add(n + at + np.arange(len(asked)), verified(unit(asked), x, asked, raw, least), columns)
        return links.rows()

    keys = ["dim", "shard", "slice"]
    return members.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(meet, "node long, links long, root long")


def _result(vectors: DataFrame, distinct: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("_vector"))
    least = groups.join(distinct.select(F.col("node").alias("_n"), "rep"), F.col("node") == F.col("_n")).groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("least"))
    named = groups.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_g"), "least")
    nodes = distinct.join(links, F.col("node") == F.col("_n"), "left").join(named, F.col("node") == F.col("_g"), "left")
    nodes = nodes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("linked"), F.coalesce("least", "rep").alias("group"))
    out = rows.join(nodes, F.col("_vector") == F.col("embedding"), "left")
    out = out.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE given AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fit AS (SELECT vec_id, e FROM given WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS root FROM fit UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.v),
roots AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
sums AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(vec_id = coalesce(root, vec_id), true) AS kept FROM given LEFT JOIN roots ON v = vec_id LEFT JOIN sums ON u = vec_id
"""
