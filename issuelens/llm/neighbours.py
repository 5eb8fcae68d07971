"""Approximate nearest neighbours by inner product with an adaptive scan of dimensions.

Vectors get one more coordinate that makes all lengths equal, so the largest inner product
is the smallest distance, and are then rotated at random, which spreads the distance evenly
over the dimensions. They lie in lists around centroids, and each piece of a list is stored
as blocks of columns. A query reads its nearest list in full; that gives the distance to
beat. In its other lists a candidate is given up after a block of dimensions as soon as a
test on the partial distance says that the full one is too large. Survivors are scored on
the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.session import materialize

SAMPLE = 20_000
MOST_LISTS = 4_096
PROBED = 0.7
LEAST_PROBED = 16
BLOCK = 8
PIECE = 2_048
EPSILON = 2.5
SEED = 7


class Space:
    """The map of vectors into the searched space, and the centroids there."""

    def __init__(self, width: int, longest: float):
        self.width, self.longest = width, longest
        draw = np.random.Generator(np.random.PCG64(SEED)).standard_normal((width + 1, width + 1))
        q, r = np.linalg.qr(draw)
        self.rotation = q * np.sign(np.diag(r))
        self.centroids = np.zeros((1, width + 1))
        self.sizes = np.zeros(1, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        return np.hstack([scaled, rest[:, None]]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Scaled to length one: the order of inner products of a query does not change."""
        scaled = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)[:, None]
        return np.hstack([scaled, np.zeros((len(x), 1))]) @ self.rotation

    def far(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T

    def fit(self, x: np.ndarray, lists: int, rounds: int = 8) -> None:
        """Lloyd's algorithm on a bounded sample, from evenly spaced rows of it."""
        self.centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
        for _ in range(rounds):
            own = np.concatenate([self.far(x[i : i + 4096]).argmin(1) for i in range(0, len(x), 4096)])
            count = np.bincount(own, minlength=lists)
            total = np.zeros_like(self.centroids)
            np.add.at(total, own, x)
            held = count > 0
            self.centroids[held] = total[held] / count[held, None]

    def probes(self, x: np.ndarray, least: int, parts: float, rows: int) -> list[np.ndarray]:
        """Nearest lists of each query: a share of all, and as many as hold ``rows`` vectors."""
        order = np.argsort(self.far(x), axis=1, kind="stable")
        n = max(least, int(np.ceil(parts * len(self.centroids))))
        enough = (np.cumsum(self.sizes[order], axis=1) < rows).sum(1) + 1
        return [o[: max(n, e)] for o, e in zip(order, enough)]


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows with an id and a finite vector that is not zero, of the usual length.

    The usual length is the most frequent one (the smaller of equals). Of rows that
    repeat an id the one with the smallest vector counts.
    """
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(whole).select(F.col("vec_id").cast("long"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return rows
    rows = rows.where(F.size("v") == sizes[0]["n"])
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """key, v, ids: each different vector with its k + 1 smallest ids.

    Copies tie in every search and ties go to smaller ids, so no other copy can be among
    the k nearest. Spark keeps that many per task already, before the shuffle.
    """
    key = F.xxhash64("v")
    order = Window.partitionBy("key", "v").orderBy("vec_id")
    first = rows.withColumn("key", key).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    return first.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_index(nodes: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> tuple[DataFrame, Space, DataFrame]:
    """Stored pieces of lists, the space, and the number of pieces of each list.

    Centroids are fitted on the ``sample`` vectors with the smallest keys; every vector is
    put into a list. A piece holds about ``PIECE`` vectors whatever the size of its list.
    """
    spark = nodes.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.max(F.size("v")).alias("width")).first()
    space = Space(stats["width"], stats["longest"])
    drawn = _stack([r["v"] for r in nodes.orderBy("key", "v").select("v").limit(sample).collect()])
    lists = lists or max(1, min(MOST_LISTS, len(drawn) // 8, int(stats["n"] ** 0.5)) or 1)
    space.fit(space.rows(drawn), min(lists, len(drawn)))
    sent = spark.sparkContext.broadcast(space)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.far(sent.value.rows(_stack(v))).argmin(1).astype(np.int32))

    placed = materialize(nodes.withColumn("list", nearest("v")), "lists")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row per list
    space.sizes = np.array([sizes.get(i, 0) for i in range(len(space.centroids))], np.int64)
    pieces = spark.createDataFrame([(i, -(-n // PIECE)) for i, n in sizes.items()], "list int, pieces int")
    rows = placed.join(F.broadcast(pieces), "list").withColumn("piece", F.pmod(F.xxhash64("v", "key"), "pieces").cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = _stack(part["v"])
        turned = sent.value.rows(x).astype(np.float32)
        blocks = [np.ascontiguousarray(turned[:, i : i + BLOCK].T).tobytes() for i in range(0, turned.shape[1], BLOCK)]
        firsts = [int(ids[0]) for ids in part["ids"]]
        return pd.DataFrame(
            {"list": [part["list"].iloc[0]], "piece": [part["piece"].iloc[0]], "nodes": [firsts], "blocks": [blocks], "originals": [x.tobytes()]}
        )

    packed = rows.groupBy("list", "piece").applyInPandas(
        pack, "list int, piece int, nodes array<long>, blocks array<binary>, originals binary"
    )
    return materialize(packed, "pieces"), space, pieces


def _scan(q: np.ndarray, original: np.ndarray, beat: np.ndarray, piece, width: int, k: int):
    """(query, node, score) of the k best candidates of a piece for each query.

    ``beat`` is the squared distance a candidate has to stay below, or infinite.
    """
    nodes = np.asarray(piece["nodes"], np.int64)
    x = np.frombuffer(piece["originals"], np.float64).reshape(len(nodes), -1)
    blocks = [np.frombuffer(b, np.float32).reshape(-1, len(nodes)) for b in piece["blocks"]]
    out = []
    for at in range(0, len(q), 256):
        part, limit = q[at : at + 256], beat[at : at + 256]
        seen = 0
        i = j = partial = None
        for block in blocks:
            own = part[:, seen : seen + len(block)].astype(np.float32)
            if i is None:
                full = (own**2).sum(1)[:, None] + (block**2).sum(0)[None] - 2 * own @ block
                seen += len(block)
                alive = full <= _bound(limit, seen, width)[:, None]
                i, j = np.nonzero(alive)
                partial = full[i, j].astype(np.float64)
            else:
                partial = partial + ((own[i] - block[:, j].T) ** 2).sum(1)
                seen += len(block)
                keep = partial <= _bound(limit, seen, width)[i]
                i, j, partial = i[keep], j[keep], partial[keep]
        score = np.concatenate([(original[at + i[s : s + 65536]] * x[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((nodes[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((at + i[keep], nodes[j[keep]], score[keep]))
    return [np.concatenate(c) for c in zip(*out)]


def _bound(limit: np.ndarray, seen: int, width: int) -> np.ndarray:
    """A partial distance above it would, at the test's level, mean a full one above the limit."""
    if seen >= width:
        return limit * (1 + 1e-5) + 1e-6
    return limit * (seen / width) * (1 + EPSILON / np.sqrt(seen)) ** 2 + 1e-6


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, probed: float = PROBED, lists: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    Score is the inner product of the original vectors in double precision; ties go to
    the smaller vec_id. Null ids, and vectors that are null, zero, of unusual length or
    hold null or non-finite parts, take no part. Fewer candidates than k are all returned;
    no usable vector gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    nodes = materialize(distinct_vectors(rows, k), "nodes")
    index, space, pieces = build_index(nodes, lists)
    sent = spark.sparkContext.broadcast(space)
    width = space.width + 1
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("key", F.xxhash64("v"))
    queries = materialize(asked.groupBy("key", "v").agg(F.min("vec_id").alias("query")), "queries")

    @F.pandas_udf("array<int>")
    def lists_of(v: pd.Series) -> pd.Series:
        space = sent.value
        return pd.Series([p.astype(np.int32) for p in space.probes(space.queries(_stack(v)), LEAST_PROBED, probed, k + 1)])

    probes = materialize(queries.select("query", "v", lists_of("v").alias("lists")), "probes")

    def scan(wanted: DataFrame, name: str) -> DataFrame:
        """Partial results of (query, v, beat, list) rows, by piece and block of queries."""
        asking = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("turns"))
        asking = asking.join(F.broadcast(pieces), "list")  # a row per list
        left = wanted.join(F.broadcast(asking), "list").withColumn("turn", F.pmod(F.xxhash64("query"), "turns").cast("int"))
        left = left.select("query", "v", "beat", "list", "turn", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
        right = index.join(F.broadcast(asking.select("list", "turns")), "list")
        right = right.select("list", "piece", "nodes", "blocks", "originals", F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"))

        def search(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(held):
                return pd.DataFrame({"query": [], "node": [], "score": []})
            x = _stack(asks["v"])
            i, node, score = _scan(sent.value.queries(x), x, asks["beat"].to_numpy(np.float64), held.iloc[0], width, k + 1)
            return pd.DataFrame({"query": asks["query"].to_numpy()[i], "node": node, "score": score})

        keys = ["list", "piece", "turn"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query long, node long, score double")
        return materialize(found, name)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    near = probes.select("query", "v", F.lit(float("inf")).alias("beat"), F.col("lists")[0].alias("list"))
    first = scan(near, "first")
    # The (k+1)th inner product so far, as a squared distance between unit vectors.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    reached = first.withColumn("at", F.row_number().over(best)).where(F.col("at") == k + 1).select("query", F.col("score").alias("reached"))
    beat = F.coalesce(2 - 2 * F.col("reached") / (norm * space.longest), F.lit(float("inf")))
    rest = probes.join(reached, "query", "left").select("query", "v", beat.alias("beat"), F.explode(F.expr("slice(lists, 2, size(lists))")).alias("list"))
    found = first.unionByName(scan(rest, "rest"))
    top = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    ids = nodes.select(F.col("ids")[0].alias("node"), F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = top.join(ids, "node").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    top = materialize(top.join(queries, "query").select("key", "v", "vec_id", "score"), "top")
    own = asked.select("key", "v", F.col("vec_id").alias("query_id")).join(top, ["key", "v"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
