"""Approximate nearest neighbours by NN-descent and greedy graph search, by largest inner product.

Equal vectors are one node of the graph, that of their least vec_id; what a search finds is spread to their least vec_ids.

Building: every vector starts with neighbours from TREES random orders (signs of random projections, then one more
projection), each cut into blocks that are compared whole. Then each round joins neighbours with their neighbours: a
vector's lists of DEGREE nearest and up to REVERSE vectors that hold it are brought together, all pairs in them are
compared, and what beats the worst of a vector's list (or equals it and has a smaller vec_id) enters it. Rounds end when few lists change. Vectors travel in
single precision, divided by the largest component of all, so that vectors of any length keep their digits; lists are of
fixed length, so groups are bounded whatever the data.

Searching: a query enters the graph at its own node and spreads greedily: in each hop the best unopened of its nearest
BEAM are opened through a join with the graph, and scored in double precision on the original vectors, until its nearest
are all opened. The index holds every vector; recall against brute force is tested to be 0.9 or more.

Defined cases: vectors that are null, all zero, or hold null, NaN or infinite components, and vectors of another length than
the most frequent one, take no part; equal scores go by the smaller vec_id; rows of equal vec_id count as the one with
the least hash; null vec_ids take no part; fewer candidates than k give all that are met (all, up to a block's size); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

DEGREE, REVERSE = 24, 20
TREES, SIGNS, BLOCK = 4, 8, 128
ROUNDS, STILL = 5, 0.01
BEAM, OPENED, HOLDERS = 480, 96, 64
SALTS = 16
ASKED_BYTES = 64_000_000  # of queries' vectors that go to all tasks


def usable(rows: DataFrame) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    x = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    x = x.where(sound).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    x = materialise(x, "ann-vectors")
    lengths = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return x.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def representatives(vectors: DataFrame) -> DataFrame:
    """(id, v) of distinct vectors, by the least id of each."""
    return vectors.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def least_members(vectors: DataFrame, n: int) -> DataFrame:
    """(at, ids) for each distinct vector: its least id and its n least ids, ascending."""
    part = Window.partitionBy("v", "salt").orderBy("id")
    x = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    x = x.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n)  # no key brings more than n * SALTS on
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rank") <= n)
    return x.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("at"), "ids")


def unpacked(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges (src, dst, score) of each src, each dst once."""
    once = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("score").alias("score"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def start(packed: DataFrame, dim: int) -> DataFrame:
    """Edges (src, dst, score) within the blocks of random orders."""
    planes = np.random.default_rng(7).standard_normal((TREES, SIGNS + 1, dim)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(1), dim)
            for t in range(TREES):
                p = x @ planes[t].T
                code = (p[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int32)), pa.array(p[:, SIGNS].astype(np.float32)), b.column(0), b.column(1)], ["tree", "code", "along", "id", "q"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def blocks(t: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
            for i in range(0, t.num_rows, size):
                part = t.slice(i, size)
                part = part.sort_by("id")
                ids, x = part["id"].to_numpy(), unpacked(part["q"].combine_chunks(), dim)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(DEGREE, len(ids) - 1)
                if k > 0:
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["src", "dst", "score"])

        for b in batches:
            rest.append(b)
            if sum(x.num_rows for x in rest) >= 16 * BLOCK:
                t = pa.Table.from_batches(rest)
                whole = t.num_rows // BLOCK * BLOCK
                yield from blocks(t.slice(0, whole), BLOCK)
                rest = t.slice(whole).to_batches()
        if rest:
            yield from blocks(pa.Table.from_batches(rest), BLOCK)

    placed = packed.mapInArrow(place, "tree int, code int, along float, id long, q binary")
    ordered = placed.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along", "id")
    return ordered.select("id", "q").mapInArrow(compare, "src long, dst long, score float")


def round_(graph: DataFrame, packed: DataFrame, dim: int) -> DataFrame:
    """Edges found by comparing all pairs within each vector's neighbours and holders."""
    back = graph.select(F.col("dst").alias("at"), F.col("src").alias("id"), "score")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= REVERSE)
    lists = graph.select(F.col("src").alias("at"), F.col("dst").alias("id")).unionByName(back.select("at", "id")).distinct()
    last = graph.groupBy("src").agg(F.max_by(F.struct("score", "dst"), F.struct(-F.col("score"), "dst")).alias("w"), F.count("*").alias("n")).where(F.col("n") >= DEGREE)
    last = last.select(F.col("src").alias("id"), F.col("w.score").cast("float").alias("worst"), F.col("w.dst").alias("last"))
    entry = F.struct("id", "q", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"), F.coalesce("last", F.lit(-1)).alias("last"))
    met = lists.join(packed.join(last, "id", "left"), "id").groupBy("at").agg(F.collect_list(entry).alias("l"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = DEGREE + REVERSE
        for b in batches:
            for i in range(0, b.num_rows, 512):
                col = b.column(0).slice(i, 512)
                n, flat = np.array([len(x) for x in col]), col.flatten()
                row, at = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])
                x, ids, worst = np.zeros((len(n), width, dim), np.float32), np.full((len(n), width), -1, np.int64), np.full((len(n), width), np.inf, np.float32)
                last, there = np.full((len(n), width), -1, np.int64), np.zeros((len(n), width), bool)
                x[row, at], ids[row, at], worst[row, at] = unpacked(flat.field("q"), dim), flat.field("id").to_numpy(), flat.field("worst").to_numpy()
                last[row, at], there[row, at] = flat.field("last").to_numpy(), True
                s = np.matmul(x, x.transpose(0, 2, 1))
                pairs = there[:, :, None] & there[:, None, :] & ~np.eye(width, dtype=bool)
                g, a, c = np.nonzero(pairs & ((s > worst[:, :, None]) | (s == worst[:, :, None]) & (ids[:, None, :] < last[:, :, None])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[g, a]), pa.array(ids[g, c]), pa.array(s[g, a, c])], ["src", "dst", "score"])

    found = met.select("l").mapInArrow(compare, "src long, dst long, score float")
    return found.groupBy("src", "dst").agg(F.max("score").alias("score"))


def build(vectors: DataFrame) -> DataFrame:
    """The neighbour graph (src, dst, score) of vectors (id, v), DEGREE neighbours each; of equal vectors the least id is in it."""
    vectors = materialise(representatives(vectors), "ann-nodes")
    first = vectors.select(F.size("v")).first()
    if first is None:
        return vectors.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).cast("float").alias("score"))
    dim, scale = first[0], vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            q = (x / scale).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "q"])

    packed = materialise(vectors.select("id", "v").mapInArrow(pack, "id long, q binary"), "ann-packed")
    graph = materialise(best(start(packed, dim), DEGREE).select("src", "dst", "score"), "ann-graph")
    size, kept = graph.count(), graph
    for _ in range(ROUNDS):
        found = round_(graph, packed, dim)
        both = graph.withColumn("old", F.lit(1)).unionByName(found.withColumn("old", F.lit(0)))
        once = both.groupBy("src", "dst").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= DEGREE)
        ranked, before = materialise(ranked.select("src", "dst", "score", "old"), "ann-graph"), kept
        discard(before)
        kept = ranked
        fresh = ranked.where("old = 0").count()
        graph = ranked.drop("old")
        if fresh <= STILL * size:
            break
    return graph.select("src", "dst", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest of each query (id), which is one of the vectors."""
    members, nodes = least_members(vectors, k + 1), materialise(representatives(vectors), "ann-nodes")
    of = queries.join(vectors, "id").join(nodes.withColumnRenamed("id", "node"), "v").select("id", "node")
    of = materialise(of, "ann-queries")
    found = nearest(of.select(F.col("node").alias("id")).distinct(), graph, nodes, k + 1)
    # k members and the query's own place: what the next nodes hold is behind them by score, or by vec_id where scores are equal
    spread = found.join(members, found["id"] == members["at"]).select("query", "score", F.explode("ids").alias("id"))
    spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k + 1)
    hits = spread.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))
    x = of.withColumnRenamed("id", "query_id").join(hits, F.col("node") == F.col("query"))
    x = x.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)).alias("at", "h"))
    return x.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score"))


def scorer(asked: DataFrame, vectors: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from pairs (query, id) to (query, id, score); asked: (query, qv).

    Pairs meet the vectors by id, so that a vector travels once for all queries that ask for it. The queries' own
    vectors go to all tasks if they fit in ASKED_BYTES; else pairs are shuffled once more, with both vectors.
    """
    size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    if size[0] * size[1] * 8 > ASKED_BYTES:
        return lambda pairs: pairs.join(vectors, "id").join(asked, "query").select("query", "id", dot(F.col("qv"), F.col("v")).alias("score"))
    own = asked.orderBy("query").toArrow()
    known, across = own["query"].to_numpy(), np.ascontiguousarray(own["qv"].combine_chunks().flatten().to_numpy().reshape(size).T)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # a list holds all queries at most
                part = b.slice(i, 256)
                ids, lists = part["id"].to_numpy(), part["queries"]
                of = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
                query = lists.flatten().to_numpy()
                v, at, total = part["v"].flatten().to_numpy().reshape(len(ids), -1).T, np.searchsorted(known, query), np.zeros(len(of))
                for x, q in zip(v, across, strict=True):  # in the order of components, as dot() sums
                    total += x[of] * q[at]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[of]), pa.array(total)], ["query", "id", "score"])

    return lambda pairs: pairs.groupBy("id").agg(F.collect_list("query").alias("queries")).join(vectors, "id").select("id", "v", "queries").mapInArrow(score, "query long, id long, score double")


def nearest(queries: DataFrame, graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, score): up to k nearest nodes of each query (id), a node of the graph; the query itself is one of them.

    Only a query's nearest BEAM are kept: what falls behind them stays behind, as they only get nearer, so it needn't be
    known when it is met again.
    """
    # a node that very many hold is left to HOLDERS of them at most, so that no way out of it grows with the table
    back = graph.withColumn("rank", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), "src"))).where(F.col("rank") <= HOLDERS)
    ways = graph.select("src", "dst").unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = materialise(ways.groupBy("src").agg(F.collect_set("dst").alias("to")), "ann-ways")
    asked = materialise(queries.join(vectors, "id").select(F.col("id").alias("query"), F.col("v").alias("qv")), "ann-asked")
    scored = scorer(asked, vectors)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def beam(met: DataFrame) -> DataFrame:
        """The nearest BEAM of each query among met (query, id, score, opened), with those that are opened next."""
        near = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEAM)
        turn = F.count_if(~F.col("opened")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return materialise(near.select("query", "id", "score", "opened", "rank", (~F.col("opened") & (turn <= OPENED)).alias("turn")), "ann-beam")

    own = asked.select("query", F.col("query").alias("id"), dot(F.col("qv"), F.col("qv")).alias("score"), F.lit(True).alias("opened"))
    first = queries.select(F.col("id").alias("src")).distinct().join(ways, "src").select(F.col("src").alias("query"), F.explode("to").alias("id"))
    state = beam(scored(first).withColumn("opened", F.lit(False)).unionByName(own))
    while not (turn := state.where("turn")).isEmpty():
        new = turn.select("query", F.col("id").alias("src")).join(ways, "src").select("query", F.explode("to").alias("id")).where("query <> id").distinct()
        new = new.join(state.select("query", "id"), ["query", "id"], "left_anti")
        marked = state.select("query", "id", "score", (F.col("opened") | F.col("turn")).alias("opened"))
        before, state = state, beam(marked.unionByName(scored(new).withColumn("opened", F.lit(False))))
        discard(before)
    return state.where(F.col("rank") <= k).select("query", "id", "score")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors.where("id % 20 = 0").select("id"), build(vectors), vectors, 20)
