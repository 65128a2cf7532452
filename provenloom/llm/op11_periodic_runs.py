"""Periodic runs of words, found by Kruskal's method over descending LCPs.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST_WORDS, LEAST_POWER * q) words that
neither neighbour extends keeping period q. Two positions i < j = i + q whose suffixes share exactly LCP words make the
stretch of i .. j + LCP, of period q, which its right neighbour can't extend. So the suffixes are sorted and the pairs of
neighbours in that order are united from the greatest LCP down by union-find. Each class keeps its positions in order;
where two classes meet, the positions that become neighbours are looked at once: at a distance within LCP they are the
seed of a run, which counts if the word before doesn't extend it. A nearer position of the class would be a smaller
period, so what is found has its smallest period, and every run is found, at the level of its own LCP.

Only words that can lie in a run are sorted: in a run that is long enough, each word but the last four begins five words
(for other bounds: as many as ``text_runs`` works out) that recur one period before or after. Stretches of such words are
cut out until nothing more falls away, which leaves nothing of most texts; no run crosses a cut. Documents are rows of
their own: nothing is shuffled, and a task holds one slice of rows (SLICE_BYTES of text, or one longer text) at a time.

Defined cases: null and blank texts have no words, no runs and collapse to ''; repeated rows each have a row; an empty
table gives none; ties are by start, then period; other columns are kept by ``find_runs`` (its own, ``runs`` and
``collapsed``, replace columns so named) and ignored by the query. In the query a null doc_id hashes as ''.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEAST_WORDS, LEAST_POWER = 6, 4
SLICE_BYTES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"

Run = tuple[int, int, int]  # start, length, period


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of small numbers in order, by doubling the length that they are ranked by."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.zeros(n, np.int64)
        steps[1:] = np.cumsum(np.diff(key[order]) != 0)
        rank[order] = steps
        if steps[-1] == n - 1 or step >= n:
            return order
        step *= 2


def shared_lengths(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in order, how many words it shares with the one before it (the first: 0), in time linear in them."""
    word, n = ids.tolist(), len(ids)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared, h = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        shared[i] = h
        h = h - 1 if h else 0
    return np.array(shared, np.int64)[order]


def met(low: list[int], high: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Two ordered position sets united, and the pairs of positions, one of each, that become neighbours."""
    small, large = (low, high) if len(low) <= len(high) else (high, low)
    pairs, last, end = [], -1, len(large)
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and (large[at - 1] > last):
            pairs.append((large[at - 1], x))
        if at < end and (k + 1 == len(small) or large[at] < small[k + 1]):
            pairs.append((x, large[at]))
        last = x
    if len(small) * 8 < end:
        for x in small:
            insort(large, x)
    else:
        large.extend(small)
        large.sort()
    return large, pairs


def runs_of(ids: np.ndarray, least: int, power: int, shared: int) -> list[Run]:
    """All runs of a sequence of numbers, by start and period. Pairs that share fewer words than shared make no run."""
    n = len(ids)
    order = suffix_order(ids)
    lcp = shared_lengths(ids, order)
    parent = list(range(n))
    places = [[p] for p in order.tolist()]
    word, found = ids.tolist(), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    edges = np.flatnonzero(lcp >= shared)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for k, level in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(k - 1), root(k)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        parent[b] = a
        places[a], pairs = met(places[b], places[a])
        places[b] = []
        for i, j in pairs:
            q = j - i
            if q + level >= max(least, power * q) and (i == 0 or word[i - 1] != word[j - 1]):
                found.append((i, q + level, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, shared: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches outside of which no word lies in a run. Keys may collide, which only keeps more."""
    todo = [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        if end - start <= shared:
            continue
        part = ids[start:end].astype(np.uint64)
        key = np.zeros(len(part) - shared + 1, np.uint64)
        for k in range(shared):
            key = key * np.uint64(0x9E3779B97F4A7C15) + part[k : len(part) - shared + 1 + k]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key) + 2, np.int8)
        again[order[1:][same] + 1] = 1
        again[order[:-1][same] + 1] = 1
        if again[1:-1].all():
            yield start, end
            continue
        edge = np.flatnonzero(np.diff(again))
        todo += [(start + a, start + b + shared - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def text_runs(words: list[bytes], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[Run]:
    """All runs of a list of words. power is 2 at least: below it a stretch has no repetition to speak of."""
    shared = min(max(least - q, (power - 1) * q) - q + 1 for q in range(1, least + 1))
    ids = np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))
    found = []
    for start, end in stretches(ids, shared):
        found += [(start + s, length, q) for s, length, q in runs_of(ids[start:end], least, power, shared)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that any run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """df with runs, an array of (start, length, period) of its text by start and period, and collapsed, the text without repeats."""
    if power < 2 or least < 1:
        raise ValueError("power must be 2 at least and least 1")
    kept = [f for f in df.schema.fields if f.name not in ("runs", "collapsed")]
    schema = T.StructType([*kept, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(column), 0).to_pylist()])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_BYTES, "right")) - 1)
                runs, short = [], []
                for t in column.slice(start, end - start).to_pylist():
                    words = (t or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space, as bytes do
                    found = text_runs(words, least, power)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    short.append(collapsed(words, found).decode("utf-8", "surrogatepass"))
                part = batch.slice(start, end - start)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, struct), pa.array(short, pa.string())], names=schema.names)
                start = end

    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields]).mapInArrow(work, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text of the contract: every tenth document, by the hash of its id, is made periodic from one of its words on."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))))

    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of all runs and of the text without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs)
    top = F.reduce(
        "runs",
        F.lit(None).cast(RUNS.elementType.simpleString()),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.concat_ws("\n", lines), F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", "runs", "collapsed", top.alias("top"), listed.alias("listed")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
