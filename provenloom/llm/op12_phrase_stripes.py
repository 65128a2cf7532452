"""Collocations: phrases whose words keep company, counted by stripes.

A prefix of two words keys an associative counter of the words after it: its stripe. Each task gathers the stripes of a
slice of texts, and stripes of one prefix are merged elementwise where they meet. The end of a piece counts as a word after,
so one structure gives all that is asked: a stripe's total is the prefix's own count, its entries are the extensions, and
its greatest entry is the longer phrase that may subsume the prefix. The stripe of the empty prefix counts the words.

Stripes are dealt by the hash of language and prefix, those of the empty prefix by the hash of the counted word, into
PARTS parts for each shuffle partition; a slice sends one row of text for each part. Only one part is unpacked at a time,
so no frequent word and no language lies on one task. What is frequent enough goes on as rows, and the counts of a
phrase's pieces are joined to it. The first TOP of each language are chosen within SALTS groups of it, fewer each time.

Defined cases: null text is empty; null lang is ``und`` and counts with a language so named; repeated rows count each; an
empty table gives no rows; ties of score and count go by the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small, table

LEAST, TOP, SHARE = 10, 2000, 50  # a phrase's least count; ranks of a language; per cent of a phrase's count that subsume it
SLICE_BYTES = 8_000_000  # of text, or one longer text
PARTS, SALTS = 8, (64, 4, 1)
END = b"\xff"  # no byte of UTF-8
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(0xFF if b in SEPARATORS else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def stripes(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, count of each word, first and second word of each prefix, where its stripe ends, its words after, their counts).

    Word 0 is the end of a piece. Prefixes are in order; a prefix whose second word is the end isn't one and is left out.
    """
    flat = b"".join(t.encode("utf-8", "surrogatepass").translate(FOLD) + END for t in texts)
    tokens = flat.replace(END, b" \xff ").split()  # FOLD leaves no white space but spaces
    numbers = Numbers({END: 0})
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    del tokens, flat
    words, ids = list(numbers), np.append(ids, [0, 0])
    counts = np.bincount(ids, minlength=len(words))
    at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0))
    pairs, where = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)
    triples, n = np.unique(where * len(words) + ids[at + 2], return_counts=True)
    ends = np.searchsorted(triples, (np.arange(len(pairs)) + 1) * len(words))
    return words, counts, pairs // len(words), pairs % len(words), ends, triples % len(words), n


def packed(lang: str, texts: list[str], parts: int) -> Iterator[tuple[int, bytes]]:
    """The stripes of texts as (part, text): a line for each prefix of two words, then the words after it with their counts."""
    words, counts, first, second, ends, after, n = stripes(texts)
    code = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    seed = np.uint64(zlib.crc32(lang.encode()))

    def dealt(key: np.ndarray) -> np.ndarray:
        key = (key + seed) * np.uint64(0x9E3779B97F4A7C15)
        return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)

    to = dealt(code[first] * np.uint64(31) + code[second] * np.uint64(0x85EBCA6B))
    alone = dealt(code)
    alone[0] = -1
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    tails = [w + b" %d" % c for w, c in zip(map(words.__getitem__, after.tolist()), n.tolist(), strict=True)]
    order, lone = np.argsort(to, kind="stable"), np.argsort(alone, kind="stable")
    cuts, lone_cuts = np.searchsorted(to[order], np.arange(parts + 1)), np.searchsorted(alone[lone], np.arange(parts + 1))
    for part in range(parts):
        mine = order[cuts[part] : cuts[part + 1]]
        ones = lone[lone_cuts[part] : lone_cuts[part + 1]].tolist()
        lines = [b"%b %d" % (words[k], counts[k]) for k in ones]
        columns = (first[mine].tolist(), second[mine].tolist(), starts[mine].tolist(), ends[mine].tolist())
        lines += [b" ".join((words[a], words[b], *tails[s:e])) for a, b, s, e in zip(*columns, strict=True)]
        if lines:
            yield part, b"\n".join(lines)


def gather(parts: int):
    """mapInArrow from (lang, text) to (part, lang, stripes)."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("stripes", pa.binary())])

    def send(lang: str, texts: list[str]) -> pa.RecordBatch:
        rows = list(packed(lang, texts, parts))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([lang] * len(rows)), pa.array([b for _, b in rows], pa.binary())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
            for i, (lang, length) in enumerate(zip(batch["lang"].to_pylist(), lengths, strict=True)):
                if not length:
                    continue
                held.setdefault(lang, []).append(batch["text"][i].as_py())
                size[lang] = size.get(lang, 0) + length
                while sum(size.values()) >= SLICE_BYTES:
                    most = max(size, key=size.get)
                    yield send(most, held.pop(most))
                    del size[most]
        for lang, texts in held.items():
            yield send(lang, texts)

    return work


ROW = "lang string, w1 string, w2 string, w3 string, a long, two long, longer long"


def frequent(least: int):
    """mapInArrow from sorted (part, lang, stripes) to the words, pairs and triples that occur at least so often.

    two: a triple's count of its first two words. longer: the count of a pair's greatest extension, if frequent too.
    A row without words has the number of all words counted in the part.
    """
    names = [c.split()[0] for c in ROW.split(", ")]
    schema = pa.schema([(c, pa.string()) for c in names[:4]] + [(c, pa.int64()) for c in names[4:]])

    def merged(part: dict[str, list[bytes]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for lang, blobs in part.items():
            alone: dict[bytes, int] = {}
            table: dict[tuple[bytes, bytes], dict[bytes, int]] = {}
            for blob in blobs:
                for line in blob.split(b"\n"):
                    cells = line.split(b" ")
                    if len(cells) == 2:
                        alone[cells[0]] = alone.get(cells[0], 0) + int(cells[1])
                        continue
                    stripe = table.setdefault((cells[0], cells[1]), {})
                    for w, n in zip(cells[2::2], cells[3::2], strict=True):
                        stripe[w] = stripe.get(w, 0) + int(n)
            rows.append((lang, None, None, None, sum(alone.values()), None, None))
            rows += [(lang, w.decode("utf-8", "surrogatepass"), None, None, n, None, None) for w, n in alone.items() if n >= least]
            for prefix, stripe in table.items():
                a = sum(stripe.values())
                if a < least:
                    continue
                one, two = (w.decode("utf-8", "surrogatepass") for w in prefix)
                stripe.pop(END, None)
                often = {w: n for w, n in stripe.items() if n >= least}
                rows.append((lang, one, two, None, a, None, max(often.values(), default=None)))
                rows += [(lang, one, two, w.decode("utf-8", "surrogatepass"), n, a, None) for w, n in often.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, {}
        for batch in batches:
            for k, lang, blob in zip(*(batch[c].to_pylist() for c in ("part", "lang", "stripes")), strict=True):
                if k != at and part:
                    yield merged(part)
                    part = {}
                at = k
                part.setdefault(lang, []).append(blob)
        if part:
            yield merged(part)

    return work


def collocations(texts: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, longer) of all phrases of two and three words of texts (lang, text).

    longer is the greatest count of a longer phrase around it (null: none); score is that of the lowest cut, in millionths.
    All phrases are there, also those that a longer one subsumes: they have 100 * longer >= share * a and subsumed true.
    """
    spark = texts.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * shuffles
    known = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sent = known.mapInArrow(gather(parts), "part int, lang string, stripes binary")
    counted = materialise(sent.repartition(shuffles, "part").sortWithinPartitions("part").mapInArrow(frequent(least), ROW), "phrase-counts")

    totals = counted.where("w1 is null").groupBy("lang").agg(F.sum("a").alias("n"))
    words = counted.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias("w"), F.col("a").alias("f"))
    pairs = counted.where("w2 is not null and w3 is null")
    triples = counted.where("w3 is not null")
    before = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))

    two = pairs.join(before, ["lang", "w1", "w2"], "left").select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "a", F.greatest("longer", "before").alias("longer"))
    last = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
    three = triples.join(last, ["lang", "w2", "w3"]).select("lang", "w1", "w2", "w3", "a", "two", "tail")
    both = two.withColumns({"two": F.lit(None).cast("long"), "tail": F.lit(None).cast("long")}).unionByName(three.withColumn("longer", F.lit(None).cast("long")))
    both = both.withColumn("end", F.coalesce("w3", "w2"))
    both = both.join(words.select("lang", F.col("w").alias("w1"), F.col("f").alias("head")), ["lang", "w1"])
    both = both.join(words.select("lang", F.col("w").alias("end"), F.col("f").alias("foot")), ["lang", "end"]).join(small(totals, totals.count()), "lang")

    def cut(left: str, right: str) -> F.Column:
        exact = f"1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))"
        return F.struct(F.expr(exact).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    one, other = cut("head", "rest"), cut("two", "foot")
    both = both.withColumn("rest", F.coalesce("tail", "foot")).withColumns({"one": one, "other": F.when(F.col("w3").isNotNull(), other)})
    best = F.when(F.col("other.score") < F.col("one.score"), F.col("other")).otherwise(F.col("one"))
    both = both.withColumn("best", best)
    subsumed = F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False))
    return both.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.when(F.col("w3").isNull(), 2).otherwise(3).alias("words"), "a", "best.l", "best.r", "n", "best.score", "longer", subsumed.alias("subsumed"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language by score and count, ties by the phrase's bytes: rank from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    return found


def op12_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language, those inside a longer one of half their count left out."""
    found = collocations(table(spark, sf_dir, "documents")).where(~F.col("subsumed"))
    return ranked(found).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, piece, row_number() OVER () AS id FROM pieces),
words AS (
  SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT lang, id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM numbered)),
next AS (SELECT lang, w, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM next
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (
  SELECT lang, k, phrase, a, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3
  FROM f WHERE k > 1 AND a >= 10),
longer AS (
  SELECT lang, phrase, max(b) AS b FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a AS b FROM cand WHERE k = 3
    UNION ALL SELECT lang, w2 || ' ' || w3, a FROM cand WHERE k = 3) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w1 AS head, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM cand
  UNION ALL SELECT lang, phrase, a, 2, w1 || ' ' || w2, w3 FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM best b JOIN n USING (lang) LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.b IS NULL OR 100 * o.b < 50 * b.a
QUALIFY rank <= 2000
"""
