"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

Texts and items are words (runs of letters and digits, lower case) and their five-word shingles; an item's weight for a
shingle is log(1 + items / items that hold it), other shingles have the weight of one that a single item holds.

1. Windows: as long as an item and aligned with it at a shingle that both hold. A window that shares no shingle with any
   item has similarity 0 with all of them, so the windows left out can't match.
2. Each window and item has a 64-bit SimHash fingerprint of its weighted shingles.
3. Multi-index: fingerprints are cut into 8 blocks. Two within RADIUS = 23 bits differ by 2 at most in some block, so items
   list all variants of each block within 2 flips, and windows of the item's length look up their 8 blocks: every pair
   within the radius is met, which one more comparison of all bits confirms. Windows of similarity 0.8 or more lie
   within 23 bits but for one in a million.
4. Candidates are verified by weighted Jaccard similarity of their shingle multisets, 0.8 or more.

A pair keeps its most similar window (the first on ties). Items are few beside documents: their shingles are broadcast
while they count less than BROADCAST_ROWS, else joined by shuffle; the same holds for what the documents' windows need.

Defined cases: null or wordless texts and items match nothing; an item shorter than five words is one shingle and is found
wherever its words follow each other; repeated items match each; repeated rows of a document give its pairs once; rows with a
null doc_id are judged by their texts and reported under a null doc_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small, table

WIDTH = 5
LEAST = 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def words(text: Column) -> Column:
    w = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    first = F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.element_at(w, -1) == "", 1).otherwise(0)
    return F.slice(w, first, F.greatest(F.size(w) - first + 1 - last, F.lit(0)))


def shingled(df: DataFrame, *keep: str, width: int = WIDTH) -> DataFrame:
    """keep, n_words and s (array of hashes of shingles by position, null without words) of the rows of df.

    The words are bound to a lambda variable, so that no rule of the optimiser repeats the split inside the loop.
    """

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.struct(F.size(w).alias("n"), F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).alias("s"))

    x = df.where("text is not null").select(*keep, F.explode(F.transform(F.array(words(F.col("text"))), hashes)).alias("x"))
    return x.select(*keep, F.col("x.n").alias("n_words"), F.col("x.s").alias("s"))


def fingerprints(rows: DataFrame, *by: str) -> DataFrame:
    """The 64-bit SimHash of each group's weighted rows (h, w): bit b is set where the rows with it outweigh those without."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return rows.groupBy(*by).agg(*sums).select(*by, out.alias("fp"))


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def flips() -> list[int]:
    """Masks of up to FLIPS bits of a block."""
    return [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, start, similarity) of docs (doc_id, text) that hold items (item_id, text)."""
    items = shingled(benchmark.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text")), "item", "item_id")
    items = materialise(items.where("n_words > 0"), "decontam-items")
    spread = items.select("item", "item_id", "n_words", F.size("s").alias("m"), F.posexplode("s").alias("at", "h"))
    n_items = max(1, items.count())
    weights = spread.groupBy("h").agg(F.log(1 + n_items / F.countDistinct("item")).alias("w"))
    spread = materialise(spread.join(weights, "h"), "decontam-shingles")
    n = spread.count()
    short = [r[0] for r in items.where(F.col("n_words") < WIDTH).select("n_words").distinct().collect()]  # numbers below WIDTH
    other = F.log(F.lit(1.0 + n_items))

    # 1. windows aligned with an item at a common shingle; rows are known by the hash of id and text, so that a null id is one
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("copy"), "text")
    seen = shingled(keyed, "copy").select("copy", F.posexplode_outer("s").alias("pos", "h")).where("pos is not null")
    aligned = spread.where(F.col("n_words") >= WIDTH).select("h", "at", "m", F.col("n_words").alias("long"))
    hits = seen.join(small(aligned, n), "h")
    windows = materialise(hits.select("copy", (F.col("pos") - F.col("at")).alias("start"), "m", "long").distinct(), "decontam-windows")
    found = windows.select("copy").distinct()
    texts = keyed.join(small(found, windows.count()), "copy", "left_semi").select("copy", "text").dropDuplicates(["copy"])
    held = shingled(texts, "copy").select("copy", "s").join(windows, "copy")
    first = F.greatest("start", F.lit(0))
    inside = F.slice("s", first + 1, F.greatest(F.least(F.col("start") + F.col("m"), F.size("s")) - first, F.lit(0)))
    win = ["copy", "start", "m", "long"]
    rows = held.select(*win, F.explode(inside).alias("h"))
    known = spread.select("h", "w").distinct()
    # items below WIDTH words are one shingle, and so are the windows of their length
    for k in short:
        grams = shingled(keyed, "copy", width=k).select("copy", "n_words", F.posexplode_outer("s").alias("start", "h")).where(F.col("start").isNotNull() & (F.col("n_words") >= k))
        those = spread.where(F.col("n_words") == k).select("h").distinct()
        rows = rows.unionByName(grams.join(small(those, n), "h", "left_semi").select("copy", "start", F.lit(1).alias("m"), F.lit(k).alias("long"), "h").distinct())
    rows = rows.join(small(known, n), "h", "left").select(*win, "h", F.coalesce("w", other).alias("w"))
    rows = materialise(rows.groupBy(*win, "h").agg(F.first("w").alias("w1"), F.count("*").alias("c")).withColumn("w", F.col("w1") * F.col("c")), "decontam-rows")

    # 2. and 3. fingerprints, and pairs within the radius
    prints = fingerprints(rows, *win)
    inner = spread.groupBy("item", "item_id", "m", F.col("n_words").alias("long"), "h").agg(F.first("w").alias("w1"), F.count("*").alias("c")).withColumn("w", F.col("w1") * F.col("c"))
    inner = materialise(inner, "decontam-items")
    marks = fingerprints(inner, "item", "item_id", "long").withColumnRenamed("fp", "mark")
    variants = marks.select("item", "item_id", "long", "mark", F.posexplode(F.array(*[block(F.col("mark"), k) for k in range(BLOCKS)])).alias("k", "value"))
    variants = variants.select("item", "item_id", "long", "mark", "k", F.explode(F.transform(F.array(*map(F.lit, flips())), lambda x: F.col("value").bitwiseXOR(x.cast("long")))).alias("value"))
    looked = prints.select(*win, "fp", F.posexplode(F.array(*[block(F.col("fp"), k) for k in range(BLOCKS)])).alias("k", "value"))
    near = looked.join(small(variants, n_items * BLOCKS * len(flips())), ["long", "k", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("mark"))) <= RADIUS)
    near = materialise(near.select(*win, "item", "item_id").distinct(), "decontam-near")

    # 4. weighted Jaccard of multisets: sum of least over sum of greatest
    sizes = rows.groupBy(*win).agg(F.sum("w").alias("window_w"))
    item_sizes = inner.groupBy("item").agg(F.sum("w").alias("item_w"))
    mine = inner.select("item", "h", F.col("c").alias("item_c"))
    common = near.join(rows, win).join(small(mine, n), ["item", "h"]).groupBy(*win, "item", "item_id").agg(F.sum(F.col("w1") * F.least("c", "item_c")).alias("common"))
    scored = common.join(sizes, win).join(small(item_sizes, n_items), "item")
    scored = scored.select(*win, "item", "item_id", "common", "window_w", "item_w").withColumn("similarity", F.col("common") / (F.col("window_w") + F.col("item_w") - F.col("common"))).where(F.col("similarity") >= least - 1e-9)
    scored = materialise(scored, "decontam-scored")
    n_rows = scored.count()
    ids = keyed.select("copy", "doc_id").join(small(scored.select("copy").distinct(), n_rows), "copy", "left_semi").distinct()
    best = scored.join(ids, "copy").groupBy("doc_id", "item_id").agg(F.max(F.struct(F.round("similarity", 6).alias("similarity"), (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.similarity").alias("similarity"))


def op3_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ds AS (SELECT doc_id, text, k, unnest(range(greatest(len(w) - k + 1, 1))) AS pos, w FROM dw, widths WHERE len(w) > 0 AND (k = 5 OR len(w) >= k)),
dh AS (SELECT doc_id, text, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS h FROM ds),
ish AS (SELECT item_id, text AS item_text, least(len(w), 5) AS k, greatest(len(w) - 4, 1) AS m, unnest(range(greatest(len(w) - 4, 1))) AS apos, w FROM iw WHERE len(w) > 0),
ih AS (SELECT item_id, item_text, k, m, apos, array_to_string(w[apos + 1 : apos + k], ' ') AS h FROM ish),
n AS (SELECT count(*) AS n FROM iw WHERE len(w) > 0),
wt AS (SELECT h, ln(1 + n / count(DISTINCT (item_id, item_text))) AS w FROM ih, n GROUP BY h, n),
win AS (SELECT DISTINCT dh.doc_id, dh.text, pos - apos AS start, m, ih.k, ih.item_id, ih.item_text FROM dh JOIN ih ON dh.h = ih.h AND dh.k = ih.k),
wc AS (SELECT win.doc_id, win.text, win.start, win.item_id, win.item_text, dh.h, count(*) AS c
       FROM win JOIN dh ON win.doc_id IS NOT DISTINCT FROM dh.doc_id AND win.text = dh.text AND win.k = dh.k AND dh.pos >= win.start AND dh.pos < win.start + win.m
       GROUP BY ALL),
ic AS (SELECT item_id, item_text, h, count(*) AS c FROM ih GROUP BY ALL),
iz AS (SELECT item_id, item_text, sum(c * w) AS item_w FROM ic JOIN wt USING (h) GROUP BY ALL),
s AS (SELECT wc.doc_id, wc.item_id, wc.start,
             sum(CASE WHEN ic.c IS NOT NULL THEN wt.w * least(wc.c, ic.c) ELSE 0 END) AS common,
             sum(coalesce(wt.w, ln(1 + n.n)) * wc.c) AS window_w, iz.item_w
      FROM wc JOIN iz ON wc.item_id = iz.item_id AND wc.item_text = iz.item_text, n
      LEFT JOIN wt ON wt.h = wc.h
      LEFT JOIN ic ON ic.h = wc.h AND ic.item_id = wc.item_id AND ic.item_text = wc.item_text
      GROUP BY wc.doc_id, wc.text, wc.item_id, wc.item_text, wc.start, iz.item_w),
r AS (SELECT *, common / (window_w + item_w - common) AS sim FROM s)
SELECT doc_id, item_id, arg_max(start, (round(sim, 6), -start))::BIGINT AS start, max(round(sim, 6)) AS similarity
FROM r WHERE sim >= 0.8 - 1e-9 GROUP BY doc_id, item_id
"""
