"""Line dedup by the spread of lines over sites.

Each distinct line has a HyperLogLog sketch of the sites (sources) that carry it, merged by aggregation. Lines whose
estimate lies well above the threshold are boilerplate, those well below are not; between, sites are counted exactly.
Boilerplate is cut from all documents of all sites; the other lines keep their order and their text.

Lines are compared without white space at their ends, by a 128-bit hash; empty lines never count. Defined cases: null text
stays null with no lines; a null source is a site of its own; repeated rows and doc_ids are rows of their own (a row
number within the scan keeps them apart); a document of boilerplate alone keeps an empty text; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table

SITES = 6
LG_K = 12
#: A sketch of 2**12 bins is off by 1.6 %; near means six times that and one site at least.
NEAR = 0.1


def key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, sites) of the lines (h1, h2, site) that at least so many sites carry."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("site"), F.lit(LG_K))).alias("about"))
    slack = max(1.0, NEAR * sites)
    spread = materialise(spread.where(F.col("about") >= sites - slack), "line-spread")
    sure = spread.where(F.col("about") > sites + slack).select("h1", "h2", F.col("about").cast("long").alias("sites"))
    near = spread.where(F.col("about") <= sites + slack).select("h1", "h2")
    counted = lines.join(small(near, near.count()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    return sure.unionByName(counted.where(F.col("sites") >= sites))


def clean(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row of docs (doc_id, text, source)."""
    rows = docs.select(F.col("doc_id"), "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("site"))
    line = F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))
    cut = rows.select("site", F.explode(F.split("text", "\n", -1)).alias("line")).where(line != "")
    found = materialise(boilerplate(cut.select(*key(line), "site"), sites), "boilerplate")
    n = found.count()
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.select("row", "doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line")).select("row", "doc_id", "pos", "line", *key(line))
    marked = parts.join(small(found.select("h1", "h2", F.lit(True).alias("bad")), n), ["h1", "h2"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("bad").isNull() & F.col("line").isNotNull(), F.struct("pos", "line"))))
    out = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), kept.alias("kept"), F.count("line").alias("n_lines"), F.count("bad").alias("n_removed"))
    text = F.when(F.col("n_lines") > 0, F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))
    return out.select("doc_id", text.alias("text"), "n_lines", "n_removed")


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce('=' || source, '') AS site FROM documents),
l AS (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS t FROM l),
b AS (SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 6),
g AS (SELECT r, count(*)::BIGINT AS n_lines, count(b.t)::BIGINT AS n_removed,
             string_agg(CASE WHEN b.t IS NULL THEN line END, chr(10) ORDER BY pos) AS text
      FROM k LEFT JOIN b ON k.t = b.t GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text,
       coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN g ON d.r = g.r
"""
