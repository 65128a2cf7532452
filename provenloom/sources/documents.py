"""Sources and sinks: files admitted by size and kind, pages with running limits, and a store of results by content."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.text import result_key, strip

VERSION = "v1"
RANGE = 1000  # pages that one window of a running sum covers
MAX_BYTES, MAX_PAGES, MAX_CHARS, OCR_MIN_CHARS, OCR_DPI, MAX_PIXELS = 25 * 1024 * 1024, 400, 1_500_000, 120, 220, 40_000_000


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under path within the size limit; the filter on length is pushed down, so larger ones are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)


def admission_error(path: Column, content: Column) -> Column:
    """Null for a PDF, else what is wrong with the file."""
    head = F.regexp_replace(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^\s+", "")
    return F.when(F.length(content) == 0, "unsupported_file_type").when(~F.lower(path).endswith(".pdf"), "unsupported_file_type").when(~F.startswith(head, F.lit("%PDF-")), "pdf_parse_error")


def text_pages(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, page_no, text, source) of texts cut at a separator; pages count from 1."""
    x = docs.select("doc_id", F.posexplode(F.split("text", separator, -1)).alias("p", "text"))
    return x.select("doc_id", (F.col("p") + 1).alias("page_no"), "text", F.when(strip(F.col("text")) != "", "text_layer").otherwise("empty").alias("source"))


def choose_ocr(text: Column, ocr: Column) -> Column:
    """Recognised text replaces a thin text layer where it is longer."""
    return F.when((F.length(text) < OCR_MIN_CHARS) & (F.length(ocr) > F.length(text)), ocr).otherwise(text)


def safe_scale(width: Column, height: Column, dpi: int = OCR_DPI, most: int = MAX_PIXELS) -> Column:
    """Rendering scale for a page, lowered where the picture would have too many pixels."""
    scale = F.lit(dpi / 72.0)
    pixels = width * scale * height * scale
    return F.when(pixels > most, scale * F.sqrt(most / pixels)).otherwise(scale)


def running(rows: DataFrame, by: str, order: str, size: Column, step: int = RANGE) -> DataFrame:
    """rows with total, the running sum of size within by, in two levels: ranges of ``order`` first, then the sums of the ranges.

    No window holds more than the rows of one range, or one row for each range, so one group may have any number of rows.
    Null sizes count as 0; rows of one place are summed at once.
    """
    x = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).withColumn("_range", F.floor(F.col(order) / step))
    sums = x.groupBy(by, "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    x = x.withColumn("_within", F.sum("_size").over(Window.partitionBy(by, "_range").orderBy(order)))
    x = x.join(sums, x[by].eqNullSafe(sums["_by"]) & x["_range"].eqNullSafe(sums["_at"]))
    return x.withColumn("total", F.col("_before") + F.col("_within")).select(*rows.columns, "total")


def limits(pages: DataFrame, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, pages, chars, first_over, error): the first page past the budget of characters, and the document's error."""
    x = running(pages.select("doc_id", "page_no", F.length("text").alias("n")), "doc_id", "page_no", F.col("n"))
    x = x.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"), F.min(F.when(F.col("total") > max_chars, F.col("page_no"))).alias("first_over"))
    error = F.when(F.col("pages") > max_pages, "document_too_long").when(F.col("first_over").isNotNull(), "document_too_long").when(F.col("chars") == 0, "empty_document")
    return x.withColumn("error", error)


def listing(files: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, size_kb, title) of the PDFs among files (path, length); titles (name, title) name those that have one, others go by their stem."""
    name = F.regexp_extract("path", r"([^/\\\\]*)$", 1)
    x = files.where(F.lower("path").endswith(".pdf")).select(name.alias("name"), F.round(F.col("length") / 1024).cast("long").alias("size_kb"))
    return x.join(titles.select("name", "title"), "name", "left").withColumn("title", F.coalesce("title", F.regexp_replace("name", r"\.[^.]*$", "")))


def requested(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(request, name, path, error) for names asked for from outside: only the last part of a name counts, so none leads out of the folder."""
    x = asked.select("request", F.regexp_extract("request", r"([^/\\\\]*)$", 1).alias("name"))
    there = files.where(F.lower("path").endswith(".pdf")).select(F.regexp_extract("path", r"([^/\\\\]*)$", 1).alias("name"), "path")
    return x.join(there, "name", "left").select("request", "name", "path", F.when(F.col("path").isNull(), "not_found").alias("error"))


def document_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, source_summary, ocr_pages)."""
    sources = F.collect_set(F.when(F.col("source") != "empty", F.col("source")))
    x = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), sources.alias("s"), F.array_sort(F.collect_list(F.when(F.col("source") == "ocr", F.col("page_no")))).alias("ocr_pages"))
    return x.withColumn("source_summary", F.when(F.size("s") == 0, "empty").when(F.size("s") == 1, F.element_at("s", 1)).otherwise("mixed")).drop("s")


def keyed(docs: DataFrame, provider: Column, model: Column) -> DataFrame:
    """docs with the hash of their content and the key under which results are stored."""
    x = docs.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    return x.withColumn("key", result_key(VERSION, provider, model, F.col("sha256")))


def plan_work(docs: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored result, misses once for each content): corrupt results count as misses."""
    good = store.where(F.try_parse_json("result").isNotNull()).select("key", "result").dropDuplicates(["key"])
    return docs.join(good, "key"), docs.join(good, "key", "left_anti").dropDuplicates(["key"])


def put(results: DataFrame, path: str) -> None:
    """Appends results (key, result) whose key isn't stored yet, once each, by the end of their keys.

    Spark's commit makes each write whole or absent, and a repeated write adds nothing. One writer at a time.
    """
    spark = results.sparkSession
    new = results.select("key", "result").dropDuplicates(["key"])
    try:
        there = spark.read.schema("key string, result string, part string").parquet(path).where(F.try_parse_json("result").isNotNull())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = new.join(there.select("key"), "key", "left_anti")
    new.withColumn("part", F.substring("key", -2, 2)).write.mode("append").partitionBy("part").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where all run on this machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="settled-")
    return root.rstrip("/")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt over as many tasks as a shuffle has, twice the cores at least: for small files that hold much work.

    Spark makes tasks by bytes, so that one of few MB may have hours of work; the number given here is not coalesced.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows as the side of a join that grows with the input: the join is shuffled, whatever size Spark takes the rows to have.

    It guesses by the bytes of files, and texts that repeat take a twentieth in a file of what they take in memory: tables
    of hundreds of MB would go through the driver.
    """
    return rows.hint("merge")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share, and read back: what follows reads it instead of working it out again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
