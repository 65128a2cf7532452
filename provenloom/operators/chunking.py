"""Pages into blocks and blocks into chunks of bounded length that keep page marks and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vocab import CONTINUED, PAGE_MARKER

CHUNK_CHARS, OVERLAP, MAX_CHUNKS = 14_000, 800, 12


def split_long(c: Column, limit: int) -> Column:
    """A text as pieces of at most so many characters: paragraphs packed greedily, longer paragraphs cut at the limit."""
    paragraphs = F.split(c, "\n\n")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > limit, cut(p)).otherwise(F.array(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        fits = a["open"].isNotNull() & (F.length(a["open"]) + 2 + F.length(p) <= limit)
        done = F.when(a["open"].isNull() | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat_ws("\n\n", a["open"], p)).otherwise(p).alias("open"))

    packed = F.aggregate(pieces, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(packed)


def page_blocks(pages: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, page_no, block_no, block) of pages that aren't blank."""
    x = pages.where(strip(F.col("text")) != "")
    return x.select("doc_id", "page_no", F.posexplode(split_long(F.col("text"), limit)).alias("block_no", "block"))


def overlap_tail(block: Column, overlap: int) -> Column:
    """What the next chunk repeats of a block: its page mark and its end, from a sentence on where one starts early."""
    header, body = F.substring_index(block, "\n", 1), F.substring(block, F.instr(block, "\n") + 1, F.length(block))
    tail = F.right(body, F.lit(overlap))
    at = F.instr(tail, ". ") - 1
    tail = F.when((at >= 0) & (at < overlap // 2), F.substring(tail, at + 3, F.length(tail))).otherwise(tail)
    return F.when(F.lit(overlap <= 0), "").when(F.length(body) <= overlap, block).otherwise(F.concat_ws("\n", header, F.lit(CONTINUED), tail))


def chunks(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, chunk_no, text, pages, dropped): a fold over each document's blocks, since overflow resets the length."""
    overlap = min(overlap, chunk_chars // 4)
    mark = F.concat(F.lit(PAGE_MARKER.split("{}")[0]), F.col("page_no").cast("string"), F.lit(PAGE_MARKER.split("{}")[1] + "\n"), F.col("block"))
    blocks = page_blocks(pages, chunk_chars).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "block_no", mark.alias("b")))).alias("blocks"))
    kind = "struct<done:array<struct<parts:array<string>,pages:array<int>>>,parts:array<string>,pages:array<int>,size:int>"
    start = F.from_json(F.lit('{"done":[],"parts":[],"pages":[],"size":0}'), kind)
    wrap = lambda parts, pages: F.array(F.struct(parts.alias("parts"), pages.alias("pages")))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["parts"]) > 0) & (a["size"] + F.length(x["b"]) > chunk_chars)
        tail = overlap_tail(F.element_at(a["parts"], -1), overlap)
        kept = F.when(full, F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>"))).otherwise(a["parts"])
        on = F.when(full, F.when(tail != "", F.slice(a["pages"], -1, 1)).otherwise(F.array().cast("array<int>"))).otherwise(a["pages"])
        size = F.when(full, F.length(tail)).otherwise(a["size"])
        return F.struct(
            F.when(full, F.concat(a["done"], wrap(a["parts"], a["pages"]))).otherwise(a["done"]).alias("done"),
            F.concat(kept, F.array(x["b"])).alias("parts"), F.concat(on, F.array(x["page_no"].cast("int"))).alias("pages"), (size + F.length(x["b"])).cast("int").alias("size"),
        )

    folded = F.aggregate("blocks", start, step, lambda a: F.concat(a["done"], wrap(a["parts"], a["pages"])))
    x = blocks.withColumn("all", folded).withColumn("dropped", F.greatest(F.size("all") - max_chunks, F.lit(0)))
    x = x.select("doc_id", "dropped", F.posexplode("all").alias("chunk_no", "c")).where(F.col("chunk_no") < max_chunks)
    return x.select("doc_id", "chunk_no", F.array_join("c.parts", "\n\n").alias("text"), F.array_sort(F.array_distinct("c.pages")).alias("pages"), "dropped")
