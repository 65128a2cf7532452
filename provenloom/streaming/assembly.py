"""Answers of a stream gathered by document: complete when all chunks are there, or given up when time is out.

State for each document is which chunks answered and which failed and why, never their facts, so that it is as small as the
document has chunks. Of repeated answers to a chunk one counts: any answer over any error, else the least by its error.
A document leaves with one row once its last chunk is there; one that waits longer than ``patience`` behind the watermark
leaves with what it has. What comes after that finds a closed document and counts as late, in a row of its own.

Spark keeps the state of groups of documents, since each call of Python costs some milliseconds whatever its rows; each document
in it has its own time to leave, and a group is woken when the first of these has come.

Equal to ``records.failures`` over the same answers, whatever their order. A restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MISSING = "no_answer"
NO_ID = "none"
#: Groups that documents are dealt to by hash: so many calls of Python at most in a batch, however many documents it has.
GROUPS = 4096
OUT = "doc_id long, state string, chunks long, answered long, warnings array<string>, error string"


def summed_up(doc: str, state: str, total: int, chunks: dict[str, list]) -> tuple:
    """The row of a document from its chunks' [label, error]; chunks without a word count as failed."""
    failed = [(int(k), label, error) for k, (label, error) in chunks.items() if error is not None]
    failed += [(k, "", MISSING) for k in range(total) if str(k) not in chunks]
    failed.sort()
    said = [f"Фрагмент {k + 1} (страницы {label}) не разобран: {error}" for k, label, error in failed]
    answered = total - len(failed)
    error = f"Не удалось разобрать ни один фрагмент документа. {failed[0][2]}" if failed and not answered else None
    return doc, state, total, answered, said, error


def framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return out.assign(doc_id=pd.array([None if d == NO_ID else int(d) for d in out["doc_id"]], "Int64"))


def assembled(answers: DataFrame, time: str, delay: str = "10 minutes", patience: timedelta = timedelta(hours=1), groups: int = GROUPS) -> DataFrame:
    """answers (doc_id, chunk_no, n_chunks, pages_label, error, time) of a stream as one row for each document, and one for late ones."""
    wait = int(patience.total_seconds() * 1000) + 1

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each document: whether it is closed, its number of chunks, its chunks, when it leaves
        docs: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        now, newest, late = state.getCurrentWatermarkMs(), {}, {}
        for part in parts:
            for doc, chunk, n, label, error, at in zip(*(part[c].tolist() for c in ("doc", "chunk_no", "n_chunks", "pages_label", "error", "ms")), strict=True):
                newest[doc] = max(newest.get(doc, 0), at)
                here = docs.setdefault(doc, [False, 0, {}, 0])
                if here[0]:
                    late[doc] = late.get(doc, 0) + 1
                    continue
                here[1] = max(here[1], n)
                said = [label, error if isinstance(error, str) else None]
                held = here[2].setdefault(str(chunk), said)
                if held[1] is not None and (said[1] is None or said[1] < held[1]):
                    here[2][str(chunk)] = said
        rows = [(doc, "late", n, 0, [], None) for doc, n in late.items()]
        for doc, at in newest.items():
            closed, total, chunks, _ = docs[doc]
            if not closed and len(chunks) >= total:
                rows.append(summed_up(doc, "complete", total, chunks))
                closed, chunks = True, {}
            docs[doc] = [closed, total, chunks, max(at, now) + wait]
        for doc in [doc for doc, here in docs.items() if here[3] < now and doc not in newest]:
            closed, total, chunks, _ = docs.pop(doc)
            if not closed:
                rows.append(summed_up(doc, "timed_out", total, chunks))
        if docs:
            state.update((json.dumps(docs),))
            state.setTimeoutTimestamp(max(now, min(here[3] for here in docs.values())))
        else:
            state.remove()
        if rows:
            yield framed(rows)

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID))
    x = answers.select(F.pmod(F.xxhash64(doc), F.lit(groups)).alias("part"), doc.alias("doc"), "chunk_no", "n_chunks", "pages_label", "error", F.unix_millis(time).alias("ms"), time).withWatermark(time, delay)
    return x.groupBy("part").applyInPandasWithState(work, OUT, "docs string", "append", GroupStateTimeout.EventTimeTimeout)


def finished(rows: DataFrame) -> DataFrame:
    """What a batch makes of the documents that left the stream: (doc_id, chunks, answered, warnings, error), late rows aside."""
    return rows.where(F.col("state") != "late").select("doc_id", "chunks", "answered", "warnings", "error")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder (a Parquet file or a folder of such) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{name}") if store.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
