"""What the operators of this package share: materialised steps, bounded broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few longs each) up to which a side of a join may be sent to every executor; beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of a batch of texts on its way to Python; a batch is held several times over, by the JVM and by the worker.
ARROW_BYTES = 8_000_000

_own: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what setCheckpointDir set; an own one only in local mode."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="provenloom-")
    return _own[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


@contextmanager
def arrow_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Within it, texts go to Python in batches of at most so many bytes (one row at least); the session's own setting returns after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*steps: DataFrame) -> None:
    """Deletes the files of materialised steps that nothing reads any more."""
    for step in steps:
        if path := _written.pop(step, None):
            delete(step.sparkSession, path)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does once the driver has collected what named them."""
    gc.collect()
    time.sleep(0.5)  # until the driver's JVM has heard of it
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else left to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as distinct (a, b) of longs, a <> b; component is its least node.

    Each round maps every node to the least node beside it and contracts the edges, so that a star ends in one round
    and a chain halves; the mappings are then composed. Nodes without edges don't appear. No group is collected.
    """
    maps, left, written = [], edges.select("a", "b"), []
    while True:
        left = materialise(left, "cc-edges")
        discard(*written)
        written = [left]
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        to = materialise(to, "cc-map")
        maps.append(to)
        ends = left.join(to.select("a", F.col("m").alias("ma")), "a").join(to.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
        left = ends.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = maps[-1]
    for to in maps[-2::-1]:
        out = to.join(out.select(F.col("a").alias("m"), F.col("m").alias("n")), "m", "left").select("a", F.coalesce("n", "m").alias("m"))
    found = materialise(out.select(F.col("a").alias("node"), F.col("m").alias("component")), "cc")
    discard(*maps, *written)
    return found
