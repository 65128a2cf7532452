"""The store of results: two writers, spoilt entries, tasks that fail, and parts that stay closed."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from provenloom.sources import documents as sources
from provenloom.sources.store import Part, StoreReader, StoreWriter, register


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "result string, key string")


def put(df, path):
    df.write.format("results").mode("append").save(path)


@pytest.fixture
def store(spark, tmp_path):
    register(spark)
    return f"{tmp_path}/store"


def read(spark, path):
    return {r["key"]: json.loads(r["result"]) for r in spark.read.format("results").load(path).collect()}


def test_what_is_put_comes_back_once(spark, store):
    assert read(spark, store) == {}
    put(results(spark, ('{"a": 1}', "k-a7"), ('{"a": "\\n\u00e9"}', "k-b1"), (None, "k-b2"), ("[]", None)).repartition(3), store)
    put(results(spark, ('{"a": 2}', "k-a7"), ("[3]", "k-a8")), store)
    assert read(spark, store) == {"k-a7": {"a": 1}, "k-b1": {"a": "\n\u00e9"}, "k-a8": [3]}
    with pytest.raises(Exception, match="append"):
        results(spark, ("1", "k")).write.format("results").mode("overwrite").save(store)


def test_spoilt_entries_are_misses(spark, store):
    put(results(spark, ("{}", "k-a7"), ("{", "k-a8"), ("1", "k-a9")).coalesce(1), store)
    (file,) = glob.glob(f"{store}/data/part=a9/*")
    open(file, "w").write('["k-a9", "1')
    assert read(spark, store) == {"k-a7": {}}
    hits, misses = sources.plan_work(spark.createDataFrame([("k-a7",), ("k-a8",), ("k-a9",)], "key string"), spark.read.format("results").load(store))
    assert [r["key"] for r in hits.collect()] == ["k-a7"] and sorted(r["key"] for r in misses.collect()) == ["k-a8", "k-a9"]


def test_what_is_not_committed_is_not_there(spark, store):
    schema = results(spark, ("1", "k")).schema
    one, two = (StoreWriter(store, schema) for _ in range(2))
    first, second = one.write(iter([("1", "k-a1")])), two.write(iter([("2", "k-a1"), ("3", "k-a2")]))
    assert read(spark, store) == {}
    two.commit([second, None])
    assert read(spark, store) == {"k-a1": 2, "k-a2": 3}
    one.abort([first, None])
    assert len(glob.glob(f"{store}/data/*/*")) == 2
    bad = results(spark, ("1", "k-c1"), ("2", "k-c2")).repartition(2).withColumn("result", F.expr("if(key = 'k-c2', raise_error('lost'), result)"))
    with pytest.raises(Exception, match="lost"):
        put(bad, store)
    assert set(read(spark, store)) == {"k-a1", "k-a2"}


def test_a_filter_on_part_opens_its_files_alone(spark, store):
    put(results(spark, *[(str(i), f"k-{i:02d}") for i in range(40)]), store)
    reader = StoreReader(store)
    assert len(reader.partitions()) == 40
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("part",), ("07", "08", "xx")), GreaterThan(("key",), "k")]))
    assert [f.attribute for f in left] == [("key",)] and [p.part for p in reader.partitions()] == ["07", "08"]
    assert list(reader.pushFilters([EqualTo(("part",), "08")])) == [] and reader.partitions() == [Part("08", reader.partitions()[0].files)]
    x = spark.read.format("results").load(store).where("part = '07'")
    assert [(r["key"], r["result"]) for r in x.collect()] == [("k-07", "7")] and x.rdd.getNumPartitions() == 1
