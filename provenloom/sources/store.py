"""A store of results by key as a Spark data source, safe for several writers at once.

Each task writes files of its own, a file for each part (the last PART characters of keys). They count once the driver has
committed: then one manifest that names them all appears under a name of its own, whole or not at all. So writers never
wait for each other, and what a lost or repeated task left is never read. Of a key written twice the entry of the
first manifest counts; an entry that is no JSON is a miss, not a failure. A filter on ``part`` keeps other parts' files closed.

    register(spark)
    results.write.format("results").mode("append").save(path)          # key string, result string
    spark.read.format("results").load(path).where("part = 'a7'")

Defined cases: a path without manifests is an empty store; rows without a key are not written; null results are misses.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

PART = 2


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def names(path: str, folder: str) -> list[str]:
    from pyarrow import fs

    store, root = opened(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)) if f.is_file)


@dataclass
class Part(InputPartition):
    part: str
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class StoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists on part; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("part",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, _ = opened(self.path)
        files: dict[str, list[str]] = {}
        for name in names(self.path, "manifest"):
            with store.open_input_stream(name) as f:
                for part, file in json.loads(f.read()):
                    if self.only is None or part in self.only:
                        files.setdefault(part, []).append(file)
        return [Part(p, f) for p, f in sorted(files.items())]

    def read(self, partition: Part | None) -> Iterator[tuple[str, str, str]]:
        if partition is None:  # no parts at all
            return
        store, root = opened(self.path)
        seen: set[str] = set()
        for file in partition.files:
            with store.open_input_stream(f"{root}/data/{file}") as f:
                left = b""
                while chunk := f.read(1 << 20):
                    *lines, left = (left + chunk).split(b"\n")
                    for line in lines:
                        entry = loaded(line)
                        if entry and entry[0] not in seen:
                            seen.add(entry[0])
                            yield (*entry, partition.part)


def loaded(line: bytes) -> tuple[str, str] | None:
    """The key and result of a line, None where either isn't whole."""
    try:
        key, result = json.loads(line)
        json.loads(result)
    except (ValueError, TypeError):
        return None
    return (key, result) if isinstance(key, str) else None


class StoreWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.at = path, (schema.names.index("key"), schema.names.index("result"))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        streams, files = {}, []
        try:
            for row in iterator:
                key, result = row[self.at[0]], row[self.at[1]]
                if key is None or result is None:
                    continue
                part = key[-PART:]
                if part not in streams:
                    file = f"part={part}/{uuid.uuid4().hex}.jsonl"
                    store.create_dir(f"{root}/data/part={part}", recursive=True)
                    streams[part] = store.open_output_stream(f"{root}/data/{file}")
                    files.append((part, file))
                streams[part].write(json.dumps([key, result], ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n")
        finally:
            for s in streams.values():
                s.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/manifest", recursive=True)
        store.create_dir(f"{root}/pending", recursive=True)
        with store.open_output_stream(f"{root}/pending/{name}") as f:
            f.write(json.dumps(files).encode())
        store.move(f"{root}/pending/{name}", f"{root}/manifest/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for _, file in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/data/{file}")


class ResultStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return "key string, result string, part string"

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("a store of results is only added to: use mode append")
        return StoreWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes the format ``results`` known, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultStore)
