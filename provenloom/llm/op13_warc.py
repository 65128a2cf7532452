"""WARC archives of pages, and capture histories by an external merge of their indexes.

``write`` puts pages into gzip-compressed WARC 1.1 files of bounded size, a record in a member of its own. A payload that
several pages have is stored once, by the page with the least page_id; the others revisit it. Payloads are compared by
length and SHA-1, by grouped minimum, so no group is gathered. ``index`` reads archives from end to end, checks payloads
against their digests, and gives a row for each record; sorted within its task, such rows are a capture run.

``histories`` merges the runs by URL key, capture time and page_id. Splitters from the runs cut the key space into ranges,
a task for each range reads its slice of each run batch by batch (row groups outside the range are skipped) and
merges the slices by a tree of losers. More than FAN runs are first merged in groups of FAN, in coarser ranges, until FAN
are left. A range ends anywhere, also within the history of one URL, so no URL falls on one task. Ranges are in order and
each is in order, so ``position`` numbers all captures globally: by URL, then time.

Files are named at random and reach a reader only through the manifest that Spark commits, so what a lost or repeated task
left is never read.

Defined cases: null html is an empty payload; a null url has the key '-'; a null page_id comes before others in order, has
no part in the choice of a response unless its group has no other, and then all are responses; rows with one page_id
and payload are all of the type that this page_id has; empty tables give no rows; other columns are ignored, but for
``captured`` (timestamp), the time of capture. Without it a page was captured page_id seconds after 1970, modulo 100 years.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import accumulate, pairwise

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small, table

LEAST_BYTES = 0  # payloads from this size on are stored once
ARCHIVE_BYTES = 256_000_000
LEVEL = 4  # of compression
FAN = 128  # runs that one task merges
RANGE_ROWS = 10_000  # a range has about so many captures, more if there would be more ranges than shuffle partitions
SAMPLED = 16  # keys looked at for each splitter
BATCH = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CENTURY = 3_155_760_000

INDEX = "url_key string, captured long, page_id long, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in INDEX.split(", "))])

Key = tuple[str, int, bool, int, str, int]


def url_key(url: str | None) -> str:
    """The key that captures are ordered by: host labels from the right, then the port, then path and query."""
    if not url:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    host, port, path = m.groups()
    return f"{','.join(reversed(host.lower().split('.')))}{port or ''}){path or '/'}"


def moment(seconds: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, captured: int, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", moment(captured)), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{base32(payload)}"))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record("revisit" if revisit else "response", headers, head if revisit else head + payload)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, captured, payload, revisit, refers_to) of pages: who stores a payload and who revisits it."""
    when = F.unix_timestamp("captured") if "captured" in pages.columns else F.lit(None).cast("long")
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce(when, F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CENTURY))).alias("captured"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("sha", "size", "first", F.lit(True).alias("shared")), "warc-equal")
    revisit = F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    joined = rows.join(small(groups, groups.count()), ["sha", "size"], "left").withColumn("revisit", revisit)
    return joined.select("page_id", "url", "captured", "payload", "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, out: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below out; returns the manifest (file, records, bytes)."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(out)
        store.create_dir(folder, recursive=True)
        stream, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "captured", "payload", "revisit", "refers_to")]
            for i in range(batch.num_rows):
                if stream is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = store.open_output_stream(f"{folder}/{name}", compression=None)
                    info = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", moment(0)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size += stream.write(record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))
                data = page_record(*(c[i].as_py() for c in columns))
                stream.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return materialise(planned(pages, least).mapInArrow(archive, "file string, records long, bytes long"), "warc-manifest")


def members(read: Callable[[int], bytes], chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream; one member is in memory at a time."""
    offset, data = 0, read(chunk)
    while data:
        opened, parts, used = zlib.decompressobj(31), [], 0
        while not opened.eof:
            if not data:
                raise ValueError(f"the archive ends within the record at {offset}")
            parts.append(opened.decompress(data))
            used += len(data) - len(opened.unused_data)
            data = opened.unused_data or read(chunk)
        yield offset, used, b"".join(parts)
        offset += used


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    return fields, block


def page_number(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def captures(read: Callable[[int], bytes], file: str) -> Iterator[tuple]:
    """The index rows of one archive, payloads checked."""
    for offset, length, content in members(read):
        fields, block = parsed(content)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"^Content-Length: (\d+)", head, re.M)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base32(payload) != digest):
            raise ValueError(f"the payload at {offset} of {file} differs from its digest")
        seconds = int((datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%S%z") - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds())
        refers = page_number(fields["warc-refers-to"]) if kind == "revisit" else None
        yield url_key(fields.get("warc-target-uri")), seconds, page_number(fields["warc-record-id"]), file, offset, length, size, digest, kind, refers


def tabled(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def index(manifest: DataFrame, out: str) -> DataFrame:
    """Reads the archives that the manifest names, each from end to end in one task, and gives their records' index rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(out)
        for batch in batches:
            for file in batch["file"].to_pylist():
                with store.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    rows = []
                    for row in captures(stream.read, file):
                        rows.append(row)
                        if len(rows) == BATCH:
                            yield tabled(rows)
                            rows = []
                    yield tabled(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(work, INDEX)


def key(row: tuple) -> Key:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Sorted runs as one, by a tree of losers: each inner node keeps the run that lost there, so a row costs one way up."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    runs = runs + [iter(())] * (size - len(runs))
    heads = [next(r, None) for r in runs]
    keys = [(h is None, key(h) if h else ()) for h in heads]

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        won, loser[node] = (a, b) if keys[a] <= keys[b] else (b, a)
        return won

    loser = [0] * size
    winner = play(1)
    while heads[winner] is not None:
        yield heads[winner]
        head = heads[winner] = next(runs[winner], None)
        mine = keys[winner] = (head is None, key(head) if head else ())
        node = (winner + size) >> 1
        while node:
            other = loser[node]
            if keys[other] < mine:
                loser[node], winner, mine = winner, other, keys[other]
            node >>= 1


def rows_between(path: str, low: Key | None, high: Key | None) -> Iterator[tuple]:
    """The rows of a sorted file from low on and before high; row groups that can't hold any are not read."""
    store, name = filesystem(path)
    with store.open_input_file(name) as source:
        held = pq.ParquetFile(source)
        at = held.schema.names.index(COLUMNS[0])
        for g in range(held.num_row_groups):
            stats = held.metadata.row_group(g).column(at).statistics
            if stats is not None and stats.has_min_max:
                if low and stats.max < low[0]:
                    continue
                if high and stats.min > high[0]:
                    return
            for batch in held.iter_batches(BATCH, [g], COLUMNS):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if low and key(row) < low:
                        continue
                    if high and key(row) >= high:
                        return
                    yield row


def merge_pass(spark: SparkSession, groups: list[list[list[str]]], splitters: list[Key]) -> DataFrame:
    """Merges each group of runs (lists of files in order) in ranges: (group, range, at, index row), a file for each group and range."""
    ranges = len(splitters) + 1
    bounds = list(pairwise([None, *splitters, None]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch["id"].to_pylist():
                group, part = divmod(task, ranges)
                low, high = bounds[part]
                at, rows = 0, []

                def sent() -> pa.RecordBatch:
                    n, body = len(rows), tabled(rows)  # noqa: B023
                    places = [pa.array([group] * n), pa.array([part] * n), pa.array(range(at, at + n), pa.int64())]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*places, *body.columns], names=["group", "range", "at", *COLUMNS])

                for row in merged([(row for file in run for row in rows_between(file, low, high)) for run in groups[group]]):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield sent()
                        at, rows = at + BATCH, []
                if rows:
                    yield sent()

    tasks = len(groups) * ranges
    return spark.range(0, tasks, 1, tasks).mapInArrow(work, f"group long, range long, at long, {INDEX}")


def sorted_files(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df written in small row groups, so that slices can be read, and its files with their count of rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 1 << 20).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back, back.groupBy(F.col("_metadata.file_path").alias("path"))


def histories(found: DataFrame, fan: int = FAN) -> DataFrame:
    """Index rows in global order: position counts all captures by URL key, time and page_id. Only paths of files, one for a
    task, and splitters, at most SAMPLED for each shuffle partition, come to the driver."""
    spark = found.sparkSession
    back, files = sorted_files(found.sortWithinPartitions("url_key", "captured", "page_id", "file", "offset"), "warc-run")
    listed = files.agg(F.count("*").alias("n")).orderBy("path").collect()
    runs, total = [[r["path"]] for r in listed], sum(r["n"] for r in listed)
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS)))
    every = max(1, total // (ranges * SAMPLED))
    chosen = back.where(F.pmod(F.xxhash64("file", "offset"), F.lit(every)) == 0).select(*COLUMNS[:5]) if ranges > 1 else back.limit(0).select(*COLUMNS[:5])
    keys = sorted(key(tuple(r)) for r in chosen.collect())
    splitters = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    while True:
        groups = [runs[i : i + fan] for i in range(0, len(runs), fan)] or [[]]
        done, files = sorted_files(merge_pass(spark, groups, splitters[len(groups) - 1 :: len(groups)]), "warc-merged")
        if len(groups) == 1:
            break
        runs = [[] for _ in groups]
        for r in files.agg(F.min("group").alias("group"), F.min("range").alias("range")).orderBy("group", "range").collect():
            runs[r["group"]].append(r["path"])
    sizes = {r["range"]: r["n"] for r in done.groupBy("range").agg(F.count("*").alias("n")).collect()}
    held = sorted(sizes)
    starts = list(zip(held, accumulate([0, *(sizes[k] for k in held[:-1])]), strict=False))
    first = F.broadcast(spark.createDataFrame(starts, "range long, start long"))  # a row for each range
    return done.join(first, "range").select((F.col("start") + F.col("at")).alias("position"), *COLUMNS)


def op13_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the capture that its archive holds, by way of the merged index."""
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "pages"), out)
    found = histories(index(manifest, out))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(:\d+)?([^#]*)', ['host', 'port', 'path']) AS u
  FROM pages),
k AS (
  SELECT *, sha1(html) AS h, '0123456789abcdef' AS hex, CASE WHEN coalesce(url, '') = '' THEN '-'
    WHEN NOT regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN url
    ELSE array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || u.port || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END
    END AS url_key FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (((strpos(hex, substr(h, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos(hex, substr(h, 5 * i // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, page_id % 3155760000, page_id) - 1 AS position
FROM k
"""
