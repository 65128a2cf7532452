"""Archives written, read back and merged, against plain dictionaries and sorted lists."""

import base64
import gzip
import hashlib
import io
import random

import duckdb
import pytest

from provenloom.llm import op13_warc as op13


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want(rows, least=0):
    """page_id, bytes, digest, type, refers_to of rows (page_id, url, html), by the contract read literally."""
    out = []
    for page, _, html in rows:
        size = len((html or "").encode())
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        revisit = size >= least and page != first
        out.append((page, size, sha(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://www.B.example/x?q=1#f", "<p>a</p>"),
    (1, "https://b.example:81/", "<p>a</p>"),
    (2, None, None),
    (5, "", ""),
    (None, "http://a.example", "<p>a</p>"),
    (None, "//c.example/\n \x7f", "only here"),
    (7, "no url", "é\r\n\r\nx" * 2000),
    (7, "no url", "é\r\n\r\nx" * 2000),
    (8, "http://user@d.example/WARC/1.1\r\n", "\x00\x1f\x8b"),
    (-4, "http://é.example/", "<p>a</p>"),
]
SCHEMA = "page_id long, url string, html string, position string"


def run(spark, tmp_path, df, fan=128, **limits):
    out = f"file://{tmp_path}/w"
    manifest = op13.write(df, out, **limits)
    return manifest, op13.histories(op13.index(manifest, out), fan)


@pytest.mark.parametrize(("least", "archive"), [(0, 256_000_000), (1, 1), (9, 900)])
def test_pages_come_back_from_archives(spark, tmp_path, monkeypatch, least, archive):
    monkeypatch.setattr(op13, "ARCHIVE_BYTES", archive)
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    manifest, found = run(spark, tmp_path, df, least=least)
    got = found.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want(ROWS, least)
    assert sorted(r["position"] for r in got) == list(range(len(ROWS)))
    assert manifest.count() == (len(ROWS) if archive == 1 else manifest.select("file").distinct().count())
    text = b"".join(gzip.open(f"{tmp_path}/w/{r['file']}").read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type: revisit") == sum(r["record_type"] == "revisit" for r in got)


def test_runs_merge_in_order_whatever_the_fan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13, "RANGE_ROWS", 20)
    monkeypatch.setattr(op13, "ARCHIVE_BYTES", 3000)
    r = random.Random(4)
    rows = [(i, r.choice(["http://hot.example/", f"http://h{r.randrange(9)}.example/{r.randrange(3)}"]), f"<p>{r.randrange(60)}</p>") for i in r.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    _, found = run(spark, tmp_path, df, fan=2)
    got = sorted(found.collect(), key=lambda x: x["position"])
    assert [x["position"] for x in got] == list(range(300))
    assert [(x["url_key"], x["page_id"]) for x in got] == sorted((op13.url_key(u), p) for p, u, _ in rows)
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str) == want(rows)


def test_capture_times_order_a_history(spark, tmp_path):
    rows = [(1, "http://a.example/", "x", 2024), (2, "http://a.example/", "y", 1999), (3, "http://a.example/", "x", 2010)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, y int").selectExpr("*", "make_timestamp(y, 2, 3, 4, 5, 6) AS captured")
    _, found = run(spark, tmp_path, df)
    assert [x["page_id"] for x in sorted(found.collect(), key=lambda x: x["position"])] == [2, 3, 1]


def test_no_pages_no_captures(spark, tmp_path):
    _, found = run(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    assert found.collect() == []


def test_tree_of_losers_equals_sorting():
    r = random.Random(2)
    for k in range(0, 9):
        runs = [[(f"{r.randrange(5)}", r.randrange(3), r.choice([None, 1, 2]), "f", r.randrange(9)) for _ in range(r.randrange(7))] for _ in range(k)]
        runs = [sorted(x, key=op13.key) for x in runs]
        assert list(op13.merged([iter(x) for x in runs])) == sorted(sum(runs, []), key=op13.key)


def test_spoilt_archives_are_refused():
    good = op13.page_record(1, "http://a.example/", 0, b"text" * 99, False, None)
    assert [x[2] for x in op13.captures(io.BytesIO(good).read, "f")] == [1]
    other = op13.page_record(1, "http://a.example/", 0, b"tent" * 99, False, None)
    mixed = gzip.compress(gzip.decompress(good).replace(b"text", b"tent"))
    assert list(op13.captures(io.BytesIO(other).read, "f"))
    for spoilt in (mixed, good[:-9], gzip.compress(b"no record")):
        with pytest.raises(ValueError):
            list(op13.captures(io.BytesIO(spoilt).read, "f"))


def test_sql_says_the_same(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and r[0] >= 0 and r[0] != 7]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op13.op13_warc_merge(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    said = con.execute(op13.ORACLE)
    assert [c[0] for c in said.description] == got.columns
    # the archive keeps control characters of a url escaped
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(r[:5] for r in said.fetchall())
