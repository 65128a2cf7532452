"""Periodic runs against all periods tried by hand, and the query against the contract read literally."""

import hashlib
import random
import re
import zlib

import pytest

from provenloom.llm import op11_periodic_runs as op11


def tried(words, least=6, power=4):
    """Every run by trying each period from each word."""
    found = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            run = words[start : start + length]
            if length >= max(least, power * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (5, 3), (10, 2), (1, 2)])
def test_runs_equal_all_periods_tried(bounds):
    r = random.Random(sum(bounds))
    for _ in range(400):
        n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
        words = [b"%d" % r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert op11.text_runs(words, *bounds) == tried(words, *bounds)


def test_long_texts_are_whole():
    assert op11.text_runs([b"a", b"b"] * 40_000) == [(0, 80_000, 2)]
    assert op11.text_runs([b"a"] * 80_000) == [(0, 80_000, 1)]
    assert op11.text_runs([b"%d" % (i % 5001) for i in range(50_000)]) == [(0, 50_000, 5001)]
    assert op11.text_runs([b"%d" % i for i in range(50_000)]) == []


def test_find_runs_keeps_columns_and_edge_rows(spark):
    texts = [None, "", " \t\n", "one", "x " * 9, "x " * 9, "a b c " * 5 + "a d", "café\u00a0z " * 6]
    df = spark.createDataFrame([(i, t, "clash", [i]) for i, t in enumerate(texts)], "doc_id long, text string, runs string, extra array<long>")
    got = {r["doc_id"]: r for r in op11.find_runs(df).collect()}
    assert [[tuple(x) for x in got[i]["runs"]] for i in range(8)] == [[], [], [], [], [(0, 9, 1)], [(0, 9, 1)], [(0, 16, 3)], [(0, 6, 1)]]
    assert [got[i]["collapsed"] for i in range(8)] == ["", "", "", "one", "x", "x", "a b c d", "café\u00a0z"]
    assert got[3]["extra"] == [3] and got[0]["text"] is None
    assert op11.find_runs(df.limit(0)).count() == 0


def test_query_follows_the_contract(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 90)))) for i in range(300)]
    rows += [(i, None) for i in range(300, 330)] + [(i, "x y " * 900) for i in range(330, 350)] + [rows[0], (None, "k " * 12)]
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in op11.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = tried(words)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        listed = "".join("%d,%d,%d\n" % x for x in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = (*top, top[1] * 1000 // top[2]) if top else (None,) * 4
        want.append((doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
