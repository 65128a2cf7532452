"""Collocations against counters of plain tuples."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from provenloom.llm import op12_phrase_stripes as op12

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(rows, least, share, top):
    """(lang, rank) -> (phrase, a, l, r, n, score) from counters of whole phrases."""
    f, n, out = defaultdict(Counter), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, c in f.items():
        longer, found = Counter(), []
        for phrase, a in c.items():
            if len(phrase) == 3 and a >= least:
                for part in (phrase[:2], phrase[1:]):
                    longer[part] = max(longer[part], a)
        for phrase, a in c.items():
            if len(phrase) < 2 or a < least or (longer[phrase] and 100 * longer[phrase] >= share * a):
                continue
            score, k = min((10**6 * a * a // (c[phrase[:k]] * c[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), c[phrase[:k]], c[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def made(seed):
    r = random.Random(seed)
    words = ["a", "B", "c", "Été", "d e", "\x00", "\x1c", "\U0001f600x", "word"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows = [(r.choice(["en", "en", "de", None, "und", ""]), t) for t in texts]
    return rows + [(None, None), ("en", ""), ("fr", " ,. \t"), rows[0], rows[0], ("en", "long word " * 40_000)]


@pytest.mark.parametrize(("slice_bytes", "least", "top"), [(8_000_000, 10, 2000), (300, 3, 5)])
def test_collocations_equal_plain_counters(spark, monkeypatch, slice_bytes, least, top):
    monkeypatch.setattr(op12, "SLICE_BYTES", slice_bytes)
    rows = made(least)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "lang string, text string, score string").repartition(3)
    found = op12.collocations(df, least).where("not subsumed")
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in op12.ranked(found, top).collect()}
    assert got == counted(rows, least, op12.SHARE, top) and got


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    huge = 6_000_000_000_000  # counts of a corpus that no test can hold
    rows = [("en", None, None, None, 9 * huge, None, None)]
    rows += [("en", w, None, None, huge + k, None, None) for k, w in enumerate("xyz")]
    rows += [("en", "x", "y", None, huge - 1, None, huge - 3), ("en", "y", "z", None, huge - 2, None, None), ("en", "x", "y", "z", huge - 3, huge - 1, None)]
    monkeypatch.setattr(op12, "materialise", lambda df, name: spark.createDataFrame(rows, op12.ROW))
    got = {r["phrase"]: (r["l"], r["r"], r["score"], r["longer"]) for r in op12.collocations(spark.createDataFrame([], "lang string, text string")).collect()}
    a = huge - 3
    assert got["x y z"] == min((10**6 * a * a // (left * right), k, left, right) for k, (left, right) in enumerate([(huge, huge - 2), (huge - 1, huge + 2)]))[2:] + (min(10**6 * a * a // (huge * (huge - 2)), 10**6 * a * a // ((huge - 1) * (huge + 2))), None)
    assert got["x y"] == (huge, huge + 1, 10**6 * (huge - 1) ** 2 // (huge * (huge + 1)), huge - 3)
    assert got["y z"][3] == huge - 3


def test_no_texts_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert op12.ranked(op12.collocations(none)).count() == 0


def test_sql_says_the_same(tmp_path):
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, text varchar)")
    rows = made(1)
    con.executemany("insert into documents values (?, ?)", rows)
    got = {(r[0], r[1]): tuple(r[2:]) for r in con.execute(op12.ORACLE).fetchall()}
    assert got == counted(rows, 10, 50, 2000)
