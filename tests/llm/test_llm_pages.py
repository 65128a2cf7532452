"""Block rules on pages that lack end tags, articles or long paragraphs, and a reader that stays linear."""

import itertools
import time

import pytest

from provenloom.llm import op5_html_blocks as op5

TEXT = "This is the text of the article and it has words that are in all of the languages. "
LONG = (TEXT * 4).strip()
SHORT = [f"It is the {i} of the day and we are in it." for i in range(12)]


@pytest.mark.parametrize(("page", "want"), [
    (f"<html><head><title>T</title><body><article><p>{LONG}", LONG),
    (f"<body><form action=x><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n\n{LONG}"),
    (f"<body><form action=x><label>Your name</label></form><p>{LONG}</p>", LONG),
    ("<body>" + "".join(f"<p>{s}</p>" for s in SHORT) + "<div class=nav><a href=x>home</a></div>", "\n\n".join(SHORT)),
    ("<nav><a href=x>home</a></nav><article><h1>The day</h1><p>We are in it.</article><footer>(c)</footer>", "The day\n\nWe are in it."),
    (f"<article><p>{LONG}</p><p style='display: none'>{LONG}</p><section class=reader-responses><p>{LONG}</p></section></article>", LONG),
    (f"<div><p>{LONG}</p><b><div><i>x</b></i></div><a b=\"x", f"{LONG}"),
    ("<head><script>if (a<b) { '<p>' }</script><style>p{}</style></head>", ""),
])
def test_pages_as_they_are_written(page, want):
    assert op5.main_text(page).startswith(want) and (want or not op5.main_text(page))


@pytest.mark.parametrize("piece", ["<a ", "<i>", "</b>", '<a b="', "<a b=\">'><", "<", "< >", "<!", "</", "<p></p>", "<b><div><i></b>", "<li><b>", "<table><td>", "&lt", "<script>", "<!--"])
def test_the_reader_is_linear(piece):
    def seconds(n):
        began = time.perf_counter()
        op5.blocks("<div>" + "<i>" * n + piece * n + "</b>" * n)
        return time.perf_counter() - began

    assert seconds(40_000) < max(4.0, 12 * seconds(10_000))


def nearest(labels, headings):
    """The second pass by looking from each block outwards."""
    out = []
    for i, label in enumerate(labels):
        left = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if labels[j] is not None), None)
        right = next(((j - i, labels[j]) for j in range(i + 1, len(labels)) if labels[j] is not None), None)
        if label is None:
            if headings[i] and right:
                label = right[1]
            elif not left or not right:
                label = (left or right or (0, False))[1]
            else:
                label = left[1] or right[1] if left[0] == right[0] else min(left, right)[1]
        out.append(bool(label))
    return out


def test_undecided_blocks_take_the_nearest_label():
    for labels in itertools.product([True, False, None], repeat=6):
        for headings in ([False] * 6, [True, False] * 3):
            assert op5.second_pass(list(labels), headings) == nearest(list(labels), headings)


def test_edge_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (2, None, "<p>" + LONG), (3, "u", "x" * 200_000), (4, "u", "<" * 100_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["n_chars"]) for r in op5.op5_html_blocks(spark, str(tmp_path)).collect())
    assert got[:3] == [(1, 0), (2, 0), (2, len(LONG))] and len(got) == 5
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op5.op5_html_blocks(spark, f"{tmp_path}/none").count() == 0
