"""Language model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ORDER bytes with counts from all training documents. A symbol is coded in
its longest context that has seen it: escapes from longer contexts follow method D (a symbol has (2 count - 1) / 2 n,
the escape distinct / 2 n), and symbols of longer contexts are excluded from shorter ones; below order 0 the symbols left
are equally likely. Texts are folded to ASCII lower case; a text begins in a context of PAD bytes and ends with END.

The trie lives in tables of (context and symbol, count), never in one place. Documents are dealt into chunks of bounded
size. Each chunk lists its distinct grams with its training counts; sums by gram give the model, whose code lengths are
worked out where all contexts with the same last two bytes meet; each chunk then gets the code lengths of its own
grams and adds them up by document. Word counts for the base score take the same way. Orders 0 and 1 have 65,536 counts
at most and are shared with all tasks. ``adaptive`` scores each document by a model that it alone builds.

Defined cases: null text is empty and has its end only; a null doc_id counts as the text '' for the fold; repeated rows
are scored (and learned from) each; an empty table gives no rows; without training documents all words are unknown
and all symbols equally likely; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table

ORDER = 5
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
SYMBOLS = 255  # all bytes but PAD
CHUNK_BYTES = 40_000_000
SLICE_BYTES = 2_000_000
FOLDS, HELD_OUT = 5, 1
GRAM, WORD = 0, 1


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def grams(texts: list[bytes]) -> np.ndarray:
    """The context and symbol of every byte and end of the texts in a row: ORDER + 1 bytes in a number."""
    pad = bytes([PAD]) * ORDER
    flat = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    n = len(flat) - ORDER
    out = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | flat[k : k + n]
    return out[flat[ORDER:] != PAD]


def slices(rows: pa.Table) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """ids and folded texts of runs of rows that hold about so many bytes, one row at least; no more is unpacked at once."""
    sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(rows["text"]), 0).to_pylist()])
    start = 0
    while start < rows.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_BYTES, "right")) - 1)
        part = rows.slice(start, end - start)
        yield part["doc_id"].to_pylist(), [folded(t) for t in part["text"].to_pylist()]
        start = end


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


END_KEY = -1  # stands for the end among the words


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.int64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int64)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def chunk_counts(chunk: pa.Table) -> pa.Table:
    """(chunk, kind, key, n): the chunk's distinct grams and words with their counts in its training documents."""
    if not chunk.num_rows:
        return pa.table({"chunk": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    gram_parts, word_parts = [], []
    for ids, texts in slices(chunk):
        held = [held_out(i) for i in ids]
        for learn in (True, False):
            mine = [t for t, h in zip(texts, held, strict=True) if h != learn]
            if mine:
                k, c = np.unique(grams(mine), return_counts=True)
                gram_parts.append((k, c * learn))
                words = Counter(chain.from_iterable(map(bytes.split, mine)))
                word_parts.append((word_keys(list(words)), np.fromiter(words.values(), np.int64, len(words)) * learn))
                word_parts.append((np.array([END_KEY]), np.array([len(mine) * learn])))
        if len(gram_parts) > 4:
            gram_parts, word_parts = [counted(gram_parts)], [counted(word_parts)]
    (k, c), (wk, wc) = counted(gram_parts), counted(word_parts)
    n = len(k) + len(wk)
    kind = np.repeat(np.array([GRAM, WORD], np.int32), [len(k), len(wk)])
    return pa.table({"chunk": np.full(n, chunk["chunk"][0].as_py(), np.int64), "kind": kind, "key": np.concatenate([k, wk]), "n": np.concatenate([c, wc])})


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each gram's probability. keys and counts: all grams of the contexts met here; pairs: counts [last byte, symbol]."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order].astype(np.float64)
    # tables of (context, symbol) for each order above 1, longest first: sums over what they have in common at the end
    at: list[np.ndarray] = []
    level: list[tuple[np.ndarray, np.ndarray]] = []
    for o in range(ORDER, 1, -1):
        u, inv = np.unique(k & ((1 << 8 * (o + 1)) - 1), return_inverse=True)
        level.append((u, np.bincount(inv, c, len(u))))
        at.append(inv)
    symbol, last = k & 255, (k >> 8) & 255
    seen = [lc[a] for (_, lc), a in zip(level, at, strict=True)] + [pairs[last, symbol], pairs.sum(axis=0)[symbol]]
    # for each gram: the counts and distinct symbols of its context, and what the longer context's symbols count there
    total, distinct, taken = [], [], []
    for i, (u, lc) in enumerate(level):
        ctx, inv = np.unique(u >> 8, return_inverse=True)
        total.append(np.bincount(inv, lc, len(ctx))[inv][at[i]])
        distinct.append(np.bincount(inv, lc > 0, len(ctx))[inv][at[i]])
        if i + 1 < len(level):
            v, vc = level[i + 1]
            lower = vc[np.searchsorted(v, u & ((1 << 8 * (ORDER - i)) - 1))]
        else:
            lower = pairs[(u >> 8) & 255, u & 255]
        taken.append(np.bincount(inv, np.where(lc > 0, lower, 0), len(ctx))[inv][at[i]])
    zero = pairs.sum(axis=0)
    total += [pairs.sum(axis=1)[last], np.full(len(k), zero.sum())]
    distinct += [(pairs > 0).sum(axis=1)[last], np.full(len(k), (zero > 0).sum())]
    taken.append((np.where(pairs > 0, zero[None, :], 0).sum(axis=1))[last])
    out, open_, gone_n, gone_d = np.zeros(len(k)), np.ones(len(k), bool), np.zeros(len(k)), np.zeros(len(k))
    for i in range(ORDER + 1):
        n, d = total[i] - gone_n, distinct[i] - gone_d
        live = open_ & (d > 0)
        hit = live & (seen[i] > 0)
        out[hit] += np.log10((2 * seen[i][hit] - 1) / (2 * n[hit]))
        miss = live & ~hit
        out[miss] += np.log10(d[miss] / (2 * n[miss]))
        open_ &= ~hit
        if i < ORDER:
            some = distinct[i] > 0
            gone_n, gone_d = np.where(some, taken[i], 0), np.where(some, distinct[i], 0)
    out[open_] -= np.log10(max(1, SYMBOLS - int((zero > 0).sum())))
    result = np.empty(len(k))
    result[order] = out
    return result


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-bytes_ // CHUNK_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    listed = materialise(dealt.groupBy("chunk").applyInArrow(chunk_counts, "chunk long, kind int, key long, n long"), "ppm-counts")
    forget(docs.sparkSession)

    known = materialise(listed.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "ppm-words")
    sums = known.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train, vocabulary = sums["n"] or 0, sums["v"]
    trie = materialise(listed.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")), "ppm-trie")
    forget(docs.sparkSession)
    pairs = np.zeros((256, 256))
    for r in trie.where("n > 0").groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(255)).alias("a"), F.col("key").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("n").alias("n")).toLocalIterator():
        pairs[r["a"], r["b"]] = r["n"]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            keys = np.concatenate([b.column(0).to_numpy() for b in held])
            found = code_lengths(keys, np.concatenate([b.column(1).to_numpy() for b in held]), pairs)
            for i in range(0, len(keys), 100_000):
                rounded = found[i : i + 100_000].astype(np.float32).astype(np.float64)  # the zeros make the shuffle small
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(rounded)], ["key", "value"])

    together = trie.repartition(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    model = together.mapInArrow(lengths, "key long, value double")
    values = listed.where(F.col("kind") == GRAM).join(model, "key").select("chunk", "kind", "key", "value")
    values = values.unionByName(listed.where(F.col("kind") == WORD).select("chunk", "kind", "key").join(known.select("key", F.col("n").cast("double").alias("value")), "key").select("chunk", "kind", "key", "value"))
    floor = n_train + 0.5 * (vocabulary + 1)

    def add(mine: pa.Table, given: pa.Table) -> pa.Table:
        kind, key, value = (given[c].to_numpy() for c in ("kind", "key", "value"))
        tables = []
        for k in (GRAM, WORD):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at])]
            tables.append((key[at], value[at]))
        (gk, gv), (wk, wv) = tables
        columns: list[list] = [[] for _ in range(7)]
        for ids, texts in slices(mine):
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            total = np.add.reduceat(gv[np.searchsorted(gk, grams(texts))], starts)
            split = [t.split() for t in texts]
            names = list(set(chain.from_iterable(split)))
            count = dict(zip(names, wv[np.searchsorted(wk, word_keys(names))].tolist(), strict=True))
            end = float(wv[np.searchsorted(wk, END_KEY)])
            for i, words, x in zip(ids, split, total.tolist(), strict=True):
                c = np.array([count[w] for w in words] + [end])
                row = (i, held_out(i), len(c), int((c > 0).sum()), n_train, float(np.log10((c + 0.5) / floor).sum()), x)
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(add, out)


def adaptive(text: str | None, order: int = ORDER) -> float:
    """log10 probability of a text by a model that starts empty and learns each symbol after coding it."""
    data, seen, total = folded(text) + bytes([END]), {}, 0.0
    history = bytes([PAD]) * order
    for s in data:
        excluded: set[int] = set()
        for o in range(order, -1, -1):
            node = seen.get(history[len(history) - o :] if o else b"")
            left = {k: v for k, v in node.items() if k not in excluded} if node else {}
            if left:
                n, d = sum(left.values()), len(left)
                if s in left:
                    total += np.log10((2 * left[s] - 1) / (2 * n))
                    break
                total += np.log10(d / (2 * n))
                excluded |= left.keys()
        else:
            total -= np.log10(max(1, SYMBOLS - len(excluded)))
        for o in range(order + 1):
            node = seen.setdefault(history[len(history) - o :] if o else b"", {})
            node[s] = node.get(s, 0) + 1
        history = (history + bytes([s]))[-order:]
    return float(total)


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
