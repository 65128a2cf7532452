"""Token ids in a compact binary form: static range asymmetric numeral systems (rANS).

One table of frequencies, counted over all documents, is shared by all blocks. A block holds whole documents in ascending
order and decodes by itself: its ids are dealt over interleaved lanes (one coder state each) that numpy steps together,
their 32-bit words share one stream, and checkpoints (lane states and stream position) allow decoding to begin inside a
block. Every segment between checkpoints and the document table carry a crc32. Blocks are rows (shard, block, n_tokens,
payload) of Parquet files: Spark's commit protocol makes them safe against lost executors, and shards ascend by doc_id.

Coder: total 2**20, states of 64 bits in [2**32, 2**64), words of 32 bits. Ids are encoded backwards and read forwards.

Defined cases: null text is empty; an empty document is its end id alone; repeated rows and equal doc_ids are documents
of their own, side by side in any order; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, shared_dir, table

SCALE_BITS = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 64
LOW = np.uint64(1 << 32)
MAGIC = b"rANS"
VOCABULARY = 49408
END_ID = 1
CACHED_WORDS = 800_000
CACHED_PIECES = 800_000
#: Marks of which a run behind letters is one piece by itself.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes as letters: printable Latin-1 as itself, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts, with the library called once for each piece not met lately.

    The vocabulary's own splitter (PIECES) drops white space and no merge crosses a piece, so a text's ids are those of
    its pieces in a row. Words between white space come from one cache, pieces of new words from another, both of
    bounded size; only new pieces, and words with characters that are past PLAIN or don't print, go to the library.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Below this, lower case is by single characters and nothing composes, so that str.lower() is the normaliser.
    PLAIN = "\u0250"
    COMPOSES = "[a-z][\u0300-\u036f]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def piece(self, x: str) -> bytes:
        """Ids of a piece in lower case whose characters all print."""
        found = self.pieces.get(x)
        if found is None:
            spelled = x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = self.pieces[x] = array("H", [t.id for t in self.library.model.tokenize(spelled)]).tobytes()
        return found

    def learn(self, new: list[str], special: bool) -> None:
        """Ids of new words; letters, or letters and then marks, need no pattern to be cut. special: some may hold special tokens."""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = {}
        known, piece, words, odd = self.pieces.get, self.piece, self.words, []
        for w in new:
            if not w.isprintable() or not (w.isascii() or max(w) < self.PLAIN and len(w.split()) == 1) or special and "<|" in w:
                odd.append(w)
                continue
            low = w.lower()
            if low.isalpha():
                words[w] = known(low) or piece(low)
                continue
            head = low.rstrip(MARKS)
            if not head.isalpha():
                words[w] = b"".join(map(piece, self.PIECES.findall(low)))
            else:
                words[w] = (known(head) or piece(head)) + piece(low[len(head) :])
        words.update(zip(odd, self.encoded(odd), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text closed by the end id, and the texts' lengths in ids."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        cased = pc.any(pc.match_substring(spaced, "<|")).as_py()  # the case of special tokens counts
        split = pc.split_pattern(spaced if cased else pc.ascii_lower(spaced), " ")
        coded = split.flatten().dictionary_encode()
        met = coded.dictionary.to_pylist()
        if not cased and pc.any(pc.match_substring_regex(coded.dictionary, self.COMPOSES)).as_py():  # a mark may compose with the small letter alone
            split = pc.split_pattern(spaced, " ")
            coded = split.flatten().dictionary_encode()
            met = coded.dictionary.to_pylist()
        new = [w for w in met if w not in self.words]
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words = {w: self.words[w] for w in met if w in self.words} | {"": b""}
        self.learn(new, cased)
        # the end id as one more word after each text
        entries = [*map(self.words.__getitem__, met), array("H", [END_ID]).tobytes()]
        size = np.array(list(map(len, entries)), np.int32) // 2
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        closes = np.cumsum(counts + 1) - 1
        inner = np.ones(int(counts.sum()) + len(counts), bool)
        inner[closes] = False
        at = np.full(len(inner), len(met), np.int32)
        at[inner] = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[at], dtype=np.int64)[closes]
        return np.frombuffer(b"".join(map(entries.__getitem__, at.tolist())), np.uint16), np.diff(ends, prepend=0)


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _slices(texts: pa.Array, chars: int = 12_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes, at least one text each."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + chars, "right")))
        yield start, end
        start = end


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every id (an id may come that the counted rows lack)."""
    n, total = len(counts), 1 << bits
    f = 1 + np.floor(counts.astype(np.float64) * ((total - n) / max(1, counts.sum()))).astype(np.int64)
    f[int(np.argmax(counts))] += total - f.sum()
    return f.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks by one shared table of frequencies."""

    def __init__(self, freqs: np.ndarray):
        self.freq = freqs.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.top = self.freq << np.uint64(64 - SCALE_BITS)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        padded = np.zeros(steps * lanes, np.uint16)
        padded[: len(ids)] = ids
        grid = padded.reshape(steps, lanes)
        x, out, marks, written = np.full(lanes, LOW, np.uint64), [], [], 0
        for s in range(steps - 1, -1, -1):
            row = grid[s]
            full = x >= self.top[row]
            if full.any():
                out.append(x[full].astype(np.uint32)[::-1])
                written += len(out[-1])
                x[full] >>= np.uint64(32)
            f = self.freq[row]
            q = x // f
            x = (q << np.uint64(SCALE_BITS)) + (x - q * f) + self.cum[row]
            if s % CHECKPOINT_STEPS == 0:
                marks.append((written, x.copy()))
        stream = np.concatenate(out)[::-1] if out else np.empty(0, np.uint32)
        marks.reverse()
        sums = [zlib.crc32(grid[i * CHECKPOINT_STEPS : (i + 1) * CHECKPOINT_STEPS].astype("<u2").tobytes()) for i in range(len(marks))]
        head = struct.pack("<4sIIII", MAGIC, len(ids), lanes, len(marks), len(stream))
        points = b"".join(struct.pack("<II", len(stream) - w, c) + st.astype("<u8").tobytes() for (w, st), c in zip(marks, sums, strict=True))
        return head + points + stream.astype("<u4").tobytes()

    def decode(self, data: bytes, segment: int | None = None) -> np.ndarray:
        """All ids of a block, or those of one segment between checkpoints. Raises ValueError where a checksum differs."""
        magic, n, lanes, points, length = struct.unpack_from("<4sIIII", data)
        if magic != MAGIC:
            raise ValueError("not a rANS block")
        steps, size, at = -(-n // lanes), 8 + 8 * lanes, 20
        stream = np.frombuffer(data, "<u4", length, at + points * size).astype(np.uint64)
        mask, grid = np.uint64((1 << SCALE_BITS) - 1), np.empty((steps, lanes), np.uint16)
        chosen = range(points) if segment is None else [segment]
        for p in chosen:
            pos, crc = struct.unpack_from("<II", data, at + p * size)
            x = np.frombuffer(data, "<u8", lanes, at + p * size + 8).astype(np.uint64)
            first, last = p * CHECKPOINT_STEPS, min(steps, (p + 1) * CHECKPOINT_STEPS)
            for s in range(first, last):
                slot = x & mask
                row = self.symbol[slot]
                grid[s] = row
                x = self.freq[row] * (x >> np.uint64(SCALE_BITS)) + slot - self.cum[row]
                low = x < LOW
                k = int(np.count_nonzero(low))
                if k:
                    x[low] = (x[low] << np.uint64(32)) | stream[pos : pos + k]
                    pos += k
            after = np.frombuffer(data, "<u8", lanes, at + (p + 1) * size + 8) if p + 1 < points else LOW
            if zlib.crc32(grid[first:last].astype("<u2").tobytes()) != crc or (x != after).any():
                raise ValueError(f"checksum of segment {p} differs")
        if segment is None:
            return grid.reshape(-1)[:n]
        return grid[first:last].reshape(-1)[: max(0, n - first * lanes)]


COLUMNS = ["shard", "block", "shard_start", "n_docs", "n_tokens", "doc_ids", "lengths", "docs_crc32", "payload"]
BLOCKS = "shard long, block long, shard_start long, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, docs_crc32 long, payload binary"


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of documents in ascending doc_id order with plain ids of two bytes as payload.

    Texts are dealt into ranges of doc_id (the ranges come from ids alone), ordered and tokenised there.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard, block, before = tokenizer(path), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, ids, lengths, held
            every, flat = np.concatenate(lengths).tolist(), np.concatenate(held)
            row = [shard, block, before, len(ids), len(flat), ids, every, zlib.crc32(repr((ids, every)).encode()), flat.tobytes()]
            block, before, ids, lengths, held = block + 1, before + len(flat), [], [], []
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], COLUMNS)

        for b in batches:
            keys = b.column(0).to_pylist()
            for start, end in _slices(b.column(1)):
                flat, sizes = tok(b.column(1).slice(start, end - start))
                ends, first = np.cumsum(sizes), 0
                while first < len(sizes):  # whole documents until the block is full
                    done = int(ends[first - 1]) if first else 0
                    last = min(len(sizes), int(np.searchsorted(ends, done + BLOCK_TOKENS - sum(map(len, held)))) + 1)
                    ids += keys[start + first : start + last]
                    lengths.append(sizes[first:last])
                    held.append(flat[done : ends[last - 1]])
                    first = last
                    if sum(map(len, held)) >= BLOCK_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    # a draw for each row lets a doc_id that very many rows share lie in several ranges
    ranged = docs.select("doc_id", "text", F.rand(7).alias("draw")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "draw")
    return ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "draw").select("doc_id", "text").mapInArrow(blocks, BLOCKS)


def frequencies(blocks: DataFrame) -> np.ndarray:
    """Counts of ids over all blocks, added up within tasks and then by id: one number for each id at most returns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                total += np.bincount(np.frombuffer(b.column(0)[i].as_buffer(), np.uint16), minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(VOCABULARY, np.int64)
    for r in blocks.select("payload").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, out: str, path: str | None = None) -> np.ndarray:
    """Encodes docs (doc_id, text) into the files at out in ascending doc_id order; returns the shared frequencies.

    Texts are tokenised once; the plain ids wait in the shared folder until the counts over all of them are known.
    """
    spark = docs.sparkSession
    plain = f"{out}-plain"
    tokenise(docs, path or vocabulary_path()).write.option("compression", "zstd").parquet(plain)
    blocks = spark.read.schema(BLOCKS).parquet(plain)
    freqs = scaled(frequencies(blocks))
    packed = zlib.compress(freqs.astype("<u4").tobytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(zlib.decompress(packed), "<u4"))
        for b in batches:
            for i in range(b.num_rows):
                coded = coder.encode(np.frombuffer(b.column("payload")[i].as_buffer(), np.uint16))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, 1) for c in COLUMNS[:-1]] + [pa.array([coded], pa.binary())], COLUMNS)

    blocks.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(out)
    delete(spark, plain)
    return freqs


def read(spark: SparkSession, path: str, freqs: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit) decoded from the files at path.

    Each row of the files decodes by itself. A document's start adds what its shard held before its block and what the
    shards before held; the latter is a sum over one row for each shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    packed = zlib.compress(freqs.astype("<u4").tobytes())
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    run = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(zlib.decompress(packed), "<u4"))
        for b in batches:
            for i in range(b.num_rows):
                shard, at, ids, lengths, crc, payload = (b.column(c)[i].as_py() for c in ("shard", "shard_start", "doc_ids", "lengths", "docs_crc32", "payload"))
                if zlib.crc32(repr((ids, lengths)).encode()) != crc:
                    raise ValueError("checksum of the document table differs")
                data = coder.decode(payload).astype("<u4").tobytes()
                ends = np.cumsum([0, *lengths])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(ids), pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(at + ends[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([data[4 * s : 4 * e] for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["shard", "doc_id", "at", "n_tokens", "ids"],
                )

    decoded = blocks.select("shard", "shard_start", "doc_ids", "lengths", "docs_crc32", "payload").mapInArrow(decode, "shard long, doc_id long, at long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame) -> DataFrame:
    """Writes docs, reads the files back and returns doc_id, start, n_tokens, ids_crc32 of what they hold."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    freqs = write(docs, out)
    return read(spark, out, freqs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
