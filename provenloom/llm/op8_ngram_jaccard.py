"""Exact n-gram Jaccard join by a token-group matrix.

A document is its set of word shingles; two documents link where intersection / union reaches num / den. Sets of like
size deal their shingles over B buckets by hash. Two linked sets differ in at most D shingles, so with B = D + 1 + E
buckets at least E + 1 buckets hold the very same shingles in both: a bucket's content is the *token* of this join.

1. One pass over the texts emits a row for each (token, set). Tokens met in one set only go.
2. Groups: the set whose tokens are the most common leads the tokens that it has; a set follows the most central leader
   of its tokens, that leader its own, and groups whose token unions overlap in E + 1 tokens become one, so that a family
   comes under one leader. A set is compared with the leader; what doesn't link with it is grouped once more by its own
   tokens, under leaders of a second level. Those that link with a leader are the first components, within which no pair
   is looked at again.
3. Token-group matrix: a group's token union is the distinct (token, component, leader) rows. The overlap of a set with the
   union bounds its overlap with every member; groups of fewer than E + 1 common tokens stay closed. A qualifying group is
   opened: members that agree with the set in E + 1 tokens, and are of another component, are compared with it.
4. Sets of one group that aren't of one component: by the triangle, two sets x and y that link share at least half
   of |D(x)| + |D(y)| - apart, where D is what a set differs in from the leader and apart what linked sets may
   differ in. So x is looked up by its first apart + 1 elements and the one of the smaller D by half as many; what
   the leader has comes last in that order, and copies that were changed each in its own way never meet, however many.
   Sets that follow one leader of the second level meet by what they differ in from that one, others by the first.
   Texts are compared only where the parities of the sets (bits that can't differ in more places than the sets do) allow it.

All links between different sets are found (the bound is exact, no cap is set), and copies are never paired: equal sets
are one set, with the rows as its membership. Passages that many documents share don't bring them together, since
a token mixes them with the document's own shingles. Sets are 64-bit hashes of shingles, compared whole.

Defined cases: null, empty or wordless texts have no shingles and link with nothing (component_id is the doc_id);
documents with fewer words than a shingle have the whole sequence as one; rows of equal doc_id are rows of their own, each
with its own set; a null doc_id keeps a row and carries links (component_id is the least doc_id of its component, null
if no row has one); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, components, discard, forget, materialise, small, table

SPARE = 5
CACHED_WORDS = 200_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


word_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: ASCII case folded, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(word_hashes.__getitem__, words)), np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(3) + h[k : k + n])
    return np.unique(out)


@lru_cache
def classes(num: int, den: int, upto: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes: their first sizes, buckets and spare buckets. A set's partners lie in its own class or beside it."""
    first = [1]
    while first[-1] < upto:
        first.append(first[-1] * den // num + 1)
    starts = np.array(first, np.int64)
    differ = 2 * (starts[1:] - 1) * (den - num) // (den + num)
    # many small buckets are empty: the spare ones outnumber those, or agreeing in one bucket by chance would be enough
    spare = np.maximum(np.minimum(SPARE, differ // 4), differ * 5 * (den - num) // (4 * den))
    return starts, differ + 1 + spare, spare


def let_go() -> None:
    """Frees what a worker holds for the texts of a task: workers live on through steps that need none of it."""
    word_hashes.clear()
    pa.default_memory_pool().release_unused()


def fingerprint(s: np.ndarray) -> int:
    if not len(s):
        return 0
    whole = np.bitwise_xor.reduce(mixed(s + np.uint64(1)), keepdims=True)
    return int(mixed(whole + np.uint64(len(s))).view(np.int64)[0])


def bucket_rows(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content, position of the set, agreements needed, whether it is of its own class) for the sets' own classes and the next ones."""
    starts, buckets, spare = classes(num, den)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(starts, sizes, "right") - 1
    out = []
    for up in (0, 1):
        c = own + up
        b = buckets[c]
        base = np.concatenate([[0], np.cumsum(b)])
        h = mixed(flat ^ mixed(c.astype(np.uint64) + np.uint64(7))[of])
        key = base[of] + ((h >> np.uint64(33)) % b[of].astype(np.uint64)).astype(np.int64)
        # sums of two 26-bit halves are exact in doubles up to 2**27 shingles in a bucket
        g = mixed(h + np.uint64(0x9E3779B97F4A7C15))
        low = np.bincount(key, (g & np.uint64((1 << 26) - 1)).astype(np.float64), base[-1])
        high = np.bincount(key, (g >> np.uint64(38)).astype(np.float64), base[-1])
        count = np.bincount(key, minlength=base[-1])
        at = np.repeat(np.arange(len(sets)), b)
        empty = np.bincount(at, count == 0, len(sets)).astype(np.int64)
        need = np.maximum(1, spare[c] + 1 - empty)
        where = (np.arange(base[-1]) - base[at]).astype(np.uint64)
        content = mixed(mixed(low.astype(np.uint64) + (where << np.uint64(40))) + high.astype(np.uint64) * M2 + mixed(c.astype(np.uint64))[at] + count.astype(np.uint64))
        kept = (count > 0) | (empty > spare[c])[at]
        out.append((content.view(np.int64)[kept], at[kept], need[at][kept], np.full(np.count_nonzero(kept), up == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ROWS = "content long, fp long, need int, own boolean"
REMEMBERED = 200_000
SAMPLE = 512
MET_AT_ONCE = 1_000


def _slices(texts: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) of runs of about so many bytes, one text at least; no more is unpacked at once."""
    held = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(held, held[start] + chars, "right")) - 1)
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def _rows(keyed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """For each row of keyed (row, text) one with content = row, its set's fp and need = -1 - size, and the tokens (content, fp, need, own) of sets.

    A task emits the tokens of a set once (as long as it remembers the set), so that copies meet as few rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, told = [c.split()[0] for c in ROWS.split(", ")], set()
        for b in batches:
            for start, texts in _slices(b.column(1)):
                sets = [shingles(t, width) for t in texts]
                fps = np.array([fingerprint(s) for s in sets], np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(sets)), pa.array(fps), pa.array((-1 - n).astype(np.int32)), pa.array(np.ones(len(sets), bool))], names)
                once = [k for k in np.unique(fps, return_index=True)[1].tolist() if n[k] and fps[k] not in told]
                if len(told) > REMEMBERED:
                    told = set()
                told.update(fps[once].tolist())
                if once:
                    content, at, need, own = bucket_rows([sets[k] for k in once], num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(fps[once][at]), pa.array(need.astype(np.int32)), pa.array(own)], names)
        let_go()

    return keyed.select("row", "text").mapInArrow(emit, ROWS)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def parities(s: np.ndarray) -> np.ndarray:
    """Bits, about as many as the set has shingles: whether an odd number of them falls on each. Two sets' bits differ in no more places than the sets."""
    n = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((mixed(s + np.uint64(3)) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(a: Column, b: Column, size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """Whether two sets can still link by their sizes and parities; of unequal numbers of bits the longer are folded."""
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(x)
    apart = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    sizes = den * F.least(size_a, size_b) >= num * F.greatest(size_a, size_b)
    return sizes & (apart <= F.floor((size_a + size_b) * (den - num) / (den + num)))


def most_apart(size: int, num: int, den: int) -> int:
    """How many shingles a set of this size and one that links with it differ in at most."""
    return (size + size * den // num) * (den - num) // (den + num)


def _judged(pairs: DataFrame, carriers: DataFrame, keyed: DataFrame, width: int, num: int, den: int, common: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) with linked, the size of a, in how many shingles (n) the two differ, and the rarest of these.

    The whole texts of both are compared: those of a come behind the one of their b, of which a part of its pairs has a copy.
    With ``common`` (b, usual), ``rarest`` holds the first elements of the difference, as many as another set that links
    with a may lack: those that b lacks, without the usual ones, then the usual ones, then those that a lacks; ``bits``
    are the parities of a. Without it, both are null.
    """
    ordered = common is not None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b, other, usual = None, None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in batches:
            for start, texts in _slices(batch.column(2)):
                of, at, linked, sizes, n, rarest, bits = [], [], [], [], [], [], []
                for i, t in enumerate(texts, start):
                    a = batch.column(1)[i].as_py()
                    if a is None:  # the text that the next ones are compared with
                        if (here := batch.column(0)[i].as_py()) != b:
                            b, other = here, shingles(t, width)
                            usual = np.sort(np.array(batch.column(3)[i].as_py() or [], np.int64).view(np.uint64))
                        last = None
                        continue
                    if a == last:  # a repeated row
                        continue
                    last, mine = a, shingles(t, width)
                    own = mine[~_among(mine, other)]
                    both = len(mine) - len(own)
                    of.append(b)
                    at.append(a)
                    linked.append(den * both >= num * (len(mine) + len(other) - both))
                    sizes.append(len(mine))
                    n.append(len(own) + len(other) - both)
                    if ordered:
                        known = _among(own, usual)
                        need = most_apart(len(mine), num, den) + 1
                        first = np.concatenate([own[~known], own[known]])
                        if len(first) < need:
                            first = np.concatenate([first, other[~_among(other, mine)]])
                        rarest.append(first[:need].view(np.int64))
                        bits.append(parities(mine))
                    else:
                        rarest.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(of, pa.int64()), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(n, pa.int32()), pa.array(rarest, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["a", "b", "linked", "size", "n", "rarest", "bits"],
                )
        let_go()

    # a set that is compared with very many meets them in several places
    split = pairs.groupBy("b").agg(F.ceil(F.count("*") / MET_AT_ONCE).cast("int").alias("parts"))
    at = pairs.join(split, "b").join(carriers.withColumnRenamed("fp", "a"), "a").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "row")
    of = split.join(carriers.withColumnRenamed("fp", "b"), "b").select("b", "row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    at, of = materialise(at, "jaccard-left"), materialise(of, "jaccard-right")
    left = keyed.select("row", "text").join(small(at, at.count()), "row").select("b", "part", "a", "text", F.lit(None).cast("array<long>").alias("usual"))
    right = keyed.select("row", "text").join(small(of, of.count()), "row").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    right = right.join(common, "b", "left") if ordered else right.withColumn("usual", F.lit(None).cast("array<long>"))
    met = right.unionByName(left).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return met.select("b", "a", "text", "usual").mapInArrow(judge, "a long, b long, linked boolean, size int, n int, rarest array<long>, bits array<long>")


def _pruned(rows: DataFrame, label: str) -> DataFrame:
    """Rows (content, fp, need, label) that can still agree: contents of several labels, sets with need contents left."""
    alive = rows.groupBy("content").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo < hi").select("content")
    rows = rows.join(alive, "content")
    enough = rows.groupBy("fp").agg(F.count("*").alias("k"), F.min("need").alias("least")).where("k >= least").select("fp")
    return rows.join(enough, "fp")


def _stars(tokens: DataFrame) -> DataFrame:
    """(fp, leader): of the sets that lead a token of fp, the one whose tokens are the most common; a set leads the tokens in which it is that one."""
    fame = tokens.join(tokens.groupBy("content").agg(F.count("*").alias("sets")), "content").groupBy("fp").agg(F.sum("sets").alias("fame"))
    matrix = tokens.join(fame, "fp").groupBy("content").agg(F.max(F.struct("fame", (-F.col("fp")).alias("back"))).alias("top")).select("content", (-F.col("top.back")).alias("leader"), F.col("top.fame").alias("fame"))
    overlap = tokens.join(matrix, "content").where("fp <> leader").groupBy("fp").agg(F.max(F.struct("fame", (-F.col("leader")).alias("back"))).alias("top"))
    return materialise(overlap.select("fp", (-F.col("top.back")).alias("leader")), "jaccard-stars")


def _families(tokens: DataFrame, stars: DataFrame) -> DataFrame:
    """(fp, leader) with one leader for the sets whose groups' token unions overlap enough that members may link."""
    while True:  # from leader to leader's leader, which is more central
        up = stars.select(F.col("fp").alias("leader"), F.col("leader").alias("higher"))
        stars, before = materialise(stars.join(up, "leader", "left").select("fp", F.coalesce("higher", "leader").alias("leader"), F.col("higher").isNotNull().alias("moved")), "jaccard-stars"), stars
        discard(before)
        if stars.where("moved").isEmpty():
            break
    stars = stars.drop("moved")
    while True:
        union = tokens.join(stars, "fp", "left").groupBy("content", F.coalesce("leader", "fp").alias("group")).agg(F.min("need").alias("need"))
        first = union.groupBy("content").agg(F.min("group").alias("first"), F.max("group").alias("last")).where("first < last").select("content", "first")
        near = union.join(first, "content").where(F.col("group") != F.col("first")).groupBy("group", "first").agg(F.count("*").alias("k"), F.min("need").alias("least")).where("k >= least")
        to = components(near.select(F.col("first").alias("a"), F.col("group").alias("b")))
        if to.isEmpty():
            return stars
        one = tokens.select("fp").distinct().join(stars, "fp", "left").withColumn("group", F.coalesce("leader", "fp"))
        one = one.join(to.withColumnsRenamed({"node": "group"}), "group", "left").select("fp", F.coalesce("component", "group").alias("leader"))
        stars = materialise(one.where("fp <> leader"), "jaccard-stars")


def _usual(stars: DataFrame, carriers: DataFrame, keyed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(b, usual): shingles that the leader b of a large group lacks and several of up to SAMPLE or so of its sets have.

    They only order what sets differ in, so that the sample decides nothing but speed.
    """
    sizes = stars.groupBy("leader").agg(F.count("*").alias("m")).where(F.col("m") > SAMPLE // 4)
    some = stars.join(sizes, "leader").where(F.pmod(F.xxhash64("fp"), F.greatest(F.lit(4), F.ceil(F.col("m") / SAMPLE))) == 0).select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    none = keyed.sparkSession.createDataFrame([], "b long, usual array<long>")
    seen = _judged(some, carriers, keyed, width, num, den, none).select("b", F.explode("rarest").alias("e"))
    seen = seen.groupBy("b", "e").agg(F.count("*").alias("c")).where("c > 2")
    with arrow_batches(keyed.sparkSession):
        return materialise(seen.groupBy("b").agg(F.array_sort(F.collect_list("e")).alias("usual")), "jaccard-usual")


def _compared(stars: DataFrame, carriers: DataFrame, keyed: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """What _judged tells of the sets in stars (fp, leader) and their leaders."""
    usual = _usual(stars, carriers, keyed, width, num, den)
    judged = _judged(stars.select(F.col("fp").alias("a"), F.col("leader").alias("b")), carriers, keyed, width, num, den, usual)
    with arrow_batches(keyed.sparkSession):
        return materialise(judged.withColumnsRenamed({"a": "fp", "b": "leader"}), name)


def _beside(judged: DataFrame, nearer: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets under one leader that may link and aren't of one component.

    A set follows its leader of the second level if it is nearer to it than to the first. ``part`` tells what is settled
    elsewhere: under the first leader, the sets that follow one of the second level (they meet under that one) and those
    that link with the leader; under one of the second level, those of one component.
    """
    labelled = lambda sets: sets.join(groups, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    nearer = nearer.join(judged.select("fp", F.col("n").alias("first_n")), "fp").where("n < first_n").drop("first_n")
    follows = nearer.select("fp", F.col("leader").alias("second"))
    first = labelled(judged.join(follows, "fp", "left")).withColumn("part", F.coalesce("second", F.when(F.col("linked"), F.col("leader")), "fp"))
    columns = ["leader", "fp", "part", "label", "size", "n"]
    led = first.select(*columns, "rarest").unionByName(labelled(nearer).withColumn("part", F.col("label")).select(*columns, "rarest"))
    mixed_ = materialise(led.groupBy("leader").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("leader"), "jaccard-mixed")
    led = led.join(small(mixed_, mixed_.count()), "leader").select(*columns, F.posexplode("rarest").alias("at", "e"))
    led = led.select(F.xxhash64("leader", "e").alias("key"), *columns[1:], (F.col("at") + 1).alias("place"))
    # one exchange by key: counts of keys that are nearly all different would only fill the heap, and the rows would be dealt again
    same = Window.partitionBy("key")
    met = led.select("*", F.min("part").over(same).alias("lo"), F.max("part").over(same).alias("hi"), F.min("label").over(same).alias("least"), F.max("label").over(same).alias("most"))
    met = materialise(met.where("lo < hi and least < most").drop("lo", "hi", "least", "most"), "jaccard-met")
    apart = lambda size: F.floor(size * (den - num) / (den + num))
    half = F.floor(apart(F.col("size") + F.floor(F.col("size") * den / num)) / 2) + 1
    less = met.where(F.col("place") <= half).select("key", *[F.col(c).alias(f"other_{c}") for c in ("fp", "part", "label", "n", "place", "size")])
    # the two share half of what they differ in from the leader beyond what they may differ in; all of it lies behind the first
    may = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    must = F.col("n") + F.col("other_n") - apart(F.col("size") + F.col("other_size"))
    open_ = (F.col("part") != F.col("other_part")) & (F.col("label") != F.col("other_label")) & (2 * may >= must)
    on = (met["key"] == less["key"]) & ((F.col("n") > F.col("other_n")) | (F.col("n") == F.col("other_n")) & (F.col("fp") > F.col("other_fp"))) & open_
    return met.join(less, on).select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def _labels(edges: DataFrame) -> DataFrame:
    return components(edges).select(F.col("node").alias("fp"), F.col("component").alias("label"))


def link(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); num / den: the least similarity."""
    ident = F.col("doc_id").cast("long")
    keyed = docs.select(ident.alias("doc_id"), "text", F.xxhash64(ident, "text").alias("row"))
    # one exchange and one sort by content: a join of the rows with the contents of several sets would sort and hold both sides in each task
    rows = _rows(keyed, width, num, den).where("content is not null").repartition("content")
    same = Window.partitionBy("content")
    met = rows.select("*", F.min("fp").over(same).alias("lo"), F.max("fp").over(same).alias("hi"), F.max("need").over(same).alias("most"), F.max("own").over(same).alias("owned"))
    # two sets of one class meet by the tokens of that class: what only sets of the class below have brings nobody together
    met = met.where("need < 0 or most > 0 and lo < hi and owned")
    with arrow_batches(docs.sparkSession):
        met = materialise(met.select("content", "fp", "need").distinct(), "jaccard-rows")
    del rows
    forget(docs.sparkSession)  # the shuffle of all tokens is by far the largest
    members = met.where("need < 0").groupBy(F.col("content").alias("row")).agg(F.min(F.struct("fp", (-1 - F.col("need")).alias("n"))).alias("m")).select("row", "m.fp", F.col("m.n").cast("long").alias("n"))
    members = materialise(members, "jaccard-members")
    tokens = materialise(_pruned(met.where("need > 0").withColumn("label", F.col("fp")), "label").select("content", "fp", "need"), "jaccard-tokens")
    discard(met)
    carriers = materialise(members.join(tokens.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row")), "jaccard-carriers")

    # groups: the set whose tokens are the most common stands in the middle of its copies and leads the tokens that it has
    stars = _families(tokens, _stars(tokens))
    judged = _compared(stars, carriers, keyed, width, num, den, "jaccard-judged")
    # a family may hold clusters far from its leader: leaders of a second level, from among the sets that don't link with it
    far = materialise(judged.where("not linked").select("fp"), "jaccard-far")
    second = _stars(tokens.join(small(far, far.count()), "fp", "left_semi"))
    nearer = _compared(second, carriers, keyed, width, num, den, "jaccard-nearer")
    edges = judged.unionByName(nearer).where("linked").select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()
    groups = _labels(edges)
    close = materialise(_beside(judged, nearer, groups, num, den), "jaccard-beside")

    # groups that a set doesn't belong to: opened where its tokens meet enough of the group's token union
    named = tokens.join(groups, "fp", "left").join(stars, "fp", "left").select("content", "fp", "need", F.coalesce("label", "fp").alias("label"), F.coalesce("leader", "fp").alias("leader"))
    left = materialise(_pruned(_pruned(named, "label"), "label"), "jaccard-left")
    union = left.select(F.col("content").alias("token"), F.col("label").alias("group"), F.col("leader").alias("group_leader")).distinct()
    on = (F.col("content") == F.col("token")) & (F.col("label") > F.col("group")) & (F.col("leader") != F.col("group_leader"))
    bound = left.join(union, on).groupBy("fp", "group", "group_leader").agg(F.count("*").alias("k"), F.min("need").alias("least"))
    open_ = materialise(bound.where("k >= least").select("fp", "group", "group_leader"), "jaccard-open")
    inside = left.select("content", F.col("fp").alias("member"), F.col("label").alias("group"), F.col("leader").alias("group_leader"))
    pairs = left.select("content", "fp", "need").join(open_, "fp").join(inside, ["content", "group", "group_leader"])
    pairs = pairs.groupBy("fp", "member").agg(F.count("*").alias("k"), F.min("need").alias("least")).where("k >= least")
    pairs = pairs.select(F.least("fp", "member").alias("a"), F.greatest("fp", "member").alias("b")).unionByName(close).distinct()
    pairs = pairs.join(groups.select(F.col("fp").alias("a"), F.col("label").alias("la")), "a", "left").join(groups.select(F.col("fp").alias("b"), F.col("label").alias("lb")), "b", "left")
    pairs = materialise(pairs.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b"), "jaccard-pairs")
    # only what the sets' parities leave open is compared; a leader has none
    known = judged.select("fp", "size", "bits")
    both = pairs.join(known.withColumnsRenamed({"fp": "a", "size": "sa", "bits": "ba"}), "a", "left").join(known.withColumnsRenamed({"fp": "b", "size": "sb", "bits": "bb"}), "b", "left")
    pairs = materialise(both.where(F.coalesce(may_link(F.col("ba"), F.col("bb"), F.col("sa"), F.col("sb"), num, den), F.lit(True))).select("a", "b").distinct(), "jaccard-open-pairs")
    more = _judged(pairs, carriers, keyed, width, num, den).where("linked").select("a", "b")
    with arrow_batches(docs.sparkSession):
        more = materialise(more, "jaccard-links")

    final = components(edges.unionByName(more).distinct())
    discard(tokens, left, judged, nearer, far, second, pairs, more, close)
    of = members.join(final.withColumnRenamed("node", "fp"), "fp", "left").select("row", "n", F.when(F.col("n") > 0, F.coalesce("component", "fp")).alias("component"))
    at = keyed.select("doc_id", "row").join(of, "row")
    least = at.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return at.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), 3, 90, 100)
