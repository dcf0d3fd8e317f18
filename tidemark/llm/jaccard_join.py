"""Exact Jaccard join of documents' word n-gram sets by universe partition (pigeonhole).

Sets are grouped into size bands.  In a band every shingle belongs, by hash, to one of m segments.
Two sets that reach the threshold differ in at most H shingles, so if the segments that a set
probes have allowances that add up to more than H, some probed segment differs by no more than its
allowance: 0 (the segment is equal) or 1 (equal but for one shingle; found by one-deletion
neighbours).  The allocation is by cost: for each band the choice between one-deletion throughout
and different numbers of exact segments is made on a sample, by the rows that it writes and the
chance meetings that it leads to; and a set probes the H + 1 cheapest of its exact segments, where
empty ones and those of frequent shingles only are dear.  The sample steers the work only.

Equal sets are one class from the start.  In each bucket of a signature the members meet one
representative; after the components of those links are known, the members of different components
still meet each other, so no link between different components is lost and a group of near copies
isn't expanded.  Buckets that the sample shows to hold a large share of all sets are dealt out in
parts, and the parts of one bucket meet like its members.  Candidates pass a bound on the symmetric
difference (hamming distance of parity sketches) and are then verified on the sets themselves
(64-bit hashes of shingles).

Null texts and texts without words have empty sets and no links; a text of fewer words than the
shingle is one shingle.  Repeated rows are equal sets.  Rows of one doc_id with different texts, and
rows with a null doc_id, are sets of their own and link like any other; component_id is the smallest
doc_id that is not null, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices
from tidemark.operators.graph import connected_components

#: Width ratio of size bands.
RATIO = 1.5
#: Bits of the parity sketch.
SKETCH = 1_024
#: The sample that steers: documents of it, and sets of one band of them; a chance meeting costs as much as so many rows.
SAMPLE, BAND_SAMPLE, MEETING = 10_000, 600, 4
#: Frequent shingles are in over this share of the sample; at most MOST of them are kept.
FREQUENT, MOST = 0.002, 100_000
#: Rows of one bucket that are settled at once (larger ones are dealt out in parts), and members of a bucket that one task compares with as many others.
PART, BLOCK = 200_000, 2_000
#: Members of a bucket, of different components, that all others meet before everyone meets everyone.
LEADERS = 8
#: Texts that are shingled at once.
CHUNK = 500
#: Ids that are broadcast for a semi or anti join; more go through a shuffle.
FEW = 1_000_000
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """64-bit hash of a word, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def shingles(texts: list[str | None], n: int, cache: Words) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text, one text after the other, and how many each has.

    A-Z is lower-cased, words stand between ASCII white space.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    w = np.fromiter((h for some in words for h in map(cache.__getitem__, some)), dtype=np.uint64, count=int(counts.sum()))
    first = np.cumsum(counts) - counts
    taken = np.minimum(n, counts)
    made = np.where(counts > 0, counts - taken + 1, 0)
    at = ragged(first, made)
    k = np.repeat(taken, made)
    h = k.astype(np.uint64)
    for i in range(n):
        on = slice(None) if (taken >= min(n, i + 1)).all() else k > i
        h[on] = mixed(h[on] * np.uint64(0x9E3779B97F4A7C15) + w[at[on] + i])
    end = np.cumsum(made)
    for s, e in zip(end - made, end, strict=True):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(end - made)[made > 0]] = True
    sizes = np.diff(np.r_[0, np.cumsum(new)][np.r_[0, end]])
    return h[new], sizes


class Plan:
    """Bands, and the segments and probes of each, for a threshold of percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 2**31:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        self.edges = np.array(edges)
        self.choose({})

    def choose(self, chosen: dict[int, tuple[int, bool]]) -> Plan:
        """Sets the number of segments, and whether probes use one-deletion neighbours, of some bands; the others keep a middle course."""
        both = [chosen.get(b) or self.options(b)[-2:][0] for b in range(len(self.edges) - 1)]
        self.m, self.deletions = np.array([m for m, _ in both]), np.array([d for _, d in both])
        return self

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def most(self, smaller):
        """Largest symmetric difference of a linked pair whose smaller set has this size."""
        return (100 - self.percent) * smaller // self.percent

    def options(self, band: int) -> list[tuple[int, bool]]:
        """What a band can choose from."""
        h = int(self.most(self.edges[band + 1] - 1))
        if h == 0:
            return [(1, False)]
        return [(-(-(h + 1) // 2), True), *((h + 1 + more, False) for more in sorted({0, 3 + h // 50, 6 + h // 4}))]


def signatures(flat: np.ndarray, sizes: np.ndarray, plan: Plan, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (as from ``shingles``): the set's place, the key and the role.

    Roles: 0 index, 1 probe and index, 2 deletion (meets probing whole segments only), 3 deletion in
    the set's own band (a probe that meets whole segments only).
    """
    starts = np.cumsum(sizes) - sizes
    own_band = plan.bands(sizes)
    whose = np.flatnonzero(sizes > 0)
    below = whose[(own_band[whose] > 0) & (plan.percent * sizes[whose] < 100 * plan.edges[own_band[whose]])]
    # an entry is a set in a band: its own, and the one below where it can have a smaller partner there
    doc = np.r_[whose, below]
    own = np.arange(len(doc)) < len(whose)
    band = own_band[doc] - ~own
    m, deletions = plan.m[band], plan.deletions[band]
    x = flat[ragged(starts[doc], sizes[doc])]
    entry = np.repeat(np.arange(len(doc)), sizes[doc])
    first = np.cumsum(m) - m
    seg = first[entry] + ((x >> np.uint64(33)) % m[entry].astype(np.uint64)).astype(np.int64)
    total = int(m.sum())
    of = np.repeat(np.arange(len(doc)), m)
    value = mixed(x ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, seg, value)
    base = mixed((np.arange(total) - first[of]).astype(np.uint64) + (band[of].astype(np.uint64) << np.uint64(32) | np.uint64(1)))
    common = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x if len(frequent) else np.zeros(len(x), bool)
    rare = np.bincount(seg, ~common, total).astype(np.int64)
    worth = np.minimum(rare, 3) * 64 + np.minimum(np.bincount(seg, minlength=total), 63)
    order = np.argsort(of * 256 + 255 - worth, kind="stable")
    need = np.where(deletions, m, plan.most(sizes[doc]) + 1) * own
    role = np.zeros(total, np.int8)
    role[order[np.arange(total) - first[of[order]] < need[of[order]]]] = 1
    gone = deletions[entry]
    return (
        np.r_[doc[of], doc[entry[gone]]],
        np.r_[mixed(base + sums), mixed(base[seg[gone]] + sums[seg[gone]] - value[gone])],
        np.r_[role, np.where(own[entry[gone]], 3, 2).astype(np.int8)],
    )


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity of each set's elements in SKETCH places, as rows of 64-bit words."""
    at = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + ((flat >> np.uint64(5)).astype(np.int64) & (SKETCH - 1))
    odd = np.bincount(at, minlength=len(sizes) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), SKETCH // 64)


def wide_sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity in two to four places for each element, a power of two, of sets over SKETCH / 2: 64-bit words, and how many each set has (0 for the others)."""
    places = np.where(sizes > SKETCH // 2, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 2))).astype(np.int64), 0)
    start = np.cumsum(places) - places
    of = np.repeat(np.arange(len(sizes)), sizes)
    x, of = flat[places[of] > 0], of[places[of] > 0]
    at = start[of] + ((x >> np.uint64(5)).astype(np.int64) & (places[of] - 1))
    odd = np.bincount(at, minlength=int(places.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), places // 64


def _chunks(batches: Iterator[pa.RecordBatch], n: int, cache: Words) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, and the shingles of their texts."""
    for some in slices(batches, CHUNK):
        yield some, *shingles(some["text"].to_pylist(), n, cache)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), _longs(flat))


def _sets(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, th, n_shingles, a 128-bit hash of the set, its sketch, and for a large set a wide one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, flat, sizes in _chunks(batches, n, Words()):
            end = np.cumsum(sizes)
            same = [xxhash.xxh3_128_digest(flat[e - k : e].tobytes()) for e, k in zip(end, sizes, strict=True)]
            bits = sketches(flat, sizes)
            columns = [some["doc_id"], some["th"], pa.array(sizes), pa.array(same, pa.binary()), _lists(bits.ravel(), np.full(len(bits), SKETCH // 64)), _lists(*wide_sketches(flat, sizes))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_shingles", "same", "sketch", "wide"])

    return documents.mapInArrow(run, "doc_id long, th long, n_shingles long, same binary, sketch array<long>, wide array<long>")


def _frequent(drawn: DataFrame, n: int) -> np.ndarray:
    """Hashes of the shingles that are in many of the sampled documents."""
    total = drawn.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, sizes in _chunks(batches, n, Words()):
            values, counts = np.unique(flat, return_counts=True)
            # a shingle that is frequent overall is in several documents of some chunk
            keep = counts > max(1, FREQUENT * len(sizes) / 2)
            yield pa.RecordBatch.from_arrays([_longs(values[keep]), pa.array(counts[keep])], ["s", "n"])

    found = drawn.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > max(2, FREQUENT * total))
    return np.sort(np.array([r["s"] for r in found.orderBy(F.desc("n"), "s").limit(MOST).collect()], dtype=np.int64).view(np.uint64))


def _unlike(flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Places of sets of which no two may be linked."""
    bits = sketches(flat, sizes).view(np.uint64)
    kept: list[int] = []
    for i in range(len(sizes)):
        apart = np.bitwise_count(bits[kept] ^ bits[i]).sum(1, dtype=np.int64)
        if (apart * (100 + percent) > (100 - percent) * (sizes[kept] + sizes[i])).all():
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _chosen(drawn: DataFrame, n: int, percent: int, frequent: np.ndarray, scale: float) -> Plan:
    """The plan whose bands have the cheapest allocation on the sampled sets; ``scale`` is how many documents one sampled stands for."""
    plan = Plan(percent)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, flat, sizes in _chunks(batches, n, Words()):
            yield pa.RecordBatch.from_arrays([pa.array(plan.bands(sizes)), some["doc_id"], _lists(flat, sizes)], ["band", "doc_id", "set"])

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        band, total = int(group["band"].iloc[0]), len(group)
        group = group.sort_values("doc_id").head(BAND_SAMPLE)
        flat, sizes = np.concatenate(group["set"].to_numpy()).view(np.uint64), group["set"].map(len).to_numpy(np.int64)
        kept = _unlike(flat, sizes, percent)
        flat, sizes = flat[ragged((np.cumsum(sizes) - sizes)[kept], sizes[kept])], sizes[kept]
        costs = []
        for m, deletions in plan.options(band):
            _, key, role = signatures(flat, sizes, Plan(percent).choose({band: (m, deletions)}), frequent)
            _, run, times = np.unique(key, return_inverse=True, return_counts=True)
            met = (times > 1) & (np.bincount(run, (role & 1) == 1) > 0)
            pairs = (times[met] * (times[met] - 1) / 2).sum() / len(sizes) * (total * scale / len(sizes))
            rows = len(key) / len(sizes)
            costs.append((rows + MEETING * min(rows, 2 * pairs), m, deletions))
        _, m, deletions = min(costs)
        return pd.DataFrame({"band": [band], "m": [m], "deletions": [deletions]})

    found = drawn.mapInArrow(sets, "band long, doc_id long, set array<long>").where("band >= 0").groupBy("band").applyInPandas(weigh, "band int, m int, deletions boolean")
    return plan.choose({r["band"]: (r["m"], r["deletions"]) for r in found.collect()})


def _signed(documents: DataFrame, n: int, plan: Plan, frequent: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """key, doc_id, tag: the signatures of each document whose set is new to its task.  A tag is 4 * part + role; buckets of ``hot`` keys are dealt out in so many parts from 1, the others are part 0."""
    hot_keys = np.array(sorted(hot), dtype=np.int64)
    shared = documents.sparkSession.sparkContext.broadcast((plan, frequent, hot_keys, np.array([hot[k] for k in sorted(hot)], dtype=np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        plan, frequent, hot_keys, parts = shared.value
        for some, flat, sizes in _chunks(batches, n, Words()):
            if len(seen) > 200_000:
                seen.clear()
            end = np.cumsum(sizes)
            new = np.zeros(len(sizes), bool)
            for i, (e, k) in enumerate(zip(end, sizes, strict=True)):
                if k and (same := xxhash.xxh3_128_digest(flat[e - k : e].tobytes())) not in seen:
                    seen.add(same)
                    new[i] = True
            doc = some["doc_id"].to_numpy(zero_copy_only=False)[new]
            place, key, role = signatures(flat[np.repeat(new, sizes)], sizes[new], plan, frequent)
            key, doc, tag = key.view(np.int64), doc[place], role.astype(np.int32)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                split = hot_keys[at] == key
                tag[split] += 4 * (1 + mixed(doc[split].view(np.uint64) ^ key[split].view(np.uint64)) % parts[at[split]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(tag)], ["key", "doc_id", "tag"])

    return documents.mapInArrow(run, "key long, doc_id long, tag int")


def _hot(drawn: DataFrame, n: int, plan: Plan, frequent: np.ndarray, scale: float) -> dict[int, int]:
    """Keys whose buckets the sample shows to be larger than PART, and the parts to deal each out in."""
    least = max(10, PART / scale)
    found = _signed(drawn, n, plan, frequent, {}).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return {r["key"]: int(1 + r["n"] * scale // PART) for r in found.orderBy(F.desc("n"), "key").limit(MOST).collect()}


def _stars(signed: DataFrame) -> DataFrame:
    """From signatures: pairs (a, b) with each bucket's representative, and the rows of buckets of three or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, parted = [], 0, None
        for b in batches:
            held.append([b[c].to_numpy() for c in ("key", "doc_id", "tag")])
            size += b.num_rows
            if size < PART:
                continue
            key, doc, tag = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1], side="left"))
            # the last bucket may go on; one that is all there is, is settled as far as it came, and a row of it links that to the rest
            if last:
                yield from _bucket_pairs(key[:last], doc[:last], tag[:last], parted)
                held = [[key[last:], doc[last:], tag[last:]]]
            else:
                yield from _bucket_pairs(key, doc, tag, parted := key[0])
                at = int(np.argmin(tag & 2))
                held = [[key[at : at + 1], doc[at : at + 1], tag[at : at + 1]]]
            size = len(held[0][0])
        if held:
            yield from _bucket_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)), parted)

    dealt = signed.repartition("key", F.shiftright("tag", 2))
    return dealt.sortWithinPartitions("key").mapInArrow(run, "kind int, key long, a long, b long")


def _bucket_pairs(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, parted: int | None = None) -> Iterator[pa.RecordBatch]:
    """Star pairs, and rows of buckets of three or more, of whole buckets.

    Of one that comes in parts (``parted`` is its key, or its tags have parts) all rows go on, as
    other parts may have what they meet.
    """
    if not len(key):
        return
    if (tag > 3).any():
        by = np.lexsort((tag >> 2, key))
        key, doc, tag = key[by], doc[by], tag[by]
    part, role = tag >> 2, tag & 3
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    some = (part[starts] > 0) | (key[starts] == parted if parted is not None else False)
    probes, whole = (np.add.reduceat(x.astype(np.int64), starts) > 0 for x in ((role & 1) == 1, role < 2))
    live = (sizes > 1) & probes & whole | some
    keep = np.repeat(live, sizes)
    if not live.any():
        return
    key, doc, role, sizes, some = key[keep], doc[keep], role[keep], sizes[live], some[live]
    run = np.repeat(np.arange(len(sizes)), sizes)
    # the representative: the whole segment with the least hash, one of four orders by key
    order = mixed((doc.view(np.uint64) << np.uint64(2)) + (key.view(np.uint64) & np.uint64(3)))
    order[role >= 2] = M64
    first = np.lexsort((order, run))[np.cumsum(sizes) - sizes]
    rep = doc[first][run]
    pair = rep != doc
    pairs = np.unique(np.stack([np.minimum(rep, doc)[pair], np.maximum(rep, doc)[pair]], 1), axis=0)
    more = ((sizes > 2) | some)[run]
    none = np.zeros(len(pairs), np.int64)
    columns = [np.r_[none, np.ones(more.sum(), np.int64)].astype(np.int32), np.r_[none, key[more]], np.r_[pairs[:, 0], doc[more]], np.r_[pairs[:, 1], role[more].astype(np.int64)]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "a", "b"])


def _bounded(pairs: DataFrame, classes: DataFrame, sketch: str, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the threshold: a, b, size_a, size_b.

    Of sketches of different widths the wider one is folded; sets without a sketch pass.
    """
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col(sketch).alias(f"sketch_{x}"))
    known = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    close = F.lit(percent) * F.greatest("size_a", "size_b") <= 100 * F.least("size_a", "size_b")
    half = lambda x: F.size(x) / 2
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x).cast("int")), F.slice(x, half(x).cast("int") + 1, half(x).cast("int")), lambda u, v: u.bitwiseXOR(v))
    as_wide = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
    differ = F.zip_with(as_wide("sketch_a", "sketch_b"), as_wide("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    # |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|) for a linked pair
    allowed = bits * (100 + percent) <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    return known.where(close).where((F.size("sketch_a") == 0) | (F.size("sketch_b") == 0) | allowed).select("a", "b", "size_a", "size_b")


def _some(table: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id with a checkpointed table of ids, which is broadcast if it is small."""
    return table.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", how)


def _sets_of(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, set: the shingles of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, flat, sizes in _chunks(batches, n, Words()):
            yield pa.RecordBatch.from_arrays([some["doc_id"], _lists(flat, sizes)], ["cls", "set"])

    texts = _some(documents.select("doc_id", "text"), cut(wanted), "left_semi").dropDuplicates(["doc_id"])
    return texts.mapInArrow(run, "cls long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, size_a, size_b) whose sets reach the threshold: a, b."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    common = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("n"))
    return cut(common.where(100 * F.col("n") >= percent * (F.col("size_a") + F.col("size_b") - F.col("n"))).select("a", "b"))


COLUMNS = ("key", "cls", "role", "component", "size", "sketch")


def _possible(i: np.ndarray, j: np.ndarray, role, size, bits, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) have a probe and pass the bounds."""
    probe = (role[j] == 1) | (role[i] == 1) | (np.maximum(role[j], role[i]) == 3) & (np.minimum(role[j], role[i]) == 0)
    at = np.flatnonzero(probe & (percent * np.maximum(size[j], size[i]) <= 100 * np.minimum(size[j], size[i])))
    apart = np.bitwise_count(bits[j[at]] ^ bits[i[at]]).sum(1, dtype=np.int64)
    return at[apart * (100 + percent) <= (100 - percent) * (size[j[at]] + size[i[at]])]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of buckets of ``n`` members in blocks: each row once for every pair of blocks (x, y) that it takes part in, and whether it is on x's side."""
    count = F.ceil(F.col("n") / size).cast("int")
    dealt = rows.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("cls", "role"), F.col("count")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return met.select(*COLUMNS, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"))


def _apart(component: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in different components, a place against many at a time: of one side, or between two.

    Each component meets the rest from its smaller side, so a component of nearly all members costs no more than the others.
    """
    if not len(left):
        return
    names, which, counts = np.unique(component[left], return_inverse=True, return_counts=True)
    order = np.argsort(counts[which] * (len(names) + 1) + which, kind="stable")
    left, which = left[order], which[order]
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(left)], strict=True):
        ours = left[s:e]
        others = left[e:] if right is None else right[component[right] != component[ours[0]]]
        few, many = (ours, others) if len(ours) <= len(others) else (others, ours)
        for k in few:
            yield np.full(len(many), k), many


def _meet(rows: DataFrame, percent: int, *, leaders: int = 0) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of bucket members in different components that pass the bounds, from rows of COLUMNS and n, the members of their bucket.

    With ``leaders``, only pairs with one of so many members of each bucket (or of a block of it).
    """

    def ordered(i: np.ndarray, j: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        swap = cls[i] > cls[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": cls[i], "b": cls[j], "size_a": size[i], "size_b": size[j]}).drop_duplicates()

    def led(component: np.ndarray, s: int, e: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in s + np.sort(np.unique(component[s:e], return_index=True)[1])[:leaders]:
            many = s + np.flatnonzero(component[s:e] != component[k])
            yield np.full(len(many), k), many

    def pairs(b: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        _, cls, role, component, size = (b[c].to_numpy() for c in COLUMNS[:5])
        bits = np.stack(b["sketch"].to_numpy()).view(np.uint64)
        across, on_left = (b["x"] != b["y"]).to_numpy(), b["left"].to_numpy()
        left, right, held = [], [], 0
        for s, e in zip(starts, np.r_[starts[1:], len(b)], strict=True):
            sides = (s + np.flatnonzero(on_left[s:e]), s + np.flatnonzero(~on_left[s:e])) if across[s] else (np.arange(s, e), None)
            for i, j in led(component, s, e) if leaders else _apart(component, *sides):
                at = _possible(i, j, role, size, bits, percent)
                left.append(i[at])
                right.append(j[at])
                held += len(at)
                if held > 200_000:
                    yield ordered(np.concatenate(left), np.concatenate(right), cls, size)
                    left, right, held = [], [], 0
        if held:
            yield ordered(np.concatenate(left), np.concatenate(right), cls, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key, x, y = (b[c].to_numpy() for c in ("key", "x", "y"))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(b) else np.zeros(1, int)
            last = int(starts[-1])
            rest, done = b.iloc[last:], b.iloc[:last]
            if last:
                yield from pairs(done, starts[:-1])
        if rest is not None and len(rest):
            yield from pairs(rest, np.zeros(1, int))

    dealt = _blocks(rows, BLOCK)
    dealt = (dealt.where("x = y") if leaders else dealt).repartition("key", "x", "y")
    return dealt.sortWithinPartitions("key", "x", "y").mapInPandas(run, "a long, b long, size_a long, size_b long").distinct()


def _named(documents: DataFrame, sized: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Documents and sets whose doc_id names one text: a new id stands for (doc_id, text) if an id is null or has several."""
    texts = sized.where("n_shingles > 0").groupBy("doc_id").agg(F.min("th").alias("x"), F.max("th").alias("y"))
    if not texts.where("doc_id IS NULL OR x <> y").limit(1).count():
        return documents.where("doc_id IS NOT NULL"), sized.withColumn("told", F.col("doc_id")), False
    names = cut(cut(sized.select(F.col("doc_id").alias("told"), "th").distinct()).withColumn("name", F.monotonically_increasing_id()))

    def renamed(df: DataFrame) -> DataFrame:
        d = df.withColumnRenamed("th", "th_")
        return d.join(names, d["doc_id"].eqNullSafe(names["told"]) & (d["th_"] == names["th"])).drop("doc_id", "th_").withColumnRenamed("name", "doc_id")

    return renamed(documents).select("doc_id", "th", "text"), cut(renamed(sized)), True


def _labelled(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, bool]:
    """doc_id, th, n_shingles, component_id, and whether the row is the one of its component that stays; and whether doc_id alone doesn't name a text."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    documents, sized, renamed = _named(documents, cut(_sets(documents, n)))
    first = sized.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("cls"))
    members = cut(sized.join(first, "same", "left").select("doc_id", "told", "th", "n_shingles", F.coalesce("cls", "doc_id").alias("cls"), *(F.when(F.coalesce("cls", "doc_id") == F.col("doc_id"), F.col(c)).alias(c) for c in ("sketch", "wide"))))
    words = SKETCH // 64
    folded = F.array(*(F.expr(" ^ ".join(f"sketch[{i + 4 * k}]" for k in range(words // 4))) for i in range(4)))
    classes = cut(members.where("sketch IS NOT NULL AND n_shingles > 0").dropDuplicates(["cls"]).select("cls", F.col("n_shingles").alias("size"), "sketch", "wide", folded.alias("folded")))
    moved = members.where("doc_id <> cls").select("doc_id", F.col("cls").alias("of")).distinct()

    total = members.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = cut(documents.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1e6))
    frequent = _frequent(drawn, n)
    plan = _chosen(drawn, n, percent, frequent, 1 / share)
    found = cut(_stars(_signed(documents, n, plan, frequent, _hot(drawn, n, plan, frequent, 1 / share))))

    def of_class(df: DataFrame, name: str) -> DataFrame:
        return df.join(moved.withColumnsRenamed({"doc_id": name, "of": "__of"}), name, "left").withColumn(name, F.coalesce("__of", name)).drop("__of")

    pairs = of_class(of_class(found.where("kind = 0").select("a", "b"), "a"), "b").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = _bounded(_bounded(pairs, classes, "folded", percent), classes, "sketch", percent)
    stars = cut(_bounded(stars, classes, "wide", percent))
    rows = cut(of_class(found.where("kind = 1").select("key", F.col("a").alias("cls"), F.col("b").alias("role")), "cls").distinct())
    linked = _verified(stars, _sets_of(documents, stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct(), n), percent)
    joined = cut(connected_components(linked, "a", "b"))
    # members of one bucket that are still apart meet: first its leaders, which joins what most of a group of near copies has in common, then each other
    for leaders in (LEADERS, 0):
        now = rows.join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        apart = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", "n")
        rows = cut(now.join(apart, "key").select("key", "cls", "role", "component", "n"))
        met = cut(_bounded(_meet(rows.join(classes, "cls").select(*COLUMNS, "n"), percent, leaders=leaders), classes, "wide", percent))
        rows = rows.select("key", "cls", "role")
        more = _verified(met, _sets_of(documents, met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct(), n), percent)
        # the new links join components
        to = joined.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        ends = more.join(to, "a", "left").join(to.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left")
        edges = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(ends.select(F.coalesce("ca", "a"), F.coalesce("cb", "b")).union(more))
        joined = cut(connected_components(edges, "a", "b"))
    out = members.join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    if not renamed:
        return out.select("doc_id", "th", "n_shingles", F.col("component").alias("component_id"), F.expr("doc_id <=> component").alias("stays")), False
    least = out.groupBy("component").agg(F.min(F.struct(F.col("told").isNull(), "told", "doc_id")).alias("least"))
    out = out.join(least, "component").withColumn("stays", F.col("doc_id") == F.col("least.doc_id"))
    return out.select(F.col("told").alias("doc_id"), "th", "n_shingles", F.col("least.told").alias("component_id"), "stays"), True


def components(documents: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    return _labelled(documents, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def deduplicated(documents: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """The document of each component with the smallest id (null ids come last), with all its repeated rows."""
    labelled, renamed = _labelled(documents, n, percent)
    gone = cut(labelled.where("NOT stays").select("doc_id", "th").distinct())
    if not renamed:
        return _some(documents, gone.select("doc_id"), "left_anti").select(*documents.columns)
    left = documents.withColumn("__th", F.xxhash64("text"))
    return left.join(gone, left["doc_id"].eqNullSafe(gone["doc_id"]) & (left["__th"] == gone["th"]), "left_anti").select(*documents.columns)
