"""Embedding near-duplicates by counting collisions in one-dimensional projections.

Unit vectors of one label are projected on many orthonormal directions.  In each the block's vectors
are sorted, and a vector's window holds those whose projection is within ``w`` of its own.  A pair
collides once for each window of its first vector that holds the second one; pairs that reach a count
are verified by their cosine in double precision.

The count is calibrated so that no pair can be lost: two unit vectors of cosine c are sqrt(2 - 2c)
apart, and the squares of their differences in orthonormal directions add up to no more than that
squared.  So with w^2 just over (2 - 2c) / (m + 1) at most m directions miss, and a linked pair
collides in the others.  With a quarter of the directions as m, a random pair of 64 components is some
5 standard deviations short of the count.

Of each label every vector meets every other one, whatever its size, so no link is lost.  A label is cut
into blocks of BLOCK vectors, or of EXACT beyond that many.  A block is stored once, its vectors as the
bytes of one value, and the blocks of a label meet by a Cartesian join of what is stored: nothing is
shuffled for a pair of blocks, and a task holds 2 blocks whatever a label, cluster or copy holds.  Pairs
never leave a task: it sends on, for each vector, how many it links and one edge to the smallest of what
it is connected with.

Equal vectors of a label are one vector with a number (told apart by 128-bit hashes).  Vectors that are
null, zero or hold null or non-finite components, and those of a null label, link with nothing; those
of different lengths don't link.  Repeated rows are vectors of their own.  A row with a null id links
like others; the smallest id of a component ignores it, and it isn't kept where an id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import apart, cut
from tidemark.operators.graph import connected_components

THRESHOLD = 0.93
#: Projections at most, and the share of them that may miss.
PROJECTIONS, MISSES = 128, 4
#: Vectors of a block in a label of up to EXACT different ones, and of one in a larger label; vectors whose windows are laid at once.
BLOCK, EXACT, TOGETHER = 2_048, 8_192, 256
#: Labels whose number of blocks is broadcast at most; partitions that one side of the blocks is dealt out in at least, over those of the other; blocks of such a partition at most.
FEW, TASKS, SIDE = 500_000, 64, 8
LINKS = "row long, links long, root long"


def with_units(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, u: the vectors over their norms in double precision; null where they take no part."""
    d = apart(embeddings.select("vec_id", "label", "embedding"), x=F.transform("embedding", lambda v: v.cast("double")))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.col("label").isNotNull()
    d = apart(d.drop("embedding"), x=F.when(sound, F.col("x")), most=F.array_max(F.transform("x", F.abs)))
    d = apart(d, x=F.when(F.col("most") > 0, F.transform("x", lambda v: v / F.col("most") + F.lit(0.0))))
    d = apart(d, norm=F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))
    return d.select("vec_id", "label", F.transform("x", lambda v: v / F.col("norm")).alias("u"))


def directions(width: int) -> np.ndarray:
    """Orthonormal directions as columns, the same for every task."""
    basis, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return basis[:, :PROJECTIONS]


def calibrated(projections: int, threshold: float) -> tuple[float, int]:
    """The half width of a window, and the collisions that no pair of at least this cosine falls short of."""
    misses = projections // MISSES
    return math.sqrt((2 - 2 * threshold) / (misses + 1)) * (1 + 1e-6) + 1e-12, projections - misses


def collisions(left: np.ndarray, right: np.ndarray, w: float) -> np.ndarray:
    """How many windows of each left row hold each right row; columns are projections."""
    counts = np.zeros((len(left), len(right)), dtype=np.uint8)
    kind = np.uint16 if len(right) < 1 << 16 else np.uint32
    for q, x in zip(left.T, right.T, strict=True):
        order = np.argsort(x, kind="stable")
        rank = np.empty(len(x), dtype=kind)
        rank[order] = np.arange(len(x), dtype=kind)
        start, end = np.searchsorted(x[order], q - w, "left").astype(kind), np.searchsorted(x[order], q + w, "right").astype(kind)
        # unsigned: a rank before the window's start is larger than any width
        counts += (rank[None] - start[:, None]) < (end - start)[:, None]
    return counts


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) of unit vectors with at least this cosine."""
    basis = directions(left.shape[1])
    w, least = calibrated(basis.shape[1], threshold)
    p, q = left @ basis, right @ basis
    found = []
    for start in range(0, len(left), TOGETHER):
        some = left[start : start + TOGETHER]
        passed = collisions(p[start : start + TOGETHER], q, w) >= least
        if passed.mean() > 0.05:
            i, j = np.nonzero(passed & (some @ right.T >= threshold))
        else:
            i, j = np.nonzero(passed)
            sure = np.einsum("ij,ij->i", some[i], right[j]) >= threshold
            i, j = i[sure], j[sure]
        found.append((i + start, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stored(table: pa.Table) -> pa.Table:
    """A block as one row."""
    one = {c: table[c][:1] for c in ("label", "d", "block", "blocks")}
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("row", "n")}
    return pa.table(one | lists | {"u": pa.array([table["u"].combine_chunks().flatten().to_numpy().tobytes()], pa.binary())})


def _meet(threshold: float):
    def side(batch: pa.RecordBatch, k: int, of: str) -> tuple[np.ndarray, ...]:
        row, n = (batch[of + c][k].values.to_numpy() for c in ("row", "n"))
        return row, n, np.frombuffer(batch[of + "u"][k].as_buffer()).reshape(len(row), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (left, n_left, a), (right, n_right, b) = side(batch, k, "a"), side(batch, k, "b")
                same = batch["ablock"][k].as_py() == batch["bblock"][k].as_py()
                row, times, ahead = (left, n_left, 0) if same else (np.r_[left, right], np.r_[n_left, n_right], len(left))
                order = np.argsort(row, kind="stable")
                place = np.empty(len(row), dtype=np.int64)
                place[order] = np.arange(len(row))
                links, edges = np.zeros(len(row)), [(place[:0], place[:0])]
                for start in range(0, len(a), BLOCK // 2):  # so many rows at a time, as all pairs of two blocks may link
                    i, j = linked(a[start : start + BLOCK // 2], b, threshold)
                    i, j = i + start, j + ahead
                    i, j = (i[i < j], j[i < j]) if same else (i, j)
                    links += np.bincount(i, times[j], len(row)) + np.bincount(j, times[i], len(row))
                    least = roots(place[i], place[j], len(row))
                    moved = np.flatnonzero(least != np.arange(len(row)))
                    edges.append((moved, least[moved]))
                root = row[order][roots(*(np.concatenate(x) for x in zip(*edges, strict=True)), len(row))[place]]
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["row", "links", "root"])

    return run


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """LINKS: partial counts and edges of the vectors (row, label, d, n, u) that link with any; all pairs of a label are compared."""
    size = F.when(F.col("count") <= EXACT, F.lit(BLOCK)).otherwise(F.lit(EXACT))
    sizes = cut(vectors.groupBy("label", "d").count().where("count > 1").select("label", "d", F.ceil(F.col("count") / size).cast("int").alias("blocks")))
    labels, blocks, several = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("blocks") > 1, F.col("blocks"))), F.lit(0))).first()
    key = ["label", "d", "block"]
    placed = vectors.join(F.broadcast(sizes) if labels <= FEW else sizes, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    kind = vectors.schema["label"].dataType.simpleString()
    # a number of partitions of its own: few large blocks stay apart, so all cores have some
    dealt = placed.repartition(max(1, min(blocks, 400)), *key)
    stored = cut(dealt.groupBy(*key).applyInArrow(_stored, f"label {kind}, d int, block int, blocks int, row array<long>, n array<long>, u binary"))
    side = lambda d, *into: d.select(*(F.col(c).alias(i + c) for i in into for c in (*key, "row", "n", "u")))
    found = side(stored.where("blocks = 1"), "a", "b").mapInArrow(_meet(threshold), LINKS)
    if several:
        large, by = stored.where("blocks > 1"), F.xxhash64(*key)
        a = side(large.repartitionByRange(min(several, 2_000), by), "a")
        b = side(large.repartitionByRange(min(several, max(-(-TASKS // several), -(-several // SIDE))), by), "b")
        same = (F.col("alabel") == F.col("blabel")) & (F.col("ad") == F.col("bd")) & (F.col("ablock") <= F.col("bblock"))
        found = found.union(a.join(b.hint("shuffle_replicate_nl"), same).mapInArrow(_meet(threshold), LINKS))
    return found


def near_duplicates(embeddings: DataFrame, *, threshold: float = THRESHOLD, recall: float = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``embeddings``.

    ``recall`` steered an earlier way that lost links of large labels; it is taken and not used.
    """
    rows = with_units(embeddings).withColumns({"k1": F.xxhash64("u"), "k2": F.xxhash64(F.lit(1), F.reverse("u")), "d": F.size("u")})
    key = ["label", "d", "k1", "k2"]
    classes = rows.where("u IS NOT NULL").groupBy(*key).agg(F.first("u").alias("u"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = cut(cut(classes).withColumn("row", F.monotonically_increasing_id()))
    found = cut(links(classes, threshold))
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("row <> root"), "row", "root")
    held = classes.join(counts, "row", "left").join(parts.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    smallest = held.groupBy("component").agg(F.min("least").alias("component_id"))
    held = held.join(smallest, "component").select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = F.col("u").isNull()
    out = rows.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.union(rows.where(~alone).drop("u").join(held, key).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
