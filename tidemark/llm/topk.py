"""Exact top-k by inner product with a pivot table.

The pivot table holds what every vector's distances to a fixed set of pivots, computed once, say of
its place: together with its norm they fix its coordinates in the space that the pivots span and its
distance from that space.  Two vectors with the coordinates a and b and the distances r and s from
it have at least the distance that |a - b|^2 + (r - s)^2 gives; no larger lower bound follows from
the distances to all pivots, so this is the largest of any (it is never less than the difference of
two distances to one pivot).  For inner products it reads <q,x> <= <a,b> + r s.  A query takes
candidates in the order of these bounds and stops when the next bound is under its k-th score, so no
candidate that could enter is left out.

Vectors are dealt out in blocks by their nearest pivot, queries likewise.  First each query meets
one block of its own neighbourhood; its k-th score there goes along to all others.  A pair of a
block of queries and a block of vectors is left out if the ranges of their coordinates show that no
score can reach; each other pair is a group of its own, of bounded size.

Pivots are a bounded sample (PIVOTS vectors, farthest-first out of SAMPLE rows with the smallest
hashes); they change the work, never the result.

Vectors that are null or hold null or non-finite components take no part; nor do null ids as
queries.  Equal scores go to the smaller id, null ids last.  A repeated row is a candidate of its
own; a query's own row is left out.  Query rows of equal id and vector are one query; those of one
id with different vectors are queries of their own, each with its own k rows.  Vectors of different
lengths meet with the missing components as 0.  Integer scores are exact up to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices

PIVOTS, SAMPLE = 48, 2_000
#: Rows of a block of vectors, and of a block of queries; queries whose bounds are held at once.
VECTORS, QUERIES, TOGETHER = 4_096, 2_048, 256
OUT = "query long, query_id long, vec_id long, score long"


def quantised(embedding: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    x = F.col(embedding)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & sound, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _pivots(vectors: DataFrame) -> np.ndarray:
    """Far-apart vectors out of a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(SAMPLE).select("q").toPandas()["q"]
    if not len(rows):
        return np.zeros((0, 0))
    x = _matrix(rows, max(map(len, rows)))
    chosen = [0]
    least = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, pivots))
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T)))


def spanned(pivots: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the pivots span, as columns."""
    if not len(pivots):
        return np.zeros((pivots.shape[1], 0))
    basis, sizes, _ = np.linalg.svd(pivots.T, full_matrices=False)
    return basis[:, sizes > 1e-9 * max(sizes[0], 1e-300)]


def coordinates(x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the span, and distances from it."""
    width = max(x.shape[1], len(basis))
    at = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ np.pad(basis, ((0, width - len(basis)), (0, 0)))
    return at, np.sqrt(np.maximum(0, (x * x).sum(1) - (at * at).sum(1)))


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, q, at (coordinates by the pivots), rest (distance from their span), near (the nearest pivot); kept in the shared folder."""
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, spanned(pivots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, basis = shared.value
        for batch in slices(batches, 2_000):
            rows = batch["q"].to_pylist()
            x = _matrix(rows, max(map(len, rows)))
            at, rest = coordinates(x, basis)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], flat, pa.array(rest), pa.array(_distances(x, pivots).argmin(1).astype(np.int32))], ["vec_id", "q", "at", "rest", "near"])

    table = vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, q array<long>, at array<double>, rest double, near int")
    return cut(cut(table).withColumn("row", F.monotonically_increasing_id()))


#: What rounding may take off a bound, as a share of the product of norms, and as such.
SLACK, LEAST = 1e-9, 1e-3


def bounds(q_at: np.ndarray, q_rest: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) and vectors (columns)."""
    norms = np.sqrt((q_at * q_at).sum(1) + q_rest**2)[:, None] * np.sqrt((at * at).sum(1) + rest**2)[None]
    return q_at @ at.T + q_rest[:, None] * rest[None] + SLACK * norms + LEAST


def best(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf, step: int = 256) -> tuple[np.ndarray, int]:
    """Positions of the k best candidates of one query whose scores are not under ``floor``, and how many were evaluated."""
    order = np.flatnonzero((bound >= floor) & (bound > -np.inf))
    order = order[np.argsort(-bound[order], kind="stable")]
    at, score, done = np.zeros(0, dtype=np.int64), np.zeros(0), 0
    while done < len(order) and (len(at) < k or bound[order[done]] >= score[-1]):
        more = order[done : done + step]
        done += len(more)
        at, score = np.concatenate([at, more]), np.concatenate([score, x[more] @ q])
        keep = np.lexsort((ids[at], -score))[:k]
        at, score = at[keep], score[keep]
    return at[score >= floor], done


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block of vectors for each query of a block (with its ``floor``): OUT."""
    found = []
    right = right.rename(columns=lambda c: c.removeprefix("x_"))
    if len(left) and len(right):
        width = max(*map(len, left["q"]), *map(len, right["q"]))
        x, ids = _matrix(right["q"].to_numpy(), width), right["vec_id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        absent, row, at_all, rest = right["vec_id"].isna().to_numpy(), right["row"].to_numpy(), np.stack(right["at"].to_numpy()), right["rest"].to_numpy()
        for start in range(0, len(left), TOGETHER):
            part = left.iloc[start : start + TOGETHER]
            qs = _matrix(part["q"].to_numpy(), width)
            upper = bounds(np.stack(part["at"].to_numpy()), part["rest"].to_numpy(), at_all, rest)
            for i, (own, query, floor) in enumerate(zip(part["row"], part["vec_id"], part["floor"], strict=True)):
                upper[i, row == own] = -np.inf
                at, _ = best(qs[i], upper[i], x, ids, k, floor)
                found.append(pd.DataFrame({"query": own, "query_id": int(query), "vec_id": pd.array([None if absent[j] else ids[j] for j in at], dtype="Int64"), "score": (x[at] @ qs[i]).astype(np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in OUT.split(", ")})


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """The rows with a block number: about ``size`` rows of the same or neighbouring pivots."""
    counts = {r["near"]: r["count"] for r in rows.groupBy("near").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // size))
    if not counts:
        return rows.withColumn(name, F.lit(0)), 1
    starts, start = {}, 0
    for near in sorted(counts):
        starts[near] = start
        start += counts[near]
    of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col("near")]
    place = of(starts) + F.pmod(F.xxhash64("row", F.lit(7)), of(counts))
    return rows.withColumn(name, F.floor(place * blocks / start).cast("int")), blocks


def _ranges(rows: DataFrame, name: str, width: int) -> DataFrame:
    """Of each block: the least and the largest of each coordinate, and the largest distance from the span."""
    low, high = (F.array(*(f(F.col("at")[p]) for p in range(width))) if width else F.array().cast("array<double>") for f in (F.min, F.max))
    return rows.groupBy(name).agg(low.alias(f"{name}_low"), high.alias(f"{name}_high"), F.max("rest").alias(f"{name}_rest"))


def _other(table: DataFrame, *columns: str) -> DataFrame:
    """The columns under names of their own, as both sides of a cogroup come from one table."""
    return table.select(*(F.col(c).alias(f"x_{c}") for c in columns))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` (vec_id, q) with the highest scores for each of those that are queries."""
    pivots = _pivots(vectors)
    table, _ = _dealt(pivot_table(vectors, pivots), VECTORS, "vb")
    queries, _ = _dealt(table.where(F.col("vec_id").isNotNull() & is_query).dropDuplicates(["vec_id", "q"]).drop("vb"), QUERIES, "qb")
    queries = cut(queries.join(table.select("row", "vb"), "row"))
    side = ["row", "vec_id", "q", "at", "rest"]
    first = queries.select("vb", *side, F.lit(float("-inf")).alias("floor")).groupBy("vb").cogroup(_other(table, "vb", *side).groupBy("x_vb"))
    at_home = first.applyInPandas(lambda a, b: _search(a, b, k), OUT).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    queries = cut(queries.drop("vb").join(at_home.withColumnRenamed("query", "row"), "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))

    width = spanned(pivots).shape[1]
    asked = _ranges(queries, "qb", width).join(queries.groupBy("qb").agg(F.min("floor").alias("least")), "qb")
    ends = F.arrays_zip("qb_low", "qb_high", "vb_low", "vb_high")
    most = F.aggregate(ends, F.lit(0.0), lambda a, x: a + F.greatest(*(x[q] * x[v] for q in ("qb_low", "qb_high") for v in ("vb_low", "vb_high"))))
    largest = F.aggregate(ends, F.lit(0.0), lambda a, x: a + F.greatest(*(F.abs(x[q] * x[v]) for q in ("qb_low", "qb_high") for v in ("vb_low", "vb_high"))))
    rests = F.col("qb_rest") * F.col("vb_rest")
    # blocks against blocks: a pair stays unless its ranges exclude it
    pairs = asked.join(_ranges(table, "vb", width), most + rests + 2 * SLACK * (largest + rests) + LEAST >= F.col("least")).select("qb", "vb")
    pairs = cut(pairs)
    left = queries.join(pairs, "qb").select("qb", "vb", *side, "floor").groupBy("qb", "vb")
    right = _other(table.join(pairs, "vb"), "qb", "vb", *side).groupBy("x_qb", "x_vb")
    local = left.cogroup(right).applyInPandas(lambda a, b: _search(a, b, k), OUT)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(embeddings: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of the rows whose id is divisible by ``every``, against all rows."""
    vectors = embeddings.select(F.col("vec_id"), quantised().alias("q")).where("q IS NOT NULL")
    return top_k(vectors, F.col("vec_id") % every == 0, k=k)
