"""Sparse feature rows (indices, values), the classical feature sets, and averaged stochastic descent on them.

A feature row is two arrays: places in ascending order, and their values; all other places are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sequences as B
from tidemark.operators.contracts import ContractError
from tidemark.operators.models import class_weights
from tidemark.operators.shared import reliable

#: Rows of a shard, which one task passes; rows of a step; models that come to the driver at once.
SHARD, STEP, TOGETHER = 50_000, 16, 16


def dense_row(*values: Column) -> list[Column]:
    """Indices and values of a row of a few columns."""
    return [F.sequence(F.lit(0), F.lit(len(values) - 1)).alias("indices"), F.array(*(v.cast("double") for v in values)).alias("values")]


def kmer_rows(df: DataFrame, key: str, s: str, sizes: range = range(1, 7), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, indices, values: shares of the k-mers of valid bases, each size for itself; places by size, then by letter."""
    first = {k: sum(4**j for j in range(sizes[0], k)) for k in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                places, shares, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
                for text in part[1].to_pylist():
                    n = 0
                    for k, at, counts in B.kmer_codes(text, sizes):
                        places.append(at + first[k])
                        shares.append(counts / max(1, counts.sum()))
                        n += len(at)
                    ends.append(ends[-1] + n)
                offsets = pa.array(np.array(ends, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part[0], *part.columns[2:], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(shares)))], [key, *keep, "indices", "values"])

    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(key, s, *keep).mapInArrow(run, f"{kept}, indices array<int>, values array<double>")


def codon_rows(df: DataFrame, key: str, s: str) -> DataFrame:
    """key, indices, values: shares of the codons of valid bases in frame that occur, by letter, then the GC shares of the three codon positions at places 64 to 66."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = [], []
            for text in batch[1].to_pylist():
                base = B.bases(text)
                frame = base[: len(base) // 3 * 3].reshape(-1, 3)
                frame = frame[(frame >= 0).all(axis=1)]
                n = np.bincount(frame @ np.array([16, 4, 1]), minlength=64)
                held = np.flatnonzero(n)
                at = [base[p::3] for p in range(3)]
                gc = [float(np.isin(x, (1, 2)).sum() / max(1, (x >= 0).sum())) for x in at]
                indices.append([*held.tolist(), 64, 65, 66])
                values.append([*(n[held] / max(1, len(frame))).tolist(), *gc])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], [key, "indices", "values"])

    return df.select(key, s).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, indices array<int>, values array<double>")


def classical_sets(cohort: DataFrame, records: DataFrame, key: str, s: str) -> DataFrame:
    """key, representation, width, indices, values: the six classical feature sets of exactly the cohort's keys.

    length, gc, length_gc, codon_67 (shares of the codons in frame and GC by codon position), aa20
    (composition of the protein), kmer_1_6.  A key of the cohort without a record is an error; so is a
    repeated key.
    """
    if records.groupBy(key).count().where("count > 1").limit(1).count():
        raise ContractError(f"records repeat a {key}")
    if n := cohort.join(records, key, "left_anti").count():
        raise ContractError(f"{n} rows of the cohort have no record")
    rows = records.join(cohort.select(key).distinct(), key, "left_semi").select(key, F.upper(s).alias("s"))
    length, gc = F.length("s"), F.coalesce(B.nucleotide_quality(F.col("s"))["gc"], F.lit(0.0))
    codon = codon_rows(rows, key, "s")
    protein = rows.select(key, B.translated(F.col("s")).alias("p"))
    sets = {
        "length": (1, rows.select(key, *dense_row(length))), "gc": (1, rows.select(key, *dense_row(gc))), "length_gc": (2, rows.select(key, *dense_row(length, gc))), "codon_67": (67, codon),
        "aa20": (20, protein.select(key, *dense_row(*B.protein_composition(F.col("p")).values()))), "kmer_1_6": (5460, kmer_rows(rows, key, "s")),
    }
    return reduce(DataFrame.unionByName, (d.select(key, F.lit(name).alias("representation"), F.lit(width).alias("width"), "indices", "values") for name, (width, d) in sets.items()))


def scaled(df: DataFrame, train: Column, width: int) -> DataFrame:
    """Values over the population deviation of their place on the train rows, zeros included and not centred, so zeros stay; a constant place is left as it is.

    A task adds its rows up and sends a row for each place; the deviations are stored, so that the rows are passed for them once.
    """
    known = df.where(train)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                _, places, values = _matrix(batch, width)
                n += batch.num_rows
                s += np.bincount(places, values, minlength=width)[:width]
                q += np.bincount(places, values * values, minlength=width)[:width]
        at = np.flatnonzero((s != 0) | (q != 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(s[at], n)), pa.array(np.append(q[at], 0.0))], ["i", "s", "q"])

    sums = reliable(known.select("indices", "values").mapInArrow(added, "i int, s double, q double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")))  # place -1 holds the rows
    places = sums.where("i >= 0")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.col("s") * F.col("s") / F.col("n") / F.col("n")))
    found = places.crossJoin(F.broadcast(sums.where("i < 0").select(F.col("s").alias("n")))).select("i", F.when(deviation > 1e-12, deviation).otherwise(1.0).alias("d"))
    one = found.agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("__m"))  # a value for each place
    one = one.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(1.0))).alias("__d"))
    return df.crossJoin(F.broadcast(one)).withColumn("values", F.zip_with("indices", "values", lambda i, v: v / F.get("__d", i))).drop("__d")


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, indices and values of a batch's rows."""
    indices, values = batch["indices"], batch["values"]
    return indices.offsets.to_numpy() - indices.offsets[0].as_py(), indices.flatten().to_numpy(), values.flatten().to_numpy()


def averaged_sgd(df: DataFrame, key: str, label: str, train: Column, width: int, *, penalty: float = 1e-4, **how):
    """``averaged_sgds`` with one penalty; the weights and the class labels."""
    (model,), labels = averaged_sgds(df, key, label, train, width, (penalty,), **how)
    return model, labels


def averaged_sgds(df: DataFrame, key: str, label: str, train: Column, width: int, penalties: tuple[float, ...], *, epochs: int = 20, tolerance: float = 1e-4, shard: int = SHARD, seed: int = 0):
    """Multinomial regression with balanced class weights by averaged stochastic descent; the weights of each penalty and the class labels.

    Rows are dealt to shards of about ``shard`` rows by a hash of their key, and in each epoch a shard
    is passed in the order of another hash, from the model that the epoch starts with.  A shard's model
    is the mean of its steps' models, and the epoch's is the mean of the shards', weighted by their
    rows, so it depends on the rows and not on their partitions.  It stops when an epoch moves no
    weight by more than ``tolerance`` of the largest.  The last row of the weights is the intercept.
    The penalties share the stored rows, and the passes until they stop.
    """
    known = df.where(train)
    weights = class_weights(known, label).orderBy(F.col(label).cast("string")).collect()  # a row for each class
    labels = [str(r[label]) for r in weights]
    n = known.count()
    if not labels:
        return [np.zeros((width + 1, 0)) for _ in penalties], []
    shards = max(1, -(-n // shard))
    of = F.create_map(*(F.lit(x) for i, c in enumerate(labels) for x in (c, i)))
    rows = known.select(F.xxhash64(key, F.lit(seed)).alias("h"), F.get(F.array(*(F.lit(float(r["weight"])) for r in weights)), of[F.col(label).cast("string")]).alias("w"), of[F.col(label).cast("string")].alias("y"), "indices", "values")
    rows = reliable(rows.withColumn("shard", F.pmod("h", F.lit(shards))).repartition(shards, "shard"))
    norm = rows.agg(F.avg(F.aggregate("values", F.lit(1.0), lambda a, v: a + v * v))).first()[0] or 1.0
    rate = 1.0 / norm
    models = [np.zeros((width + 1, len(labels))) for _ in penalties]

    def epoch(start: np.ndarray, penalty: np.ndarray, number: int) -> np.ndarray:
        """The models after a pass, beside each other as in ``start``; their penalties, a column of a model each."""
        shared = df.sparkSession.sparkContext.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, w, mean, seen, step = None, shared.value.copy(), np.zeros_like(shared.value), 0, 0
            held, place = np.zeros(width, dtype=bool), np.zeros(width, dtype=np.int64)

            def sent() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([mean.tobytes()], pa.binary())], ["shard", "n", "model"])

            for batch in batches:
                starts, places, values = _matrix(batch, width)
                y, weight, own = batch["y"].to_numpy(), batch["w"].to_numpy(), batch["shard"].to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if now is not None and own[a] != now:
                        yield sent()
                        w, mean, seen, step = shared.value.copy(), np.zeros_like(shared.value), 0, 0
                    now = int(own[a])
                    for i in range(a, b, STEP):
                        j = min(i + STEP, b)
                        part = slice(starts[i], starts[j])
                        held[places[part]] = True
                        at = np.flatnonzero(held)
                        held[at], place[at] = False, np.arange(len(at))
                        x = np.zeros((j - i, len(at) + 1))
                        x[np.repeat(np.arange(j - i), np.diff(starts[i : j + 1])), place[places[part]]] = values[part]
                        x[:, -1] = 1
                        at = np.append(at, width)
                        z = (x @ w[at]).reshape(j - i, -1, len(labels))
                        p = np.exp(z - z.max(2, keepdims=True))
                        p /= p.sum(2, keepdims=True)
                        p[np.arange(j - i), :, y[i:j]] -= 1
                        pace = rate / (1 + rate * penalty * (number * shard / STEP + step))
                        w *= 1 - pace * penalty
                        w[at] -= pace * (x.T @ (p * weight[i:j, None, None]).reshape(j - i, -1)) / (j - i)
                        step += 1
                        mean += (w - mean) / step
                    seen += int(b - a)
            if now is not None:
                yield sent()

        def added(models: pd.DataFrame) -> pd.DataFrame:
            models = models.sort_values("shard")
            total = sum(k * np.frombuffer(m) for k, m in zip(models["n"], models["model"], strict=True))
            return pd.DataFrame({"shard": [int(models["shard"].iloc[0])], "n": [models["n"].sum()], "model": [total.tobytes()]})

        schema = "shard long, n long, model binary"
        passed = rows.sortWithinPartitions("shard", F.xxhash64("h", F.lit(number)), "h").select("shard", "y", "w", "indices", "values").mapInArrow(run, schema)
        sums = passed.groupBy(F.pmod("shard", F.lit(TOGETHER))).applyInPandas(added, schema).toPandas().sort_values("shard")
        return sum(np.frombuffer(m) for m in sums["model"]).reshape(start.shape) / max(1, sums["n"].sum())

    going = list(range(len(penalties)))
    for number in range(epochs):
        if not going:
            break
        new = np.split(epoch(np.hstack([models[i] for i in going]), np.repeat([penalties[i] for i in going], len(labels)), number), len(going), axis=1)
        moved = {i: np.abs(m - models[i]).max() for i, m in zip(going, new, strict=True)}
        models = [new[going.index(i)] if i in moved else m for i, m in enumerate(models)]
        going = [i for i in going if moved[i] > tolerance * np.abs(models[i]).max()]
    return models, labels


def class_scores(df: DataFrame, model: np.ndarray, labels: list[str], into: str = "logits") -> DataFrame:
    """Adds the array of class scores and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        w = shared.value
        for indices, values in batches:
            z = np.tile(w[-1], (len(indices), 1))
            for a in range(0, len(indices), 500):
                own = indices.slice(a, 500)
                row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
                at, x = own.flatten().to_numpy(), values.slice(a, 500).flatten().to_numpy()
                for c in range(w.shape[1]):
                    z[a : a + len(own), c] += np.bincount(row, x * w[at, c], minlength=len(own))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(z.ravel()))

    out = df.withColumn(into, scores("indices", "values"))
    return out.withColumn("predicted", F.get(F.array(*map(F.lit, labels)), F.array_position(into, F.array_max(into)).cast("int") - 1))
