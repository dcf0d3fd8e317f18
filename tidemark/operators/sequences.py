"""Sequence operators as column expressions: quality, translation, composition, k-mers, windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bases in the order of the standard codon table, its amino acids, and the start codons of table 11.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")
CODONS = ["".join(c) for c in product(BASES, repeat=3)]
PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def letters(s: Column, letter: str) -> Column:
    """How often a letter occurs."""
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def nucleotide_quality(s: Column) -> dict[str, Column]:
    """Length, GC share of the valid bases, share of N and of ambiguous letters, content hash."""
    s = F.upper(s)
    valid = sum((letters(s, b) for b in "ACGT"), F.lit(0))
    n = F.length(s)
    return {"nt_length": n, "gc": F.try_divide(letters(s, "G") + letters(s, "C"), valid), "n_share": F.try_divide(letters(s, "N"), n), "ambiguous_share": F.try_divide(n - valid, n), "content_hash": F.sha2(s, 256)}


def codons(s: Column) -> Column:
    """Codons in frame."""
    return F.coalesce(F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0)), F.array().cast("array<string>"))


def translated(s: Column) -> Column:
    """Protein: table 11, unknown codons X, a start codon M, a terminal stop removed."""
    table = F.create_map(*(F.lit(x) for c, a in zip(CODONS, AMINO_ACIDS, strict=True) for x in (c, a)))
    amino = F.transform(codons(s), lambda c, i: F.when((i == 0) & c.isin(*STARTS), "M").otherwise(F.coalesce(F.try_element_at(table, c), F.lit("X"))))
    return F.regexp_replace(F.array_join(amino, ""), r"\*$", "")


def translation_quality(s: Column) -> dict[str, Column]:
    c, p = codons(s), translated(s)
    stops = lambda x: x.isin("TAA", "TAG", "TGA")
    return {
        "length_mod3": F.length(s) % 3,
        "terminal_stop": F.coalesce(stops(F.try_element_at(c, F.lit(-1))), F.lit(False)),
        "internal_stops": letters(p, "*"),
        "ambiguous_codons": F.size(F.filter(c, lambda x: F.regexp_like(x, F.lit("[^ACGT]")))),
        "protein_length": F.length(p),
        "x_share": F.try_divide(letters(p, "X"), F.length(p)),
    }


def protein_valid(q: dict[str, Column], least: int = 30, most_x: float = 0.05) -> Column:
    return (q["length_mod3"] == 0) & (q["internal_stops"] == 0) & (q["ambiguous_codons"] == 0) & (q["protein_length"] >= least) & (F.coalesce(q["x_share"], F.lit(1.0)) <= most_x)


def codon_usage(df: DataFrame, key: str, s: str) -> DataFrame:
    """key, codon, share of the known codons of the record."""
    from pyspark.sql import Window

    rows = df.select(key, F.explode(codons(F.col(s))).alias("codon")).where(~F.regexp_like("codon", F.lit("[^ACGT]"))).groupBy(key, "codon").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def gc_by_position(s: Column) -> dict[str, Column]:
    """GC share of the valid bases at each codon position; 0 where there is none."""
    bases = F.split(s, "")
    at = lambda p, letters_: F.size(F.filter(bases, lambda b, i: (i % 3 == p) & b.isin(*letters_)))
    return {f"gc{p + 1}": F.coalesce(F.try_divide(at(p, "GC"), at(p, "ACGT")), F.lit(0.0)) for p in range(3)}


def protein_composition(s: Column) -> dict[str, Column]:
    n = F.length(s)
    return {f"aa_{a}": F.coalesce(F.try_divide(letters(s, a), n), F.lit(0.0)) for a in PROTEIN_LETTERS}


#: The bases of a k-mer's number, in order.
_BASE = np.full(256, -1, dtype=np.int64)
_BASE[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)


def bases(text: str | None) -> np.ndarray:
    """The number of each letter among ``ACGT``, -1 for others."""
    return _BASE[np.frombuffer((text or "").encode("ascii", "replace"), dtype=np.uint8)]


#: Records whose k-mers a task holds at once.
RECORDS = 200


def kmer_codes(text: str | None, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each size: k, the k-mers of valid bases that occur, as numbers in base four and in order, and how often.

    A k-mer's number is made from that of the size before it, so a record takes time in proportion to its length.
    """
    base = bases(text)
    code = base
    for k in range(1, sizes[-1] + 1):
        if k > 1:
            head, tail = code[: max(0, len(base) - k + 1)], base[k - 1 :]
            code = np.where((head < 0) | (tail < 0), -1, head * 4 + tail)
        if k in sizes:
            n = np.bincount(code[code >= 0], minlength=4**k)
            at = np.flatnonzero(n)
            yield k, at, n[at]


def kmer_counts(df: DataFrame, key: str, s: str, sizes: range) -> DataFrame:
    """key, k, kmers, counts: of each record and size the k-mers of valid bases that occur, in order, and how often.

    Null and short records give empty rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["".join(x) for k in range(1, sizes[-1] + 1) for x in product("ACGT", repeat=k)])
        first = {k: sum(4**j for j in range(1, k)) for k in sizes}
        for batch in batches:
            for start in range(0, batch.num_rows, RECORDS):
                part = batch.slice(start, RECORDS)
                keys, found, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, text in enumerate(part[1].to_pylist()):
                    for k, at, n in kmer_codes(text, sizes):
                        keys.append((i, k))
                        found.append(at + first[k])
                        counts.append(n)
                ends = pa.array(np.cumsum([len(c) for c in counts]).astype(np.int32))
                at, k = np.array(keys, dtype=np.int64).reshape(-1, 2).T
                columns = [part[0].take(pa.array(at)), pa.array(k.astype(np.int32)), pa.ListArray.from_arrays(ends, names.take(pa.array(np.concatenate(found)))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))]
                yield pa.RecordBatch.from_arrays(columns, [key, "k", "kmers", "counts"])

    return df.select(key, s).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, k int, kmers array<string>, counts array<long>")


def kmer_spectrum(df: DataFrame, key: str, s: str, sizes: range) -> DataFrame:
    """key, k, kmer, n, share among the record's valid k-mers of that size."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = kmer_counts(df, key, s, sizes).select(key, "k", total.alias("total"), F.inline(F.arrays_zip(F.col("kmers").alias("kmer"), F.col("counts").alias("n"))))
    return rows.select(key, "k", "kmer", "n", (F.col("n") / F.col("total")).alias("share"))


def kmer_totals(df: DataFrame, s: str, sizes: range) -> DataFrame:
    """k, kmer, n, records that hold it, mean of their shares: added up in the tasks, so a task sends a row for each k-mer."""
    first = {k: sum(4**j for j in range(1, k)) for k in sizes}
    width = sum(4**j for j in range(1, sizes[-1] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, records, shares = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width)
        for batch in batches:
            for text in batch[0]:
                for k, at, counts in kmer_codes(text.as_py(), sizes):
                    places = at + first[k]
                    n[places] += counts
                    records[places] += 1
                    shares[places] += counts / max(1, counts.sum())
        held = np.flatnonzero(records)
        names = ["".join(x) for k in range(1, sizes[-1] + 1) for x in product("ACGT", repeat=k)]
        kmers = [names[i] for i in held]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in kmers], pa.int32()), pa.array(kmers, pa.string()), pa.array(n[held]), pa.array(records[held]), pa.array(shares[held])], ["k", "kmer", "n", "records", "shares"])

    sums = df.select(s).mapInArrow(run, "k int, kmer string, n long, records long, shares double").groupBy("k", "kmer").agg(*(F.sum(c).alias(c) for c in ("n", "records", "shares")))
    return sums.select("k", "kmer", "n", "records", (F.col("shares") / F.col("records")).alias("mean_share"))


def windows(df: DataFrame, key: str, s: str, width: int) -> DataFrame:
    """Non-overlapping windows of a record: key, window (from 0), part."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(s), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("window", "part"))


def eligible(length: Column, context: int, special: int = 2) -> Column:
    return length + special <= context
