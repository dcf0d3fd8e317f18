"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by two vocabularies over the same bytes.  The byte offsets where tokens of each end
are two rising arrays; where both hold an offset, a group ends.  Groups of one token each are the
rule and stand on a diagonal: the ends at (i, j), (i + 1, j + 1), ... are equal as long as the index
shift j - i holds.  So stretches are compared at the current shift, after the first few ends in lengths
that double while they agree and halve where they don't, and a run is passed in a logarithmic number of
comparisons.  Where
the ends differ, the tokens of the irregular group are walked one by one to the next common end, and
the shift is what it then is.  The walk meets each overlapping pair of tokens once; on a diagonal the
pairs are the groups themselves.

How many documents link a pair of ids is counted over all of them: each task adds up its own
documents' distinct pairs before the shuffle, so a pair that all documents hold is one row a task.
The counts come back to the documents as a broadcast where they are FEW at most, and else joined to
the distinct pairs of each chunk of documents.

Texts that are null or empty, or that a vocabulary does not give back byte by byte (the second one
reads U+2581 as a space), have no tokens: zeros and an empty digest.  Repeated rows are documents of
their own, rows with a null id too.  A text of any length is aligned whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices

FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Ids of the second vocabulary; a pair of ids is first * WIDTH + second, under 2^32.
WIDTH = 1 << 15
#: Pairs of ids that are broadcast at most (12 bytes each); pairs that a task adds up before it sends them on.
FEW, HELD = 2_000_000, 2_000_000
#: Ends that are compared one by one before the steps double.
FIRST_STEP = 8
#: Characters of texts whose groups are written at once.
TOGETHER = 4_000_000
#: Documents of a chunk, and their distinct pairs.
CHUNK, CHUNK_PAIRS = 2_000, 2_000_000
STATE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, pairs binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """Texts to arrays of ids, and the bytes, the sizes and the names of each id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.tokens = np.array(tokens, dtype=object)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.names = pa.array(map(str, range(len(tokens))), pa.string())

    def bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


@cache
def vocabularies(first: str = FIRST, second: str = SECOND) -> tuple[Vocabulary, Vocabulary]:
    """The byte-level vocabulary, which gets a space and the text, and the piece vocabulary, which adds the space itself.

    Strings of special tokens are plain text to both.
    """
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(public_tokenizers.path(first), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        tokens[i] = token
    own = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
    held = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))]
    by_bytes = Vocabulary(lambda t: own.encode_to_numpy(" " + t, disallowed_special=()), tokens)
    return by_bytes, Vocabulary(lambda t: np.array(pieces.encode(t, num_threads=1), dtype=np.uint32), held)


def stretches(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Stretches of linked tokens, as lists of i, j and lengths: from (i, j) on, both ids step by one for each link.

    Each link of a stretch is a group of its own or the last one of an irregular group; a link inside an
    irregular group has the length 0.  Both arrays end with the same offset.
    """
    out = [], [], []
    put_i, put_j, put = (x.append for x in out)
    i = j = 0
    n = len(a)
    a, b = [*a, -1], [*b, -2]  # what stands behind the last ends differs
    while i < n:
        x, y = a[i], b[j]
        while x != y:
            put_i(i)
            put_j(j)
            put(0)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        run = 1
        while run < FIRST_STEP and a[i + run] == b[j + run]:
            run += 1
        if run == FIRST_STEP:
            step = FIRST_STEP
            while i + run < n and a[i + run : i + run + step] == b[j + run : j + run + step]:
                run += step
                step *= 2
            while step > 1:
                step //= 2
                if a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
            run = min(run, n - i)
        put_i(i)
        put_j(j)
        put(run)
        i += run
        j += run
    return out


def laid_out(found: tuple[list[int], list[int], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked tokens of both arrays in order, and which links end a group."""
    i, j, runs = (np.array(c) for c in found)
    size = np.maximum(runs, 1)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(i, size) + within, np.repeat(j, size) + within, np.repeat(runs > 0, size)


class Aligned(NamedTuple):
    """Ids of both vocabularies, where groups end in either, the links, and the distinct linked pairs with how often they occur."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    n_links: int
    pairs: np.ndarray
    times: np.ndarray


def aligned(text: str | None) -> Aligned | None:
    """None where a text has no tokens."""
    if not text:
        return None
    first, second = vocabularies()
    whole = (" " + text).encode()
    a, b = first.encode(text), second.encode(text)
    ends_a, ends_b = first.sizes[a].cumsum(), second.sizes[b].cumsum()
    # tokens of the byte-level vocabulary are cut from the bytes themselves
    if not len(b) or ends_a[-1] != len(whole) or ends_b[-1] != len(whole) or second.bytes(b) != whole:
        return None
    la, lb, ends = laid_out(stretches(ends_a.tolist(), ends_b.tolist()))
    pairs, times = np.unique(a[la] * np.uint32(WIDTH) + b[lb], return_counts=True)
    return Aligned(a, b, la[ends] + 1, lb[ends] + 1, len(la), pairs, times.astype(np.uint32))


def listed(found: list[Aligned]) -> list[str]:
    """The groups of each as text: ids of one vocabulary, a bar, ids of the other; groups apart by semicolons."""
    if not found:
        return []

    def side(vocabulary: Vocabulary, ids: list[np.ndarray], ends: list[np.ndarray]) -> pa.Array:
        before = np.cumsum([0, *map(len, ids)])
        offsets = np.concatenate([[0], *(e + n for e, n in zip(ends, before, strict=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), vocabulary.names.take(pa.array(np.concatenate(ids)))), ",")

    first, second = vocabularies()
    groups = pc.binary_join_element_wise(side(first, [x.a for x in found], [x.ends_a for x in found]), side(second, [x.b for x in found], [x.ends_b for x in found]), "|")
    offsets = np.cumsum([0, *(len(x.ends_a) for x in found)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), groups), ";").to_pylist()


def _packed(pairs: np.ndarray, times: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(np.concatenate([np.diff(pairs, prepend=np.uint32(0)), times]).tobytes())


def _unpacked(held: bytes, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(press.decompress(held), dtype=np.uint32)
    return np.cumsum(flat[: len(flat) // 2], dtype=np.uint32), flat[len(flat) // 2 :]


def alignments(documents: DataFrame) -> DataFrame:
    """STATE: what one document says by itself, with its distinct pairs packed; a chunk is some neighbouring rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, chunk, rows, held = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32, 0, 0
        names = [c.split()[0] for c in STATE.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary()]
        waiting: list[tuple] = []

        def sent() -> pa.RecordBatch:
            nonlocal chunk, rows, held
            texts = iter(listed([x for _, x in waiting if x is not None]))
            out = []
            for doc, x in waiting:
                if x is None:
                    out.append((doc, 0, 0, 0, 0, "", chunk, None))
                else:
                    out.append((doc, len(x.a), len(x.b), len(x.ends_a), x.n_links, hashlib.sha256(next(texts).encode()).hexdigest(), chunk, _packed(x.pairs, x.times, press)))
                    held += len(x.pairs)
                rows += 1
                if rows >= CHUNK or held >= CHUNK_PAIRS:
                    chunk, rows, held = chunk + 1, 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, 200):
            size = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                waiting.append((doc, aligned(text)))
                size += len(text or "")
                if size >= TOGETHER:
                    yield sent()
                    waiting, size = [], 0
            if waiting:
                yield sent()
                waiting = []

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATE)


def pair_counts(state: DataFrame) -> DataFrame:
    """pair, n, best: how many documents link a pair of ids, and whether none of the first id's pairs is linked by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        keys, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        waiting: list[np.ndarray] = []

        def added() -> None:
            nonlocal keys, counts, waiting
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys, waiting = both, []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

        size = 0
        for batch in slices(batches):
            for held in batch["pairs"].to_pylist():
                waiting.append(_unpacked(held, press)[0])
                size += len(waiting[-1])
            if size >= HELD:
                added()
                size = 0
                if len(keys) >= HELD:
                    yield sent()
                    keys, counts = keys[:0], counts[:0]
        added()
        yield sent()

    counts = cut(state.where("pairs IS NOT NULL").select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("a", F.shiftright("pair", 15).cast("int"))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # a row for each id of the vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _scored(state: pd.DataFrame, keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    press = zstandard.ZstdDecompressor()
    n_best, count_sum = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    for at, held in enumerate(state["pairs"]):
        if held is not None:
            pairs, times = _unpacked(held, press)
            where = np.searchsorted(keys, pairs)
            n_best[at] = times[best[where]].sum(dtype=np.int64)
            count_sum[at] = (times * n[where]).sum(dtype=np.int64)
    out = state.drop(columns=["chunk", "pairs"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out.assign(n_best=n_best, count_sum=count_sum)[[c.split()[0] for c in OUT.split(", ")]]


def _by_broadcast(state: DataFrame, counts: DataFrame) -> DataFrame:
    held = counts.orderBy("pair").toPandas()
    shared = state.sparkSession.sparkContext.broadcast((held["pair"].to_numpy().astype(np.uint32), held["n"].to_numpy(), held["best"].to_numpy(dtype=bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            yield pa.RecordBatch.from_pandas(_scored(batch.to_pandas(), *shared.value), preserve_index=False)

    return state.mapInArrow(run, OUT)


def _by_chunk(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts that a chunk's documents need go to the chunk."""

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, chunk, held = zstandard.ZstdDecompressor(), None, np.zeros(0, dtype=np.uint32)
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(held), chunk)), pa.array(held.astype(np.int64))], ["chunk", "pair"])
        for batch in slices(batches):
            for number, packed in zip(batch["chunk"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                if number != chunk and len(held):
                    yield sent()
                    held = held[:0]
                chunk, held = number, np.union1d(held, _unpacked(packed, press)[0])
        if len(held):
            yield sent()

    def score(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("pair")
        return _scored(docs, table["pair"].to_numpy().astype(np.uint32), table["n"].to_numpy(), table["best"].to_numpy(dtype=bool))

    wanted = state.where("pairs IS NOT NULL").select("chunk", "pairs").mapInArrow(needed, "chunk long, pair long").join(counts, "pair")
    other = wanted.select(F.col("chunk").alias("of"), "pair", "n", "best")
    return state.groupBy("chunk").cogroup(other.groupBy("of")).applyInPandas(score, OUT)


def report(documents: DataFrame) -> DataFrame:
    """OUT: one row for each document."""
    state = cut(alignments(documents))
    counts = cut(pair_counts(state))
    return _by_broadcast(state, counts) if counts.count() <= FEW else _by_chunk(state, counts)
