"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

Texts are tokenised once and the token ids kept in the shared folder.  The number of documents, their
mean length and the document frequency of every token id are counted over all of them; the
vocabulary is fixed, so these statistics have a bounded size and every task gets them whole.  The
documents are then put in the order of their lexical key: the ids with the highest BM25 weights,
heaviest first, so that documents about the same things stand together whatever file they came
from.  A range of that order is a shard of the inverted index, and a shard is worked off in blocks
of at most BLOCK_TOKENS tokens: over a block the inverted index returns a seed's best unused
neighbours, scored with the statistics of the whole corpus, and they fill its window greedily; the
last one is cut where the window ends, and its rest opens the next window.  Equal keys are split by
a hash of the document, so no key is a shard of its own size.

What a block's last window lacks is carried to the next block of the shard; at the end of the shard
the rest is cut at powers of two, which need no padding.  So a window holds ``width`` ids or a power
of two.

Null texts are empty: such a document is its end id alone.  Repeated rows are packed each.  A
document of any length is cut into as many pieces as it needs.  Rows with a null id keep it.
Sequence ids number the windows within the shard: shard * 2^32 + window.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices

WIDTH, END = 1_024, 0
#: Tokens of a block, whose index one task holds.
BLOCK_TOKENS = 1_000_000
#: Ids of the vocabulary, with its end-of-text id.
VOCABULARY, SPECIAL = 50_257, {"<|endoftext|>": 50_256}
#: Terms of a query (the rarest of the seed); ids of a lexical key; saturation and length weight of BM25.
TERMS, KEY, K1, B = 24, 3, 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(name: str = "byte_bpe_50k.tiktoken"):
    """Text to ids of the 50k byte-level vocabulary.  The string of the end-of-text id in a text is that id.

    The rank file holds the same vocabulary as byte_bpe_50k.json and gives the same ids, by default,
    in a fifth of the time; tests compare the two.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    mark = next(iter(SPECIAL))
    return lambda text: own.encode(text, allowed_special="all") if mark in text else own.encode_ordinary(text)


class Corpus:
    """What BM25 needs to know of all documents: the weight of each id, and the length that a document has on average."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.df = df
        self.idf = np.log(1 + (documents - df + 0.5) / (df + 0.5))
        self.mean = max(1.0, tokens / max(1, documents))

    def weights(self, ids: np.ndarray, counts: np.ndarray, length) -> np.ndarray:
        return self.idf[ids] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))

    def key(self, ids: np.ndarray) -> list[int]:
        """The ids of a document that weigh most, heaviest first, out of those that other documents hold too."""
        terms, counts = np.unique(ids, return_counts=True)
        shared = self.df[terms] > 1
        terms, counts = terms[shared], counts[shared]
        heavy = np.argsort(-self.weights(terms, counts, len(ids)), kind="stable")[:KEY]
        return [*terms[heavy].tolist(), *[-1] * (KEY - len(heavy))]


class Index:
    """BM25 over the token ids of a block of documents, with the statistics of a corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        sizes = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
        pairs, counts = np.unique((np.concatenate(docs).astype(np.int64) << 32) | doc, return_counts=True)
        term, self.doc = pairs >> 32, pairs & 0xFFFFFFFF
        self.weight = corpus.weights(term, counts, sizes[self.doc])
        self.held = np.bincount(term)
        self.start = np.concatenate([[0], np.cumsum(self.held)])
        self.n, self.df = len(docs), corpus.df

    def neighbours(self, seed: np.ndarray, free: np.ndarray, most: int) -> np.ndarray:
        """The unused documents with the best scores for the seed's rarest terms, best first."""
        terms = np.unique(seed)
        terms = terms[self.held[terms] > 1]
        terms = terms[np.argsort(self.df[terms], kind="stable")[:TERMS]]
        if not len(terms):
            return terms
        at = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in terms])
        scores = np.bincount(self.doc[at], self.weight[at], self.n) * free
        found = np.flatnonzero(scores > 0)
        if len(found) > 4 * most:
            found = found[scores[found] >= np.partition(scores[found], -most)[-most]]
        return found[np.lexsort((found, -scores[found]))[:most]]


class Shard:
    """Windows of one shard; pieces come out as columns."""

    def __init__(self, number: int, width: int, corpus: Corpus):
        self.number, self.width, self.corpus, self.window, self.open, self.rows = number << 32, width, corpus, 0, [], []
        self.filled = 0

    def put(self, doc, ids: np.ndarray) -> None:
        """Lay a document into the open window and those after it."""
        start = 0
        while start < len(ids):
            take = min(self.width - self.filled, len(ids) - start)
            self.open.append((doc, start, ids[start : start + take], len(ids)))
            self.filled += take
            start += take
            if self.filled == self.width:
                self.close(self.open)
                self.open, self.filled = [], 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.number + self.window, offset))
            offset += len(ids)
        self.window += 1

    def end(self) -> None:
        """Cut the open window's rest at powers of two."""
        rest = self.open
        while self.filled:
            size, now, later = 1 << (self.filled.bit_length() - 1), [], []
            self.filled -= size
            for doc, start, ids, total in rest:
                if size:
                    now.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    later.append((doc, start + size, ids[size:], total))
                size -= min(size, len(ids))
            self.close(now)
            rest = later
        self.open = []

    def pack(self, names: list, docs: list[np.ndarray]) -> None:
        """Pack a block: each seed, then its nearest unused documents until the window is full."""
        index, free = Index(docs, self.corpus), np.ones(len(docs))
        for seed in range(len(docs)):
            if not free[seed]:
                continue
            free[seed] = 0
            self.put(names[seed], docs[seed])
            if self.filled:
                for near in index.neighbours(docs[seed], free, 1 + (self.width - self.filled) // 8):
                    window = self.window
                    free[near] = 0
                    self.put(names[near], docs[near])
                    if self.window > window:
                        break

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names)


def tokenised(documents: DataFrame) -> DataFrame:
    """doc_id, ids: the token ids of each text and the end id, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in slices(batches):
            ids = [np.array([*encode(text or ""), END], dtype="<u2").tobytes() for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def statistics(tokens: DataFrame) -> Corpus:
    """The corpus of tokenised documents, counted over all of them; one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in slices(batches):
            for ids in batch["ids"].to_pylist():
                df[np.unique(np.frombuffer(ids, dtype="<u2"))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "n"])

    df = np.zeros(VOCABULARY, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r["id"]] = r["n"]
    n, size = tokens.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    return Corpus(n, (size or 0) // 2, df)


def ordered(tokens: DataFrame, corpus: Corpus) -> DataFrame:
    """doc_id, ids in the order of their lexical keys, in ranges of it."""
    shared = tokens.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        for batch in slices(batches):
            keys = np.array([corpus.key(np.frombuffer(ids, dtype="<u2")) for ids in batch["ids"].to_pylist()], dtype=np.int32).reshape(-1, KEY)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(keys[:, i]) for i in range(KEY))], ["doc_id", "ids", *names])

    names = [f"k{i}" for i in range(KEY)]
    keyed = tokens.mapInArrow(run, f"doc_id long, ids binary, {', '.join(f'{k} int' for k in names)}").withColumn("tie", F.xxhash64("doc_id", F.lit(11)))
    return keyed.repartitionByRange(*names, "tie").sortWithinPartitions(*names, "tie").select("doc_id", "ids")


def pieces(documents: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    tokens = cut(tokenised(documents))
    corpus = statistics(tokens)
    shared = documents.sparkSession.sparkContext.broadcast(corpus)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(TaskContext.get().partitionId(), width, shared.value)
        names: list = []
        docs: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                docs.append(np.frombuffer(ids, dtype="<u2"))
                names.append(doc)
                size += len(docs[-1])
                if size >= BLOCK_TOKENS:
                    shard.pack(names, docs)
                    names, docs, size = [], [], 0
                    yield shard.taken()
        if docs:
            shard.pack(names, docs)
        shard.end()
        yield shard.taken()

    return ordered(tokens, corpus).mapInArrow(pack, PIECES)

