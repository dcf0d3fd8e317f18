"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words form one automaton.  Each training text is streamed through it; the automaton's
state gives the longest suffix of what was read that occurs in any item.  Where that length
reaches the window length (or covers a whole shorter item) the words are hit.

Null and empty texts have no words and are never hit.  Null items and items without words give no
window.  Repeated items are items of their own.  All columns of the documents pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_texts, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of one automaton at most; a larger benchmark is cut into several automata.
BLOCK_WORDS = 1_000_000
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return [] if text is None else WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items in which a window occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[str]] = [set()]
        self.ends: dict[int, set[str]] = {}
        for item, words in items:
            state = 0
            for w in words:
                state = self._extend(state, w, own)
                own[state].add(item)
            if 0 < len(words) < window:
                self.ends.setdefault(state, set()).add(item)
        self._finish(own)

    def _state(self, length: int, moves: dict[bytes, int], link: int, own: list[set[str]]) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        own.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes, own: list[set[str]]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes, own: list[set[str]]) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w, own)
        new, p = self._state(self.length[last] + 1, {}, 0, own), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, own)
        return new

    def _finish(self, own: list[set[str]]) -> None:
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[self.link[s]] >= self.window:
                own[self.link[s]] |= own[s]
        #: by state: the state of its last ``window`` words, and the nearest shorter state that ends a short item
        self.holds, self.short = [-1] * len(self.length), [-1] * len(self.length)
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.holds[s] = self.holds[up] if self.length[up] >= self.window else s
            self.short[s] = up if up in self.ends else self.short[up]
        self.items = {s: frozenset(own[s]) for s in set(self.holds) - {-1}}
        self.least = min([self.window, *(self.length[s] for s in self.ends)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit intervals of word positions, in order of their ends, and the items that occur."""
        moves, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        root, state, matched, hits, found = moves[0], 0, 0, [], set()
        for i, w in enumerate(words):
            to = moves[state].get(w)
            if to is None:
                if w not in root:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = moves[state].get(w)
                matched = length[state]
            state = to
            matched += 1
            if matched >= least:
                start = i + 1
                if matched >= window:
                    start = i + 1 - window
                    found |= self.items[self.holds[state]]
                s = state if state in self.ends and matched == length[state] else self.short[state]
                while s > 0:
                    start = min(start, i + 1 - length[s])
                    found |= self.ends[s]
                    s = self.short[s]
                if start <= i:
                    hits.append((start, i + 1))
        return hits, found


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[SuffixAutomaton]:
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > BLOCK_WORDS:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((row["id"] or "", words))
        size += len(words)
    yield SuffixAutomaton(block, window)


def hits(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, id_col: str = "item_id", text_col: str = "text", into: str = "hits") -> DataFrame:
    """The documents with a column ``into``: n_words, n_hit, the items that occur, the hit runs.

    The items are read in blocks of at most BLOCK_WORDS words; each block is one broadcast
    automaton of that bounded size, and a text is streamed through the blocks one after another.
    """
    *first, last = _blocks(benchmark, id_col, text_col, window)
    return _through(_before(documents, first, text_col, into), last, text_col, into)


def _before(documents: DataFrame, automata: list[SuffixAutomaton], text_col: str, into: str) -> DataFrame:
    """The documents with the hits of some automata, or null where there are none."""
    out = documents.withColumn(into, F.lit(None).cast(f"struct<{HITS.replace(' long', ':long').replace('items ', 'items:').replace('spans ', 'spans:')}>"))
    for automaton in automata:
        out = _through(out, automaton, text_col, into)
    return out


def _scanned(automaton: SuffixAutomaton, text: str | None, old: dict | None) -> dict:
    """A text's hits, with those of earlier blocks."""
    words = words_of(text)
    spans, items = automaton.scan(words)
    if old is not None:
        items = items.union(old["items"])
        spans += [(x["start"], x["end"]) for x in old["spans"]]
    spans = merged(spans) if spans else spans
    return {"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "items": sorted(items), "spans": [{"start": s, "end": e} for s, e in spans]}


def _through(documents: DataFrame, automaton: SuffixAutomaton, text_col: str, into: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(automaton)
    run = lambda texts, before: [_scanned(shared.value, t, old) for t, old in zip(texts, before, strict=True)]
    return documents.withColumn(into, over_texts(run, HITS, ARROW)(F.col(text_col), F.col(into)))


def _without_spans(text: str, spans: list[dict], longest: int) -> str:
    """The text without its hit runs of over ``longest`` words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    kept, last = [], 0
    for x in spans:
        if x["end"] - x["start"] > longest:
            kept.append(raw[last : at[x["start"]][0]])
            last = at[x["end"] - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: float = 0.05, longest_span: int = 50) -> DataFrame:
    """The documents under the coverage limit, without hit runs of over ``longest_span`` words; the last block's pass decides and cuts."""
    tmp = "__hits"
    *first, last = _blocks(benchmark, "item_id", "text", window)
    shared, names = documents.sparkSession.sparkContext.broadcast(last), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keep = batch["text"].to_pylist(), []
            for i, (text, old) in enumerate(zip(texts, batch[tmp].to_pylist(), strict=True)):
                hit = _scanned(shared.value, text, old)
                keep.append(not (hit["n_hit"] > 0 and hit["n_hit"] >= coverage * hit["n_words"]))
                if keep[-1] and any(x["end"] - x["start"] > longest_span for x in hit["spans"]):
                    texts[i] = _without_spans(text, hit["spans"], longest_span)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return _before(documents, first, "text", tmp).mapInArrow(run, documents.schema)


def report(documents: DataFrame, benchmark: DataFrame, *, window: int = 13) -> DataFrame:
    """One row for each document: its counts, the digest of the items found, and the verdict."""
    h = hits(documents.select("doc_id", "text"), benchmark, window=window, into="hits")
    return h.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        ((F.col("hits.n_hit") > 0) & (20 * F.col("hits.n_hit") >= F.col("hits.n_words"))).alias("contaminated"),
    )
