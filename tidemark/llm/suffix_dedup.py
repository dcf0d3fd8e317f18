"""Removal of repeated substrings by sorting suffixes (deep-shallow sorting).

Of all strings of LENGTH bytes only the repeated ones matter, so suffixes are sampled: a window's
anchor is its leftmost GRAM-byte string with the least hash.  Equal windows have equal anchors at
equal offsets, so a window can only be repeated where its anchor is.  Anchors meet by gram:

1. an anchor whose whole context (all windows that it anchors) occurs earlier is repeated there;
2. where one gram has several contexts, the first anchor of each is a suffix to sort.  The suffixes
   are sorted by multikey quicksort on 8-byte keys to a shallow depth; groups that still share their
   prefix are ordered by blind tries.  The same is done with the reversed texts before the anchors.
   Common prefix lengths of neighbours on both sides tell for each offset which windows are equal,
   and all but the first of those are repeated.

A byte is removed when a repeated window covers it.  Grams and contexts meet by 64-bit hashes;
windows that step 2 removes are compared byte by byte.  Work is dealt out by gram, runs are read as
a sorted stream, and grams that are frequent in a bounded sample of documents are dealt out by the
hash of each window instead, so no gram is one task's.

Null and empty texts have no bytes; matches never cross documents; texts shorter than LENGTH stay
whole.  Rows that repeat a doc_id and its text are one document and get the same result; other
texts of one id are ordered by their hash.  Null ids come last in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_frames, over_texts

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Shallow depth of the quicksort in bytes; groups up to SMALL are sorted by plain comparison.
SHALLOW, SMALL = 48, 8
#: Anchors of a task that meet before they are dealt out.
GATHERED = 500_000
#: Bytes of a chunk that a task works on at once, and suffixes sorted at once.
CHUNK, SORTED = 1 << 18, 30_000
#: Contexts of one gram that a task sorts at once (HOLD * 168 bytes); grams that have more, as a
#: sample of about SAMPLE documents tells, are dealt out by window.  At most MOST such grams.
HOLD, SAMPLE, MOST = 200_000, 10_000, 50_000
MULTIPLIERS = (np.random.default_rng(20).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Anchors of some documents laid end to end, with LENGTH zero bytes around each."""

    def __init__(self, texts: list[bytes]):
        pad = bytes(LENGTH)
        buffer = np.frombuffer(pad + b"".join(x for t in texts for x in (t, pad)) + bytes(16), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.start = LENGTH + np.concatenate([[0], np.cumsum(sizes[:-1] + LENGTH)])
        self.end = self.start + sizes
        w = buffer.astype(np.uint64)
        for k in (1, 2, 4):
            w = w[:-k] | (w[k:] << np.uint64(8 * k))
        self.bytes, self.words = buffer, w
        n = len(w) - GRAM + 8
        gram = sum(w[8 * j : n + 8 * j] * MULTIPLIERS[j] for j in range(GRAM // 8))
        self.gram = mixed(gram)
        least = self.gram & ~np.uint64(127)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:] + np.uint64(step))
            width += step
        first = np.repeat(self.start, np.maximum(0, sizes - LENGTH + 1))
        order = np.arange(len(first)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(0, sizes - LENGTH + 1))[:-1]]), np.maximum(0, sizes - LENGTH + 1))
        i = first + order
        doc = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - LENGTH + 1))
        a = i + (least[i] & np.uint64(127)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(a)] - 1 if len(a) else new
        self.at, self.doc = a[new], doc[new]
        self.high, self.low = (self.at - i[new]), (self.at - i[last])
        self.pos = self.at - self.start[self.doc]

    def contexts(self) -> np.ndarray:
        """Hash of all bytes of an anchor's windows, and of where its document ends on either side."""
        left = np.minimum(self.at - self.start[self.doc], SPAN - 1)
        right = np.minimum(self.end[self.doc] - self.at, LENGTH)
        h = left.astype(np.uint64) * MULTIPLIERS[40] + right.astype(np.uint64) * MULTIPLIERS[41]
        for j in range((SPAN - 1 + LENGTH) // 8):
            h += self.words[self.at - (SPAN - 1) + 8 * j] * MULTIPLIERS[j]
        return mixed(h)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor index, start and two hashes of every window of the given anchors."""
        count = self.high[which] - self.low[which] + 1
        anchor = np.repeat(which, count)
        offset = self.high[anchor] - (np.arange(len(anchor)) - np.repeat(np.cumsum(count) - count, count))
        i = self.at[anchor] - offset
        cuts = [*range(0, LENGTH - 8, 8), LENGTH - 8]
        one = sum(self.words[i + c] * MULTIPLIERS[j] for j, c in enumerate(cuts))
        two = sum(self.words[i + c] * MULTIPLIERS[20 + j] for j, c in enumerate(cuts))
        return anchor, self.pos[anchor] - offset, mixed(one), mixed(two)


def _chunks(b: pd.DataFrame) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Chunks of a batch (id, th, text) with the ids and text hashes of their documents."""
    texts, ids, ths, size = [], [], [], 0
    for doc, th, text in zip(b["id"].to_numpy(), b["th"].to_numpy(), b["text"], strict=True):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if len(raw) < LENGTH:
            continue
        texts.append(raw)
        ids.append(doc)
        ths.append(th)
        size += len(raw)
        if size > CHUNK:
            yield Chunk(texts), np.array(ids, dtype=np.int64), np.array(ths, dtype=np.int64)
            texts, ids, ths, size = [], [], [], 0
    if texts:
        yield Chunk(texts), np.array(ids, dtype=np.int64), np.array(ths, dtype=np.int64)


#: place = position (32 bits) | highest offset (7) | lowest offset (7); RESOLVED marks a repeated anchor.
RESOLVED = 1 << 62


def _place(pos: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (pos << 14) | (high << 7) | low


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> 14) & 0xFFFFFFFF, (place >> 7) & 127, place & 127


def _keyed(documents: DataFrame, *columns: str) -> DataFrame:
    """id, th, text: the key (id, th) names one text.  th is the text's hash where an id has several texts (null ids are one), else 0, which takes no room."""
    d = documents.select(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("th"), "text", *columns)
    several = d.groupBy("id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").limit(1).count()
    return d if several else d.withColumn("th", F.lit(0).cast("long"))


def _anchors(keyed: DataFrame, frequent: np.ndarray) -> DataFrame:
    """gram, context, id, th, place of the anchors.  What repeats within a batch of a task goes on once; the rest is RESOLVED and dealt out evenly."""
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)

    def settle(held: list[np.ndarray]) -> pd.DataFrame:
        gram, context, doc, th, place = np.concatenate(held, axis=1)
        order = np.lexsort((place, th, doc, context, gram))
        gram, context, doc, th, place = gram[order], context[order], doc[order], th[order], place[order]
        again = np.r_[False, (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])]
        same = np.r_[False, again[1:] & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (place[1:] == place[:-1])]
        later = again & ~same
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(gram))))
        # a repeated row of one document is no earlier occurrence
        later &= ~((doc == doc[first]) & (th == th[first]) & (place == place[first]))
        gram = np.where(later, mixed((doc * 1_000_003 + th + place).view(np.uint64)).view(np.int64), gram)
        place = np.where(later, place | RESOLVED, place)
        return pd.DataFrame({"gram": gram[~same], "context": context[~same], "id": doc[~same], "th": th[~same], "place": place[~same]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for b in batches:
            for chunk, ids, ths in _chunks(b):
                rows = np.stack([chunk.gram[chunk.at].view(np.int64), chunk.contexts().view(np.int64), ids[chunk.doc], ths[chunk.doc], _place(chunk.pos, chunk.high, chunk.low)])
                held.append(rows[:, ~np.isin(chunk.gram[chunk.at], shared.value)] if len(shared.value) else rows)
                if sum(h.shape[1] for h in held) > GATHERED:
                    yield settle(held)
                    held = []
        if held:
            yield settle(held)

    return map_frames(keyed, run, "gram long, context long, id long, th long, place long")


def _resolved(anchors: DataFrame) -> DataFrame:
    """From anchors sorted by gram: id, th, place of repeated anchors (gram null), and of the first anchors of each context where a gram has several."""

    def settle(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        gram, context, doc, th, place = (b[c].to_numpy() for c in ("gram", "context", "id", "th", "place"))
        done = (place & RESOLVED) != 0
        run = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
        new_context = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]
        first = np.maximum.accumulate(np.where(new_context, np.arange(len(gram)), 0))
        repeated = done | ((doc != doc[first]) | (th != th[first]) | (place != place[first]))
        several = (np.bincount(run, new_context & ~done, run[-1] + 1) > 1)[run] if len(run) else done
        if repeated.any():
            k = repeated
            yield pd.DataFrame({"id": doc[k], "th": th[k], "place": place[k] & ~RESOLVED, "gram": pd.array([None] * int(k.sum()), dtype="Int64")})
        k = several & new_context & ~done
        if k.any():
            yield pd.DataFrame({"id": doc[k], "th": th[k], "place": place[k], "gram": pd.array(gram[k], dtype="Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            gram = b["gram"].to_numpy()
            last = int(np.searchsorted(gram, gram[-1], side="left")) if len(gram) else 0
            rest = b.iloc[last:]
            if last:
                yield from settle(b.iloc[:last])
        if rest is not None and len(rest):
            yield from settle(rest)

    return anchors.repartition("gram").sortWithinPartitions("gram", "context", "id", "th", "place").mapInPandas(run, "id long, th long, place long, gram long")


def _frequent_grams(keyed: DataFrame, total: int) -> np.ndarray:
    """Grams with over HOLD contexts, as a bounded sample of documents tells; they only change how work is dealt out."""
    share = min(1.0, SAMPLE / max(1, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, _, _ in _chunks(b):
                pairs = np.unique(np.stack([chunk.gram[chunk.at].view(np.int64), chunk.contexts().view(np.int64)]), axis=1)
                yield pd.DataFrame({"gram": pairs[0], "context": pairs[1]})

    drawn = keyed.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share * 1e6)
    found = map_frames(drawn, run, "gram long, context long").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(20, HOLD * share))
    return np.sort(np.array([r["gram"] for r in found.orderBy(F.desc("n"), "gram").limit(MOST).collect()], dtype=np.int64).view(np.uint64))


def _frequent_windows(keyed: DataFrame, frequent: np.ndarray) -> DataFrame:
    """id, th, start, end of the repeated windows at frequent grams: the first of each window's hash stays."""
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, ids, ths in _chunks(b):
                which = np.flatnonzero(np.isin(chunk.gram[chunk.at], shared.value))
                if len(which):
                    anchor, start, one, two = chunk.windows(which)
                    yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "id": ids[chunk.doc[anchor]], "th": ths[chunk.doc[anchor]], "start": start})

    rows = map_frames(keyed, run, "one long, two long, id long, th long, start long")
    first = rows.groupBy("one", "two").agg(F.min("id").alias("first_id"))
    first = rows.join(first, ["one", "two"]).where("id = first_id").groupBy("one", "two", "first_id").agg(F.min(F.struct("th", "start")).alias("first"))
    later = rows.join(first, ["one", "two"]).where("id <> first_id OR th <> first.th OR start <> first.start")
    return later.select("id", "th", "start", (F.col("start") + LENGTH).alias("end"))


# --- deep-shallow sorting of fixed-length byte strings


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """Order of equally long strings by a blind trie: a branch knows only its depth; each new string is compared with one leaf."""
    root: list | int = group[0]
    equal: dict[int, list[int]] = {group[0]: []}
    for new in group[1:]:
        s, node = strings[new], root
        while type(node) is list:
            kids = node[1]
            node = kids[s[node[0]]] if s[node[0]] in kids else next(iter(kids.values()))
        leaf = node
        if s == strings[leaf]:
            equal[leaf].append(new)
            continue
        equal[new] = []
        differ = int.from_bytes(s) ^ int.from_bytes(strings[leaf])
        depth = len(s) - (differ.bit_length() + 7) // 8
        parent, node = None, root
        while type(node) is list and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = new
        else:
            branch = [depth, {strings[leaf][depth]: node, s[depth]: new}]
            if parent is None:
                root = branch
            else:
                parent[1][s[parent[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += [node, *equal[node]]
    return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, and the common prefix length of each with the one before it."""
    n, length = rows.shape
    padded = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    padded[:, :length] = rows
    keys = padded.view(">u8")
    raw = padded.tobytes()
    strings = [raw[i * padded.shape[1] : i * padded.shape[1] + length] for i in range(n)]
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, column = stack.pop()
        group = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = sorted(group, key=strings.__getitem__)
        elif column * 8 >= min(shallow, length):
            order[lo:hi] = blind_trie(strings, group.tolist())
        else:
            k = keys[group, column]
            pivot = np.partition(k, len(k) // 2)[len(k) // 2]
            less, more = k < pivot, k > pivot
            parts = (group[less], group[~(less | more)], group[more])
            order[lo:hi] = np.concatenate(parts)
            a, b = lo + len(parts[0]), hi - len(parts[2])
            stack += [(x, y, c) for x, y, c in ((lo, a, column), (a, b, column + 1), (b, hi, column)) if y - x > 1]
    ordered = rows[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(1), differs.argmax(1), length) if n > 1 else np.zeros(0, np.int64)
    return order, np.r_[0, common]


def repeated_windows(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and offset of each window that equals one of an earlier anchor; anchors come in their order."""
    by_right, common_right = deep_shallow(right)
    by_left, common_left = deep_shallow(left)
    n = len(low)
    anchors, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    same_right, same_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN):
        active = np.flatnonzero((low <= o) & (o <= high))
        if len(active) < 2:
            continue
        same_right[by_right] = np.cumsum(common_right < LENGTH - o)
        same_left[by_left] = np.cumsum(common_left < o)
        key = same_right[active] * (n + 1) + same_left[active]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(active), dtype=bool)
        later[first] = False
        anchors.append(active[later])
        offsets.append(np.full(later.sum(), o))
    return np.concatenate(anchors), np.concatenate(offsets)


def _covered(resolved: DataFrame) -> DataFrame:
    """id, th, start, end of the bytes that repeated anchors' windows cover."""
    pos, high, low = F.shiftright("place", 14).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    return resolved.where("gram IS NULL").select("id", "th", (pos - high).alias("start"), (pos - low + LENGTH).alias("end"))


def _contexts(keyed: DataFrame, resolved: DataFrame) -> DataFrame:
    """gram, id, th, place, and the bytes on both sides of each anchor to sort."""
    wanted = resolved.where("gram IS NOT NULL").groupBy("id", "th").agg(F.collect_list(F.struct("gram", "place")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, th, text, wanted in zip(b["id"].to_numpy(), b["th"].to_numpy(), b["text"], b["wanted"], strict=True):
                raw = bytes(LENGTH) + text.encode("utf-8", "surrogatepass") + bytes(LENGTH)
                for w in wanted:
                    place = w["place"]
                    at = LENGTH + ((place >> 14) & 0xFFFFFFFF)
                    rows.append((w["gram"], doc, th, place, raw[at - SPAN + 1 : at + LENGTH]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["gram", "id", "th", "place", "context"])
                    rows = []
            yield pd.DataFrame(rows, columns=["gram", "id", "th", "place", "context"])

    texts = keyed.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])
    return map_frames(texts, run, "gram long, id long, th long, place long, context binary")


def _sorted_windows(contexts: DataFrame) -> DataFrame:
    """id, th, start, end of the repeated windows among anchors of one gram, by deep-shallow sorting."""

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "th", "place"], kind="stable")
        rows = np.frombuffer(b"".join(b["context"]), dtype=np.uint8).reshape(len(b), SPAN - 1 + LENGTH)
        th, (pos, high, low) = b["th"].to_numpy(), _parts(b["place"].to_numpy())
        anchor, offset = repeated_windows(np.ascontiguousarray(rows[:, SPAN - 2 :: -1]), np.ascontiguousarray(rows[:, SPAN - 1 :]), low, high)
        order = np.lexsort((offset, anchor))
        anchor, offset = anchor[order], offset[order]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(anchor) else anchor
        last = np.r_[new[1:], len(anchor)] - 1 if len(anchor) else anchor
        k = anchor[new]
        return pd.DataFrame({"id": b["id"].to_numpy()[k], "th": th[k], "start": pos[k] - offset[last], "end": pos[k] - offset[new] + LENGTH})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            gram = b["gram"].to_numpy()
            last = int(np.searchsorted(gram, gram[-1], side="left")) if len(gram) else 0
            if last < SORTED // 4 and len(b) < SORTED:
                rest = b
                continue
            rest = b.iloc[last:]
            if last:
                yield settle(b.iloc[:last])
        if rest is not None and len(rest):
            yield settle(rest)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, "id long, th long, start long, end long")


def repeats(keyed: DataFrame) -> DataFrame:
    """id, th, spans: the bytes of each document (id, th, text) that repeated windows cover, overlaps included."""
    frequent = _frequent_grams(keyed, keyed.count())
    resolved = cut(_resolved(_anchors(keyed, frequent)))
    found = _covered(resolved).union(_sorted_windows(_contexts(keyed, resolved)))
    if len(frequent):
        found = found.union(_frequent_windows(keyed, frequent))
    return found.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
ARROW = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut_out(with_bytes: bool):
    def run(texts: list, spans: list) -> list:
        rows = []
        for text, found in zip(texts, spans, strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            kept, at, runs, end = [], 0, 0, -1
            for s, e in sorted((x["start"], x["end"]) for x in found) if found is not None else ():
                if s > end:
                    runs += 1
                    kept.append(raw[at:s])
                end = max(end, e)
                at = end
            kept = b"".join([*kept, raw[at:]])
            rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_bytes else None})
        return rows

    return over_texts(run, DIGEST, ARROW)


def report(documents: DataFrame, *, with_bytes: bool = False) -> DataFrame:
    """One row for each document: bytes, removed bytes and runs, and the hash of what is left (``with_bytes``: what is left itself)."""
    # the id itself goes along only where it can't be told from the stand-in of a null: else both joins share one shuffle of the texts
    both = documents.where(F.col("doc_id") == 2**63 - 1).limit(1).count() > 0
    keyed = _keyed(documents, *(["doc_id"] if both else []))
    joined = keyed.join(repeats(keyed.select("id", "th", "text")), ["id", "th"], "left")
    joined = joined if both else joined.withColumn("doc_id", F.when(F.col("id") != 2**63 - 1, F.col("id")))
    out = joined.withColumn("r", _cut_out(with_bytes)(F.col("text"), F.col("spans")))
    return out.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256", *(["r.kept"] if with_bytes else []))
