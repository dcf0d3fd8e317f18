"""Conversation prefix trie by vertical bitmaps.

Conversations are put in the order of their turns' hashes, so that those with a common prefix stand
together, and that order is cut into shards of bounded size.  A shard numbers its conversations by
their ids and holds, for each (position, turn), the bitset of the conversations with that turn there.
A node is a bitset too: depth first, a node's children are its bitset intersected with the postings of
the next position; its members are the population count, its smallest member the lowest bit, and the
members that end there its intersection with the bitset of their length.

A node that holds neither the first nor the last conversation of its shard has all its members there:
it is closed, and so is everything under it, so its counts and sums are final.  The few others, on the
paths of the two, are open: their shares are added up over the shards by a hash of the prefix.  What
stands under an open node is summed by doubling: in round k each node adds what its descendants 2^k
below hold, so the rounds are the logarithm of the depth.

Turns are ordered by number, null first; turns of one number by role, the first characters of the
text and the text's hash.  Repeated rows are turns of their own.  Null roles and texts are empty.  Rows
without a conv_id belong to no conversation; an empty table has no nodes, not even a root.  Turns and
prefixes are told apart by 128-bit hashes.  A task holds the hashes (16 bytes) of one conversation's
turns at once, never its texts, and the postings of one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, slices

#: Conversations of a shard, and their turns.
SHARD, TURNS = 4_096, 65_536
#: Conversations that share a head, and the turns of a head at most.
FAMILY, HEAD = 20, 3
#: Open nodes that are broadcast at most.
FEW = 500_000
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "open boolean, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, first_end long, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (a hash of role and text), words: one row for each turn, without its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), F.substring(text, 1, 64).alias("start"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "start", "turn")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "turn", "words")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % (HEAD + 1)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, words: each conversation with the head of its family in place of its own."""
    every = cut(turns(conversations))
    own = F.col("conv_id")
    heads = every.where(F.col("pos") <= HEAD).select(F.col("conv_id").alias("family"), "pos", "turn", "words")
    asking = every.where("pos = 1").select("conv_id", (own - own % FAMILY).alias("family"), head_length(own).alias("h")).where("h > 0")
    part = lambda p: F.lit(p).alias("part")
    borrowed = asking.join(heads, "family").where("pos <= h").select("conv_id", part(0), "pos", "turn", "words")
    kept = every.where(F.col("pos") > head_length(own)).select("conv_id", part(1), "pos", "turn", "words")
    marks = every.where("pos = 1").select("conv_id", part(-1), "pos", F.lit(None).cast("binary").alias("turn"), F.lit(0).alias("words"))
    rows = kept.union(borrowed).union(marks).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "turn", "words"))).alias("t"))
    rest = F.slice("t", F.lit(2), F.size("t") - 1)  # without the mark
    return rows.select("conv_id", F.transform(rest, lambda t: t["turn"]).alias("turns"), F.transform(rest, lambda t: t["words"]).alias("words"))


class Shard:
    """The bitmap index of some conversations that are neighbours in the order of their turns."""

    def __init__(self, convs: list[int], turns: list[list[bytes]], words: list[list[int]]):
        bits = sorted(range(len(convs)), key=convs.__getitem__)
        self.convs = [convs[i] for i in bits]
        self.turns = [turns[i] for i in bits]
        self.words = [words[i] for i in bits]
        self.edges = sum({1 << bits.index(0), 1 << bits.index(len(convs) - 1)})
        self.postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, turns)) + 1)]
        self.ends = [0] * len(self.postings)
        for bit, own in enumerate(self.turns):
            self.ends[len(own)] |= 1 << bit
            for at, turn in enumerate(own):
                held = self.postings[at]
                held[turn] = held.get(turn, 0) | 1 << bit

    def children(self, members: int, depth: int) -> Iterator[tuple[bytes, int]]:
        """Turn and members of each child of a node."""
        left = members & ~self.ends[depth]
        while left:
            turn = self.turns[(left & -left).bit_length() - 1][depth]
            child = members & self.postings[depth][turn]
            yield turn, child
            left &= ~child

    def ids(self, members: int) -> list[int]:
        """Their conv_ids in ascending order."""
        out = []
        while members:
            low = members & -members
            out.append(self.convs[low.bit_length() - 1])
            members ^= low
        return out

    def nodes(self) -> list[tuple]:
        """NODES of the shard, depth first.  Those of an open node hold what its closed children add."""
        found: list[list] = []
        stack = [(ROOT, -1, (1 << len(self.convs)) - 1, 0)]
        while stack:
            key, parent, members, depth = stack.pop()
            least = (members & -members).bit_length() - 1
            ended = self.ids(members & self.ends[depth])
            at = len(found)
            found.append([bool(members & self.edges), key, parent, self.convs[least], depth, members.bit_count(), self.words[least][depth - 1] if depth else 0, ended, 0, 0, 0])
            for turn, child in self.children(members, depth):
                stack.append((hashlib.blake2b(key + turn, digest_size=16).digest(), at, child, depth + 1))
        rows = []
        for is_open, key, parent, conv, depth, n, words, ended, n_children, n_leaves, saved in reversed(found):
            above = found[parent] if parent >= 0 else None
            if not is_open:
                n_leaves, saved = n_leaves or 1, saved + (n - 1) * words
                above[8] += 1
                above[9] += n_leaves
                above[10] += saved
            within = above is not None and not is_open and not above[0]
            text = ",".join(map(str, ended))
            ends = text if is_open and ended else None if is_open else hashlib.sha256(text.encode()).hexdigest()
            rows.append((is_open, key, None if above is None or within else above[1], conv, depth, above[3] if within else None, n, n_children, n_leaves, saved, words, ended[0] if is_open and ended else None, ends))
        return rows


def shards(rebuilt: DataFrame, size: int = SHARD) -> DataFrame:
    """NODES of all shards; an open node has a row for each shard that it is in.

    ``ends`` is the digest of a closed node, and of an open one the conv_ids that end in the shard: in
    the order of all shards these are ascending, as equal conversations are ordered by their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 9, pa.string()]
        convs, turns, words, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            rows = Shard(convs, turns, words).nodes()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in slices(batches):
            for conv, own, counts in zip(*(batch[c].to_pylist() for c in ("conv_id", "turns", "words")), strict=True):
                convs.append(conv)
                turns.append(own)
                words.append(counts)
                held += len(own)
                if len(convs) >= size or held >= TURNS:
                    yield done()
                    convs, turns, words, held = [], [], [], 0
        if convs:
            yield done()

    order = ["turns", "conv_id"]
    return rebuilt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, NODES)


def end_digests(parts: DataFrame) -> DataFrame:
    """id, ends_sha256: the parts of each open node's list of ends, streamed in order through one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])
        key, digest = None, hashlib.sha256()
        for batch in slices(batches):
            for now, text in zip(batch["id"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if key is not None and now != key:
                    yield sent()
                    key = None
                if key is None:
                    key, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key is not None:
            yield sent()

    rows = parts.where("ends IS NOT NULL").select("id", "first_end", "ends")
    return rows.repartition("id").sortWithinPartitions("id", "first_end").select("id", "ends").mapInArrow(run, "id binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """id, n_leaves, saved_tokens: the sums of the columns of that name over each subtree; ``nodes`` has id, parent too."""
    now = nodes.select("id", F.col("parent").alias("jump"), "n_leaves", "saved_tokens")
    for _ in range(depth.bit_length()):
        below = now.where("jump IS NOT NULL").groupBy(F.col("jump").alias("id")).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("saved"))
        above = now.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        now = now.join(below, "id", "left").join(above, "jump", "left")
        added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        now = cut(now.select("id", F.col("next").alias("jump"), added("n_leaves", "more"), added("saved_tokens", "saved")))
    return now.drop("jump")


def trie(rebuilt: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """One row for each node: OUT."""
    nodes = cut(shards(rebuilt, shard))
    parts = nodes.where("open")
    merged = cut(parts.groupBy("id").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    ))
    size, deepest = merged.agg(F.count(F.lit(1)), F.max("depth")).first()
    inner = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("open_children"))
    full = merged.join(inner, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    full = full.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    full = cut(full)
    sums = subtree_sums(full, deepest or 0)
    named = full.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    digests = end_digests(parts)
    opened = full.drop("n_leaves", "saved_tokens").join(sums, "id").join(digests, "id", "left").join(named, "parent", "left")
    opened = opened.withColumn("parent_conv_id", F.col("above")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*OUT)
    closed = nodes.where("NOT open").withColumn("ends_sha256", F.col("ends"))
    under = closed.where("parent IS NOT NULL").join(F.broadcast(named) if size <= FEW else named, "parent").withColumn("parent_conv_id", F.col("above"))
    return opened.union(under.select(*OUT)).union(closed.where("parent IS NULL").select(*OUT))


def report(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))
