"""Prefix trie, vector links and token alignment against brute-force versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import embed_dedup, prefix_trie, token_align
from tidemark.llm.queries import QUERIES, SQL

TURN = "conv_id long, turn long, role string, text string"
VEC = "vec_id long, embedding array<double>, label int"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(family, [])[:h] + v[h:])
    members, kids = defaultdict(set), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, sum(sums[k][1] for k in kids[p]) + (len(members[p]) - 1) * words)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = [(c if rng.random() > 0.02 else None, t if rng.random() > 0.1 else None, rng.choice(["u", "a", None]), rng.choice(["x y", "x", None, "z  z z z"])) for c in range(-25, 45) for t in range(rng.choice([1, 2, 3, 9]))]
    return rows + [(c, t, "u", "same") for c in range(100, 140) for t in range(6)]


@pytest.mark.parametrize("shard", [1, 3, 4_096])
def test_trie_equals_brute_force(spark, shard):
    rows = conversations(shard)
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, TURN).repartition(3)), shard=shard)
    assert got.columns == prefix_trie.OUT
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_odd_rows(spark):
    odd = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, None, None, None), (21, 0, "u", "w " * 50_000), (None, 1, "u", "a"), (40, 5, "", "")]
    extra = spark.createDataFrame([(*r, "x", 1) for r in odd], TURN + ", parent string, id int")
    assert sorted(map(tuple, prefix_trie.report(extra).collect()), key=str) == brute_trie(odd)
    assert prefix_trie.report(spark.createDataFrame([], TURN)).collect() == []


def test_shard_closes_what_stands_within():
    turns = [[b"a"], [b"b", b"c"], [b"b", b"d"], [b"e"]]
    nodes = {r[1]: r for r in prefix_trie.Shard([4, 3, 2, 1], turns, [[1] * len(t) for t in turns]).nodes()}
    assert sum(r[0] for r in nodes.values()) == 3  # the root, a and e
    inner = next(r for r in nodes.values() if r[4] == 1 and not r[0])
    assert (inner[3], inner[6], inner[7], inner[8], inner[9]) == (2, 2, 2, 2, 1)


def brute_links(rows, threshold=0.93):
    sound = [i for i, (_, v, label) in enumerate(rows) if v is not None and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, part = np.zeros(len(rows), int), list(range(len(rows)))
    for at, i in enumerate(sound):
        for j in sound[:at]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[[i, j]] += 1
                part = [part[i] if p == part[j] else p for p in part]
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in part}
    return sorted(((rows[i][0], int(links[i]), least[part[i]], rows[i][0] is not None and rows[i][0] == least[part[i]]) for i in range(len(rows))), key=str)


def vectors():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 12))
    x = [(centres[rng.integers(20)] * rng.uniform(0.1, 9) + rng.standard_normal(12) * rng.choice([0.05, 0.25])).tolist() for _ in range(160)] + [[1.0] * 12] * 12
    rows = [(i, v, int(rng.integers(2))) for i, v in enumerate(x)]
    odd = [None, [0.0] * 12, [None, *[1.0] * 11], [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11], [], [1.0] * 3, [-0.0, *[1e200] * 11], [0.0, *[1.0] * 11]]
    return rows + [(1_000 + i, v, 0) for i, v in enumerate(odd)] + [(2_000, x[0], None), (None, x[1], rows[1][2]), (5, x[5], rows[5][2])]


def test_vector_links_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], VEC + ", row int")
    safe = [(i, None if v is None or len(v) and None in v else np.array(v) / max(1, np.abs(v).max(initial=0)) if np.isfinite(v).all() else v, label) for i, v, label in rows]
    want = brute_links([(i, None if v is None else list(v), label) for i, v, label in safe])
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # many blocks of one cell
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(embed_dedup, "EXACT", 32)  # several tables of cells, few broadcasts
    monkeypatch.setattr(embed_dedup, "FEW", 0)
    found = embed_dedup.near_duplicates(df).collect()
    assert sum(r["n_links"] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df, recall=1).collect()), key=str) == want
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VEC)).collect() == []


def test_large_labels_lose_no_link(spark, monkeypatch):
    """Pairs just over the threshold in a label that is cut in several blocks; a label of one block and one of one vector beside it."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "EXACT", 128)
    x = rng.standard_normal((600, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.932, 600)[:, None]
    rows = [(i, v.tolist(), 0 if i % 600 < 560 else 1) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * y]))] + [(5_000, x[0].tolist(), 2)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert len(found) == 1_201 and found[5_000] == (0, 5_000)
    assert all(found[i] == found[i + 600] == (1, i) for i in range(600))


def test_no_pair_falls_short_of_the_count():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 7, 64, 200):
        a = rng.standard_normal((200, width))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = a + rng.standard_normal(a.shape) * rng.choice([0.01, 0.04, 0.3], (200, 1)) * np.where(rng.random(a.shape) < 0.3, 3, 0.3)
        b /= np.linalg.norm(b, axis=1)[:, None]
        i, j = embed_dedup.linked(a, b, 0.93)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(p, q) for p, q in np.argwhere(a @ b.T >= 0.93).tolist()}


def test_collision_count_rejects_random_pairs():
    x = np.random.default_rng(3).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w, least = embed_dedup.calibrated(64, 0.93)
    p = x @ embed_dedup.directions(64)
    assert ((embed_dedup.collisions(p, p, w) >= least).sum() - 400) / 400**2 < 1e-3


def test_stretches_equal_brute_force():
    rng = random.Random(0)
    for _ in range(600):
        n = rng.randint(1, 60)
        a = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        b = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) if rng.random() < 0.5 else sorted({*a, rng.randint(1, n)} - {rng.randint(1, n)} | {n})
        found = token_align.stretches(a, b)
        la, lb, ends = token_align.laid_out(found)
        sa, sb = [0, *a], [0, *b]
        assert list(zip(la.tolist(), lb.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])]
        assert [a[i] for i in la[ends]] == sorted({*a} & {*b})


def test_a_long_run_takes_few_comparisons():
    a = list(range(1, 100_001))
    assert token_align.stretches(a, a) == ([0], [0], [100_000])
    assert token_align.stretches([5, *range(10, 90_000)], [2, 5, *range(10, 90_000)]) == ([0, 0], [0, 1], [0, 89_991])


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in visible)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    out, count = [], Counter()
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        ta, tb = [bytes(char[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(ta) != (whole := (" " + text).encode()) or b"".join(tb) != whole:
            out.append(None)
            continue
        at_a, at_b = ([k for k, t in enumerate(ts) for _ in t] for ts in (ta, tb))
        links = sorted(set(zip(at_a, at_b, strict=True)))
        common = [k for k in range(1, len(whole)) if at_a[k] != at_a[k - 1] and at_b[k] != at_b[k - 1]] + [len(whole)]
        groups, start = [], 0
        for end in common:
            groups.append(",".join(str(a[k]) for k in sorted(set(at_a[start:end]))) + "|" + ",".join(str(b[k]) for k in sorted(set(at_b[start:end]))))
            start = end
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(set(pairs))
        out.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else (*o[:3], len(o[3]), sum(count[p] == best[p[0]] for p in o[3]), sum(count[p] for p in o[3]), o[4]) for o in out]


TEXTS = [None, "", " ", "a", "the cat sat on the mat.", "the cat sat on the mat.", "<|endoftext|> <s> </s> <unk> <0x41>", "tab\there\n\n  two", "▁ bar", "naïve café \U0001f600 日本語 \x00 z", "x" * 20_000, "ﬁ ½ é", "abc def " * 3_000]


@pytest.mark.parametrize("few", [10**6, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(token_align, "FEW", few)  # 0: counts go to chunks of documents
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab éß\n.1") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(None if i == 3 else 7 if i in (4, 5) else 100 + i, t, "x") for i, t in enumerate(texts)]
    got = token_align.report(spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(4))
    want = [(rows[i][0], *w) for i, w in enumerate(brute_alignment(texts))]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == sorted(want, key=str)
    assert token_align.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_embed_dedup"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    theirs = con.execute(SQL[name])
    cols = [c[0] for c in theirs.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(theirs.fetchall(), key=str)
