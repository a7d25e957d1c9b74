"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from lethe.llm import ngram_join, shingles


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """component of each doc_id, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, plain_set(text))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, docs=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice((1, 2, 4, 5, 6, 9, 12, 30, 80, 200)))] for _ in range(docs // 4)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(docs):
        text = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.2:
            text += passage
        joined = r.choice((" ", "\n", "\t")).join(text)
        rows.append((i, joined.upper() if r.random() < 0.1 else joined))
    one = [r.choice(words) for _ in range(100)]
    for i in range(60):  # one large group of near copies
        text = list(one)
        text[r.randrange(100)] = r.choice(words)
        rows.append((1000 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block_rows", [8, 128])
def test_matches_brute_force(spark, block_rows):
    rows = [*corpus(3), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "é b c d e"), (5007, "É b c d e")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_rows=block_rows, per_part=2000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_sf001_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.ngram_join(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_repeated_rows_nulls_and_extra_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "p q", None), (3, "a b c d e f", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (3, 2, 1), (None, 1, ngram_join.NO_ID)], key=str)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_join(docs).count() == 0
    assert ngram_join.drop_near_copies(docs).count() == 0


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 77, 150, 333, 800]:
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = r.integers(0, n // 5 + 1)
            b = np.delete(a, r.choice(len(a), drop, replace=False))
            b = np.unique(np.concatenate([b, r.integers(0, 1 << 63, int(r.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            if len(b) and ngram_join.similar(a, b):
                # However signatures are ordered, the first d + 1 of each tag have one in common.
                order = r.permutation(1 << 16)
                first = [{int(v) for tag, x in shingles.signatures(s) for v in sorted(x, key=lambda v: order[int(v) >> 48])[: shingles.differences(tag >> 2) + 1]} for s in (a, b)]
                assert first[0] & first[1]


def test_tree_keeps_every_similar_pair():
    r = np.random.default_rng(6)
    base = [np.unique(r.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in r.integers(1, 60, 12)]
    sets = [np.delete(b, r.choice(len(b), r.integers(0, len(b) // 6 + 1), replace=False)) for b in base for _ in range(9)]
    sets = [s for s in sets if len(s)]
    kept = {tuple(sorted(map(int, p))) for p in zip(*ngram_join.SignatureTree(sets).pairs())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.similar(sets[i], sets[j])}
    assert want <= kept
    assert len(kept) < len(sets) * (len(sets) - 1) // 4


def test_near_copies_of_rows_repeated_over_partitions(spark):
    shingled = lambda k, n: " ".join(f"{k}x{i}" for i in range(n + 4))
    rows = [(d, shingled(d // 10, n)) for k in range(40) for n in (4 + k % 30,) for d in (10 * k,) for _ in range(6)]
    rows += [(d + 1, f"{text} more") for d, text in dict(rows).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ngram_join.ngram_join(docs, per_part=2000).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert {r.component_id for r in got} == {10 * k for k in range(40)}


@pytest.mark.parametrize("block_rows", [8, 128])
def test_near_copies_of_many_null_ids_and_of_a_document_of_two_texts(spark, block_rows):
    words = lambda k, n: " ".join(f"{k}y{i}" for i in range(n + 4))
    rows = [(None, words(k, 4 + k % 7)) for k in range(60)] + [(k, f"{words(k, 4 + k % 7)} more") for k in range(60)]
    rows += [(100, "far from all others"), (101, "far from all others"), (101, "another text of the same one"), (102, "another text of the same one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_join(docs, block_rows=block_rows, per_part=2000).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is None or r.doc_id < 100} == {ngram_join.NO_ID}
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id >= 100} == {100}


def test_node_pairs_of_different_groups_part_above_the_leaves(spark):
    """A block of many groups: what pairs of nodes the traversal drops, level by level, and that no similar pair is lost."""
    r = np.random.default_rng(8)
    sets, groups = [], []
    for g in range(60):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(20, 300)), dtype=np.uint64))
        for _ in range(int(r.integers(2, 14))):
            sets.append(np.delete(base, r.choice(len(base), r.integers(0, len(base) // 8 + 1), replace=False)))
            groups.append(g * 7919)
    tree = ngram_join.SignatureTree(sets, groups)
    kept = {tuple(sorted(map(int, p))) for p in zip(*tree.pairs())}
    assert {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.similar(sets[i], sets[j])} <= kept
    assert [x[0] for x in tree.seen] == list(range(len(tree.levels) - 1, -1, -1)) and len(tree.levels) >= 4
    above = {level: kept / pairs for level, pairs, kept in tree.seen if level}
    assert above[1] < 0.2  # of the pairs of nodes of eight sets


def test_long_texts_and_clashing_names(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = list(long)
    for _ in range(500):
        other[r.randrange(len(other))] = "changed"
    names = ["row", "id", "__gone", "component", "digest", "a.b"]
    rows = [(i, t, *names) for i, t in enumerate([" ".join(long), " ".join(other), "x" * 300_000, "short text"])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = ngram_join.drop_near_copies(docs, block_items=1 << 14)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] != 1)
