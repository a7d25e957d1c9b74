"""NN-descent near-duplicates against brute force over all pairs."""

import numpy as np

from lethe.llm import embedding_dedup


def brute(rows, threshold=0.95):
    good = {}
    for vec_id, x in rows:
        if vec_id is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.asarray(x, np.float32).astype(float)
            good[vec_id] = v / np.linalg.norm(v)
    ids = sorted(good)
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = dict.fromkeys(up, 0)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in up}


def run(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_links(vectors, **options).collect()}


def cloud(seed, n, dim=32):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    rows = [(i, base[i]) for i in range(n)]
    for i in range(n, n + n // 3):
        rows.append((i, base[r.integers(n // 4)] + 0.08 * r.standard_normal(dim)))
    one = r.standard_normal(dim)
    rows += [(10_000 + i, one + 0.05 * r.standard_normal(dim)) for i in range(150)]  # a large group
    rows += [(20_000 + i, one) for i in range(40)]  # exact copies
    return [(i, [float(np.float32(v)) for v in x]) for i, x in rows]


def test_matches_brute_force(spark):
    rows = cloud(1, 300)
    rows += [(30_000, None), (30_001, []), (30_002, [0.0] * 32), (30_003, [float("nan")] * 32), (30_004, [1.0, None] * 16), (30_005, [float("inf")] * 32), (30_006, [1.0]), (30_007, [2.0])]
    want, got = brute(rows), run(spark, rows, leaf=16, block=32)
    assert got.keys() == want.keys()
    assert got == want


def test_large_groups_inside_and_apart(spark):
    """Groups of which all, some and few vectors lie near the centre, with copies among them."""
    r = np.random.default_rng(8)
    rows, at = [], 0
    for spread in (0.02, 0.035, 0.05):
        one = r.standard_normal(32)
        one /= np.linalg.norm(one)
        for _ in range(90):
            rows.append((at, [float(np.float32(v)) for v in one + spread * r.standard_normal(32)]))
            at += 1
    rows += [(1000 + i, x) for i, x in rows[::7]]
    want, got = brute(rows), run(spark, rows, block=16)
    assert got == want


def test_sf001_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_links(vectors).collect()}
    assert got == brute(rows)


def test_empty_table_and_no_links(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]) == {1: (0, 1, True), 2: (0, 2, True)}


def test_a_long_chain_is_counted_without_comparing_all_pairs(spark, tmp_path):
    """A long winding curve and a dense knot on it, one component: exact counts from a small share of the pairs."""
    r = np.random.default_rng(4)
    n, knot, dim = 20_000, 2_000, 64
    t = np.arange(n)[:, None] * 0.02 * r.standard_normal((1, dim // 2))
    x = np.concatenate([np.cos(t), np.sin(t)], axis=1)
    x = np.concatenate([x, x[0] + 0.03 * r.standard_normal((knot, dim))]).astype("<f4")
    weight = r.integers(1, 4, n + knot)
    rows = [(i, dim, embedding_dedup.pack(v.astype(float)), int(w)) for i, (v, w) in enumerate(zip(x, weight))]
    classes = spark.createDataFrame(rows, "id long, dim long, raw binary, weight long")
    found = classes.select("id", embedding_dedup.F.lit(0).cast("long").alias("component"))
    scratch = embedding_dedup.Scratch(spark, "chain-test")
    got = {r.id: r.links for r in embedding_dedup._link_counts(classes, found, scratch, 0.95, 512).collect()}
    u = embedding_dedup.unit([row[2] for row in rows])
    for at in range(0, n + knot, 2000):
        near = u[at : at + 2000] @ u.T >= 0.95
        want = near @ weight - weight[at : at + 2000]
        assert [got.get(at + i, 0) for i in range(len(want))] == want.tolist()
    met = spark.read.parquet(scratch.path("cell-pairs"))
    sizes = spark.read.parquet(scratch.path("cell-sizes")).select("cell", "n")
    pairs = met.where("not whole").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").selectExpr("sum(na * nb)").first()[0]
    assert pairs < 0.05 * (n + knot) ** 2, pairs


def test_recall_below_the_least_fails(spark):
    import pytest

    r = np.random.default_rng(3)
    base = r.standard_normal((60, 24))
    rows = [(i, [float(v) for v in base[i % 60] + 0.05 * r.standard_normal(24)]) for i in range(240)]
    with pytest.raises(RuntimeError, match="recall"):
        run(spark, rows, k=1, most=1, trees=1, leaf=2, rounds=1, extra=0, least=1.0, recall=1.0)


def test_clashing_column_names(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.01], 2, "y"), (3, [0.0, 1.0], 3, "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, component string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_links(vectors).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
