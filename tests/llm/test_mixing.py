"""Source mixing against its SQL and its promises."""

import duckdb

from lethe.llm import mixing


def targets(sizes, cap=3):
    """Water filling, step by step."""
    names = sorted(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def documents(spark):
    rows = [(i, "w " * (i % 97 + 1), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", None), (5002, "one two", None), (None, "lost", "s2"), (5003, "tiny", "zz")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_are_met(spark):
    docs = documents(spark)
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in got:
        by.setdefault(r.source or "￿", []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    sizes = {s: rows[0].source_size for s, rows in by.items()}
    # The row without a doc_id is not joined, but its source counts it.
    want = targets(sizes)
    for s, rows in by.items():
        assert abs(rows[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in rows) - want[s]) <= max(r.size for r in rows)
    assert sizes["zz"] == 1 and want["zz"] == 3


def test_reruns_agree_and_rows_multiply(spark):
    docs = documents(spark)
    a = sorted((r.doc_id or -1, r.taken) for r in mixing.mix_report(docs.repartition(7)).collect())
    assert a == sorted((r.doc_id or -1, r.taken) for r in mixing.mix_report(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(x for _, x in a)


def test_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted((d, s, n, round(t, 6), k) for d, s, n, t, k in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_report(spark.read.parquet(path)).collect()) == want


def test_empty_inputs(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_report(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix_report(spark.createDataFrame([(1, None, "a"), (1, None, "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix(spark.createDataFrame([(1, "", "a")], schema)).count() == 0


def test_columns_whose_names_clash_pass_through(spark):
    names = ["doc_id", "text", "source", "__size", "__class", "__rate", "src", "size", "class", "salt", "rank", "row", "a.b"]
    rows = [(i, f"a b {'c ' * (i % 5)}", f"s{i % 3}", *(f"{n}{i}" for n in names[3:])) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names[3:]])
    mixed = mixing.mix(docs)
    assert mixed.columns == names and mixed.schema == docs.schema
    assert set(map(tuple, mixed.collect())) <= set(rows) and mixed.count() > 0


def test_one_doc_id_may_hold_most_rows(spark):
    rows = [(None, "a b c", "x")] * 400 + [(7, "a b", "x")] * 400 + [(i, "a", "y") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == 900
    for s, words in (("x", 2000), ("y", 100)):
        mine = [r for r in got if r.source_size == words]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3
    assert sum(len(r.text.split()) for r in mixing.mix(docs).collect()) == sum(r.taken for r in got)
