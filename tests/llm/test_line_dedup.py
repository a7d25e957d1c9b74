"""Line dedup against its SQL and against plain Python."""

import hashlib

import duckdb
import pytest

from lethe.llm import line_dedup


def plain(rows, min_docs=3, min_chars=20):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and doc_id != max(held[key(x)]))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


LONG = "This line is long enough to count"
ROWS = [
    (1, f"{LONG}\nshort\n{LONG}"),
    (2, f"  {LONG.upper()}\t\nother"),
    (3, f"x\n{LONG}\n\n"),
    (4, "tail"),
    (5, None),
    (6, ""),
    (7, "é" * 19 + "\n" + "É" * 20),
    (8, "É" * 20),
    (9, "é" * 20 + "\n" + "É" * 20),
    (10, "\n\n\n"),
    (11, "a line with a no-break space at the end "),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_matches_plain_python(spark, batches, fanout):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = line_dedup.line_report(docs, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect())) == plain(ROWS)


def test_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(line_dedup.SQL).fetchall())
    got = sorted(map(tuple, line_dedup.line_report(spark.read.parquet(path)).collect()))
    assert got == want
    assert any(r[2] for r in got)


def test_text_stage_keeps_columns_and_clashing_names(spark):
    rows = [(i, f"{LONG}\nown {i}", "k", 40) for i in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, n_chars long")
    out = line_dedup.dedup_lines(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "own 1", 5), (2, "own 2", 5), (3, f"{LONG}\nown 3", 40)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (3, LONG), (3, LONG)]
    got = sorted(map(tuple, line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain(rows)
    null = spark.createDataFrame([(None, LONG), (1, LONG), (2, LONG)], "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_report(null).collect()} == {(None, 1), (1, 1), (2, 0)}
    assert line_dedup.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_main_path_is_native(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = line_dedup.line_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_column_names_and_long_texts(spark):
    names = ["__id", "__drop", "__lines", "row", "drop", "id", "th", "a.b"]
    long = "\n".join([LONG, "x" * 500_000, *(f"line {i}" for i in range(20_000))])
    rows = [(i, f"{LONG}\nown {i}", *(f"{n}{i}" for n in names)) for i in (1, 2)] + [(3, long, *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    want = [(i, f"own {i}", *(f"{n}{i}" for n in names)) for i in (1, 2)] + [(3, long, *names)]
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(map(tuple, line_dedup.line_report(docs).collect())) == plain([r[:2] for r in rows])


def test_runs_are_merged_as_they_lie(spark):
    """No exchange and no sort above a run in the anti-join and in the merge of runs."""
    runs = line_dedup.LineRuns(spark, line_dedup.Scratch(spark, "runs-test"), fanout=3)
    batch = lambda low: spark.range(low, low + 50).selectExpr("id % 40 AS h", "cast(id % 7 AS int) AS g", "id AS doc_id")
    runs.add(batch(0))
    runs.add(batch(30))
    with line_dedup.setting(spark, line_dedup.IN_ORDER, "true"):
        for rows in (runs.joined(batch(60)), runs.merged()):
            rows.collect()
            plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            scans = [i for i, x in enumerate(plan) if "Scan" in x and "line_run" in x]
            assert len(scans) == 2
            for i in scans:
                depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
                above, at = [], depth(plan[i])
                for x in reversed(plan[:i]):
                    if depth(x) < at:
                        above.append(x)
                        at = depth(x)
                    if "SortMergeJoin" in x and depth(x) <= at:
                        break
                assert "SortMergeJoin" in above[-1], plan
                assert not any("Exchange" in x or " Sort [" in x for x in above), "\n".join(plan)
    assert sorted(map(tuple, runs.merged().select("h", "g", "n_docs").collect())) == sorted(
        map(tuple, batch(0).union(batch(30)).groupBy("h", "g").count().collect())
    )
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
