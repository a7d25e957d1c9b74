"""The pipeline, stage by stage, against brute force on its own input."""

import duckdb
import public_tokenizers

import corpus_pipeline
from lethe.llm import line_dedup, mixing, toxicity
from lethe.llm.common import table
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check

DIR = "/root/testdata/sf0.001"


def test_each_stage_does_its_whole_job(spark):
    docs = table(spark, DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    held = docs
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, DIR)
        rows = out.collect()
        outs.append((name, held.collect(), rows))
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
            held = spark.createDataFrame(rows, docs.schema)
    inputs = {n: i for n, i, _ in outs}
    results = {n: o for n, _, o in outs}

    verdicts = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(spark, DIR, "labels")).collect()}
    assert {r.doc_id for r in results["toxicity"]} == {i for i, p in verdicts.items() if not p}

    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(inputs["line dedup"], docs.schema).toPandas())
    import hashlib

    want = {d: h for d, _, _, h in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL})").fetchall()}
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in results["line dedup"]} == want

    groups = brute([(r.doc_id, r.text) for r in inputs["n-gram Jaccard join"]])
    assert sorted(r.doc_id for r in results["n-gram Jaccard join"]) == sorted(i for i, (_, c) in groups.items() if i == c)

    con.register("mixed", spark.createDataFrame(inputs["mixing sources to target weights"], docs.schema).toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM mixed")
    copies = {d: t // s if s else 0 for d, s, t in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    got = {}
    for r in results["mixing sources to target weights"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    sized = {d: n for d, n in copies.items() if n}
    assert {d: n for d, n in got.items() if d in sized} == sized

    rows = [(r.doc_id, r.text) for r in inputs["packing"]]
    assert check(rows, results["packing"]) == 0
    assert public_tokenizers


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    names = ["row", "id", "src", "size", "rank", "drop", "__size", "h"]
    rows = [(1, words(1), "en", "a", 5), (1, words(1), "en", "a", 5), (2, words(1) + " more", "en", None, 5), (None, None, None, None, None), (None, words(3), None, "b", None), (4, "", "de", "b", 0), (5, words(5) * 300, "de", "c", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for held in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, DIR)
            got = out.collect()
            if name != "packing":
                assert out.schema == docs.schema
                held = spark.createDataFrame(got, docs.schema)
            if name == "n-gram Jaccard join" and got:
                assert {r.doc_id for r in got} == {1, None, 4, 5}
        assert bool(got) == bool(held.collect())
