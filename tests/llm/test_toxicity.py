"""Toxicity: folding, held-out accuracy, exceptions, defined cases."""

import random
import zlib

from lethe.llm import toxicity


def test_folding():
    assert toxicity.fold("An 1D10T, ѕtuріd!") == " an idiot stupid "
    assert toxicity.fold("i.d.i.o.t iiidiot i d i o t") == " idiot idiot idiot "
    assert toxicity.fold("ｓｃｕｍ 2024 5 $5") == " scum 2024 5 5 "
    assert toxicity.fold("") == "  "


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(max(1, len(text) // 20)):
                bad = r.choice(["zorgle", "wuxxit", "qymbol" + r.choice(["a", "en", "ish", "ata"])])
                text.insert(r.randrange(len(text)), r.choice([bad, bad.upper(), bad.replace("o", "0"), ".".join(bad)]))
        elif r.random() < 0.05:
            text += ["clean", "zorgle", "award"]
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_exceptions_excuse_a_term():
    lexicon = toxicity.Lexicon({" zorgle ": 3.0}, [" zorgle award "], (-1.0, 2.0, 0.0))
    match = lexicon.matcher()
    assert match(toxicity.fold("a zorgle b"))[0] == 3.0
    assert match(toxicity.fold("a zorgle award"))[0] == 0.0
    assert lexicon.score(0.0, 5) < 0.5 < lexicon.score(3.0, 5)


def test_labels_of_held_out_documents_are_never_read(spark):
    docs, labels = frames(spark, corpus(400))
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and all(r.predicted == 0 for r in got)
    one = spark.createDataFrame([(1, 1), (1, None), (2, None)], "doc_id long, toxic int")
    assert all(r.score > 0.99 for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    more = docs.selectExpr("doc_id", "text", "1 AS score", "'x' AS terms")
    assert toxicity.drop_toxic(more, none).columns == more.columns


def naive(lexicon, text):
    """All places of all terms and exceptions, by plain search."""
    def places(term):
        at = text.find(term)
        while at >= 0:
            yield at, at + len(term)
            at = text.find(term, at + 1)

    excused = [p for phrase in lexicon.exceptions if phrase not in lexicon.weights for p in places(phrase)]
    total, terms, starts = 0.0, set(), {}
    for term, weight in lexicon.weights.items():
        for a, b in places(term):
            if not any(x <= a and b <= y for x, y in excused):
                starts.setdefault(a, []).append((b, weight, term))
    for a, found in starts.items():
        _, weight, term = max(found)
        total += weight
        terms.add(term)
    return total, len(terms)


def test_repeated_ids_learn_from_one_text_in_any_order(spark):
    rows = corpus(400)
    ids = "doc_id long, text string"
    docs = [(i, text) for i, text, _ in rows] + [(i, "~ zorgle " * 3) for i, _, _ in rows] + [(i, None) for i, _, _ in rows[::3]]
    labels = spark.createDataFrame([(i, bool(toxic)) for i, _, toxic in rows], "doc_id long, toxic boolean")
    once = toxicity.fit(spark.createDataFrame([(i, text) for i, text, _ in rows], ids), labels)
    for given, parts in ((docs, 3), (docs[::-1], 5)):
        assert toxicity.fit(spark.createDataFrame(given, ids).repartition(parts), labels) == once


def test_matcher_is_the_naive_search():
    import random

    r = random.Random(5)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abba ": 2.5, " ba": 0.5, " cab ": 4.0}, [" ab c ", " c ba ", " abba ab "])
    match = lexicon.matcher()
    for _ in range(500):
        text = f" {' '.join(''.join(r.choice('abc') for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 30)))} "
        total, terms, words = match(text)
        assert (round(total, 9), terms) == (round(naive(lexicon, text)[0], 9), naive(lexicon, text)[1]), text
        assert words == max(0, text.count(" ") - 1)


def test_scores_are_those_of_the_naive_search(spark):
    """Every score of the query from the learned lexicon, by plain search and the curve."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    for r in docs.collect():
        text = toxicity.fold(r.text or "")
        assert abs(got[r.doc_id] - lexicon.score(naive(lexicon, text)[0], max(0, text.count(" ") - 1))) < 1e-9


def test_long_texts_are_linear(spark):
    import time

    lexicon = toxicity.Lexicon({" bad": 1.0}, [" bad apple pie in "], (0.0, 1.0, 0.0))
    match, text = lexicon.matcher(), " bad apple pie in" * 60_000 + " "
    began = time.time()
    assert match(text)[0] == 0.0
    assert time.time() - began < 5
    docs = spark.createDataFrame([(1, "bad " * 200_000, "x"), (2, "", "y"), (3, None, "z")], "doc_id long, text string, score string")
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(docs, lexicon).collect()} == {1: True, 2: False, 3: False}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).schema == docs.schema
