"""Language profiles: held-out accuracy, algebra, defined cases."""

import random
import zlib

import numpy as np

from lethe.llm import language

SYLLABLES = {"aa": "ka lo mi ren tas", "bb": "sch ung heit ver be", "cc": "tion eau ment que oui", "dd": "ción ar do mente os"}


def rows(n, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 80))]
        out.append((i, " ".join(words), lang))
    return out


def test_held_out_accuracy(spark):
    data = rows(800)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs, per_lang=60)).collect()}
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.where("lang_pred = lang").count()
    assert right / out.count() > 0.97


def test_bundles_are_sums_of_bound_permuted_letters():
    grams = language.Grams(dims=64)
    a, b, c = (grams.char(ord(x)).astype(int) for x in " xy")
    want = np.roll(a, 2) * np.roll(b, 1) * c
    assert (grams.document(" xy") == want).all()
    assert (grams.document(" xy xy") == 2 * want + np.roll(b, 2) * np.roll(c, 1) * a + np.roll(c, 2) * np.roll(a, 1) * b).all()


def test_refilled_table_changes_nothing(monkeypatch):
    text = language.letters("some words of many letters, and yet more of them")
    want = language.Grams().document(text)
    monkeypatch.setattr(language, "MEMO_GRAMS", 10)
    small = language.Grams()
    small.document(language.letters("other words"))
    assert (small.document(text) == want).all()


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "12 34 !? ½ ²", "aa"), (4, "ka", "aa"), (4, "ka", "aa"), (None, "x", None)], "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect())
    assert [x[1] for x in got] == ["aa", "und", "und", "und", "aa", "aa"]
    none = language.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), none).count() == 0


def test_predictions_are_those_of_plain_vectors(spark):
    """Documents bundled n-gram by n-gram and compared with the learned prototypes in plain numpy."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    profiles = language.fit(docs)
    char = lambda c: np.random.default_rng((profiles.seed, ord(c))).integers(0, 2, language.DIMS, dtype=np.int8).astype(int) * 2 - 1
    held = {}

    def gram(g):
        if g not in held:
            held[g] = np.roll(char(g[0]), 2) * np.roll(char(g[1]), 1) * char(g[2])
        return held[g]

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, profiles).collect()}
    for r in docs.limit(60).collect():
        words = language.letters(r.text)
        if not words:
            assert got[r.doc_id][0] == "und"
            continue
        v = np.sum([gram(words[i : i + 3]) for i in range(len(words) - 2)], axis=0).astype(float)
        v = v / np.linalg.norm(v) - profiles.shared
        cosines = profiles.prototypes @ (v / np.linalg.norm(v))
        share = np.exp(profiles.sharpness * (cosines - cosines.max()))
        assert got[r.doc_id][0] == profiles.names[int(cosines.argmax())]
        assert abs(got[r.doc_id][1] - share.max() / share.sum()) < 1e-3


def test_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"text number {i}", "en") for i in range(300)] + [(4, "same text", "de")] * 300 + [(i, f"texte {i}", "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["count"] for r in language.sample(docs, per_lang=20).groupBy("lang").count().collect()}
    assert got["en"] == 20 and got["de"] == 20 and 1 <= got["fr"] <= 5


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "the quick brown fox " * 50_000, "en", "x"), (3, "der schnelle braune fuchs " * 3, "de", "y"), (4, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, spot string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(docs)).collect()}
    assert got[4] == "und" and got[1] == "en"
