"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed and the letter. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a document's vector
bundles (adds) its n-grams' vectors. A language's prototype bundles the unit vectors of its sample
documents; what all prototypes share is taken off, and a few passes move misjudged documents' vectors
from the wrong prototype to the right one. Documents get the language of the largest cosine.

Prototypes are fitted on the driver on a bounded sample (``per_lang`` documents of each language,
chosen by hash, whole texts); every document is then compared in full.

Defined cases: a null text or one without any letter is ``und`` with score 0; without learned
languages every document is ``und``; null languages are not learned from; null doc_ids are not held out; languages with few rows are
learned from all of them; repeated rows are judged alike; text without n-gram of three is padded by
word ends, so a single letter has n-grams; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches

GRAM = 3
DIMS = 1024
MEMO_GRAMS = 200_000
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters with a space on both sides; empty without letters."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""  # the pattern also lets fractions and the like through


class Grams:
    """Vectors of n-grams, bound from letter vectors and kept in a table that is refilled when full."""

    def __init__(self, dims: int = DIMS, seed: int = 7):
        self.dims, self.seed = dims, seed
        self.chars: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dims), np.int8)

    def char(self, code: int) -> np.ndarray:
        if code not in self.chars:
            self.chars[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1
        return self.chars[code]

    def _learn(self, key: int) -> int:
        codes = [key >> 21 * (GRAM - 1 - i) & 0x1FFFFF for i in range(GRAM)]
        bound = np.ones(self.dims, np.int8)
        for i, code in enumerate(codes):
            bound = bound * np.roll(self.char(code), GRAM - 1 - i)
        row = len(self.rows)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = bound
        self.rows[key] = row
        return row

    def document(self, words: str) -> np.ndarray:
        """The bundled n-grams of a text as letters() gives it."""
        code = np.frombuffer(words.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        keys = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
        found, counts = np.unique(keys, return_counts=True)
        if len(self.rows) + len(found) > MEMO_GRAMS:
            self.rows.clear()
            self.table = np.zeros((max(1024, len(found)), self.dims), np.int8)
        rows, held = self.rows, found.tolist()
        at = [rows[k] if k in rows else self._learn(k) for k in held]
        out = np.zeros(self.dims, np.float32)
        for i in range(0, len(at), 4096):
            out += counts[i : i + 4096].astype(np.float32) @ self.table[at[i : i + 4096]].astype(np.float32)
        return out


@dataclass
class Profiles:
    """Language names, their prototypes as unit rows, the shared vector taken off, and the seed."""

    names: list[str]
    prototypes: np.ndarray
    shared: np.ndarray
    seed: int = 7
    sharpness: float = 12.0

    def judge(self, grams: Grams, text: str | None) -> tuple[str, float]:
        words = letters(text)
        if not words or not self.names:
            return "und", 0.0
        cosines = self.prototypes @ centred(grams.document(words), self.shared)
        share = np.exp(self.sharpness * (cosines - cosines.max()))
        best = int(cosines.argmax())
        return self.names[best], float(share[best] / share.sum())


def centred(vector: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The unit vector without what all languages share, of length 1."""
    v = vector / (np.linalg.norm(vector) + 1e-9) - shared
    return v / (np.linalg.norm(v) + 1e-9)


def learn(texts: list[str], langs: list[str], passes: int = 10, rate: float = 0.2, seed: int = 7) -> Profiles:
    """Prototypes from labelled texts."""
    pairs = [(w, g) for t, g in zip(texts, langs) if (w := letters(t))]
    names = sorted({g for _, g in pairs})
    grams = Grams(seed=seed)
    if not names:
        return Profiles([], np.zeros((0, DIMS), np.float32), np.zeros(DIMS, np.float32), seed)
    vectors = np.stack([grams.document(w) for w, _ in pairs])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    y = np.array([names.index(g) for _, g in pairs])
    raw = np.stack([vectors[y == i].mean(axis=0) for i in range(len(names))])
    shared = raw.mean(axis=0) if len(names) > 1 else np.zeros(DIMS, np.float32)
    x = vectors - shared
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    p = np.stack([x[y == i].mean(axis=0) for i in range(len(names))])
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    best, best_wrong = unit(p), len(y) + 1
    for _ in range(passes):
        guess = (x @ unit(p).T).argmax(axis=1)
        wrong = np.flatnonzero(guess != y)
        if len(wrong) < best_wrong:
            best, best_wrong = unit(p), len(wrong)
        if not len(wrong):
            break
        for i in wrong:
            p[y[i]] += rate * x[i] / max(1, (y == y[i]).sum()) ** 0.5
            p[guess[i]] -= rate * x[i] / max(1, (y == guess[i]).sum()) ** 0.5
    return Profiles(names, best.astype(np.float32), shared.astype(np.float32), seed)


def sample(docs: DataFrame, per_lang: int = 600, fold_of: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, text, lang): at most ``per_lang`` documents of each language outside the held-out remainder.

    A hash of doc_id and text chooses some more than that, and the first of them in order of the hash stay.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold_of != held, F.lit(True)))
    spot = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 20))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("least")).collect()  # a row for each language
    if not counts:
        return rows.select("doc_id", "text", "lang").limit(0)
    most = {r.lang: max(r.least, int((1 << 20) * min(1.0, 2 * per_lang / r.n))) for r in counts}  # the least passes, however few texts differ
    chance = F.create_map(*[F.lit(x) for pair in sorted(most.items()) for x in pair])
    some = rows.select("doc_id", "text", "lang", spot.alias("spot")).where(F.col("spot") <= F.element_at(chance, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id", "text"))
    return some.withColumn("place", place).where(F.col("place") <= per_lang).select("doc_id", "text", "lang")


def fit(docs: DataFrame, per_lang: int = 600, fold_of: int = 4, held: int = 2) -> Profiles:
    """Profiles from at most ``per_lang`` documents of each language, whole texts, on the driver."""
    got = sample(docs, per_lang, fold_of, held).orderBy("doc_id", "lang", "text").select("text", "lang").toPandas()
    return learn(list(got["text"]), list(got["lang"]))


def identify(docs: DataFrame, profiles: Profiles, fold_of: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(profiles)  # a vector for each language

    def run(batches):
        known = shipped.value
        grams = Grams(seed=known.seed)
        for batch in batches:
            found = [known.judge(grams, x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold_of == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
