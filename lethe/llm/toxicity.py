"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to plain letters, takes marks out of the
inside of words and shortens long runs of one letter. The lexicon's terms are words and word beginnings
learned from labelled documents, each with a weight; exception phrases are a term with a neighbour that
clean documents use and toxic ones don't, and a hit inside one doesn't count. A document's weight is
normalised by its length, and a logistic curve turns both into a score.

The lexicon is fitted on the driver on a bounded sample of labelled rows (``per_label`` documents of
each label, chosen by hash); scoring covers every document in full.

Defined cases: null and empty texts score as a text without hits; null labels are not learned from;
repeated rows score alike, null doc_ids are not held out, repeated labels of a document count once with
the largest; of the texts of a repeated doc_id the first in byte order is learned from; with one label
only, or no labels, every document scores the share of toxic labels (0 without labels); an empty table
gives an empty result; further columns pass through ``drop_toxic`` unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches, small

# Letters of other scripts that look like Latin ones, and digits or marks written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
WIDE = {chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}  # full-width forms

FOLD = str.maketrans(WIDE | HOMOGLYPHS | dict.fromkeys("​‌‍⁠﻿­"))
_IN_WORD = re.compile(r"(?<=[^\W_])[013457890@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457890@$]+(?=[^\W\d_])")
_MARKS = re.compile(r"(?<=[^\W\d_])[*._\-~'’]+(?=[^\W\d_])")
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ \-.*_]){3,}[^\W\d_](?![^\W_])")
_NO_WORD = re.compile(r"[\W_]+")
_DIGIT = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Words of letters and digits, each between single spaces, with a space at both ends."""
    t = text.lower().translate(FOLD)
    t = _MARKS.sub("", t)
    t = _IN_WORD.sub(lambda m: m[0].translate(_DIGIT), t)
    t = _SPELLED.sub(lambda m: _NO_WORD.sub("", m[0]), t)
    t = _RUNS.sub(r"\1", t)
    return f" {_NO_WORD.sub(' ', t).strip()} "


@dataclass
class Lexicon:
    """Terms with weights (a term begins with a space, a whole word also ends with one), exceptions, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def matcher(self):
        """A function from folded text to (summed weight, distinct terms, words)."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                machine.add_word(phrase, (len(phrase), None, phrase))
        if not len(machine):
            return lambda text: (0.0, 0, text.count(" ") - 1)
        machine.make_automaton()

        def match(text: str):
            hits, excused = [], []
            for end, (n, weight, term) in machine.iter(text):
                (excused if weight is None else hits).append((end - n + 1, -end, weight, term))
            hits.sort(key=lambda x: x[:2])
            excused.sort(key=lambda x: x[:2])
            total, terms, last, reach, i = 0.0, set(), -1, -1, 0
            for start, end, weight, term in hits:
                # reach is the farthest end of the exceptions that begin at or before the hit.
                while i < len(excused) and excused[i][0] <= start:
                    reach = max(reach, -excused[i][1])
                    i += 1
                if start != last and -end > reach:
                    total += weight
                    terms.add(term)
                    last = start
            return total, len(terms), max(0, text.count(" ") - 1)

        return match

    def score(self, weight: float, words: int) -> float:
        """The logistic curve over the weight and the weight for each 100 words."""
        a, b, c = self.curve
        z = a + b * np.log1p(weight) + c * np.log1p(100 * weight / (words + 20))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(texts: list[str], labels: list[int], share: float | None = None, least: int = 8, most_terms: int = 5000) -> Lexicon:
    """A lexicon from labelled texts. share: of toxic documents where it will be used, if the texts differ from that.

    A term needs ``least`` different contexts in toxic texts, so copies of one document prove nothing.
    A beginning stands for words of which none makes up most of it.
    """
    y = np.asarray(labels, float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        found = float(y.mean()) if len(y) else 0.0
        return Lexicon(curve=(float(np.log((found + 1e-9) / (1 - found + 1e-9))), 0.0, 0.0))
    folded = [fold(x) for x in texts]
    toxic, clean = Counter(), Counter()
    for text, label in zip(folded, labels):
        (toxic if label else clean).update(set(text.split()))

    def gain(a: int, b: int) -> float:
        """Log odds of the shares with the term, shrunk towards none."""
        return float(np.log((a + 0.1) / (n1 + 0.2)) - np.log((b + 0.5 + 0.02 * a) / (n0 + 1)))

    found = [(gain(n, clean[w]), n, f" {w} ") for w, n in toxic.items() if n >= least]
    heads = {}
    ordered = sorted(toxic)
    for size in range(3, HEAD_CHARS):
        for head, same in groupby((w for w in ordered if len(w) > size), key=lambda w: w[:size]):
            counts = [toxic[w] for w in same]
            if len(counts) >= 3 and sum(counts) >= 2 * least and max(counts) < 0.7 * sum(counts):
                heads[head] = sum(counts)
    clean_heads = Counter()
    for word, n in clean.items():
        for size in range(3, min(len(word) + 1, HEAD_CHARS)):
            if word[:size] in heads:
                clean_heads[word[:size]] += n
    found += [(gain(n, clean_heads[h]), n, f" {h}") for h, n in heads.items()]
    found = sorted((x for x in found if x[0] > 2.0), key=lambda x: (-x[0] * np.sqrt(x[1]), len(x[2])))
    taken: dict[str, float] = {}
    for value, _, term in found:
        bare = term.strip()
        # A beginning already taken covers the longer terms that are no stronger.
        if max((taken.get(f" {bare[:i]}", -1.0) for i in range(3, len(bare) + 1)), default=-1.0) < 0.8 * value:
            taken[term] = value
            if len(taken) >= 4 * most_terms:
                break
    in_toxic, contexts, in_clean = Counter(), {t: set() for t in taken}, Counter()
    machine = _machine(taken)
    for text, label in zip(folded, labels):
        hits = list(machine.iter(text)) if machine else []
        (in_toxic if label else in_clean).update({term for _, term in hits})
        if label:
            for end, term in hits:
                contexts[term].add(text[max(0, end - len(term) - 12) : end - len(term) + 1])
    kept = {t: gain(in_toxic[t], in_clean[t]) for t in taken if len(contexts[t]) >= least}
    kept = dict(sorted(((t, v) for t, v in kept.items() if v > 2.0), key=lambda x: (-x[1], x[0]))[:most_terms])
    lexicon = Lexicon(kept, _exceptions(folded, labels, kept))
    match = lexicon.matcher()
    points = np.array([match(x) for x in folded])
    x = np.column_stack([np.ones(len(points)), np.log1p(points[:, 0]), np.log1p(100 * points[:, 0] / (points[:, 2] + 20))])
    curve = _logistic(x, y)
    if share is not None and 0 < share < 1:
        curve[0] += np.log(share / (1 - share)) - np.log(n1 / n0)
    lexicon.curve = tuple(map(float, curve))
    return lexicon


HEAD_CHARS = 12


def _machine(terms):
    """The automaton of the terms, or None without terms."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term in terms:
        machine.add_word(term, term)
    if terms:
        machine.make_automaton()
    return machine if terms else None


def _exceptions(folded: list[str], labels: list[int], weights: dict[str, float], least: int = 3) -> list[str]:
    """Phrases of a term and a neighbouring word that clean documents hold and toxic ones don't."""
    heads = {t.strip() for t in weights}
    in_clean, in_toxic = Counter(), Counter()
    for text, label in zip(folded, labels):
        held = set()
        ws = text.split()
        for i, w in enumerate(ws):
            if w in heads or any(w[:k] in heads for k in range(3, min(len(w), HEAD_CHARS))):
                if i:
                    held.add(f" {ws[i - 1]} {w} ")
                if i + 1 < len(ws):
                    held.add(f" {w} {ws[i + 1]} ")
        (in_toxic if label else in_clean).update(held)
    return sorted(p for p, n in in_clean.items() if n >= least and not in_toxic[p])


def training_rows(docs: DataFrame, labels: DataFrame, fold_of: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, toxic) of labelled documents outside the held-out remainder of crc32(doc_id)."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where(F.crc32(F.col("doc_id").cast("string")) % fold_of != held)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, **folds) -> Lexicon:
    """A lexicon learned on at most about ``per_label`` labelled documents of each label, in full."""
    rows = training_rows(docs, labels, **folds)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("toxic") == label, F.lit(min(1.0, per_label / n))).otherwise(chance)
    spot = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(spot < chance)
    # Broadcast within the sample's bound, with room for chance; texts then stay where they are read.
    wanted = small(chosen, chosen.count(), 4 * per_label)
    sample = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id")
    got = sample.select("text", "toxic").toPandas()  # bounded by per_label for each label
    total = sum(counts.values())
    return learn([x or "" for x in got["text"]], [int(x) for x in got["toxic"]], counts.get(1, 0) / total if total else None)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, hits, words) for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(lexicon)  # bounded by most_terms

    def run(batches):
        held = shipped.value
        match = held.matcher()
        for batch in batches:
            found = [(w, n, held.score(w, words)) for w, n, words in (match(fold(x or "")) for x in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[2] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "score", "terms"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, terms long")


def toxicity(docs: DataFrame, labels: DataFrame, fold_of: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, terms."""
    out = score(docs, fit(docs, labels, fold_of=fold_of, held=held, **options))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold_of == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "terms",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the documents that score at or above the threshold; all columns stay."""
    lexicon = fit(docs, labels, **options)
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        held = shipped.value
        match = held.matcher()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = []
            for x in batch.column(at).to_pylist():
                w, _, words = match(fold(x or ""))
                keep.append(held.score(w, words) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
