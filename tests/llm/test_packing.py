"""Packing: an exact round trip against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lethe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, window=4096):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((i is None, i or 0, np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x[2]) // 4 for x in want)
    once = {i: t for i, t in rows}
    for doc_id, parts in by_doc.items():
        ids = np.asarray(tokenizer.encode(once[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        covered = np.zeros(len(ids), int)
        for p in parts:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            covered[p.start : p.start + p.length] += 1
        assert set(covered) == {sum(i == doc_id for i, _ in rows)}
    padding = 0
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = [(90001, None), (90002, ""), (90003, "a" * 30000), (90004, "x<|endoftext|>y, Don't. <|ENDOFTEXT|> İstanbul, é z\u001cq 1,2.3"), (90005, "word " * 9000), (None, "no id")]
    everything = docs.union(spark.createDataFrame(odd, docs.schema)).repartition(3)
    pieces = packing.pack(everything, PATH).collect()
    assert check(rows + odd, pieces) == 0
    groups = {}
    for p in pieces:
        groups[p.step_group] = groups.get(p.step_group, 0) + p.length
    assert max(groups.values()) <= 32768


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two"), (1, "one two"), (2, "three")]
    assert check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("limit", [5, 50])
def test_memo_refills(monkeypatch, limit):
    monkeypatch.setattr(packing, "MEMO_WORDS", limit)
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(tokenizer)
    for text in ("a b c d e f g", "a b x, y. z, a", "q r s t u v w x y z a b c d", "İ İa b"):
        assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_marks_after_letters_that_normalise_to_a_combining_mark():
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(tokenizer)
    for letter in ("\u0130", "\u0958", "\u09df", "\ufb1d", "\ufb4e"):
        for text in (f"{letter},", f"SANK{letter}.", f"a{letter}b!? {letter} {letter}\"", f"x {letter}, y."):
            assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(["Some Words  here", "", None, "A\n\nB\tc", "don't STOP", "ça va été", "x" * 5000, "a  <|endoftext|> b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for p in packing.pack(docs, path).collect():
        ids = np.asarray(tokenizer.encode(rows[p.doc_id][1] or "", add_special_tokens=False).ids + [2], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packing.word_by_word(open(PATH).read()) and not packing.word_by_word(open(path).read())
