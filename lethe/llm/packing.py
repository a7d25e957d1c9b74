"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents of its partition as a stream, so no token crosses the network:

1. A document's full ``window`` long stretches become sequences of their own; the rest is routed to
   the smallest tier (512, 1024, 2048, 4096) that holds it.
2. A buffer of pieces is packed from the longest tier down: each piece opens a window of its tier, and
   the gap is filled with the longest shorter piece that fits; if none fits, one is cut to size.
3. What is left when the partition ends is cut into windows at powers of two, which need no padding.
4. Sequences are dealt to step groups of equal token counts, best fit first.

Sequence and step group ids hold the partition in their upper half and a counter in the lower one.

Defined cases: null and empty texts are the closing id alone; repeated rows are packed again; a text
of any length is cut into pieces; an empty table gives no pieces; each id lies in exactly one piece;
only a sequence whose length is no power of two is padded, to ``window``.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
MEMO_WORDS = 600_000
SPECIAL = b"<|"
MARKS = string.punctuation.encode()


def stays_letters(word: str) -> bool:
    """Whether a word is letters alone before and after the tokenizer normalises it.

    U+0130 in lower case, and some letters in NFC, end with a combining mark, which is one token with marks that follow.
    """
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a tokenizer's normaliser or pre-tokenizer, sequences taken apart."""
    if part is None:
        return []
    return [x for y in part[inner] for x in steps(y, inner)] if inner in part else [part]


def word_by_word(source: str) -> bool:
    """Whether a tokenizer lower-cases, cuts at white space and drops it, and closes each word, so that WordIds gives its ids."""
    import regex

    data = json.loads(source)
    model, cuts = data["model"], steps(data.get("pre_tokenizer"), "pretokenizers")
    if {x["type"] for x in steps(data.get("normalizer"), "normalizers")} != {"NFC", "Replace", "Lowercase"} or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return False
    split, level = cuts
    cut = split["pattern"].get("Regex")
    return (
        model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not level["add_prefix_space"] and not level["use_regex"]
        and split["behavior"] == "Removed" and split["invert"] and cut is not None and regex.findall(cut, "ab cd.,\t\u00a0e") == ["ab", "cd", ".,", "e"]
    )


class TextIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer

    def text(self, text: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4").tobytes()


class WordIds(dict):
    """Ids of a word as packed little-endian 32-bit numbers; bounded, and refilled when full.

    For tokenizers of which ``word_by_word`` holds; others take ``TextIds``.

    White space never lies inside a token of a tokenizer that drops it, so texts can be encoded word
    by word. ASCII marks that close a word which stays letters are apart from it there. Unknown words of
    letters alone are encoded in one call, as one text: each ends with the only token that closes a
    word; should their number differ, words are encoded one by one.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if w.isalpha()]
        out = {}
        if plain:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[np.minimum(ids, len(self.closes) - 1)]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                out = {w: data[i:j] for w, i, j in zip(plain, [0, *cuts], cuts)}
        rest = [w for w in words if w not in out]
        for w, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[w] = np.asarray(x.ids, "<u4").tobytes()
        return [out[w] for w in words]

    def learn(self, words: list[bytes]) -> None:
        tails = {w: stem for w in words if len(stem := w.rstrip(MARKS)) < len(w) and stays_letters(stem.decode())}
        unknown = {x for w in words if (x := tails.get(w, w)) not in self}
        unknown |= {x for w, stem in tails.items() if (x := w[len(stem) :]) not in self}
        names = list(unknown)
        self.update(zip(names, self._encode([w.decode() for w in names])))
        for w, stem in tails.items():
            self[w] = self[stem] + self[w[len(stem) :]]

    def text(self, text: bytes) -> bytes:
        if SPECIAL not in text:  # case tells special strings apart, and nothing else
            text = text.lower()
        words = text.split()
        fresh = [w for w in set(words) if w not in self]
        if fresh and len(self) + len(fresh) > MEMO_WORDS:
            self.clear()
            fresh = list(set(words))
        if fresh:
            self.learn(fresh)
        return b"".join(map(self.__getitem__, words))


@lru_cache(2)
def text_ids(source: str) -> WordIds | TextIds:
    """A tokenizer, kept as long as a Python worker lives, so that later tasks find its memo of words filled."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return (WordIds if word_by_word(source) else TextIds)(Tokenizer.from_str(source))


class Packer:
    """Packs one partition's pieces; rows come out as lists for the schema's columns."""

    def __init__(self, part: int, tiers=TIERS, step_tokens: int = 32768, buffer_pieces: int = 2048):
        self.base, self.tiers, self.window = part << 32, tiers, tiers[-1]
        self.step_tokens, self.buffer_pieces = step_tokens, buffer_pieces
        self.pool: list[tuple[int, int, tuple]] = []  # (length, order, piece), sorted
        self.order = self.sequences = self.groups = 0
        self.open: list[list[int]] = []  # [room, step group] of groups that are not full
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._emit([(doc_id, at, ids[at : at + self.window], n)], self.window)
            at += self.window
        if at < n:
            self._put((doc_id, at, ids[at:].copy(), n))
        if len(self.pool) >= self.buffer_pieces:
            self._pack(self.buffer_pieces // 4)

    def close(self) -> None:
        self._pack(0)
        while self.pool:
            total = sum(x[0] for x in self.pool)
            self._fill([], 1 << min(total.bit_length() - 1, self.window.bit_length() - 1))

    def _put(self, piece: tuple) -> None:
        self.order += 1
        insort(self.pool, (len(piece[2]), self.order, piece))

    def _pack(self, keep: int) -> None:
        """Pack windows until few pieces, too short to fill a window of their tier, are left."""
        held = sum(x[0] for x in self.pool)
        while len(self.pool) > keep:
            longest = self.pool[-1][0]
            tier = next(t for t in self.tiers if t >= longest)
            if held < tier:
                return
            self._fill([self.pool.pop()[2]], tier)
            held -= tier

    def _fill(self, pieces: list[tuple], size: int) -> None:
        room = size - sum(len(x[2]) for x in pieces)
        while room:
            i = bisect_right(self.pool, (room, self.order + 1, ()))
            length, _, piece = self.pool.pop(i - 1 if i else 0)
            if length > room:
                doc_id, start, ids, n = piece
                self._put((doc_id, start + room, ids[room:], n))
                piece = (doc_id, start, ids[:room], n)
            pieces.append(piece)
            room -= len(piece[2])
        self._emit(pieces, size)

    def _emit(self, pieces: list[tuple], size: int) -> None:
        fits = [x for x in self.open if x[0] >= size]
        if fits:
            group = min(fits)
        else:
            group = [self.step_tokens, self.groups]
            self.groups += 1
            self.open.append(group)
        group[0] -= size
        if not group[0]:
            self.open.remove(group)
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.base + self.sequences, offset, size, self.base + group[1]))
            offset += len(ids)
        self.sequences += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers=TIERS, step_tokens: int = 32768) -> DataFrame:
    """One row for each piece of each document of (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path) as file:
        shipped = spark.sparkContext.broadcast(file.read())  # one vocabulary file
    closing = np.asarray([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        ids = text_ids(shipped.value)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)

        def out():
            rows = packer.take()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names) if rows else None

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packer.add(doc_id, np.frombuffer(ids.text(text or b"") + closing, "<u4"))
            if done := out():
                yield done
        packer.close()
        if done := out():
            yield done

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
