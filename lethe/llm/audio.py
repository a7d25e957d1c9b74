"""MPEG audio columns: writing, resynchronising, checking and indexing Layer III streams.

The bytes of a payload travel as the main data of MPEG-1 Layer III frames, one byte as the unit. A
stream is an ID3v2 tag, a frame with a Xing table (frames, bytes, seek table), and frames of the
highest bitrate; the last one has the lowest bitrate that holds the rest, so the rate varies. Each
frame carries the CRC-16 over its header and side information.

The parser starts from bytes alone and knows Layer III of MPEG-1, 2 and 2.5: it reads tags, looks for
frame headers, verifies each frame's checksum, steps on by the frame's length, and resynchronises when
a step fails. Out of step, a header without checksum counts only if another of the same kind stands
where its frame ends, or the stream ends there. Xing, Info and VBRI tables are read by their flags, and
give a seek table of their own. Durations are exact, as samples and sample rate. Seek offsets are byte
offsets of the frames at each step of ``seek_frames``.

Defined cases: a null or empty text is a payload of 64 zero bytes; repeated rows give equal columns;
bytes that hold no frame give an empty payload and no duration; bad frames are counted and skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import Scratch, bounded_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index for Layer III, sample rates, samples in a frame, side information.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE = {3: 17}  # bytes of side information by channel mode; 32 unless mono
LOW_SIDE = {3: 9}  # 17 unless mono
VERSIONS = {3: 1, 2: 2, 0: 4}  # version bits: what the rates of MPEG-1 are divided by
HEAD, CRC = 4, 2


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and all ones at the start."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def frame_length(bitrate: int, rate: int, padding: int) -> int:
    return 144000 * bitrate // rate + padding


@lru_cache(64)
def _frame_head(index: int, padding: int) -> bytes:
    """Header, checksum and empty side information of a mono frame at 44.1 kHz."""
    head = bytes((0xFF, 0xFA, index << 4 | padding << 1, 0xC0))
    side = bytes(SIDE[3])
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _room(index: int, padding: int = 0) -> int:
    return frame_length(BITRATES[index], RATES[0], padding) - HEAD - CRC - SIDE[3]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        text = b"\x03" + key.encode() + b"\x00" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body


TOP = len(BITRATES) - 1


def write_audio(payload: bytes, unpadded: int) -> bytes:
    """A stream that holds the payload."""
    frames, room, head = [], _room(TOP), _frame_head(TOP, 0)
    full = len(payload) // room
    frames = [head + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest := payload[full * room :]:
        index = next(i for i in range(1, TOP + 1) if _room(i) >= len(rest))
        frames.append(_frame_head(index, 0) + rest.ljust(_room(index), b"\x00"))
    sizes = [len(x) for x in frames]
    first = frame_length(BITRATES[9], RATES[0], 0)
    total = first + sum(sizes)
    starts, at = [], first
    for n in sizes:
        starts.append(at)
        at += n
    toc = bytes(starts[i * len(starts) // 100] * 256 // total for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    table = (_frame_head(9, 0) + xing).ljust(first, b"\x00")
    return _tag({"payload": str(len(payload)), "bytes": str(unpadded)}) + table + b"".join(frames)


def _read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio begins, and the user fields of an ID3v2 tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = 10 + sum((data[6 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
    at, fields = 10, {}
    while at + 10 <= size and data[at : at + 4].strip(b"\x00"):
        n = sum((data[at + 4 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
        if data[at : at + 4] == b"TXXX":
            key, _, value = data[at + 11 : at + 10 + n].partition(b"\x00")
            fields[key.decode(errors="replace")] = value.decode(errors="replace")
        at += 10 + n
    return size, fields


@dataclass(frozen=True)
class Header:
    length: int
    rate: int
    skip: int  # bytes before main data
    checked: bool
    bitrate: int
    samples: int
    kind: tuple  # what all frames of a stream share


@lru_cache(4096)
def _header(head: bytes) -> Header | None:
    """A Layer III frame's header, or None for no valid one."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2:
        return None
    part = VERSIONS.get(head[1] >> 3 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if part is None or not 0 < index < 15 or rate == 3 or head[3] & 3 == 2:
        return None
    first = part == 1
    hertz, bitrate = RATES[rate] // part, (BITRATES if first else LOW_BITRATES)[index]
    checked, mode = not head[1] & 1, head[3] >> 6
    side = SIDE.get(mode, 32) if first else LOW_SIDE.get(mode, 17)
    samples = SAMPLES if first else SAMPLES // 2
    length = samples // 8 * 1000 * bitrate // hertz + (head[2] >> 1 & 1)
    skip = HEAD + CRC * checked + side
    return Header(length, hertz, skip, checked, bitrate, samples, (part, hertz, mode == 3)) if length >= skip else None


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in a stream's first frame: kind, frames and bytes (None where not told), seek offsets."""
    number = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    end, x = at + h.length, at + h.skip
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, i = number(x + 4), x + 8
        out = {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "seek": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = number(i), i + 4
        if flags & 4 and i + 100 <= end and out["bytes"]:
            out["seek"] = [at + b * out["bytes"] // 256 for b in data[i : i + 100]]
        return out
    x = at + HEAD + 32
    if data[x : x + 4] == b"VBRI" and x + 26 <= end:
        entries, scale, size = number(x + 18, 2), number(x + 20, 2), number(x + 22, 2)
        seek, to = [], at
        for i in range(entries if x + 26 + entries * size <= end else 0):
            seek.append(to)
            to += number(x + 26 + i * size, size) * scale
        return {"kind": "VBRI", "frames": number(x + 14), "bytes": number(x + 10), "seek": seek}
    return None


def read_audio(data: bytes, seek_frames: int = 39) -> dict:
    """What a stream holds: payload, frames, samples, rate, bitrates, tag fields, its table, seek offsets, errors."""
    at, fields = _read_tag(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    out = {"fields": fields, "frames": 0, "samples": 0, "rate": 0, "bad": 0, "lost": 0, "table": None, "seek": [], "low": 0, "high": 0}
    parts, kind, in_step = [], None, False
    while at < end:
        h = _header(data[at : at + 4])
        if h and (kind is None or h.kind == kind):
            after = at + h.length
            if after > end:
                good = False
            elif h.checked:
                good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + h.skip]) == data[at + 4] << 8 | data[at + 5]
            else:
                following = _header(data[after : after + 4])
                good = in_step or after == end or following is not None and following.kind == h.kind
            if good:
                table = _table(data, at, h) if kind is None else None
                if table:
                    out["table"] = table
                else:
                    if out["frames"] % seek_frames == 0:
                        out["seek"].append(at)
                    out["frames"] += 1
                    out["samples"] += h.samples
                    out["low"], out["high"] = min(out["low"] or h.bitrate, h.bitrate), max(out["high"], h.bitrate)
                    parts.append(data[at + h.skip : after])
                out["rate"], kind, in_step, at = h.rate, h.kind, True, after
                continue
            out["bad"] += 1
        in_step = False
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out["lost"] += nxt - at
        at = nxt
    payload = b"".join(parts)
    out["payload"] = payload[: int(fields["payload"])] if fields.get("payload", "").isdigit() else payload
    return out


def padded(text: bytes, unit: int = 64) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\x00")


def to_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) from (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([write_audio(padded(x), len(x)) for x in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder, and read from there."""
    return Scratch(docs.sparkSession, "audio").write(to_audio(docs), "media", compression="zstd")


INDEX = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "samples long, sample_rate long, duration_us long, seek_offsets array<long>, bad_frames long"
)


def index_audio(media: DataFrame) -> DataFrame:
    """Digests, exact duration, feature string and seek offsets of each stream of (doc_id, n_bytes, media).

    The duration is samples / sample_rate seconds; duration_us is that to the nearest microsecond.
    """
    bounded_batches(media.sparkSession)
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.list_(pa.int64()) if "array" in x else pa.string() if "string" in x else pa.int64() for x in INDEX.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media"))):
                data = data or b""
                x = read_audio(data)
                p, t = x["payload"], x["table"] or {"kind": "none", "frames": None, "bytes": None, "seek": []}
                us = (2_000_000 * x["samples"] + x["rate"]) // (2 * x["rate"]) if x["rate"] else 0
                feature = (
                    f"layer3 {x['rate']}Hz frames={x['frames']} samples={x['samples']} kbps={x['low']}-{x['high']} "
                    f"table={t['kind']}:{t['frames']}:{t['bytes']}:{len(t['seek'])} bad={x['bad']} lost={x['lost']}"
                )
                digests = len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest()
                rows.append((doc_id, n, *digests, feature, x["samples"], x["rate"], us, x["seek"], x["bad"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, INDEX)
