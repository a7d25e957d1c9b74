"""MPEG audio columns: exact round trips, damaged streams, and defined cases."""

import hashlib
import random
import zlib

import pytest

from lethe.llm import audio


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 1021, 1022, 5000, 200_000])
def test_round_trip(n):
    payload = audio.padded(random.Random(n).randbytes(n))
    data = audio.write_audio(payload, n)
    found = audio.read_audio(data)
    assert found["payload"] == payload
    assert found["bad"] == found["lost"] == 0
    assert (found["table"]["frames"], found["table"]["kind"], len(found["table"]["seek"])) == (found["frames"], "Xing", 100)
    assert found["fields"]["bytes"] == str(n)
    for at in found["seek"]:
        assert data[at] == 0xFF and audio._header(data[at : at + 4])


def test_resynchronises_after_damage_and_junk():
    payload = audio.padded(random.Random(1).randbytes(20_000))
    data = audio.write_audio(payload, 20_000)
    clean = audio.read_audio(data)
    start = clean["seek"][0]
    broken = bytearray(data)
    broken[start + 4] ^= 0xFF  # the first frame's checksum
    found = audio.read_audio(bytes(broken))
    assert found["frames"] == clean["frames"] - 1
    assert found["bad"] >= 1
    junk = audio.read_audio(b"\xff\xfa\x00junk" * 3 + data[start:] + b"TAG" + bytes(125))
    assert junk["frames"] == clean["frames"]
    assert junk["payload"][: len(payload)] == payload
    assert audio.read_audio(b"")["frames"] == audio.read_audio(b"no audio")["frames"] == 0


def test_known_checksum():
    assert audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(90001, None), (90002, ""), (90003, "é" * 50_000), (90003, "é" * 50_000), (None, "x" * 64)]
    rows = docs.union(spark.createDataFrame(odd, docs.schema))
    got = audio.index_audio(audio.to_audio(rows)).collect()
    texts = {(r.doc_id, hashlib.sha256(audio.padded((r.text or "").encode())).hexdigest()): (r.text or "").encode() for r in rows.collect()}
    assert len(got) == docs.count() + len(odd)
    for r in got:
        text = texts[r.doc_id, r.payload_sha256]
        payload = audio.padded(text)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.duration_us > 0 and r.bad_frames == 0
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (90001, 90002)}) == 1
    assert audio.index_audio(audio.to_audio(rows.limit(0))).count() == 0
    assert audio.index_audio(audio.store_audio(rows)).count() == len(got)


def frame(head: bytes, fill: bytes = b"") -> bytes:
    h = audio._header(head)
    return (head + fill).ljust(h.length, b"\x00")


MONO = bytes((0xFF, 0xFB, 0x90, 0xC0))  # 128 kbit/s at 44.1 kHz without checksum
LOW = bytes((0xFF, 0xF3, 0x80, 0xC0))  # MPEG-2, 64 kbit/s at 22.05 kHz


def test_a_lone_header_in_junk_is_no_frame():
    payload = audio.padded(random.Random(2).randbytes(3000))
    data = audio.write_audio(payload, 3000)
    tag = data.index(b"\xff\xfa")
    clean = audio.read_audio(data)
    junk = data[:tag] + b"junk" * 10 + MONO + bytes(456) + data[tag:]
    found = audio.read_audio(junk)
    assert found["payload"] == payload and found["frames"] == clean["frames"] and found["table"] == clean["table"] | {"seek": [x + 500 for x in clean["table"]["seek"]]}
    good = audio.read_audio(b"junk" + frame(MONO) * 3 + b"junk" + frame(MONO) * 2)
    assert good["frames"] == 5 and good["lost"] == 8
    assert audio.read_audio(frame(MONO))["frames"] == 1


def test_tables_are_read_by_their_flags():
    skip = audio._header(MONO).skip - 4
    for flags, body, want in (
        (1, (7).to_bytes(4, "big"), (7, None, 0)),
        (2, (900).to_bytes(4, "big"), (None, 900, 0)),
        (3, (7).to_bytes(4, "big") + (900).to_bytes(4, "big"), (7, 900, 0)),
        (6, (2560).to_bytes(4, "big") + bytes(range(100)), (None, 2560, 100)),
        (0, b"", (None, None, 0)),
    ):
        for kind in (b"Xing", b"Info"):
            x = audio.read_audio(frame(MONO, bytes(skip) + kind + flags.to_bytes(4, "big") + body) + frame(MONO) * 2)
            t = x["table"]
            assert x["frames"] == 2 and (t["kind"], t["frames"], t["bytes"], len(t["seek"])) == (kind.decode(), *want)
    assert t["seek"] == [] and audio.read_audio(frame(MONO, bytes(skip) + b"Xing" + (6).to_bytes(4, "big") + (2560).to_bytes(4, "big") + bytes(range(100))) + frame(MONO))["table"]["seek"][:3] == [0, 10, 20]
    vbri = b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (4000).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes((0, 3, 0, 2, 0, 2, 0, 3)) + bytes((0, 10, 0, 20, 0, 30))
    x = audio.read_audio(frame(MONO, bytes(32) + vbri) + frame(MONO))
    assert x["table"] == {"kind": "VBRI", "frames": 9, "bytes": 4000, "seek": [0, 20, 60]} and x["frames"] == 1


def test_low_sample_rates_and_exact_durations(spark):
    x = audio.read_audio(frame(LOW) * 5)
    assert (x["frames"], x["samples"], x["rate"]) == (5, 5 * 576, 22050)
    media = spark.createDataFrame([(1, 0, bytearray(frame(LOW) * 5)), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in audio.index_audio(media).collect()}
    assert (got[1].samples, got[1].sample_rate, got[1].duration_us) == (2880, 22050, round(2880 / 22050 * 1e6))
    assert (got[2].samples, got[2].duration_us) == (0, 0)
