import hashlib
import zlib

import pytest

from weir.llm import media, mpeg, packing, sharding

TEXTS = [(1, "Hello  world\n\nagain"), (2, None), (3, ""), (4, "é" * 5000), (4, "é" * 5000), (5, "word " * 9000 + "<|endoftext|> x"), (None, "no id here"), (7, " lead\ttab\r\nend ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 5, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, media string").repartition(3)


def test_media_round_trip(docs):
    rows = media.probe(media.store(docs)).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = by[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.crc_bad == 0 and r.junk_bytes == 0 and r.crc_ok == r.frames and r.table_kind == "Xing"
    assert len({r.media_sha256 for r in by[4]}) == 1


def test_resynchronisation_and_checksums():
    payload = bytes(range(256)) * 30
    stream = mpeg.encode(payload)
    clean = mpeg.scan(stream)
    assert mpeg.decode(stream, clean) == payload and clean["samples"] == 1152 * len(clean["frames"])
    at = clean["frames"][2][0]
    noisy = b"\xff\xfbxx" + stream[:at] + b"\xff\xff\xe0junk" + stream[at:]
    s = mpeg.scan(noisy[4:])
    assert len(s["frames"]) == len(clean["frames"]) and s["resyncs"] == 1 and s["junk"] == 7
    broken = bytearray(stream)
    broken[clean["frames"][1][0] + 8] ^= 1  # side information, under the checksum
    assert mpeg.scan(bytes(broken))["crc_bad"] == 1
    cut = mpeg.scan(stream[:-10])
    assert cut["truncated"] and len(cut["frames"]) == len(clean["frames"]) - 1
    assert mpeg.scan(b"")["frames"] == [] and mpeg.scan(b"\xff" * 50)["duration"] == 0


def naive_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


@pytest.mark.parametrize("layer,mode,index,bands,bound", [(1, 0, 5, [4] * 32, 32), (1, 1, 5, [4] * 32, 8), (1, 3, 5, [4] * 32, 32), (2, 0, 12, [4] * 11 + [3] * 12 + [2] * 7, 30), (2, 1, 12, [4] * 11 + [3] * 12 + [2] * 7, 8), (2, 3, 1, [4, 4, 3, 3, 3, 3, 3, 3], 8)])
def test_checksums_of_layers_one_and_two(layer, mode, index, bands, bound):
    import random

    r = random.Random(index + mode)
    word = 0x7FF << 21 | 3 << 19 | (4 - layer) << 17 | index << 12 | mode << 6 | 1 << 4  # 44.1 kHz, bound 8 if joint
    h = mpeg.header(word)
    bits, chosen = [], 0
    for band, n in enumerate(bands):
        for _ in range(1 if mode == 3 or band >= bound else 2):
            v = r.choice([0, r.randrange(1 << n)])
            bits += [v >> n - 1 - i & 1 for i in range(n)]
            chosen += (v > 0) * (1 if mode == 3 or band < bound else 2)
    if layer == 2:
        bits += [r.randrange(2) for _ in range(2 * chosen)]
    head = word.to_bytes(4, "big")
    crc = naive_crc([word >> 15 - i & 1 for i in range(16)] + bits)
    raw = "".join(map(str, bits)).ljust(8 * (h.size - 6), "1")
    frame = head + crc.to_bytes(2, "big") + int(raw, 2).to_bytes(h.size - 6, "big")
    s = mpeg.scan(frame * 3)
    assert (len(s["frames"]), s["crc_ok"], s["crc_bad"]) == (3, 3, 0)
    broken = frame[:6] + bytes([frame[6] ^ 0x80]) + frame[7:]
    s = mpeg.scan(frame + broken + frame)
    assert (s["crc_ok"], s["crc_bad"]) == (2, 1)


def test_tags_and_tables():
    import struct

    body = mpeg.encode(b"x" * 5000)
    plain = mpeg.scan(body)
    assert plain["table"]["agrees"] and len(plain["table"]["points"]) == 100 and plain["table"]["points"][0] == plain["table"]["at"]
    audio = body[plain["table"]["at"] :]
    old = b"TT2\0\0\x05\0name" + b"TXX\0\0\x06\0ab\0\xff\0c"
    tag = b"ID3\x02\0\x80" + mpeg._syncsafe(len(old)) + old
    n, tags = mpeg.read_id3v2(tag + audio)
    assert n == len(tag) and tags["TT2"] == "name" and "TXXX:ab" in tags
    item = struct.pack("<II", 3, 0) + b"Artist\0abc"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    v1 = b"TAG" + b"title".ljust(125, b"\0")
    s = mpeg.scan(audio + ape + v1)
    assert s["tags"]["APE:Artist"] == "abc" and s["tags"]["TIT2"] == "title" and s["junk"] == 0 and s["table"]["agrees"]
    assert not mpeg.scan(audio[:-1])["table"]["agrees"]
    # an encoder's delay and padding are not played
    at = 4 + 2 + 17 + 16 + 100
    lame = audio[:at] + b"LAME3.100" + bytes(12) + (576 << 12 | 100).to_bytes(3, "big") + audio[at + 24 :]
    s = mpeg.scan(lame)
    assert s["duration"] == mpeg.Fraction(s["samples"] - 676, 32000) and (s["table"]["delay"], s["table"]["padding"]) == (576, 100)
    vbri = audio[:23] + bytes(13) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, len(audio), len(s["frames"]), 3, 2, 2, 1) + struct.pack(">HHH", 10, 20, 30)
    size = plain["frames"][0][0] - plain["table"]["at"]
    s = mpeg.scan(vbri.ljust(size, b"\0") + audio[size:])
    assert s["table"]["kind"] == "VBRI" and s["table"]["points"] == [0, 20, 60] and s["table"]["agrees"]
    assert len(mpeg.scan(audio, 1)["seek"]) == len(plain["frames"])


def test_probe_leaves_out_clashing_columns(spark):
    df = spark.createDataFrame([(1, bytearray(mpeg.encode(b"y" * 192)), "a", 5), (2, None, "b", 6), (2, None, "b", 6)], "doc_id long, media binary, Frames string, own int")
    rows = sorted(media.probe(df, seek_every=1).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.own, r.frames) for r in rows] == [(1, 5, 1), (2, 6, 0), (2, 6, 0)]
    assert rows[0].tags == {"TXXX:payload_bytes": "192"} and rows[1].tags == {}
    assert media.probe(df.limit(0)).count() == 0


def test_headers():
    h = mpeg.header(0xFFFB9064)
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples, h.protected) == (1, 3, 128, 44100, 417, 1152, False)
    assert mpeg.header(0xFFF30000 | 8 << 12).version == 2
    assert mpeg.header(0xFFE00000) is None and mpeg.header(0) is None


def test_packing_against_brute_force(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    length = 64
    rows = packing.pack(docs, length).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, x in spans.items():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
        assert sum(n for _, n in x) == length or s == max(spans)
    import struct

    for i, text in {k: v for k, v in TEXTS if k != 4}.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i, len(ids)], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r.continued == (r.start > 0) and r.continues == (r.start + r.length < len(ids))
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * (len(t.encode("é" * 5000).ids) + 1)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.grown_shard in (r.shard, sharding.SHARDS)
    many = spark.range(0, 6000).selectExpr("id as doc_id", "cast(id as string) as text").union(spark.range(0, 3000).selectExpr("7L as doc_id", "'same' as text"))
    got = sharding.shard(many, 5, [1, 1, 2, 1, 1]).collect()
    slots, keys = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        keys.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(k) == 1 for k in keys.values())
    share = sum(next(iter(k))[0] == 2 for k in keys.values()) / 6000
    assert abs(share - 2 / 6) < 0.03
    assert all(g in (s, 5) for k in keys.values() for s, g in k)
    assert {r.text_crc32 for r in got if r.doc_id == 7} == {zlib.crc32(b"7"), zlib.crc32(b"same")}
    assert sharding.shard(many.limit(0)).count() == 0
