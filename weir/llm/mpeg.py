"""MPEG audio streams: a tolerant parser, and a writer that carries bytes without loss.

The parser finds frames by their headers (versions 1, 2 and 2.5, layers I to III), resynchronises
after junk by asking that a second header of the same kind follows, reads ID3v2 (2.2 to 2.4), ID3v1
and APE tags and the Xing/Info and VBRI tables with their seek points, and verifies the checksum of
protected frames of all layers. Duration is exact: samples over rate, no rounding, without the
encoder's delay and padding where a table tells them. Free-format streams aren't read.
"""

from __future__ import annotations

import struct
from fractions import Fraction

# Fixed values of the MPEG audio header: kbit/s by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hz by version and index.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Bits of each subband's allocation in layer II, by table.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
#: A seek offset is kept for every so many frames, unless told otherwise.
SEEK_EVERY = 64


class Header:
    __slots__ = ("version", "layer", "protected", "kbps", "rate", "padding", "mono", "bound", "size", "samples")

    def __init__(self, word: int) -> None:
        self.version = {0: 2.5, 2: 2, 3: 1}[word >> 19 & 3]
        self.layer = 4 - (word >> 17 & 3)
        self.protected = not word >> 16 & 1
        self.kbps = BITRATES[1 if self.version == 1 else 2, self.layer][word >> 12 & 15]
        self.rate = RATES[self.version][word >> 10 & 3]
        self.padding = word >> 9 & 1
        self.mono = word >> 6 & 3 == 3
        self.bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32  # first subband both channels share
        self.samples = 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576
        if self.layer == 1:
            self.size = (12000 * self.kbps // self.rate + self.padding) * 4
        else:
            self.size = self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def allocation(self) -> tuple[int, ...]:
        """Bits of the subbands' allocations (layers I and II)."""
        if self.layer == 1:
            return (4,) * 32
        if self.version != 1:
            return ALLOCATION["lsf"]
        each = self.kbps if self.mono else self.kbps // 2
        if each >= 56:
            return ALLOCATION["a" if self.rate == 48000 or each <= 80 else "b"]
        return ALLOCATION["d" if self.rate == 32000 else "c"]

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header that 32 bits are, or None. Free-format streams (bitrate index 0) aren't read."""
    if word not in _headers:
        if len(_headers) > 1 << 16:
            _headers.clear()
        ok = word >> 21 == 0x7FF and word >> 19 & 3 != 1 and word >> 17 & 3 and 0 < word >> 12 & 15 < 15 and word >> 10 & 3 < 3
        _headers[word] = Header(word) if ok else None
    return _headers[word]


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes, bits: int | None = None) -> int:
    """The audio checksum of the first `bits` bits, or of all: polynomial 0x8005, start 0xFFFF, high
    bit first. Kept by content."""
    bits = 8 * len(data) if bits is None else bits
    if (data, bits) not in _crcs:
        if len(_crcs) > 1 << 14:
            _crcs.clear()
        c = 0xFFFF
        for b in data[: bits // 8]:
            c = c << 8 & 0xFFFF ^ _CRC[c >> 8 ^ b]
        for i in range(bits % 8):
            top = c >> 15 ^ data[bits // 8] >> 7 - i & 1
            c = (c << 1 ^ 0x8005 * top) & 0xFFFF
        _crcs[data, bits] = c
    return _crcs[data, bits]


def covered(frame: bytes, h: Header) -> int:
    """Bits behind the checksum that it covers: side information, or allocations and, in layer II,
    two bits for each that isn't 0."""
    if h.layer == 3:
        return 8 * h.side
    channels, bits, more = 1 if h.mono else 2, 0, 0
    body, total = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    for band, n in enumerate(h.allocation):
        for _ in range(channels if band < h.bound else 1):
            bits += n
            if h.layer == 2 and bits <= total and body >> total - bits & (1 << n) - 1:
                more += 2 * (1 if band < h.bound else channels)
    return bits + more


def intact(frame: bytes, h: Header) -> bool:
    """Whether the checksum of a protected frame holds."""
    bits = covered(frame[: 6 + 128], h)  # no layer covers more than 128 bytes
    if 48 + bits > 8 * len(frame):
        return False
    return crc16(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _number(raw: bytes, safe: bool) -> int:
    """A size: seven bits a byte if safe, else eight."""
    return sum(b << (7 if safe else 8) * i for i, b in enumerate(reversed(raw)))


def _joined(raw: bytes) -> bytes:
    """Bytes without what unsynchronisation put in."""
    return raw.replace(b"\xff\x00", b"\xff")


def read_id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of a leading ID3v2 tag (0 if none) and its text frames, under their own names; those
    with a name in their text as TXXX:name. Versions 2.2 to 2.4, unsynchronised ones too."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    major, flags = data[3], data[5]
    size, tags, p = 10 + _number(data[6:10], True), {}, 0
    body = data[10:size]
    if flags & 0x80 and major < 4:
        body = _joined(body)
    if flags & 0x40 and major > 2 and len(body) >= 4:  # extended header
        p = _number(body[:4], True) if major == 4 else 4 + _number(body[:4], False)
    width, head = (3, 6) if major == 2 else (4, 10)
    while major in (2, 3, 4) and p + head <= len(body) and body[p]:
        n = _number(body[p + width : p + 2 * width], major == 4)
        name, value = body[p : p + width].decode("latin-1"), body[p + head : p + head + n]
        if major == 4:
            kind = body[p + 9]
            value = _joined(value[4 * (kind & 1) :]) if kind & 2 or flags & 0x80 else value[4 * (kind & 1) :]
        if name[0] == "T" and value:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            text = value[1:].decode(codec, "replace").rstrip("\0")
            if name in ("TXXX", "TXX"):
                key, _, text = text.partition("\0")
                name = f"TXXX:{key}"
            tags[name] = text.lstrip("\ufeff")
        p += head + n
    return size + 10 * (major == 4 and bool(flags & 0x10)), tags


def read_ape(data: bytes, end: int) -> tuple[int, dict[str, str]]:
    """Where an APE tag that ends at `end` begins (`end` if there is none), and its texts as APE:name."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end, {}
    size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
    if not 32 <= size <= end:
        return end, {}
    p, tags = end - size, {}
    for _ in range(count):
        stop = data.find(b"\0", p + 8, end - 32)
        if stop < 0:
            break
        n, kind = struct.unpack("<II", data[p : p + 8])
        if not kind & 6:
            tags["APE:" + data[p + 8 : stop].decode("latin-1")] = data[stop + 1 : min(end - 32, stop + 1 + n)].decode("utf-8", "replace")
        p = stop + 1 + n
    begin = end - size - 32 * (flags >> 31)
    return (begin if begin >= 0 else end - size), tags


def read_table(frame: bytes, h: Header) -> dict | None:
    """The variable-bitrate table of a first frame: kind, frames, bytes, entries, points (offsets of
    its seek entries from the table's frame on), delay and padding (samples; 0 if it tells none)."""
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "entries": 0, "points": [], "delay": 0, "padding": 0}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                out[key], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4 and p + 100 <= len(frame):
            out["entries"] = 100
            out["points"] = [x * out["bytes"] // 256 for x in frame[p : p + 100]] if out["bytes"] else []
            p += 100
        p += 4 * bool(flags & 8)
        if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and p + 24 <= len(frame):
            trim = int.from_bytes(frame[p + 21 : p + 24], "big")
            out["delay"], out["padding"] = trim >> 12, trim & 0xFFF
        return out
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        points, p = [0], 62
        while width and len(points) <= entries and p + width <= len(frame):
            points.append(points[-1] + scale * int.from_bytes(frame[p : p + width], "big"))
            p += width
        return {"kind": "VBRI", "frames": frames, "bytes": size, "entries": entries, "points": points[:-1], "delay": 0, "padding": 0}
    return None


def scan(data: bytes, seek_every: int = SEEK_EVERY) -> dict:
    """Everything the stream tells.

    frames: (offset, Header) of audio frames, without a table frame; junk: bytes between them;
    samples, rate, duration (Fraction of a second; less the delay and padding of a table, if all
    frames have one rate); crc_ok, crc_bad; table, its points as offsets in data, with agrees: whether
    its frames and bytes are those found; tags; vbr; seek: offsets of every seek_every-th frame;
    truncated: whether the last frame is cut off.
    Empty or frameless data gives no frames and a duration of 0.
    """
    p, tags = read_id3v2(data)
    id3_bytes, end = min(p, len(data)), len(data)
    if end - p >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    end, ape = read_ape(data, end)
    tags |= ape
    end, p = max(end, id3_bytes), id3_bytes
    frames, junk, resyncs, good, bad, table, truncated, locked, kind = [], 0, 0, 0, 0, None, False, False, None
    kinds, samples, duration = set(), 0, Fraction(0)
    by_rate: dict[int, int] = {}
    while p + 4 <= end:
        h = header(int.from_bytes(data[p : p + 4], "big"))
        if h and (not locked or (h.version, h.layer, h.rate) != kind):  # a second header of the kind, or the end, confirms
            q = p + h.size
            nxt = header(int.from_bytes(data[q : q + 4], "big")) if q + 4 <= end else None
            if q != end and not (nxt and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)):
                h = None
        if h is None:
            resyncs += locked
            locked = False
            q = data.find(b"\xff", p + 1, end)
            q = end if q < 0 else q
            junk += q - p
            p = q
            continue
        if p + h.size > end:
            truncated = True
            break
        locked, kind = True, (h.version, h.layer, h.rate)
        if not frames and table is None and (table := read_table(data[p : p + h.size], h)):
            table["at"], table["points"] = p, [p + x for x in table["points"]]
            p += h.size
            continue
        if h.protected:
            ok = intact(data[p : p + h.size], h)
            good, bad = good + ok, bad + (not ok)
        frames.append((p, h))
        kinds.add(h.kbps)
        by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        p += h.size
    if not truncated:
        junk += max(0, end - p)
    for rate, n in by_rate.items():
        samples += n
        duration += Fraction(n, rate)
    if table:
        trim = table["delay"] + table["padding"]
        if len(by_rate) == 1 and trim < samples:
            duration -= Fraction(trim, *by_rate)
        told = (table["frames"], len(frames)), (table["bytes"], end - table["at"] if frames else 0)
        table["agrees"] = all(x is None or x == y for x, y in told)
    return {
        "frames": frames, "junk": junk, "resyncs": resyncs, "samples": samples, "rate": frames[0][1].rate if frames else 0, "duration": duration,
        "crc_ok": good, "crc_bad": bad, "table": table, "tags": tags, "vbr": len(kinds) > 1, "seek": [f[0] for f in frames[::seek_every]], "truncated": truncated,
    }


# -- carrying bytes: MPEG-1 layer III, 32 kHz, mono, protected. A frame's side information is all
# zero (no coded audio: silence), so what follows it is ancillary data, here the payload.
UNIT = 192
_HEAD = 4 + 2 + 17


def _frame_kinds() -> list[tuple[int, bytes]]:
    """(payload bytes, frame start with checksum), the smallest frame for each number of units."""
    best: dict[int, tuple[int, bytes]] = {}
    for index, kbps in enumerate(BITRATES[1, 3]):
        size = 144 * 1000 * kbps // 32000
        units = (size - _HEAD) // UNIT if index else 0
        if units > 0 and units not in best:
            word = 0xFFE00000 | 3 << 19 | 1 << 17 | 0 << 16 | index << 12 | 2 << 10 | 3 << 6
            head, side = word.to_bytes(4, "big"), bytes(17)
            best[units] = size, head + crc16(head[2:] + side).to_bytes(2, "big") + side
    return [(units * UNIT, size, start) for units, (size, start) in sorted(best.items())]


_KINDS = _frame_kinds()


def encode(payload: bytes) -> bytes:
    """A stream whose frames carry the payload: tag with its length, Xing table, frames.

    Full frames are as large as the format allows; a rest takes the smallest frame that holds it,
    so the bitrate varies. The payload may be of any length.
    """
    most, most_size, most_start = _KINDS[-1]
    pad = bytes(most_size - _HEAD - most)
    out, full = [], len(payload) - len(payload) % most
    for p in range(0, full, most):
        out += (most_start, payload[p : p + most], pad)
    sizes = [most_size] * (full // most)
    if rest := payload[full:]:
        room, size, start = next(k for k in _KINDS if k[0] >= len(rest))
        out += (start, rest, bytes(size - _HEAD - len(rest)))
        sizes.append(size)
    total = sum(sizes)
    body = b"".join(out)
    _, table_size, start = next(k for k in _KINDS if k[0] >= 192)
    offsets, p = [], 0
    for s in sizes:
        offsets.append(p)
        p += s
    toc = bytes(min(255, 256 * offsets[len(sizes) * i // 100] // max(1, total)) if sizes else 0 for i in range(100))
    table = start + b"Xing" + struct.pack(">III", 7, len(sizes), total + table_size) + toc
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag_frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _syncsafe(len(tag_frame)) + tag_frame
    return tag + table.ljust(table_size, b"\0") + body


def decode(data: bytes, scanned: dict | None = None) -> bytes:
    """The payload of encode()'s stream, from its frames as the parser found them."""
    s = scanned or scan(data)
    left, out = int(s["tags"].get("TXXX:payload_bytes", "0")), []
    for p, h in s["frames"]:
        n = min(left, (h.size - _HEAD) // UNIT * UNIT)
        out.append(data[p + _HEAD : p + _HEAD + n])
        left -= n
    return b"".join(out)
