"""MPEG audio columns: a parser for frames, tags, variable-bitrate tables and checksums, and a lossless carrier.

The carrier keeps bytes in MPEG-2 Layer III frames: 576 bytes ride in the ancillary part of each
frame (one byte for each of its 576 samples), behind empty side information, so any decoder plays
silence and the bytes come back unchanged.

Cases: null text is empty; the payload of an empty text is 576 padding bytes; equal texts give equal
media; rows that repeat are kept; an empty table gives an empty table; other columns are ignored.
In parsing, null media gives no frames and a duration of 0; bytes that are no frame count as junk. Free-format streams (frames
without a stated bitrate) aren't read and count as junk. Checksums of all three layers are verified; ``unchecked`` counts
Layer II frames whose allocation would reach beyond the frame. Input columns named like a new one are replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, pick, string_bytes, tidy

# Fixed values of the format: kbit/s by (MPEG-1, layer), index 1 to 14, and Hz by version.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
# Layer II: bits of the allocation of a subband as (bits, subbands) from the lowest on, by table; and the tables' subbands.
ALLOCATION = {"high": ((4, 11), (3, 12), (2, 7)), "low": ((4, 2), (3, 10)), "half": ((4, 4), (3, 7), (2, 19))}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}

UNIT = 576
FRAME = 648
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])  # MPEG-2, Layer III, checksum, 144 kbit/s, 16 kHz, mono
PAYLOAD_AT = 4 + 2 + 9
RATE = 16000
TOOL = b"lodestrata carrier"


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        state = np.where(state & 0x8000, (state << 1) ^ 0x8005, state << 1) & 0xFFFF
    return state


CRC_STEP = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum (x^16 + x^15 + x^2 + 1, from all ones) of each row of bytes."""
    state = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        state = ((state << 8) & 0xFFFF) ^ CRC_STEP[(state >> 8) ^ column]
    return state


def header(data: bytes, at: int) -> dict | None:
    """The frame header at ``at``, or None. Free-format streams (no stated bitrate) aren't read."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, bits, rate = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    first = version == "1"
    kbit, hz, pad = BITRATES[first, layer][bits - 1], RATES[version][rate], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    mono = b3 >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbit": kbit, "hz": hz, "samples": samples, "length": length, "mono": mono, "checked": not b1 & 1, "side": side if layer == 3 else 0, "mode": b3 >> 6, "extension": b3 >> 4 & 3}


def covered(h: dict) -> int:
    """Bytes behind the checksum that it covers, in Layers I and III."""
    if h["layer"] == 3:
        return h["side"]
    bound = 4 * (h["extension"] + 1) if h["mode"] == 1 else 32
    return 16 if h["mono"] else (4 * (2 * bound + 32 - bound) + 7) // 8


def allocation_widths(h: dict) -> list[int]:
    """Layer II: the bits of each subband's allocation."""
    each = h["kbit"] // (1 if h["mono"] else 2)
    if h["version"] != "1":
        table, bands = "half", 30
    elif each < 56:
        table, bands = "low", 12 if h["hz"] == 32000 else 8
    else:
        table, bands = "high", 30 if each >= 96 and h["hz"] != 48000 else 27
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)][:bands]


def layer2_bits(data: bytes, at: int, h: dict) -> int | None:
    """Layer II: bits behind the checksum that it covers, allocation and scale factor selection; None if they reach beyond the frame."""
    widths = allocation_widths(h)
    bound = 0 if h["mono"] else min(len(widths), 4 * (h["extension"] + 1) if h["mode"] == 1 else 32)
    body = data[at + 6 : at + h["length"]]
    value, have, used, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for k, width in enumerate(widths):
        for _ in range(2 if k < bound else 1):
            if used + width > have:
                return None
            if (value >> (have - used - width)) & ((1 << width) - 1):
                chosen += 1 if k < bound or h["mono"] else 2
            used += width
    return used + 2 * chosen if used + 2 * chosen <= have else None


def layer2_sound(data: bytes, at: int, h: dict) -> bool | None:
    """Whether a Layer II frame's checksum is right; None if it can't be told."""
    bits = layer2_bits(data, at, h)
    if bits is None:
        return None
    whole = bits // 8
    state = int(crc16(np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + whole], np.uint8)[None, :])[0])
    for k in range(bits % 8):
        bit = data[at + 6 + whole] >> (7 - k) & 1
        state = ((state << 1) & 0xFFFF) ^ (0x8005 if (state >> 15 ^ bit) else 0)
    return state == int.from_bytes(data[at + 4 : at + 6], "big")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes) -> tuple[dict, int, int]:
    """Tags, and where the audio begins and ends."""
    tags, low, high = {}, 0, len(data)
    while data[low : low + 3] == b"ID3" and low + 10 <= high and not any(x & 0x80 for x in data[low + 6 : low + 10]):
        major, flags, size = data[low + 3], data[low + 5], _syncsafe(data[low + 6 : low + 10])
        body, at = data[low + 10 : low + 10 + size], 0
        if flags & 0x40 and major in (3, 4) and len(body) >= 4:
            at = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
        found = tags.setdefault("id3v2", {"version": major, "frames": {}})["frames"]
        name, head = (3, 6) if major == 2 else (4, 10)
        while at + head <= len(body) and body[at : at + name].isalnum():
            n = int.from_bytes(body[at + 3 : at + 6], "big") if major == 2 else _syncsafe(body[at + 4 : at + 8]) if major == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            value = body[at + head : at + head + n]
            if value and body[at : at + 1] == b"T":
                kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
                found[body[at : at + name].decode("ascii")] = value[1:].decode(kind, "replace").rstrip("\0")
            at += head + n
        low = min(high, low + 10 + size + 10 * bool(flags & 0x10 and major == 4))
    if high - low >= 128 and data[high - 128 : high - 125] == b"TAG":
        fields = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
        last = data[high - 128 :]
        tags["id3v1"] = {k: last[a:b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in fields.items()} | {"genre": last[127]}
        high -= 128
    if high - low >= 32 and data[high - 32 : high - 24] == b"APETAGEX":
        size = int.from_bytes(data[high - 20 : high - 16], "little") + 32 * bool(data[high - 9] & 0x80)
        tags["ape"] = {"items": int.from_bytes(data[high - 16 : high - 12], "little")}
        high = max(low, high - size)
    return tags, low, high


def vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    """A Xing/Info or VBRI table in the frame at ``at``."""
    x = at + 4 + 2 * h["checked"] + h["side"]
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, out, p = int.from_bytes(data[x + 4 : x + 8], "big"), {"kind": data[x : x + 4].decode()}, x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"], p = list(data[p : p + 100]), p + 100
        if flags & 8:
            out["quality"], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if p + 24 <= at + h["length"] and data[p : p + 4].isalnum():  # the encoder's name, and samples that it put before and behind
            both = int.from_bytes(data[p + 21 : p + 24], "big")
            out |= {"encoder": data[p : p + 9].decode("latin-1").rstrip("\0"), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= at + h["length"]:
        n = lambda a, b: int.from_bytes(data[x + a : x + b], "big")
        entries, scale, width = n(18, 20), n(20, 22), n(22, 24)
        return {"kind": "VBRI", "bytes": n(10, 14), "frames": n(14, 18), "toc": [scale * n(26 + k * width, 26 + (k + 1) * width) for k in range(min(entries, (h["length"] - 62) // max(1, width)))]}
    return None


def _follows(a: dict, b: dict | None) -> bool:
    return b is not None and all(a[k] == b[k] for k in ("version", "layer", "hz"))


def _sound(data: bytes, at: int, h: dict) -> bool:
    """Whether a frame's checksum is right, where it has one that can be verified."""
    if not h["checked"]:
        return True
    if h["layer"] == 2:
        return layer2_sound(data, at, h) is not False
    row = np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered(h)], np.uint8)
    return int(crc16(row[None, :])[0]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _run(view: np.ndarray, at: int, end: int, size: int) -> int:
    """How many frames of equal size and header follow each other from ``at`` on; looked for in blocks of twice the size each, so the work is in proportion to the run."""
    run, block, most = 1, 4, (end - at) // size
    while run < most:
        n = min(block, most - run)
        heads = view[at + run * size : at + (run + n) * size].reshape(n, size)[:, :4]
        same = (heads == view[at : at + 4]).all(1)
        if not same.all():
            return run + int(np.argmin(same))
        run, block = run + n, 2 * block
    return run


def parse(data: bytes) -> dict:
    """All that one stream holds. ``duration`` is that of all audio frames, ``played`` leaves out the samples that an encoder says it added. ``offsets`` and ``lengths`` have every audio frame, without a table's frame.

    A header counts where the next frame follows it, or the audio ends with its frame, or it follows
    another frame and its checksum, if any, is right; other bytes are skipped one sync word at a time and counted as junk.
    """
    tags, at, end = read_tags(data)
    view = np.frombuffer(data, np.uint8)
    offsets, lengths, shapes = [], [], []
    checks, junk, table, synced, resyncs = [0, 0, 0], 0, None, False, 0
    last = None
    while at < end:
        h = header(data, at)
        stop = at + h["length"] if h else 0
        good = h is not None and h["length"] > 4 and stop <= end and (stop == end or _follows(h, header(data, stop)) or (synced and _follows(last, h) and last["mode"] == h["mode"] and _sound(data, at, h)))
        if not good:
            resyncs += synced
            synced = False
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            junk += near - at
            at = near
            continue
        size = h["length"]
        run = _run(view, at, end, size)
        if not offsets and table is None and (table := vbr_table(data, at, h)):
            table["at"], run, skip = at, 1, True
        else:
            skip = False
        if h["checked"] and h["layer"] == 2:
            for k in range(run):
                right = layer2_sound(data, at + k * size, h)
                checks[2 if right is None else 0 if right else 1] += 1
        elif h["checked"]:
            n, rows = covered(h), view[at : at + run * size].reshape(run, size)
            right = crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + n]], 1)) == rows[:, 4].astype(np.uint32) * 256 + rows[:, 5]
            checks[0] += int(right.sum())
            checks[1] += int(run - right.sum())
        if not skip:
            offsets.append(at + size * np.arange(run))
            lengths.append(np.full(run, size))
            shapes.append((h["version"], h["layer"], h["hz"], h["samples"], run))
        at += run * size
        synced, last = True, h
    duration = sum((Fraction(s * n, hz) for _, _, hz, s, n in shapes), Fraction(0))
    kinds = sorted({(v, layer, hz) for v, layer, hz, _, _ in shapes})
    silent = Fraction(table["delay"] + table["padding"], kinds[0][2]) if table and "delay" in table and len(kinds) == 1 else 0
    return {
        "tags": tags, "table": table, "kinds": kinds, "frames": sum(x[4] for x in shapes), "samples": sum(x[3] * x[4] for x in shapes), "duration": duration, "played": max(Fraction(0), duration - silent),
        "offsets": np.concatenate(offsets) if offsets else np.zeros(0, np.int64), "lengths": np.concatenate(lengths) if lengths else np.zeros(0, np.int64),
        "checked": checks[0], "broken": checks[1], "unchecked": checks[2], "junk": junk, "resyncs": resyncs,
    }


def seek(parsed: dict, samples: int) -> int:
    """Byte offset of the frame that holds a sample, for streams whose frames are all of one size in samples."""
    each = parsed["samples"] // max(1, parsed["frames"])
    return int(parsed["offsets"][min(samples // max(1, each), parsed["frames"] - 1)])


# --- the carrier ---------------------------------------------------------------------------

_EMPTY_SIDE_CHECK = int(crc16(np.array([[*HEADER[2:4], *[0] * 9]], np.uint8))[0])


def _tag() -> bytes:
    body = b"TSSE" + bytes([0, 0, 0, len(TOOL) + 1, 0, 0, 3]) + TOOL
    return b"ID3\x04\x00\x00" + bytes([0, 0, 0, len(body)]) + body


def write_carrier(payload: bytes) -> bytes:
    """An MPEG stream that holds ``payload``, a positive multiple of 576 bytes."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(units) + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, 4], frames[:, 5] = _EMPTY_SIDE_CHECK >> 8, _EMPTY_SIDE_CHECK & 255
    frames[1:, PAYLOAD_AT : PAYLOAD_AT + UNIT] = units
    toc = bytes(256 * (1 + len(units) * k // 100) // (len(units) + 1) for k in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + len(units).to_bytes(4, "big") + frames.size.to_bytes(4, "big") + toc
    frames[0, PAYLOAD_AT : PAYLOAD_AT + len(info)] = np.frombuffer(info, np.uint8)
    return _tag() + frames.tobytes()


def read_carrier(media: bytes, parsed: dict | None = None) -> bytes:
    parsed = parsed or parse(media)
    at = parsed["offsets"]
    view = np.frombuffer(media, np.uint8)
    if len(at) and (np.diff(at) == FRAME).all():
        rows = view[at[0] : at[0] + FRAME * len(at)].reshape(-1, FRAME)
        return rows[:, PAYLOAD_AT : PAYLOAD_AT + UNIT].tobytes()
    return b"".join(media[a + PAYLOAD_AT : a + PAYLOAD_AT + UNIT] for a in at)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def summary(p: dict, media: bytes) -> str:
    """The features of a stream as one line of JSON, with a checksum of all its frames' bytes and how even these are."""
    ends = p["offsets"] + p["lengths"]
    body = np.frombuffer(media, np.uint8)[p["offsets"][0] : ends[-1]] if len(ends) else np.zeros(0, np.uint8)
    share = np.bincount(body, minlength=256) / max(1, len(body))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    kinds = ["MPEG-%s layer %d %d Hz" % k for k in p["kinds"]]
    return json.dumps({
        "kinds": kinds, "frames": p["frames"], "samples": p["samples"], "seconds": str(p["duration"]), "checked": p["checked"], "broken": p["broken"], "unchecked": p["unchecked"], "junk": p["junk"], "resyncs": p["resyncs"],
        "table": p["table"] and {k: v for k, v in p["table"].items() if k != "toc"}, "tags": p["tags"], "frames_crc32": zlib.crc32(body), "bits_a_byte": round(entropy, 6), "seek_crc32": zlib.crc32(p["offsets"].astype("<u8").tobytes()),
    }, sort_keys=True)


NEW = "mp_kinds string, mp_frames long, mp_numerator long, mp_denominator long, mp_played_numerator long, mp_played_denominator long, mp_checked long, mp_broken long, mp_unchecked long, mp_junk long, mp_tags string, mp_table string, mp_offsets array<long>"


def parse_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Every column of ``df`` but the media, and those of ``NEW``: exact seconds as numerator and denominator, checksums that are right, wrong and can't be told, offsets of all frames."""
    names = {c.split(" ")[0] for c in NEW.split(", ")}
    rest = [f for f in df.schema.fields if f.name != media and f.name not in names]
    from pyspark.sql import types as T

    from .common import arrow_schema

    schema = T.StructType(rest + T.StructType.fromDDL(NEW).fields)
    types = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(media):
                p = parse(value.as_py() or b"")
                out.append((json.dumps(p["kinds"]), p["frames"], p["duration"].numerator, p["duration"].denominator, p["played"].numerator, p["played"].denominator, p["checked"], p["broken"], p["unchecked"], p["junk"], json.dumps(p["tags"]), json.dumps(p["table"]), p["offsets"]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            arrays = [batch.column(f.name) for f in rest] + [pa.array(c, t) for c, t in zip(columns, types.types[len(rest) :], strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types.types, strict=True)], schema=types)

    return df.select(*[f"`{f.name}`" for f in rest], f"`{media}`").mapInArrow(tidy(read), schema)


def store_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table (doc_id, media) with each whole text as a carrier stream."""
    types = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = string_bytes(batch.column("text"))
            for low in range(0, batch.num_rows, 512):
                high = min(batch.num_rows, low + 512)
                media = [write_carrier(padded(buf[bounds[k] : bounds[k + 1]].tobytes())) for k in range(low, high)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(media, pa.binary())], schema=types)

    return scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(tidy(write), "doc_id long, media binary"))


def text_features(docs: DataFrame) -> DataFrame:
    """Stores every text as a stream, reads the streams back and describes them."""
    stored = store_texts(docs, Scratch(docs.sparkSession, "mpeg"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, seconds double"
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("seconds", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("media"):
                media = value.as_py()
                p = parse(media)
                payload = read_carrier(media, p)
                n = len(payload.rstrip(b"\xff"))  # no byte of UTF-8 is 255
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), summary(p, media), p["frames"], float(p["duration"])))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types.types[1:], strict=True))], schema=types)

    return stored.mapInArrow(tidy(read), schema)
