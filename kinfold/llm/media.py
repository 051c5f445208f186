"""Matroska media columns: write texts or samples as PCM tracks, parse files into packet tables, compute features.

The parser reads variable-length EBML ids and sizes (unknown sizes too), clusters, simple blocks and block
groups, the three kinds of lacing and cues, and yields one row per frame with its timestamp, track and byte
range. ``op1_matroska`` is its contract query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm._text import texts_as_bytes
from kinfold.plans.runtime import table

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, TRACK_NUMBER, TRACK_TYPE, CODEC, RATE, DEPTH, CHANNELS = 0x2AD7B1, 0xD7, 0x83, 0x86, 0xB5, 0x6264, 0x9F
DOC_TYPE, TRACK_UID, LACING = 0x4282, 0x73C5, 0x9C
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, EBML}
_TOP = {INFO, TRACKS, CLUSTER, CUES}

SAMPLE_RATE = 8000
FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, MULTIPLE = 1024, 8, 16, 64


def put_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def put_size(n: int, width: int = 0) -> bytes:
    """A size in as few bytes as can hold it; all ones is kept for unknown sizes."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(i: int, body: bytes) -> bytes:
    return put_id(i) + put_size(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing header of 2 or more frames: 1 Xiph, 2 fixed, 3 EBML."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 3:
        head += put_size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += put_size(b - a + (1 << 7 * w - 1) - 1, w)
        return head
    return head


def mux(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A file with one 8-bit mono PCM track that holds ``payload`` without loss; equal payloads give equal files."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio
    body = bytearray(info + element(TRACKS, element(TRACK_ENTRY, track)))
    cues = []
    step = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for c in range(0, len(frames), step):
        start = c * FRAME * 1000 // rate
        cluster = bytearray(uint(TIMESTAMP, start))
        for b in range(c, min(c + step, len(frames)), FRAMES_A_BLOCK):
            group = frames[b : min(b + FRAMES_A_BLOCK, c + step)]
            even = len({len(f) for f in group}) == 1
            kind = 0 if len(group) == 1 else (1, 2, 3)[b // FRAMES_A_BLOCK % 3]
            kind = 3 if kind == 2 and not even else kind
            head = b"\x81" + struct.pack(">h", b * FRAME * 1000 // rate - start) + bytes([0x80 | kind << 1])
            cluster += element(SIMPLE_BLOCK, head + (lace(group, kind) if kind else b"") + b"".join(group))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, len(body)))))
        body += element(CLUSTER, bytes(cluster))
    body += element(CUES, b"".join(cues))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, bytes(body))


def get_id(data: bytes, at: int) -> tuple[int, int]:
    w = 9 - data[at].bit_length()
    if w > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + w], "big"), at + w


def get_size(data: bytes, at: int) -> tuple[int, int, int]:
    """(value or -1 if unknown, next byte, width)."""
    w = 9 - data[at].bit_length()
    if w > 8 or at + w > len(data):
        raise ValueError(f"no size at byte {at}")
    n = int.from_bytes(data[at : at + w], "big") & (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w, w


def walk(data: bytes, start: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements of a range; an unknown size ends where an element of a higher level begins."""
    at = start
    while at < end:
        i, p = get_id(data, at)
        if within == CLUSTER and i in _TOP:
            return
        n, p, _ = get_size(data, p)
        if n < 0:
            if i not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size of element {i:x}")
            stop = end
            if i == CLUSTER:
                stop = p
                while stop < end:
                    j, q = get_id(data, stop)
                    if j in _TOP:
                        break
                    m, q, _ = get_size(data, q)
                    stop = q + m
            n = stop - p
        if p + n > end:
            raise ValueError(f"element {i:x} at byte {at} goes beyond its parent")
        yield i, p, p + n
        at = p + n


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of frames) of a block's body."""
    track, at, _ = get_size(data, at)
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, rel, flags, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for k in range(n - 1):
            v, at, w = get_size(data, at)
            sizes.append(v if k == 0 else sizes[-1] + v - ((1 << 7 * w - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("fixed lacing of an uneven block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    return track, rel, flags, ranges


def parse(data: bytes) -> dict:
    """Tracks, cues and packets of a file.

    packets: (cluster, track, timestamp in ms, first byte, length, keyframe, lacing kind, index in the lace).
    """
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    out: dict = {"tracks": [], "packets": [], "cues": [], "clusters": [], "scale": 1_000_000, "segment": 0}

    def block(a: int, b: int, cluster: int, time: int, simple: bool) -> None:
        track, rel, flags, ranges = block_frames(data, a, b)
        for k, (x, y) in enumerate(ranges):
            out["packets"].append((cluster, track, (time + rel) * out["scale"] // 1_000_000, x, y - x, bool(flags & 0x80) if simple else True, flags >> 1 & 3, k))

    for top, s, e in walk(data, 0, len(data)):
        if top != SEGMENT:
            continue
        out["segment"] = s
        for i, a, b in walk(data, s, e, SEGMENT):
            if i == INFO:
                out["scale"] = next((number(x, y) for j, x, y in walk(data, a, b) if j == SCALE), out["scale"])
            elif i == TRACKS:
                for _, x, y in (z for z in walk(data, a, b) if z[0] == TRACK_ENTRY):
                    t = {"number": 0, "codec": "", "rate": 0.0, "depth": 0, "channels": 1}
                    for j, p, q in walk(data, x, y):
                        if j == TRACK_NUMBER:
                            t["number"] = number(p, q)
                        elif j == CODEC:
                            t["codec"] = data[p:q].decode("ascii", "replace")
                        elif j == AUDIO:
                            for k, u, v in walk(data, p, q):
                                if k == RATE:
                                    t["rate"] = struct.unpack(">d" if v - u == 8 else ">f", data[u:v])[0]
                                elif k in (DEPTH, CHANNELS):
                                    t["depth" if k == DEPTH else "channels"] = number(u, v)
                    out["tracks"].append(t)
            elif i == CLUSTER:
                k, time = len(out["clusters"]), 0
                out["clusters"].append(a)
                for j, x, y in walk(data, a, b, CLUSTER):
                    if j == TIMESTAMP:
                        time = number(x, y)
                    elif j == SIMPLE_BLOCK:
                        block(x, y, k, time, True)
                    elif j == BLOCK_GROUP:
                        for m, p, q in walk(data, x, y):
                            if m == BLOCK:
                                block(p, q, k, time, False)
            elif i == CUES:
                for _, x, y in (z for z in walk(data, a, b) if z[0] == CUE_POINT):
                    time, at = 0, -1
                    for j, p, q in walk(data, x, y):
                        if j == CUE_TIME:
                            time = number(p, q)
                        elif j == CUE_TRACK_POSITIONS:
                            at = next((number(u, v) for k, u, v in walk(data, p, q) if k == CUE_CLUSTER), -1)
                    out["cues"].append((time, at))
    return out


def samples(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join(data[p[3] : p[3] + p[4]] for p in parsed["packets"] if p[1] == track)


def feature(data: bytes, parsed: dict, payload: bytes) -> str:
    """Structure and signal figures of a file, read from its packet table and samples."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / max(1, len(x))
    cues_hit = sum(get_id(data, parsed["segment"] + at)[0] == CLUSTER for _, at in parsed["cues"] if at >= 0)
    laces = sorted({p[6] for p in parsed["packets"]})
    last = parsed["packets"][-1][2] if parsed["packets"] else 0
    return (
        f"tracks={len(parsed['tracks'])};packets={len(parsed['packets'])};clusters={len(parsed['clusters'])};cues={cues_hit};"
        f"laces={''.join(map(str, laces))};last_ms={last};mean={x.mean() if len(x) else 0:.4f};std={x.std() if len(x) else 0:.4f};entropy={-(share * np.log2(share)).sum():.4f}"
    )


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % MULTIPLE or MULTIPLE * (not raw))


@F.pandas_udf(T.BinaryType())
def _mux_texts(text):
    import pandas as pd

    return pd.Series([mux(pad((x or "").encode())) for x in text], dtype=object)


def text_to_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """All rows with a further binary column ``media``: the UTF-8 text padded by zeros to a positive multiple of 64, as a PCM file.

    A null text counts as empty. A column that is called like ``media`` is replaced.
    """
    return df.withColumn(media, _mux_texts(F.col(text)))


PACKETS = "cluster int, track int, timestamp_ms long, byte_start long, byte_length long, keyframe boolean, lacing int, lace_index int, error string"


def packet_table(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, one row per frame). A null file has no rows; a broken one has one row that holds only ``error``."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(*p, None) for p in parse(data)["packets"]]
                except (ValueError, IndexError, struct.error) as e:
                    found = [(None,) * 8 + (str(e),)]
                keys += [k] * len(found)
                rows += found
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()))]
            taken = batch.column(0).take(pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, *cols], names=[key, *(x.split()[0] for x in PACKETS.split(", "))])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PACKETS}")


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: store each text as a file, read the bytes back through the parser, and digest them.

    Null and empty texts give 64 zero samples; null and repeated keys keep their rows; other columns take no part.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for raw in texts_as_bytes(batch.column(1)):
                data = mux(pad(raw))
                parsed = parse(data)
                back = samples(data, parsed)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-MULTIPLE:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, parsed, back)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, *(x.split()[0] for x in _DIGEST.split(", "))])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_DIGEST}")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
