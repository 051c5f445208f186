import hashlib
import random
import zlib

import pytest

from kinfold.llm import media
from tests.llm.conftest import ODD


def test_round_trips_of_all_lengths():
    rng = random.Random(1)
    for n in (64, 128, 1024, 1088, 8192, 8256, 131072, 131072 + 64, 700_032):
        raw = rng.randbytes(n)
        data = media.mux(raw)
        parsed = media.parse(data)
        assert media.samples(data, parsed) == raw and data == media.mux(raw)
        assert len(parsed["cues"]) == len(parsed["clusters"]) == -(-n // 131072)
        for (_, at), cluster in zip(parsed["cues"], parsed["clusters"], strict=True):
            i, p = media.get_id(data, parsed["segment"] + at)
            assert i == media.CLUSTER and media.get_size(data, p)[1] == cluster
        times = [p[2] for p in parsed["packets"]]
        assert times == sorted(times)


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_lacing(kind):
    rng = random.Random(kind)
    frames = [rng.randbytes(700 if kind == 2 else n) for n in (700, 3, 255, 256, 1, 5000, 510)]
    body = b"\x81\x00\x05" + bytes([0x80 | kind << 1]) + media.lace(frames, kind) + b"".join(frames)
    track, rel, flags, ranges = media.block_frames(body, 0, len(body))
    assert (track, rel, flags >> 1 & 3) == (1, 5, kind) and [body[a:b] for a, b in ranges] == frames


def test_sizes_groups_and_unknown_sizes():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        assert media.get_size(media.put_size(n), 0)[0] == n
    block = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x82\xff\xfe\x00abc"))
    cluster = media.put_id(media.CLUSTER) + b"\xff" + media.uint(media.TIMESTAMP, 10) + block
    data = media.put_id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster + media.element(media.CUES, b"")
    parsed = media.parse(data)
    assert [(p[0], p[1], p[2], data[p[3] : p[3] + p[4]]) for p in parsed["packets"]] == [(0, 2, 8, b"abc"), (1, 2, 8, b"abc")]
    with pytest.raises(ValueError):
        media.parse(data[:-3] + b"\x8f\x00\x00")


def test_digest_and_packets(spark, odd, empty):
    got = media.media_digest(odd).collect()
    assert len(got) == len(ODD)
    want = []
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_hash = {}
    for r in got:
        by_hash.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_hash.values())
    assert media.media_digest(empty).count() == 0
    files = media.text_to_media(odd)
    assert set(files.columns) == {*odd.columns, "media"}
    packets = media.packet_table(files, "doc_id")
    assert packets.where("error is not null").count() == 0 and packets.where("doc_id = 9").count() == -(-30016 // 1024)
    broken = spark.createDataFrame([(1, b"\x00\x01"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.error is not None) for r in media.packet_table(broken, "doc_id").collect()] == [(1, True)]
    assert media.text_to_media(files).columns == files.columns
