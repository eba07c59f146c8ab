"""Media payloads: exact round trip and defined results for odd texts."""

import hashlib
import zlib

from wayfold.llm.op5_media import op5_media_fingerprints


def test_round_trip(spark):
    texts = [None, "", "a", "naïve " * 50, "x" * 576, "y" * 577, "naïve " * 50]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in op5_media_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert r.media_bytes > r.payload_bytes
    assert out[3][1:] == out[6][1:] and out[0][1:] == out[1][1:]
    assert len({out[i].media_sha256 for i in (1, 2, 3, 4, 5)}) == 5


def test_empty_table(spark):
    assert op5_media_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
