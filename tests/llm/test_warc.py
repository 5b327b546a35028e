import base64
import gzip
import hashlib
import io

import pytest

from estimark.llm import warc as A


def test_members_are_gzip_and_digests_are_verified():
    raw = [A.record(i, f"http://x/{i}", p, A.digest(p)) for i, p in enumerate([b"", b"a\r\n\r\nb", "é".encode() * 200000])]
    got = list(A.members(io.BytesIO(b"".join(raw))))
    assert got == [gzip.decompress(r) for r in raw]
    headers, block = A.parse(got[1])
    assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"a\r\n\r\nb").digest()).decode()
    assert block.endswith(b"\r\n\r\na\r\n\r\nb")
    for broken in (got[1].replace(b"a\r\n\r\nb", b"a\r\n\r\nc"), got[1][:-1], got[1] + b"x", b"nothing"):
        with pytest.raises(ValueError):
            A.parse(broken)
    with pytest.raises(ValueError):
        list(A.members(io.BytesIO(raw[2][:-9])))


def test_round_trip_equals_brute_force(spark, monkeypatch):
    rows = [(5, "u", "same"), (3, None, "same"), (9, "u\r\nX: y", "same"), (4, "u", None), (1, "u", ""), (7, "u", "ü" * 300000),
            (8, "u", "alone\r\n\r\nx"), (None, "u", "same"), (None, "u", "orphan"), (3, None, "same")]
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 200)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 refers_to")
    got = sorted(map(repr, A.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    from pyspark.sql import Row
    R = Row("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(repr(R(*w)) for w in want)
    assert A.round_trip(df.limit(0)).count() == 0
