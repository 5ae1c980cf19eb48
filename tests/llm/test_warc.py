import gzip
import hashlib
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from galena.llm import warc
from galena.llm.common import shared_path

PAGES = "page_id long, url string, html string, path string"


def expected(rows):
    last = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            last[html] = max(last.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = last.get(html) if page_id is not None and len(data) >= 1000 and page_id < last[html] else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", "é" * 700), (9, "http://b/ä\n x%20", "é" * 700), (4, None, "é" * 700), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", "é" * 700), (11, "u", "x" * 999), (12, "u", "x" * 999), (9, "http://b/ä\n x%20", "é" * 700), (13, "u", "z" * 3_000_000)]


def test_round_trip_and_revisits(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], PAGES)
    assert sorted((tuple(r) for r in warc.query(df).collect()), key=repr) == expected(ROWS)
    back = warc.read_archives(warc.write_archives(df, shared_path(spark, "t"))).where("record_type = 'response'").collect()
    assert {(r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in back} == {(i, u, h or "") for i, u, h in ROWS if (h != "é" * 700 or i in (9, None))}


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], PAGES)).collect() == []


@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 64))
def test_members_whatever_the_chunks(blocks, chunk):
    data = b"".join(warc.encode_record([("WARC-Type", "resource"), ("WARC-Block-Digest", warc.digest_header(hashlib.sha1(b).digest()))], b) for b in blocks)
    assert [r.block for r in warc.read_records(io.BytesIO(data), chunk=chunk)] == blocks
    assert len(gzip.decompress(data) if data else b"") >= sum(map(len, blocks))


def test_damage_is_named():
    good = warc.encode_record([("WARC-Type", "resource"), ("WARC-Block-Digest", warc.digest_header(hashlib.sha1(b"abc").digest()))], b"abc")
    bad_digest = warc.encode_record([("WARC-Block-Digest", warc.digest_header(hashlib.sha1(b"abd").digest()))], b"abc")
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    for data, what in ((good[:-3], "ends within"), (b"nonsense", "not a gzip"), (bad_digest, "digest"), (short, "Content-Length is 5"), (gzip.compress(b"WARC/1.1\r\n\r\n"), "no Content-Length"), (gzip.compress(b"HTTP"), "no WARC header")):
        with pytest.raises(warc.WarcError, match=what):
            list(warc.read_records(io.BytesIO(data)))
