"""Archives as others write them: a member for each record, plain files, broken ends, revisits of nothing."""

import gzip

import pytest

from tierloom.llm import warc

HEAD = b"HTTP/1.1 200 OK\r\n\r\n"


def record(page, payload, **fields):
    own = {"WARC-Record-ID": f"<urn:uuid:{page}>", "WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{warc.payload_digest(payload)}", "X-Page-ID": str(page)}
    return warc.Record(own | {k.replace("_", "-"): v for k, v in fields.items()}, HEAD + payload).written() + b"\r\n\r\n"


RECORDS = [record(i, b"payload %d" % i) for i in range(3)]


def read(spark, *contents):
    return sorted(tuple(r)[:2] for r in warc.read_archives(spark.createDataFrame([(c,) for c in contents], "content binary")).collect())


@pytest.mark.parametrize("archive", [b"".join(map(gzip.compress, RECORDS)), gzip.compress(b"".join(RECORDS)), b"".join(RECORDS), b"".join(map(gzip.compress, RECORDS)) + b"\x00" * 9, gzip.compress(RECORDS[0]) + gzip.compress(b"") + gzip.compress(RECORDS[1] + RECORDS[2])])
def test_every_member_is_read(spark, archive):
    assert read(spark, archive, b"", None) == [(0, 9), (1, 9), (2, 9)]


@pytest.mark.parametrize("archive", [b"".join(map(gzip.compress, RECORDS))[:-3], gzip.compress(RECORDS[0]) + b"rest", gzip.compress(RECORDS[0][:-9]), b"no archive"])
def test_what_is_broken_is_told(archive):
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflated(archive)))


def test_revisits_are_held_against_their_response(spark):
    rows = lambda *r: spark.createDataFrame(r, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    warc.check_revisits(rows((1, 5, "A", "response", None), (2, 5, "A", "revisit", 1), (None, 5, "A", "revisit", 1), (1, 6, "B", "response", None)))
    warc.check_revisits(rows((1, 5, "A", "response", None)).limit(0))
    for wrong in [(2, 5, "B", "revisit", 1), (2, 6, "A", "revisit", 1), (2, 5, "A", "revisit", 3)]:
        with pytest.raises(ValueError, match="no response"):
            warc.check_revisits(rows((1, 5, "A", "response", None), wrong))
