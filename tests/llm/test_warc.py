import gzip
import hashlib
import random

import pytest

from staylight.llm import warc
from staylight.llm.oracles import oracle_sql
from staylight.llm.queries import op1_warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=1000):
    groups = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= least and i is not None:
            groups[payload] = max(groups.get(payload, i), i)
    out = []
    for i, url, html in rows:
        payload = (html or "").encode()
        newest = groups.get(payload) if len(payload) >= least else None
        kind = "revisit" if newest is not None and i != newest else "response"
        out.append((i, url, len(payload), hashlib.sha1(payload).hexdigest(), kind, newest if kind == "revisit" else None))
    return sorted(out, key=str)


def figures(frame):
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    big = ["é" * 500, "<p>" * 400 + "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60]
    made = [(i, f"http://a/{i}\n%0A", random.Random(i).choice(big + ["short", "", None])) for i in range(60)]
    # At the limit and just below it, ids missing or repeated, a missing url.
    made += [(70, None, "x" * 1000), (71, None, "x" * 1000), (72, "u", "y" * 999), (73, "u", "y" * 999)]
    made += [(None, "u", "x" * 1000), (None, None, "z" * 2000), (None, None, "z" * 2000), (80, "v", "w" * 1500), (80, "v", "w" * 1500), (79, "v", "w" * 1500)]
    return made


def test_round_trip(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as payload", "2 as record_type").repartition(3)
    back = warc.archived(pages, roll=5000, payloads=True)
    assert figures(back) == brute(rows)
    for r in back.collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_query_equals_sql(spark, sample):
    from checks.compare import compare

    result = compare(spark, sample[0], op1_warc, oracle_sql()["op1_warc"])
    assert result.startswith("ok"), result


def test_sidecar_points_at_single_members(spark, rows, tmp_path):
    whole, single = f"{tmp_path}/whole", f"{tmp_path}/single"
    records = warc.with_types(spark.createDataFrame(rows, PAGES).coalesce(1))
    archives = warc.write_archives(records, whole)
    first = archives.first()
    assert first["records"] == len(rows)
    raw = open(f"{whole}/{first['archive']}", "rb").read()
    new = warc.normalise(archives, whole, single).first()
    packed = open(f"{single}/{new['archive']}", "rb").read()
    assert gzip.decompress(packed) == gzip.decompress(raw)
    places = [tuple(map(int, x.split())) for x in open(f"{single}/{new['sidecar']}")]
    assert sum(n for _, n in places) == len(packed) and len(places) == len(rows)
    for offset, length in places:
        assert gzip.decompress(packed[offset : offset + length]).startswith(b"WARC/1.1\r\n")
    some = warc.read_offsets(spark.createDataFrame([new]), single).filter("offset > 0")
    assert warc.read_records(some, single, 2).count() == len(rows) - 1


def test_streams_in_any_cut():
    row = {"page_id": 1, "url": None, "record_type": "response", "refers_to": None, "payload": b"a\r\n\r\nb",
           "payload_digest": hashlib.sha1(b"a\r\n\r\nb").hexdigest(), "payload_bytes": 6}
    records = [warc.make_record({**row, "page_id": i}, "2024") for i in range(5)]
    stream = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    for step in (1, 7, 10_000):
        parts = (stream[i : i + step] for i in range(0, len(stream), step))
        assert list(warc.split_records(warc.inflated(parts))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([records[0][:-5]]))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"\r\n\r\nb", b"\r\n\r\nc"))


def test_empty_table(spark, rows):
    assert warc.archived(spark.createDataFrame(rows, PAGES).limit(0)).count() == 0
