import base64
import hashlib

import pytest

from tests.compare import connect, same
from tests.conftest import SF
from veinmap.llm import queries, warc
from veinmap.llm.files import filesystem

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://b/9", "same"), (3, "http://a/3", "other é\r\n\r\nWARC/1.1\r\n"), (4, None, None), (5, "http://a/5", ""), (None, "http://n/ x\ny%", "same"), (6, "u", "x" * 300_000), (9, "http://b/again", "same"), (None, "n", "only null ids"), (None, "n", "only null ids")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "z", "z") for r in ROWS], "page_id long, url string, html string, size string, address string")


def read(spark, pages, **options):
    return sorted((tuple(r) for r in warc.read_records(spark, warc.write_archive(pages, **options)).select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()), key=repr)


def test_records(spark, pages):
    got = read(spark, pages)
    assert len(got) == len(ROWS)
    for page_id, url, html in ROWS:
        payload = (html or "").encode()
        mine = [g for g in got if g[0] == (None if page_id is None else str(page_id)) and g[1] == url and g[4] == len(payload)]
        assert mine and all(g[5] == base64.b32encode(hashlib.sha1(payload).digest()).decode() for g in mine)
    same = [g for g in got if g[4] == 4]
    assert sorted((g[2], g[3]) for g in same) == [("response", None)] + [("revisit", "9")] * 4
    assert {g[0] for g in same if g[2] == "response"} == {"9"}
    assert sorted((g[0], g[2], g[3]) for g in got if g[4] == 0) == [("4", "revisit", "5"), ("5", "response", None)]
    assert sorted(g[2] for g in got if g[4] == 13) == ["response", "revisit"]


def test_small_payloads_may_all_be_responses(spark, pages):
    assert all(g[2] == "response" for g in read(spark, pages, least_revisit=5) if g[4] < 5)


def test_payloads_are_stored_once_and_records_come_back_whole(spark, pages):
    files = warc.write_archive(pages)
    assert warc.read_payloads(spark, files).count() == len({h or "" for _, _, h in ROWS})
    back = [(None if r.page_id is None else int(r.page_id), r.url, bytes(r.payload).decode()) for r in warc.reconstruct(spark, files).collect()]
    assert sorted(back, key=repr) == sorted(((p, u, h or "") for p, u, h in ROWS), key=repr)


def test_any_record_reads_from_its_offset(spark, pages):
    for r in warc.read_records(spark, warc.write_archive(pages)).collect():
        fs, path = filesystem(r.path)
        with open(path, "rb") as f:
            f.seek(r.offset)
            offset, head, headers, _ = next(warc.records_of(f))
        assert offset == 0 and head == bytes(r.headers) and headers["X-Payload-SHA256"] == r.address


def test_damage_is_seen(spark, pages):
    files = warc.write_archive(pages.coalesce(1))
    _, path = filesystem(files[0][0])
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read_records(spark, files).collect()


def test_empty_table(spark, pages):
    files = warc.write_archive(pages.limit(0))
    assert files == [] and warc.read_records(spark, files).count() == 0 and warc.reconstruct(spark, files).count() == 0


def test_query(spark):
    same(queries.queries()["op2_warc"](spark, SF), connect(SF), queries.oracle_sql()["op2_warc"])
