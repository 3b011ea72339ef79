import pytest

from veinmap.llm import queries, warc


def test_a_revisit_without_its_payload_is_seen(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u1", "same"), (2, "u2", "same"), (3, "u3", "other")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()["op2_warc"](spark, str(tmp_path)).count() == 3
    read = warc.read_records
    monkeypatch.setattr(warc, "read_records", lambda *a: read(*a).filter("page_id != '2'"))
    with pytest.raises(Exception, match="no stored payload"):
        queries.queries()["op2_warc"](spark, str(tmp_path)).collect()
