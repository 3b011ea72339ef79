from tests.llm.test_layouts import FIRST, SECOND
from veinmap.llm import extract, shelves


def test_rows_come_back_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(shelves, "BUCKET_BYTES", 200)
    rows = [(f"h{k % 40}", k, "x" * (k % 30)) for k in range(400)]
    df = spark.createDataFrame(rows, "host string, n long, text string")
    shelf = shelves.put_on_shelf(df, "some")
    assert shelf.buckets > 5 and shelf.size > 400
    place = {r.host: r.b for r in df.select("host", shelf.bucket(df["host"]).alias("b")).distinct().collect()}
    back = [tuple(x) for b in range(shelf.buckets) for x in shelf.rows(b)]
    assert sorted(back) == sorted(rows)
    assert all(x[0] == "h3" or place[x[0]] == place["h3"] for x in shelf.rows(place["h3"]))
    monkeypatch.setattr(shelves, "KEPT", 500)
    shelves._kept.clear()
    for b in range(shelf.buckets):
        shelf.rows(b)
    assert sum(n for _, n in shelves._kept.values()) <= 500 + max(n for _, n in shelves._kept.values())


def test_an_empty_shelf(spark):
    shelf = shelves.put_on_shelf(spark.createDataFrame([], "host string, text string"), "none")
    assert shelf.buckets == 1 and shelf.rows(0) == []


def test_shelves_too_large_to_keep_give_the_same_texts(spark, monkeypatch):
    rows = [(100 * h + k, f"http://h{h}.example/{k}", (FIRST if k % 2 else SECOND).format(t=f"Title {k}", a=f"alpha {h} {k}")) for h in range(12) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = sorted(map(tuple, extract.extract(pages).collect()))
    monkeypatch.setattr(extract, "KEPT", 0)
    monkeypatch.setattr(shelves, "BUCKET_BYTES", 300)
    assert sorted(map(tuple, extract.extract(pages).collect())) == expected
    assert expected[0][2] == "Title 0\n\nalpha 0 0"
