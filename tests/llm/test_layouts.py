from veinmap.llm import extract

FIRST = "<body><div><p>All rights reserved by us</p></div><div><h2>{t}</h2><p>{a}</p></div><div><p>Read our terms</p></div>"
SECOND = "<body class=wide><section><p>Second look, same owner</p></section><div><h3>{t}</h3><p>{a}</p></div><section><p>Printed on paper</p></section>"


def test_each_layout_of_a_host_loses_its_template(spark):
    rows = [(k, f"http://two.example/{k}", FIRST.format(t=f"Title {k}", a=f"alpha {k}")) for k in range(8)]
    rows += [(k, f"http://two.example/{k}", SECOND.format(t=f"Title {k}", a=f"beta {k}")) for k in range(20, 26)]
    rows += [(k, f"http://two.example/{k}", h) for k, h in ((40, None), (41, ""), (42, "<p>Error 404"), (43, "<p>gone"))]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\n\nalpha {k}" for k in range(8))
    assert all(got[k] == f"Title {k}\n\nbeta {k}" for k in range(20, 26))
    assert got[40] == got[41] == "" and got[42] == "Error 404" and got[43] == "gone"


def test_empty_pages_are_no_wrapper(spark):
    rows = [(100 + k, "http://e.example/x", f"<!-- {k} -->") for k in range(30)] + [(k, f"http://e.example/{k}", FIRST.format(t=f"T {k}", a=f"a {k}")) for k in range(4)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T {k}\n\na {k}" for k in range(4))


def test_constant_texts_go_from_marked_articles(spark):
    page = "<nav>n</nav><article><h1>Title {k}</h1><p>alpha {k} beta gamma delta epsilon zeta eta theta iota kappa</p><p>Tell your friends</p>{more}</article>"
    rows = [(k, f"http://m.example/{k}", page.format(k=k, more=f"<p>more of {k}</p>" * (k % 3))) for k in range(9)]
    copy = "<article><h1>Once</h1><p>a text that near copies repeat</p></article><i>{k}</i>"
    rows += [(100 + k, f"http://copies.example/{k}", copy.format(k=k)) for k in range(9)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == "\n\n".join([f"Title {k}", f"alpha {k} beta gamma delta epsilon zeta eta theta iota kappa", *[f"more of {k}"] * (k % 3)])
        assert got[100 + k] == "Once\n\na text that near copies repeat"
