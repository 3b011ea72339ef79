import re

import pytest

from tests.compare import connect, same
from tests.conftest import SF
from tests.llm.fixtures import documents, empty
from veinmap.llm import mixing, queries


def fill(sizes, weights, share=1.5, most=2.0):
    """Clamp, reshare, until none is above."""
    budget, target, open_ = share * sum(sizes), {}, list(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if budget * weights[k] / total > most * sizes[k]]
        if not over:
            return [target.get(k, budget * weights[k] / total) for k in range(len(sizes))]
        for k in over:
            target[k] = most * sizes[k]
        budget -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return [target[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 1000], [1, 1, 1, 500], [0, 0, 7], [5, 0, 0, 90, 3, 2, 800, 1]])
def test_water_filling_is_clamping_until_feasible(spark, sizes):
    names = [chr(97 + k) for k in range(len(sizes))]
    got = mixing.water_fill(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long"), 1.5, 2.0, (5, 2, 1))
    expected = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
    assert [r.target for r in got.orderBy("source").collect()] == pytest.approx(expected)


def test_taken(spark):
    docs = documents(spark)
    got = [r.asDict() for r in mixing.taken(docs).collect()]
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r.text) for r in docs.collect())
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got)
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in mixing.taken(docs.repartition(3)).collect())


def test_taken_comes_near_the_target(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 1 + CAST(id % 23 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 7) END AS source")
    got = mixing.taken(docs).groupBy("target", "source_size").sum("taken").collect()
    for r in got:
        assert abs(r["sum(taken)"] - r.target) <= 24


def test_mix_repeats_whole_rows(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    wanted = {}
    for r in mixing.taken(docs).collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.repeats
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in wanted.items() if v}


def test_empty_and_wordless_tables(spark):
    docs = documents(spark)
    assert mixing.taken(empty(docs)).count() == 0 and mixing.mix(empty(docs)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(blank).collect()] == [(0, 0.0, 0)] * 2


def test_native(spark):
    plan = mixing.taken(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query(spark):
    same(queries.queries()["op10_mixing"](spark, SF), connect(SF), queries.oracle_sql()["op10_mixing"])
