import sys
from collections import Counter

from tests.conftest import ROOT, SF
from tests.llm.fixtures import documents, empty, sentences
from tests.llm.test_simhash import classes, print_of
from veinmap.llm.common import table

sys.path.insert(0, str(ROOT))
import corpus_pipeline  # noqa: E402

A, B, C, D = (" ".join(sentences(4, seed=k)) for k in range(20, 24))


def kept(spark, docs):
    return corpus_pipeline.simhash_dedup(spark, docs, SF)


def test_unlike_texts_stay_whatever_their_ids(spark):
    rows = [(None, A), (None, B), (None, A), (7, C), (7, D), (9, B), (9, B), (7, A)]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, tie string, root string")
    got = kept(spark, docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(7, A), (7, C), (7, D), (9, B)])
    nulls = docs.filter("doc_id IS NULL")
    assert sorted(r.text for r in kept(spark, nulls).collect()) == sorted([A, B])
    assert kept(spark, empty(docs)).count() == 0


def test_each_component_of_documents_keeps_one_row(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {t: k for (_, t), k in zip(rows, classes([print_of(t) for _, t in rows]))}
    got = Counter(prints[r.text] for r in kept(spark, docs).collect())
    assert set(got) == set(prints.values()) and set(got.values()) == {1}


def test_ids_that_do_not_repeat_keep_the_least(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = classes([print_of(t) for _, t in rows])
    assert sorted(r.doc_id for r in kept(spark, docs).collect()) == [rows[k][0] for k in sorted(set(roots))]
