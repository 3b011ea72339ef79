import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import ROOT, SF
from veinmap.llm import decontam, mixing, quality, queries, simhash
from veinmap.llm.common import fresh, table

sys.path.insert(0, str(ROOT))
import corpus_pipeline  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "mixing", "tokens"]


def test_pipeline_equals_its_parts_done_by_hand(spark):
    from tokenizers import Tokenizer

    from tests.llm.test_decontam import brute
    from tests.llm.test_simhash import classes, print_of

    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.judge(docs, model).collect() if r.kept}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    roots = classes([print_of(t) for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = []
    for (d, t, s), (_, hit, found) in zip(rows, brute([t for _, t, _ in rows], items)):
        spans = [(p, p + 1) for p in hit if p - 1 not in hit]
        spans = [(a, next(b for b in range(a + 1, 10**6) if b not in hit)) for a, _ in spans]
        if len(found) < 2:
            kept.append((d, decontam.without_spans(t.encode(), spans).decode(), s))
    assert any(len(t) < len(dict((a, b) for a, b, _ in rows)[d]) for d, t, _ in kept)
    times = {r.doc_id: r.repeats for r in mixing.taken(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for d, text, _ in sorted(kept):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for _ in range(times[d]):
            expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r) for r in queries_pipeline(spark)), key=lambda r: r[1])
    assert got == expected


def queries_pipeline(spark):
    return corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = table(spark, SF, "documents")
    groups = Counter(r.component_id for r in simhash.near_duplicates(docs).collect())
    assert corpus_pipeline.simhash_dedup(spark, docs, SF).count() == len(groups)


def test_names_are_fresh(spark):
    df = spark.createDataFrame([(1, 2)], "X long, x_ long")
    assert fresh(df, "x") == "x__" and fresh(df, "y") == "y"


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline_over_odd_documents_and_an_empty_table(spark, tmp_path):
    from tests.llm.fixtures import benchmark, documents, empty, labels, sentences

    plain = [" ".join(sentences(5, seed=k)) for k in range(70, 80)]
    for name, docs in (("odd", documents(spark).unionByName(documents(spark, plain).filter("lang = 'en' AND doc_id IS NOT NULL"))), ("none", empty(documents(spark)))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        labels(spark).write.parquet(f"{d}/labels.parquet")
        benchmark(spark).write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert (len(got) > 5) == (name == "odd")
        rows = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, d)
            assert out.columns == rows.columns and (out.count() > 0 or name == "none")
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_intermediate_stages_are_discarded(spark):
    from veinmap import storage

    before = storage.written()
    out = corpus_pipeline.run(spark, SF)
    assert storage.written() - before == 1 and out.count() > 0
