import hashlib
import pickle
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.fixtures import benchmark, documents, empty
from veinmap.llm import decontam, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=8):
    """(n_words, hit positions, sorted items) of each text."""
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(name)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[x]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def shard(tmp_path, texts, items, blocks=1, window=8):
    paths = []
    for k in range(blocks):
        paths.append(str(tmp_path / f"block-{random.random()}"))
        with open(paths[-1], "wb") as f:
            pickle.dump(decontam.phrases([(n, (t or "").encode()) for n, t in items[k::blocks]], window), f)
    found = decontam.scan_shard([(t or "").encode() for t in texts], paths, window)
    return [(n, [p for a, b in s for p in range(a, b)], i) for n, s, i in zip(found.n_words, found.spans, found.items)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    a = np.array(text, np.int64)
    assert decontam.suffix_array(a).tolist() == sorted(range(len(text)), key=lambda k: text[k:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 7))
def test_index_finds_and_locates(text, phrase, sample):
    index = decontam.FMIndex(np.array(text, np.int64), 4, sample)
    low, high = index.search(np.array([phrase]))
    m = len(phrase)
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [k for k in range(len(text) - m + 1) if text[k : k + m] == phrase]


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 11, 500)
    tree = decontam.WaveletTree(symbols, 4)
    for s in range(11):
        at = r.integers(0, 501, 50)
        assert tree.rank(np.full(50, s), at).tolist() == [int((symbols[:k] == s).sum()) for k in at]


@pytest.mark.parametrize("seed", range(20))
def test_shards_equal_brute_force(tmp_path, seed):
    r = random.Random(seed)
    text = lambda lo, hi: " ".join(r.choice(["a", "B", "c", "É", "d1"]) for _ in range(r.randint(lo, hi)))
    texts = [r.choice([None, "", "?!", text(0, 30), text(0, 40)]) for _ in range(7)]
    items = [(str(k % 4), r.choice([None, "", text(1, 3), text(4, 14)])) for k in range(5)]
    for blocks in (1, 2):
        assert shard(tmp_path, texts, items, blocks) == brute(texts, items)


def test_long_texts_are_indexed_in_pieces(tmp_path, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    texts, items = [text(300), "", text(40), None, text(90)], [(str(k), text(r.randint(2, 12))) for k in range(30)]
    whole = shard(tmp_path, texts, items)
    for size in (1, 7, 50):
        monkeypatch.setattr(decontam, "SHARD_WORDS", size)
        assert shard(tmp_path, texts, items, blocks=3) == whole == brute(texts, items)


def test_index_is_over_the_shards_own_words():
    codes, sizes, vocabulary = decontam.coded([b"One two, one", b"", b"TWO.three"])
    assert codes.tolist() == [1, 2, 1, 0, 0, 2, 3, 0] and sizes.tolist() == [3, 0, 2] and vocabulary.to_pylist() == [".", "one", "two", "three"]


def test_blocks_kept_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(decontam, "KEPT_WORDS", 30)
    items = [(str(k), " ".join(f"w{k + j}" for j in range(9))) for k in range(12)]
    assert shard(tmp_path, ["w1 w2 w3 w4 w5 w6 w7 w8 w9"], items, blocks=4) == brute(["w1 w2 w3 w4 w5 w6 w7 w8 w9"], items)
    assert sum(b.size for b in decontam._loaded.values()) <= 60


def test_n_chars_of_any_type(spark):
    items = benchmark(spark)
    for column in (F.lit("five"), F.lit(5).cast("int"), F.lit(5.5), F.lit(None).cast("long")):
        docs = documents(spark).withColumn("n_chars", column)
        kept = decontam.clean(docs, items, least_items=4)
        assert kept.schema == docs.schema and kept.count() == docs.count()


def test_tables(spark):
    docs, items = documents(spark), benchmark(spark)
    rows = docs.collect()
    expected = brute([r.text for r in rows], [("" if r.item_id is None else str(r.item_id), r.text) for r in items.collect()])
    got = decontam.scan(docs, items).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.items, r.contaminated) for r in got) == sorted((repr(r.doc_id), n, len(h), i, len(i) > 1) for r, (n, h, i) in zip(rows, expected))
    assert any(r.contaminated for r in got) and all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in got)
    assert decontam.scan(empty(docs), items).count() == 0
    assert decontam.scan(docs, empty(items)).filter("n_hit > 0 OR contaminated").count() == 0


def test_cleaning(spark):
    docs, items = documents(spark).withColumn("n_chars", F.lit(5).cast("long")), benchmark(spark)
    kept = decontam.clean(docs, items, least_items=4)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.scan(kept, items).filter("n_hit > 0").count() == 0
    before = {(r.doc_id, r.n_words) for r in decontam.scan(docs, items).filter("n_hit = 0").collect()}
    after = {(r.doc_id, r.n_words) for r in decontam.scan(kept, items).collect()}
    assert before <= after
    cut = [r for r in kept.collect() if r.doc_id == 5]
    assert cut and all(r.n_chars == len(r.text) and r.text == "The  from here today" or r.n_chars == len(r.text) for r in cut)
    dropped = decontam.clean(docs, items)
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in dropped.select("doc_id").collect()} == {r.doc_id for r in decontam.scan(docs, items).filter("contaminated").collect()}


def test_cutting_spans():
    assert decontam.without_spans(b"One, two; three (four) five!", [(1, 3)]) == b"One,  (four) five!"
    assert decontam.without_spans("é à b".encode(), [(0, 1), (2, 3)]) == " à ".encode()


def test_benchmark_in_blocks(spark):
    paths = decontam.write_blocks(benchmark(spark), block_items=2)
    assert len(paths) == 4


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = brute([r.text for r in docs], items)
    got = {r.doc_id: r for r in queries.queries()["op4_decontamination"](spark, SF).collect()}
    assert len(got) == len(docs) and any(h for _, h, _ in expected)
    for r, (n, h, i) in zip(docs, expected):
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), len(i) >= 2)
