import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm.fixtures import TEXTS, documents, empty
from veinmap.llm import queries
from veinmap.llm import token_output as tok

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def array(texts):
    return pa.array([None if t is None else t.encode() for t in texts], pa.binary())


@pytest.mark.parametrize("cache", [3, 200, 100_000])
def test_words_in_a_row_are_the_whole_text(whole, cache):
    encoder = tok.WordEncoder(PATH, cache_words=cache, cache_bytes=50 * cache)
    texts = [*TEXTS, "it's I'LL we've 'S", "<|endoftext|> a<|startoftext|>b", "A <|EndOfText|> <|ENDOFTEXT|>.", "x<|endoftext|>, <|endoftext|>. <|startoftext|>y. <|startoftext|><|endoftext|>z", "<| endoftext|> <|endoftext", "İstanbul ΑΣ ﬁ Å é ́x", "1.5, 2,, ...a a., (b). «c».", "a\u0000b"]
    for _ in range(2):
        for k in range(0, len(texts), 5):
            part = texts[k : k + 5]
            ids, n = encoder.encode(array(part))
            assert n.tolist() == [len(whole(t or "")) for t in part]
            assert ids.tolist() == [i for t in part for i in whole(t or "")]


_shared = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from(['<|endoftext|>', '<|EndOfText|>', '<|startoftext|>', ' ', 'A', 'b.', "'S", '<|', 'İ'])).map(''.join), max_size=6))
def test_any_text(texts):
    from tokenizers import Tokenizer

    if not _shared:
        t = Tokenizer.from_file(PATH)
        _shared.extend([t, tok.WordEncoder(PATH, cache_words=50)])
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, n = _shared[1].encode(array(texts))
    expected = [_shared[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_special_strings_are_special_tokens(whole):
    assert whole("a <|endoftext|> b") == [320, 49407, 321]
    assert tok.WordEncoder(PATH).encode(array(["a <|endoftext|> b"]))[0].tolist() == [320, 49407, 321]


def test_files_read_back(spark, whole):
    docs = documents(spark)
    files = tok.write_tokens(docs, PATH)
    got = sorted((tuple(r) for r in tok.read_index(spark, files).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    left, start = list(rows), 0
    for doc_id, at, n, crc in got:
        ids = tok.tokens_of(files, at, n)
        assert at == start and ids[-1] == 1 and crc == zlib.crc32(ids.astype("<u4").tobytes())
        text = next(t for d, t in left if d == doc_id and whole(t) + [1] == ids.tolist())
        left.remove((doc_id, text))
        start += n
    assert not left


def test_query(spark, whole):
    """Every document through the library, whole and by itself."""
    got = sorted((tuple(r) for r in queries.queries()["op1_token_output"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    start = 0
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for (doc_id, text), row in zip(docs, got, strict=True):
        ids = np.array([*whole(text), 1], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_wide_ids_and_empty_tables(spark, whole):
    files = tok.write_tokens(documents(spark), PATH, vocabulary=1 << 20)
    assert files.dtype == "<u4" and tok.read_index(spark, files).count() == len(TEXTS) + 4
    none = tok.write_tokens(empty(documents(spark)), PATH)
    assert none.parts == [] and tok.read_index(spark, none).count() == 0


def test_a_hot_document_id_spreads(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "concat('text number ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tok.write_tokens(docs, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.parts) > 1 and sum(n for _, n, _, _ in files.parts) == 4000
    assert [b for *_, b in files.parts] == np.cumsum([0, *(n for _, _, n, _ in files.parts)])[:-1].tolist()


def test_damage_is_seen(spark):
    from veinmap.llm.files import filesystem

    files = tok.write_tokens(documents(spark), PATH)
    _, path = filesystem(files.stem(files.parts[0][0]) + ".tokens")
    with open(path, "ab") as f:
        f.write(b"xx")
    with pytest.raises(Exception, match="its index says"):
        tok.read_index(spark, files).collect()


def test_cache_stays_bounded():
    encoder = tok.WordEncoder(PATH, cache_words=500, cache_bytes=5000)
    r = random.Random(1)
    for _ in range(20):
        encoder.encode(array([" ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(300))]))
        assert len(encoder.slots) <= 1000 and encoder.key_bytes <= 10_000
