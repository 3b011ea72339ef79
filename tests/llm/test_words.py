import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veinmap.llm import words


def of(texts):
    return words.words_in(pa.array([None if t is None else t.encode("utf-8", "ignore") for t in texts], pa.binary()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab é\u0085\x1c\x0b\t\n\r\x0c \0"), max_size=30), max_size=8), st.sampled_from([1, 3, 1 << 16]))
def test_words_and_hashes(texts, segment):
    before, words.SEGMENT = words.SEGMENT, segment
    try:
        got = of(texts)
    finally:
        words.SEGMENT = before
    expected = [(k, w) for k, t in enumerate(texts) for w in (t or "").encode("utf-8", "ignore").split()]
    data = b"".join((t or "").encode("utf-8", "ignore") for t in texts)
    assert got.text.tolist() == [k for k, _ in expected]
    assert [data[a:b] for a, b in zip(got.start.tolist(), got.stop.tolist())] == [w for _, w in expected]
    by_word = {}
    for (_, w), h in zip(expected, got.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert got.breaks.tolist() == [data[:a].count(b"\n") for a in got.start.tolist()]


def test_slices_of_arrays():
    whole = pa.array([b"x y", b"a b", None, b"c"], pa.binary())
    a, b = words.words_in(whole.slice(1, 3)), of(["a b", None, "c"])
    assert a.text.tolist() == b.text.tolist() == [0, 0, 2] and a.hash.tolist() == b.hash.tolist() and a.start.tolist() == b.start.tolist()


def test_span_hashes_tell_spans_apart():
    r = np.random.default_rng(0)
    found = of([" ".join(r.choice(list("abcd"), 400))])
    first = np.repeat(np.arange(390), 5)
    stop = first + np.tile(np.arange(1, 6), 390)
    both = [found.span_hash(first, stop, k) for k in (0, 1)]
    spans = {}
    for k, (a, b) in enumerate(zip(first.tolist(), stop.tolist())):
        key = tuple(found.hash[a:b].tolist())
        assert spans.setdefault(key, (both[0][k], both[1][k])) == (both[0][k], both[1][k])
    assert len(set(spans.values())) == len(spans) and all(x != y for s, (x, y) in spans.items() if len(s) > 1)


def test_no_words():
    for texts in ([], [None], ["", " \n"]):
        got = of(texts)
        assert len(got.hash) == 0 and len(got.span_hash(np.empty(0, np.int64), np.empty(0, np.int64))) == 0
