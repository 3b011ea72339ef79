import random
import re

import numpy as np
import pyarrow as pa

from tests.conftest import SF
from tests.llm.fixtures import documents, empty, sentences
from veinmap.llm import line_dedup, queries
from veinmap.llm.words import finish, words_in

SPACE = " \t\n\r\x0b\x0c"
WORDS = sentences(60, seed=3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def running(words):
    """The words in lists, cut after each whose hash with the next one's is the least of its neighbourhood."""
    h = {w: int(words_in(pa.array([w.encode()], pa.binary())).hash[0]) for w in set(words)}
    mix = lambda a, b: int(finish(np.array([(3 * a + 0x9E3779B97F4A7C15 * b) % 2**64], np.uint64))[0])
    pair, out = [mix(h[a], h[b]) for a, b in zip(words, words[1:])], [[]]
    for k, w in enumerate(words):
        out[-1].append(w)
        if 3 <= k < len(pair) - 3 and pair[k] < min(pair[k - 3 : k]) and pair[k] <= min(pair[k + 1 : k + 4]):
            out.append([])
    return [x for x in out if x]


def spans(text, width, both):
    """(what is compared, first word, end word) of each window of a text."""
    out = []
    for family, lines in enumerate([[w for x in text.split("\n") if (w := words_of(x))], running(words_of(text)) if both else []]):
        ends = np.cumsum([0, *map(len, lines)])
        m = width if family else min(width, len(lines))
        out += [((family, tuple(map(tuple, lines[k : k + m]))), int(ends[k]), int(ends[k + m])) for k in range(len(lines) - m + 1) if m]
    return out


def brute(rows, width=3, both=True):
    """Words left of each row, by position: a window goes where a lesser id has it, or the text itself has it before."""
    least = {}
    for doc_id, text in rows:
        for w, _, _ in spans(text or "", width, both):
            least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words, gone, seen = words_of(text or ""), set(), set()
        for w, a, b in spans(text or "", width, both):
            if least[w] < doc_id or w in seen:
                gone |= set(range(a, b))
            seen.add(w)
        out.append((doc_id, text is None, [w for k, w in enumerate(words) if k not in gone], len(gone)))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, ord string, places string").repartition(3)
    got = sorted(map(repr, ((r.doc_id, r.text is None, words_of(r.text or ""), r.n_words_removed) for r in line_dedup.dedup(docs, **options).collect())))
    assert got == sorted(map(repr, brute(rows, both=options.get("running", True))))


def pool():
    return ["a", "b b", "c", "", " ", "  d.  x", "e! f? g.", *sentences(6, vocabulary=30), " ".join(sentences(4, seed=2)), "tail \x1c\u0085", "café\xa0\U0001f600"]


def test_random_texts(spark):
    r = random.Random(4)
    rows = [(k, "\n".join(r.choice(pool()) for _ in range(r.randint(0, 9)))) for k in range(120)]
    rows += [rows[3], rows[3], (7, rows[9][1]), (500, None), (501, "")]
    check(spark, rows, running=False)
    check(spark, rows)


def test_blanks_alone_decide_nothing(spark):
    """Forty one-word sentences, joined by blanks, tabs and line breaks: one passage to the running lines."""
    words = [f"{w}." for w in " ".join(WORDS).replace(".", "").split()[:40]]
    rows = [(1, " ".join(words)), (2, "\t".join(words)), (3, "\n".join(words))]
    check(spark, rows)
    left = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == rows[0][1] and not left[2].split() and not left[3].split()


def plant(r, passage):
    """The passage amid words of its own, mid-sentence, on one line or over several."""
    own = lambda: " ".join("".join(r.choice("ijklmnop") for _ in range(6)) for _ in range(r.randint(3, 25)))
    cuts = sorted(r.sample(range(1, len(passage)), 2))
    return f"{own()} {r.choice(' ' + chr(10)).join(' '.join(passage[a:b]) for a, b in zip([0, *cuts], [*cuts, None]))} {own()}.\n{own()}"


def test_passages_planted_mid_sentence(spark):
    r = random.Random(8)
    stock = " ".join(sentences(160, seed=5, vocabulary=3000)).replace(".", "").split()
    passages = [stock[100 * k : 100 * k + n] for k, n in enumerate([51, 51, 56, 60, 75] * 8)]
    rows = [(k, plant(r, passages[k % 40])) for k in range(160)]
    check(spark, rows)
    gone = {r.doc_id: r.n_words_removed for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(gone[k] for k in range(40))  # of each passage the first stays
    share = [gone[k] / len(passages[k % 40]) for k in range(40, 160)]
    assert min(share) > 0.25 and np.mean(share) > 0.65 and max(share) <= 1


def test_lines_keep_their_ends():
    words = [f"w{k}" for k in range(30)]
    for text, left in ((f"a\n{' '.join(words)}\nb c", b"a\nb c"), (f"a\n{chr(10).join(words)}\nb", b"a\nb")):
        found = line_dedup.Windows(words_in(pa.array([text.encode()], pa.binary())))
        inside = [k for k in range(len(found.first)) if found.first[k] >= 1 and found.stop[k] <= 31]
        assert line_dedup.cut(text.encode(), inside)[0].startswith(left[:2]) and line_dedup.cut(text.encode(), inside)[0].endswith(left[2:])
    assert line_dedup.cut(b"x y\nl1\n\nl2\nl3\nz", [1], running=False) == (b"x y\n\nz", 3, 3)


def test_copies_without_an_id_are_documents_of_their_own(spark):
    text = "One line.\nAnother line.\nA third line.\nA fourth."
    docs = spark.createDataFrame([(None, text)] * 5 + [(1, text), (1, text)], "doc_id long, text string").repartition(3)
    got = line_dedup.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", text), *[("None", "")] * 4, *[("1", "")] * 2])


def test_documents(spark):
    docs = documents(spark)
    got = line_dedup.dedup(docs)
    assert got.count() == docs.count() and got.filter("text IS NULL").count() == 1
    assert line_dedup.dedup(empty(docs)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r.doc_id, r.text is None, words_of(r.text or ""), r.n_words_removed) for r in queries.queries()["op7_line_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(brute(docs))
