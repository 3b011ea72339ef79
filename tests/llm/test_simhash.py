import random
import re

import numpy as np
import pytest
import xxhash

from tests.conftest import SF
from tests.llm.fixtures import documents, empty, sentences
from veinmap.llm import queries, simhash


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=4):
    """Position to the least position of its component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(a))]


def clusters(seed, groups=40, most=40, flips=9):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, most)):
            x = base
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def united(codes, links):
    place = {c: k for k, c in enumerate(codes.tolist())}
    forest = simhash.Forest(len(codes))
    for a, b in links:
        forest.link(np.array([place[x] for x in a.tolist()], np.int64), np.array([place[x] for x in b.tolist()], np.int64))
    return forest.roots().tolist()


@pytest.mark.parametrize("count", [100, 10**8, 10**12])
@pytest.mark.parametrize("seed", range(3))
def test_tries_find_all_links_for_any_number_of_segments(seed, count):
    codes = clusters(seed)
    links = [simhash.links_within(codes, codes & np.uint64(m), 4) for m in simhash._key_masks(count, 4)]
    assert united(codes, links) == classes(codes)


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 7])
def test_one_root_and_other_budgets(bits):
    codes = clusters(9, groups=25)
    assert united(codes, [simhash.links_within(codes, np.zeros(len(codes), np.int64), bits)]) == classes(codes, bits)


def test_dense_groups_give_forests_not_pairs():
    codes = clusters(4, groups=1, most=3000, flips=3)
    a, _ = simhash.links_within(codes, np.zeros(len(codes), np.int64), 4)
    assert len(a) < len(codes)


def test_the_descent_settles_the_links_of_documents(spark):
    """On the groups that documents form under pigeonhole keys, node pairs go down, few leaves meet, and the links are those of brute force."""
    texts = [r.text for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    codes = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64))
    links, walked, met, pairs = [], 0, 0, 0
    for mask in simhash._key_masks(len(codes), 4):
        keys = codes & np.uint64(mask)
        order = np.lexsort((codes, keys))
        sizes = np.unique(keys, return_counts=True)[1]
        forest = simhash.Forest(len(codes))
        w, m = simhash.descend(codes[order], np.concatenate([[0], np.cumsum(sizes)]), 4, forest)
        walked, met, pairs = walked + w, met + m, pairs + int((sizes * (sizes - 1) // 2).sum())
        roots = forest.roots()
        links.append((codes[order], codes[order][roots]))
    assert walked > (sizes > 1).sum() > 0 and 0 < met < pairs
    assert united(codes, links) == classes(codes)


def test_tasks_let_go_of_whole_groups(spark, monkeypatch):
    fps = spark.createDataFrame([(simhash._signed(int(x)),) for x in clusters(3)], "fp long")
    expected = {tuple(r) for r in simhash.components(simhash.near_links(fps)).collect()}
    monkeypatch.setattr(simhash, "HELD", 7)
    monkeypatch.setattr(simhash, "MAX_GROUP", 10)
    assert {tuple(r) for r in simhash.components(simhash.near_links(fps, max_group=10)).collect()} == expected


def test_masks_cover_by_pigeonhole():
    for count in (10, 10**8, 10**10, 10**12):
        parts, chosen = simhash.segments(count, 4)
        assert sum(w for _, w in parts) == 64 and len(parts) - chosen == 4


def test_fingerprints():
    for t in (None, "", "A b", "a B c d", "x\x0by\x0cz \x1c \u0085 é É", " ".join(sentences(40))):
        assert simhash.fingerprint((t or "").encode()) == print_of(t)


def near(spark, docs):
    return {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [print_of(t) for _, t in rows]
    roots = classes(prints)
    ids = {k: min((rows[j][0] for j in range(len(rows)) if roots[j] == k and rows[j][0] is not None), default=None) for k in set(roots)}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    expected = sorted(((d, p, ids[k]) for (d, _), p, k in zip(rows, prints, roots)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == expected
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes_ = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, classes_))
    assert simhash.keep_one(empty(docs)).count() == 0


def test_hot_groups_are_cut_and_lose_no_link(spark):
    codes = clusters(7, groups=3, most=400, flips=6)
    fps = spark.createDataFrame([(x,) for x in codes.view(np.int64).tolist()], "fp long").cache()
    for most in (50, 10**6):
        found = [(np.array([r.a], np.int64).view(np.uint64), np.array([r.b], np.int64).view(np.uint64)) for r in simhash.near_links(fps, max_group=most).collect()]
        assert united(codes, found) == classes(codes)


def test_components(spark):
    r = random.Random(2)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (300, 200)]
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    got = queries.queries()["op5_simhash"](spark, SF).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [print_of(t) for _, t in docs]
    roots = classes(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(d, f"{p:016x}", docs[k][0]) for (d, _), p, k in zip(docs, prints, roots)]
