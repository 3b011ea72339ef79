import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.fixtures import documents, empty, labels
from veinmap.llm import queries, toxicity


def test_features():
    assert toxicity.words_of("It's ÉTÉ, it's so-so!\n".encode()) == {b"it", b"s", "été".encode(), b"so"}
    assert toxicity.features_of(b"abcde") == [b"abcde", b"^abcd", b"^abcde"]
    assert toxicity.features_of(b"abc") == [b"abc"]


def test_swaps_stay_in_their_group():
    groups = [g for x in toxicity.IDENTITY_GROUPS.values() for g in x]
    assert toxicity.swapped({b"the", b"women", b"atheists"}, groups) == {b"the", b"men", b"christians"}
    assert toxicity.swapped({"männer".encode()}, groups) == {b"frauen"} and toxicity.swapped({b"the"}, groups) is None
    terms = [t for g in groups for t in g]
    assert len(set(terms)) >= len(terms) - 1 and all(len(set(g)) == len(g) > 1 for g in groups)


def test_counterfactual_sentences():
    groups = [("men", "women")]
    pairs = toxicity.counterfactuals(b"Some men sing. Others listen!", True, groups)
    assert ({b"some", b"men", b"sing"}, {b"some", b"women", b"sing"}) in pairs and len(pairs) == 3
    one, other, plain = pairs[1][0], pairs[1][1], pairs[2][1]
    assert one - plain <= {b"men", b"women"} and pairs[2][0] == one and one ^ other <= {b"men", b"women"}
    assert len(toxicity.counterfactuals(b"Others listen!", False, groups)) == 1
    assert toxicity.counterfactuals(b" .!", True, groups) == [] == toxicity.counterfactuals(b"x", True, [])


def spurious(spark):
    """Documents in which toxic ones mention one group far more often than clean ones do, and their labels."""
    r = random.Random(2)
    fill = lambda: " ".join(r.choice(["road", "river", "music", "bread", "winter", "garden", "stone", "letter"]) for _ in range(8))
    rows, given = [], []
    for k in range(900):
        toxic = k % 3 == 0
        mention = "women" if r.random() < (0.6 if toxic else 0.03) else "men" if r.random() < 0.2 else ""
        insult = "wretched" if toxic and r.random() < 0.75 else ""
        rows.append((k, f"{fill()} {mention} {fill()}. {insult} {fill()}."))
        given.append((k, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(given, "doc_id long, quality int, toxic int")


def test_the_penalty_spares_neutral_mentions(spark):
    docs, given = spurious(spark)
    neutral = spark.createDataFrame([(k, f"{a} women {b} garden") for k, (a, b) in enumerate([("road", "river"), ("music", "bread"), ("stone", "winter"), ("letter", "music")])], "doc_id long, text string")
    insults = spark.createDataFrame([(1, "wretched road river music")], "doc_id long, text string")
    found = {}
    for counter in (0.0, toxicity.COUNTER):
        model = toxicity.fit(docs, given, least_texts=3, counter=counter)
        found[counter] = [r.predicted for r in toxicity.score(neutral, model).collect()], toxicity.score(insults, model).first().predicted, model.n_pairs
    (loose, insult_0, n_0), (spared, insult_1, n_1) = found[0.0], found[toxicity.COUNTER]
    assert n_0 == 0 and n_1 > 900 and insult_0 == insult_1 == 1
    assert sum(loose) == 4 and sum(spared) == 0


def test_labelled_documents_give_pairs(spark):
    """No labelled document of the tables mentions a group: put-in terms make the penalty work."""
    d = SF.replace("0.001", "0.01")
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert model.n_pairs >= spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 0").count() / 2


def fit(counter):
    """Labels in which one group's mention goes with toxicity, though an insult is what makes it."""
    r = random.Random(0)
    rows, y, pairs = [], [], []
    for _ in range(600):
        insult, group = r.random() < 0.3, r.random() < 0.5
        mention = 1 if r.random() < (0.8 if insult else 0.2) else 2
        x = ([0] if insult and r.random() < 0.8 else []) + ([mention] if group else [])
        rows.append(x)
        y.append(float(insult))
        if group:
            pairs.append((x, [3 - k if k else 0 for k in x]))
    return toxicity.fit_logistic(rows, np.array(y), pairs, 3, counter=counter)


def test_counterfactual_term_takes_the_score_off_mentions():
    (w0, _), (w1, _) = fit(0.0), fit(50.0)
    assert abs(w0[1] - w0[2]) > 1 and abs(w1[1] - w1[2]) < 0.3 * abs(w0[1] - w0[2]) and w1[0] > 1


def test_documents(spark):
    docs = documents(spark)
    model = toxicity.fit(docs, labels(spark), least_texts=1, least_z=0.0)
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.filter("score BETWEEN 0 AND 1 AND predicted = CAST(score >= 0.3 AS INT)").count() == docs.count()
    by_text = {}
    for a, b in zip(sorted(docs.collect(), key=lambda r: (repr(r.doc_id), r.text or "")), [None] * docs.count()):
        by_text.setdefault(a.text, a.doc_id)
    assert toxicity.score(empty(docs), model).count() == 0
    assert toxicity.fit(docs, empty(labels(spark))).weights == {}
    only = toxicity.fit(docs, labels(spark).withColumn("toxic", F.lit(1)))
    assert toxicity.score(docs, only).filter("predicted = 1").count() == docs.count()


def test_scores_depend_on_texts_alone(spark):
    docs = spark.createDataFrame([(1, "you idiot", "en", "a"), (2, "you idiot", "fr", None)], "doc_id long, text string, lang string, source string")
    model = toxicity.Model({b"idiot": 2.0}, -1.0)
    a, b = (r.score for r in toxicity.score(docs, model).collect())
    assert a == b == pytest.approx(1 / (1 + np.exp(-1)))


def test_small_cache_scores_alike():
    model = toxicity.Model({b"idiot": 2.0, b"^wort": 1.0}, -3.0)
    texts = [b"an idiot", b"worthless words go here", b"", b"plain words only and many more of them"] * 3
    big, small = model.scorer(), model.scorer(cache=2)
    assert [big(t) for t in texts] == [small(t) for t in texts]


def test_query(spark):
    """Scores by the formula: the weights of all words and word beginnings that a text has, each once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), trains=lambda c: ~toxicity.is_held_out(c))
    got = {r.doc_id: r for r in queries.queries()["op9_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = set(re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (r.text or "").lower()).split(" ")) - {""}
        features = {w.encode() for w in words} | {b"^" + w.encode()[:k] for w in words for k in (4, 5, 6) if len(w.encode()) >= k}
        score = 1 / (1 + np.exp(-(model.bias + sum(w for f, w in model.weights.items() if f in features))))
        g = got[r.doc_id]
        assert g.score == pytest.approx(score) and g.predicted == (g.score >= 0.3) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(200), None, -5]], "doc_id long")
    for r in ids.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, given = documents(spark), labels(spark)
    flipped = given.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    trains = lambda c: ~toxicity.is_held_out(c)
    a, b = (toxicity.fit(docs, x, trains, least_texts=1, least_z=0.0) for x in (given, flipped))
    assert a == b


def test_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.1")
    got = queries.queries()["op9_toxicity"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r for r in got if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
