"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings. Features are
those that the labels of a bounded sample (max_labelled ids) set apart most
clearly; fitting minimises the log loss, a ridge, and the squared change of the
score between counterfactual sentences, so that a mention of a group earns no
score. These come from the sample's sentences:

- a sentence with identity terms, and the same with each term swapped for
  another of its group;
- of every sample text one sentence with a term put in, and the same with
  another term of that group; of texts labelled clean also the same without any.

Groups are per language, as a parameter; all languages' terms are looked for in
all texts, so that scores depend on texts only.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_chunks
from .quality import labelled_sample

#: Groups of identity terms by language; terms of a group stand for one another.
IDENTITY_GROUPS = {
    "en": (
        ("men", "women"),
        ("man", "woman"),
        ("boys", "girls"),
        ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "straight", "lesbian", "bisexual"),
        ("immigrants", "natives", "refugees", "citizens"),
    ),
    "de": (
        ("männer", "frauen"),
        ("mann", "frau"),
        ("jungen", "mädchen"),
        ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
        ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
        ("schwule", "lesben", "bisexuelle"),
        ("einwanderer", "einheimische", "flüchtlinge", "bürger"),
    ),
    "fr": (
        ("hommes", "femmes"),
        ("homme", "femme"),
        ("garçons", "filles"),
        ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "africains", "européens"),
        ("gays", "lesbiennes", "bisexuels"),
        ("immigrés", "autochtones", "réfugiés", "citoyens"),
    ),
    "es": (
        ("hombres", "mujeres"),
        ("hombre", "mujer"),
        ("niños", "niñas"),
        ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos"),
        ("gais", "lesbianas", "bisexuales"),
        ("inmigrantes", "nativos", "refugiados", "ciudadanos"),
    ),
}
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Weight of the penalty on counterfactual pairs; it is taken of the mean over pairs, of which any one group has a few hundredths.
COUNTER = 100.0
#: ASCII that is neither letter nor digit becomes a space.
BETWEEN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.decode("utf-8", "replace").lower().encode().translate(BETWEEN).split())


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, these marked by a leading ^."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) >= k)]


@functools.lru_cache(16)
def _changes(groups: tuple) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, g[1:] + g[:1])}


def swapped(words: set[bytes], groups) -> set[bytes] | None:
    """The words with each identity term exchanged for the next of its group; None without any term. groups: tuples of terms."""
    change = _changes(tuple(groups))
    return {change.get(w, w) for w in words} if words & change.keys() else None


SENTENCE = re.compile(rb"[^.!?\n]+")


def counterfactuals(text: bytes, clean: bool, groups) -> list[tuple[set[bytes], set[bytes]]]:
    """Pairs of sentences, as sets of words, that should score alike. Which sentence takes which terms follows from the text's hash."""
    sentences = [w for x in SENTENCE.findall(text) if (w := words_of(x))]
    pairs = [(w, s) for w in sentences if (s := swapped(w, groups)) is not None]
    if sentences and groups:
        seed = zlib.crc32(text)
        words, group = sentences[seed % len(sentences)], groups[seed // 7 % len(groups)]
        k = seed // 1009 % len(group)
        one, other = words | {group[k].encode()}, words | {group[(k + 1) % len(group)].encode()}
        pairs.append((one, other))
        if clean:
            pairs.append((one, words))
    return pairs


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    n_pairs: int = 0

    def scorer(self, cache: int = 300_000):
        """A function from a text to its score; it remembers up to cache words that carry no weight."""
        plain: set[bytes] = set()
        loaded: dict[bytes, list[bytes]] = {}

        def score(text: bytes) -> float:
            words = words_of(text)
            for w in words - plain:
                if w not in loaded:
                    if found := [f for f in features_of(w) if f in self.weights]:
                        loaded[w] = found
                    else:
                        plain.add(w)
            features = {f for w in words & loaded.keys() for f in loaded[w]}
            if len(plain) + len(loaded) > cache:
                plain.clear()
                loaded.clear()
            return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(features))))))

        return score


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([k for r in rows for k in r], np.int64)


def fit_logistic(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, ridge: float = 2e-4, counter: float = 1.0, steps: int = 600, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on log loss + ridge + counter * mean squared score change of pairs."""
    r, c = _sparse(rows)
    ra, ca = _sparse([a for a, _ in pairs])
    rb, cb = _sparse([b for _, b in pairs])
    positive = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
    w, bias = np.zeros(n), float(np.log(positive / (1 - positive)))
    # Adagrad-like scaling by how often a feature occurs keeps rare and frequent features moving alike.
    scale = np.zeros(n)
    gw_sum, gb_sum = np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(bias + np.bincount(r, w[c], len(rows)))))
        g = (p - y) / max(len(y), 1)
        grad = np.bincount(c, g[r], n) + ridge * w
        grad_b = g.sum()
        if pairs:
            pa = 1 / (1 + np.exp(-(bias + np.bincount(ra, w[ca], len(pairs)))))
            pb = 1 / (1 + np.exp(-(bias + np.bincount(rb, w[cb], len(pairs)))))
            d = 2 * counter * (pa - pb) / len(pairs)
            da, db = d * pa * (1 - pa), d * pb * (1 - pb)
            grad += np.bincount(ca, da[ra], n) - np.bincount(cb, db[rb], n)
            grad_b += (da - db).sum()
        gw_sum += grad**2
        gb_sum += grad_b**2
        scale = rate / np.sqrt(gw_sum)
        w = w - scale * grad
        bias -= rate / np.sqrt(gb_sum) * grad_b
    return w, float(bias)


def _counts(batches):
    """Per task: how many texts of each label have a feature."""
    import pyarrow as pa

    seen: dict[bytes, list[int]] = {}

    def out():
        keys = list(seen)
        return pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.binary()), "n0": pa.array([seen[k][0] for k in keys], pa.int64()), "n1": pa.array([seen[k][1] for k in keys], pa.int64())})

    for batch in batches:
        labels = batch.column("label").to_pylist()
        for first, _, texts in text_chunks(batch, "text"):
            for k, text in enumerate(texts):
                for f in {f for w in words_of(text) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[labels[first + k]] += 1
            if len(seen) > 200_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


def fit(docs: DataFrame, labels: DataFrame, trains: Column | None = None, max_labelled: int = 12_000, max_features: int = 3_000, least_texts: int | None = None, least_z: float = 4.5, label: str = "toxic", groups: dict[str, tuple] = IDENTITY_GROUPS, counter: float = COUNTER) -> Model:
    """A model from the sample's labels; trains picks the labelled ids that may be learnt from.

    A feature has to be in least_texts texts of the sample (a 400th of it, from 4
    to 8, if not given) and to differ from chance by least_z standard deviations;
    the terms of groups, and their beginnings, are features always. counter weighs
    the penalty on counterfactual pairs; at zero there is none. Without labels of
    both kinds every text has the score of the share of positives.
    """
    sample = materialize(labelled_sample(docs, labels, label, max_labelled, keep=trains), "toxicity-sample")
    n0, n1 = (int(x or 0) for x in sample.agg(F.sum(1 - F.col("label")), F.sum("label")).first())
    if not n0 or not n1:
        return Model({}, 8.0 if n1 else -8.0)
    share = n1 / (n0 + n1)
    least_texts = min(8, max(4, (n0 + n1) // 400)) if least_texts is None else least_texts
    n = F.col("n0") + F.col("n1")
    z = (F.col("n1") - n * share) / F.sqrt(n * share * (1 - share))
    counts = sample.mapInArrow(_counts, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = counts.filter(n >= least_texts).withColumn("z", F.abs(z)).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_features).select("feature")
    groups_ = tuple(tuple(g) for language in sorted(groups) for g in groups[language])
    terms = {f for g in groups_ for t in g for f in features_of(t.encode())}
    features = sorted({bytes(x.feature) for x in chosen.collect()} | terms)
    place = {f: k for k, f in enumerate(features)}

    def rows(batches):
        import pyarrow as pa

        codes = lambda ws: sorted({place[f] for w in ws for f in features_of(w) if f in place})
        kind = pa.list_(pa.int32())
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                given = batch.column("label").slice(first, last - first)
                pairs = [[(codes(a), codes(b)) for a, b in counterfactuals(t, y == 0, groups_)] if counter else [] for t, y in zip(texts, given.to_pylist())]
                pairs = [[(a, b) for a, b in p if a != b] for p in pairs]  # alike already
                yield pa.RecordBatch.from_arrays([given, pa.array([codes(words_of(t)) for t in texts], kind), *(pa.array([[x[k] for x in p] for p in pairs], pa.list_(kind)) for k in (0, 1))], ["label", "codes", "one", "other"])

    gathered = sample.mapInArrow(rows, "label int, codes array<int>, one array<array<int>>, other array<array<int>>").toArrow()  # max_labelled rows at most
    found = sorted(zip(*(c.to_pylist() for c in gathered.columns)), key=repr)
    pairs = [x for _, _, one, other in found for x in zip(one, other)]
    w, bias = fit_logistic([c for _, c, _, _ in found], np.array([y for y, _, _, _ in found], float), pairs, len(features), counter=counter)
    return Model({f: float(x) for f, x in zip(features, w) if abs(x) > 1e-4}, bias, len(pairs))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document.

    Null and empty texts have the score of no words; rows of equal or null doc_id
    are scored each for itself; an empty table gives an empty result. Other columns
    are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        scorer = model.scorer()
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                found = np.array([scorer(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def is_held_out(doc_id: Column) -> Column:
    """Ids whose crc32, taken of the id as text, leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
