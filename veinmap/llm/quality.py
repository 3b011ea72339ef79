"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts feed boosted trees fitted on a bounded sample of
labelled documents (max_labelled ids, those with the smallest hashes). Trees are
grown on histograms. On chosen features, shares of something amiss, the score may
only fall as the statistic rises (MONOTONE), so that more symbols, more repeated
lines or more shouting never make a text better. Statistics that are neither good
nor bad in themselves, as the length of words, are free: the score may turn with
them, but a split on one has to gain FREE_GAIN, which chance does not. A fitted
model is flat numpy arrays over all nodes, and scoring walks all rows down all
trees at once.

Fixed rules come before the model: a text of fewer than MIN_WORDS words, or with
more than MAX_REPEAT_PERCENT of its words in repeated five-word windows, fails.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_chunks

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"

#: Statistics that the trees see, and the sign of the constraint: -1, the score never rises with it; 0, free.
FEATURES = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "bang_share": -1,
    "top_word_share": -1,
    "short_piece_share": -1,
    "stutter_share": -1,
    "word_length": 0,
    "distinct_share": 0,
    "line_words": 0,
}
FREE_GAIN = 20.0
#: Words that the share of the most frequent word is taken of at least.
TOP_OF = 20
MONOTONE = np.array(list(FEATURES.values()))


def repeated_words(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in windows of width words found twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ codes[k : n + k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((codes[a + k] != codes[b + k]).any() for k in range(width)):  # two windows share a hash: compare the windows themselves
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(codes, width), axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(counts[inverse.ravel()] > 1)
    else:
        hit = np.union1d(a, b)
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the FEATURES of one whole text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    continued = int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    chars = len(joined) - continued
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    slots: dict[bytes, int] = {}
    codes = np.array([slots.setdefault(w, len(slots)) for w in words], np.int64)
    repeat = repeated_words(codes)
    m = max(n, 1)
    top = int(np.bincount(codes).max()) if n else 0
    share = lambda drop: (len(joined) - len(joined.translate(None, drop))) / max(chars, 1)
    stutter = int(np.count_nonzero(codes[1:] == codes[:-1]))
    return [n, chars, symbols, dup, repeat], [
        symbols / m, dup / max(len(lines), 1), repeat / m, share(UPPER), share(DIGITS), joined.count(b"!") / m, top / max(n, TOP_OF), sum(len(w) == 1 and not w.isalnum() for w in words) / m, stutter / m,
        chars / m, len(slots) / m, n / max(len(lines), 1),
    ]


@dataclass
class Trees:
    """Boosted trees, flattened: node k sends a row left if its feature is at most threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance that a text is good."""
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0, free_gain: float = 1e-3) -> Trees:
    """Logistic boosting on histograms. A constrained split keeps its halves' values in order, and hands each half the midpoint as a bound; a split on a free feature has to gain free_gain."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    positive = float(y.mean()) if len(y) else 1.0
    base = float(np.log(np.clip(positive, 0.01, 0.99) / (1 - np.clip(positive, 0.01, 0.99))))
    if 0 < positive < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)

            def new(v: float) -> int:
                for a, b in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, v)):
                    a.append(b)
                return len(feature) - 1

            def weight(gs, hs):
                return -gs / (hs + l2)

            root = new(0.0)
            roots.append(root)
            todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                node, rows, level, low, high = todo.pop()
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value[node] = rate * float(np.clip(weight(total_g, total_h), low, high))
                best = (1e-3, None)
                if level < depth and total_h >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                        wl, wr = np.clip(weight(gl, hl), low, high), np.clip(weight(total_g - gl, total_h - hl), low, high)
                        gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                        fine = (hl >= least) & (total_h - hl >= least) & ((wr - wl) * monotone[j] >= 0)
                        gain = np.where(fine & (gain > (free_gain if monotone[j] == 0 else 0)), gain, -1)
                        if gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (float(gain[k]), (j, k, float(wl[k]), float(wr[k])))
                if best[1] is None:
                    raw[rows] += value[node]
                    continue
                j, k, wl, wr = best[1]
                goes = binned[rows, j] <= k
                feature[node], threshold[node] = j, float(edges[j][k])
                left[node], right[node] = new(0.0), new(0.0)
                mid = (wl + wr) / 2
                bounds = [(low, high), (low, high)]
                if monotone[j] < 0:
                    bounds = [(mid, high), (low, mid)]
                elif monotone[j] > 0:
                    bounds = [(low, mid), (mid, high)]
                todo += [(left[node], rows[goes], level + 1, *bounds[0]), (right[node], rows[~goes], level + 1, *bounds[1])]
    return Trees(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, base)


def _labelled_features(batches):
    import pyarrow as pa

    for batch in batches:
        for first, last, texts in text_chunks(batch, "text"):
            found = [statistics(t)[1] for t in texts]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(first, last - first), "features": pa.array(found, pa.list_(pa.float64()))})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, keep=None) -> DataFrame:
    """(label, text as binary) of at most max_labelled labelled ids that docs has, those with the smallest hashes.

    An id counts once: of labels that share an id the least, and of texts the least.
    """
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1))
    chosen = chosen.filter(keep(F.col("label_id"))) if keep else chosen
    chosen = chosen.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    chosen = F.broadcast(materialize(chosen, "labelled"))  # at most max_labelled rows of two numbers
    met = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id"))
    texts = met.select("label_id", "label", F.col("text").cast("binary").alias("text"))
    if not met.groupBy("label_id").count().filter("count > 1").isEmpty():  # reads ids only
        texts = texts.groupBy("label_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    return texts.select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Trees:
    """Trees from the labels' quality. Without labels of both kinds every text scores alike."""
    rows = labelled_sample(docs, labels, "quality", max_labelled).mapInArrow(_labelled_features, "label int, features array<double>").toArrow()
    x = np.array(rows.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows.column("label").to_numpy()])
    return fit_trees(x[order], rows.column("label").to_numpy()[order].astype(float), MONOTONE, free_gain=FREE_GAIN)


THRESHOLD = 0.5


def verdicts(text_column: str, model: Trees, threshold: float):
    """Per chunk of a record batch: its slice, the counts, and base_failed, score and kept."""

    def over(batch):
        for first, last, texts in text_chunks(batch, text_column):
            found = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in found], np.int64)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            score = model.score(np.array([f for _, f in found], float))
            yield first, last, counts, failed, score, ~failed & (score >= threshold)

    return over


def judge(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every document.

    A null or empty text has no words and fails; rows of equal or null doc_id are
    judged each for itself; an empty table gives an empty result. Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    over = verdicts("text", model, threshold)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, counts, failed, score, kept in over(batch):
                columns = {"doc_id": batch.column("doc_id").slice(first, last - first)}
                columns |= {c: pa.array(counts[:, k]) for k, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
                yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "score": pa.array(score), "kept": pa.array(kept)})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Null and empty texts fail; rows of equal or null doc_id are judged each for
    itself; texts are judged whole, however long; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    over = verdicts("text", model, threshold)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [np.empty(0, bool), *(k for *_, k in over(batch))]
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
