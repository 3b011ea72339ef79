"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of about SHARD_BYTES; a longer text is cut
into pieces that overlap by a window less one word. A shard's text is the sequence
of its words' codes, over the shard's own vocabulary, with separators between
documents. Over it stand a suffix array (prefix doubling, each step on what is
still undecided), its Burrows-Wheeler transform and a wavelet tree. The index is
built once and knows nothing of the benchmark. All phrases are then searched
backwards at once through wavelet ranks; the occurrences of those found are
located by walking the last-to-first mapping to sampled suffix positions;
overlapping occurrences merge into removal spans.

Phrases are windows of WINDOW consecutive words of a benchmark item, or a whole
shorter item. The benchmark is a query set of its own: it goes to the workers as
files of at most BLOCK_ITEMS items in the shared folder, and every shard's index
meets every block, so no size of the benchmark has to fit into memory.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, text_chunks
from .files import filesystem, new_file

WINDOW = 8
SHARD_BYTES = 2 << 20
#: Words that one index holds at most.
SHARD_WORDS = 400_000
BLOCK_ITEMS = 20_000
#: Window words of the blocks that a worker keeps between shards.
KEPT_WORDS = 8_000_000
#: Every so many text positions one suffix array entry is kept.
SAMPLE = 4
#: Bytes to bytes: upper case to lower case, and what stands between words to a space. Words are made of digits, a to z and all that is not ASCII.
BETWEEN_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BETWEEN_WORDS).split()


class WaveletTree:
    """Ranks of symbols in a sequence: a level per bit of the symbols, from the highest, with prefix sums of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        symbols = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            bit = (symbols & np.int32(1 << level)) != 0
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position beside it."""
        start = np.zeros(len(upto), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            s1, u1 = ones[start], ones[upto]
            start = np.where(bit, zeros + s1, start - s1)
            upto = np.where(bit, zeros + u1, upto - u1)
        return upto - start


def _ranked(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place in order: the place where its run of equal keys starts, and whether the run has more than one."""
    if not len(order):
        return order, np.zeros(0, bool)
    sorted_ = key[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    return np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)), ~alone


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: places of the first 1, 2, 4, ... symbols, in which only suffixes that share a place are sorted again."""
    n = len(text)
    order = np.argsort(text)
    start, tied = _ranked(order, text)
    rank = np.empty(n, np.int64)
    rank[order] = start
    places = np.flatnonzero(tied)
    step = 1
    while len(places):
        some = order[places]
        second = np.where(some + step < n, rank[np.minimum(some + step, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + second
        by = np.argsort(key)
        order[places] = some[by]
        start, tied = _ranked(by, key)
        rank[some[by]] = places[start]
        places = places[tied]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 up; 0 separates."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        closed = np.concatenate([text + 1, [0]]).astype(np.int64)  # 0 now ends the text
        order = suffix_array(closed)
        self.bwt = closed[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(top + 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(closed, minlength=top + 2))])
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - self.sampled
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rows whose suffixes start with each phrase (equal lengths, one a row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt))
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k] + 1
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at[live]]
            hit = live[done]
            out[hit] = self.samples[self.sample_rank[at[hit]]] + steps[hit]
            live = live[~done]
            symbol = self.bwt[at[live]]
            at[live] = self.before[symbol] + self.tree.rank(symbol, at[live])
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """A block of benchmark items: its words, distinct windows by length as rows of word numbers, and the items that each window is in (of window k those from bounds[k] on)."""

    words: list[bytes]
    windows: list[np.ndarray]
    bounds: list[np.ndarray]
    items_of: list[np.ndarray]
    items: list[str]

    @property
    def size(self) -> int:
        return sum(w.size for w in self.windows)


def phrases(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    by_length: dict[int, dict[tuple, set[int]]] = {}
    for name, text in items:
        words = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
        if words:
            item, m = names.setdefault(name, len(names)), min(window, len(words))
            for k in range(len(words) - m + 1):
                by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set()).add(item)
    found = list(by_length.values())
    return Phrases(
        list(numbers),
        [np.array(list(x), np.int32) for x in found],
        [np.cumsum([0, *map(len, x.values())]) for x in found],
        [np.array([i for s in x.values() for i in sorted(s)], np.int64) for x in found],
        list(names),
    )


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each pair: n numbers."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def occurrences(index: FMIndex, vocabulary, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, words, item) of all occurrences of a block's windows in an index over codes; the word of code k is at k in vocabulary, an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = pc.fill_null(pc.index_in(vocabulary, value_set=pa.array(block.words, pa.large_binary()).view(pa.large_string())), -1).to_numpy()
    codes = np.zeros(len(block.words), np.int64)
    codes[at[at >= 0]] = np.flatnonzero(at >= 0)
    out = [(np.empty(0, np.int64),) * 3]
    for windows, bounds, items_of in zip(block.windows, block.bounds, block.items_of):
        coded = codes[windows]
        known = np.flatnonzero((coded > 0).all(axis=1))
        low, high = index.search(coded[known])
        some = high > low
        found, low, n = known[some], low[some], (high - low)[some]
        at = index.locate(_spread(low, n))
        window = np.repeat(found, n)
        per = bounds[window + 1] - bounds[window]
        out.append((np.repeat(at, per), np.full(int(per.sum()), windows.shape[1]), items_of[_spread(bounds[window], per)]))
    return tuple(np.concatenate(x) for x in zip(*out))


def write_blocks(benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS) -> list[str]:
    """Files of items' windows in the shared folder; the driver holds one block at a time."""
    folder = scratch(benchmark.sparkSession, "phrases")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator()
    paths = []
    while block := list(itertools.islice(rows, block_items)):
        paths.append(f"{folder}/block-{len(paths):05d}")
        with new_file(paths[-1]) as out:
            out.write(pickle.dumps(phrases([(r.item_id, bytes(r.text or b"")) for r in block], window)))
    return paths


_loaded: dict[str, Phrases] = {}


def _load(path: str) -> Phrases:
    """The block of a file; those used last are kept as long as they are small together."""
    block = _loaded.pop(path, None)
    if block is None:
        fs, at = filesystem(path)
        with fs.open_input_stream(at, compression=None) as f:
            block = pickle.loads(f.read())
        while _loaded and block.size + sum(x.size for x in _loaded.values()) > KEPT_WORDS:
            _loaded.pop(next(iter(_loaded)))
    _loaded[path] = block
    return block


@dataclass
class Found:
    """What one shard has: per document its words, hit words and items, and its removal spans in words."""

    n_words: list[int]
    n_hit: list[int]
    items: list[list[str]]
    spans: list[list[tuple[int, int]]]


def coded(texts: list[bytes]):
    """(codes of all words with a zero after each text, words per text, an Arrow array that has the word of each code; at 0 it has no word)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # No word has a stop: one opens the vocabulary, and one ends each text.
    spaced = pa.array([b".", *(b"".join((t.translate(BETWEEN_WORDS), b" .")) for t in texts)], pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy()[1:].astype(np.int64), pc.list_value_length(lists).to_numpy()[1:].astype(np.int64) - 1, flat.dictionary


def scan_shard(texts: list[bytes], paths: list[str], window: int) -> Found:
    codes, sizes, vocabulary = coded(texts)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(len(codes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for start in range(0, len(codes), SHARD_WORDS) if paths else ():
        index = FMIndex(codes[start : start + SHARD_WORDS + window - 1], len(vocabulary))
        for path in paths:
            block = _load(path)
            at, n, item = occurrences(index, vocabulary, block)
            np.add.at(change, start + at, 1)
            np.add.at(change, start + at + n, -1)
            doc = np.searchsorted(firsts, start + at, side="right") - 1
            for pair in np.unique(doc * max(1, len(block.items)) + item).tolist():
                items[pair // len(block.items)].add(block.items[pair % len(block.items)])
    hit = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(firsts, starts, side="right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip(doc.tolist(), (starts - firsts[doc]).tolist(), (stops - firsts[doc]).tolist()):
        spans[d].append((a, b))
    return Found(sizes.tolist(), [sum(b - a for a, b in s) for s in spans], [sorted(x) for x in items], spans)


LEAST_ITEMS = 2


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans (in words), contaminated of every document.

    Null and empty texts have no words and are clean; rows of equal or null
    doc_id are scanned each for itself; benchmark rows of one item_id are one
    item, null ids count as the empty name; without items all documents are
    clean. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    paths = write_blocks(benchmark, window)

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text", SHARD_BYTES):
                found = scan_shard(texts, paths, window)
                n_items = np.array([len(x) for x in found.items], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "n_words": pa.array(found.n_words, pa.int64()),
                    "n_hit": pa.array(found.n_hit, pa.int64()),
                    "n_items": pa.array(n_items),
                    "items": pa.array(found.items, pa.list_(pa.string())),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found.items], pa.string()),
                    "spans": pa.array([[{"first": a, "last": b - 1} for a, b in s] for s in found.spans], span),
                    "contaminated": pa.array(n_items >= least_items),
                })

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<first:long,last:long>>, contaminated boolean"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between these words."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(BETWEEN_WORDS))]
    kept, at = [], 0
    for first, stop in spans:
        kept.append(text[at : places[first][0]])
        at = places[stop - 1][1]
    return b"".join(kept) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The rows of docs that are not contaminated, removal spans cut from their texts, with all their columns.

    A column n_chars of whole numbers follows the text where that changes; of any
    other type it is left alone. Documents without an occurrence, null and empty
    texts among them, come back as they are; rows of equal or null doc_id are each
    cleaned for itself; an empty table gives an empty result, and an empty
    benchmark changes nothing.
    """
    small_batches(docs.sparkSession)
    paths = write_blocks(benchmark, window)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            clean_rows, changed, row = [], {}, 0
            for _, _, texts in text_chunks(batch, "text", SHARD_BYTES):
                found = scan_shard(texts, paths, window)
                for text, items, spans in zip(texts, found.items, found.spans):
                    clean_rows.append(len(items) < least_items)
                    if spans and clean_rows[-1]:
                        changed[row] = without_spans(text, spans)
                    row += 1
            if changed:
                texts = batch.column("text").view(pa.binary()).to_pylist()
                for k, text in changed.items():
                    texts[k] = text
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).view(batch.schema.field("text").type))
                if (k := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(k).type):
                    sizes = batch.column(k).to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text.decode("utf-8", "replace"))
                    batch = batch.set_column(k, "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
            yield batch.filter(pa.array(clean_rows, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB SQL for the query: windows as joined words, found by an equality join.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, unnest(list_transform(range(len(w) - m + 1), lambda k: array_to_string(w[k + 1:k + m], ' '))) AS win FROM (SELECT *, least(8, len(w)) AS m FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, unnest(range(len(w) - m + 1)) AS k, unnest(list_transform(range(len(w) - m + 1), lambda k: array_to_string(w[k + 1:k + m], ' '))) AS win FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
h AS (SELECT doc_id, k, m, item FROM dw JOIN bw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(i.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
