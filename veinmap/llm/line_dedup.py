"""Line dedup by overlapping windows of three lines.

A text is cut into lines in two ways, and both are read alike. Written lines end
at line breaks; those without a word are passed over. Running lines end where the
words themselves say so, whatever breaks and sentences do: after a word whose
hash, taken with the next word's, is the least among REACH neighbours on both
sides. A passage that stands mid-line, or is wrapped elsewhere in another text,
has the same running lines in both, some seven words each.

Every WIDTH consecutive lines make a window, told apart by 96 bits over its
words. A text of fewer written lines is one window of them. Of all equal windows
in the corpus those of the least document id stay, and in a text the first; the
words of the others go: overlapping windows merge into the set of covered words.
Of a passage that repeats, the words before its first and after its last whole
running line stay, a few at each end.

Two aggregations and joins by window see a few numbers per window, never texts;
texts meet their places in one join by document.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_chunks, materialize, small_batches, text_chunks
from .words import Words, finish, words_in

WIDTH = 3
REACH = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of a window's first, second and third line, for its two hashes.
PLACES = ((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
WINDOWS = "ord long, sub long, h1 long, h2 int, place int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cuts(words: Words, reach: int = REACH) -> np.ndarray:
    """Per word, whether a running line ends after it: its hash with the next word's is less than the reach hashes before and no more than the reach after. All must lie in one text."""
    out = np.zeros(len(words.hash), bool)
    n = len(words.hash) - 1
    if n < 2 * reach + 1:
        return out
    pair = finish(words.hash[:-1] * np.uint64(3) + words.hash[1:] * ODD)
    here = pair[reach : n - reach]
    fine = words.text[: n - 2 * reach] == words.text[2 * reach + 1 : n + 1]
    for k in range(1, reach + 1):
        fine &= (here < pair[reach - k : n - reach - k]) & (here <= pair[reach + k : n - reach + k])
    out[reach : n - reach] = fine
    return out


def _window_spans(firsts: np.ndarray, text: np.ndarray, n_words: int, short: bool, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, end word) of the windows of consecutive lines, given the lines' first words and texts; short: a text of fewer lines is one window."""
    n = len(firsts)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none
    opens = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))  # each text's first line
    size = np.diff(np.append(opens, n))
    left = np.repeat(opens + size, size) - np.arange(n)  # lines from here to the text's end
    lines = np.where(left >= width, width, 0)
    if short:
        few = size < width
        lines[opens[few]] = size[few]
    at = np.flatnonzero(lines)
    return at, lines[at], np.append(firsts, n_words)[at + lines[at]]


class Windows:
    """The windows of some texts: per window its text, the span of its words in all words, and two hashes; a text's written lines come first."""

    def __init__(self, words: Words, width: int = WIDTH, running: bool = True):
        new_text = np.concatenate([[True], words.text[1:] != words.text[:-1]]) if len(words.text) else np.zeros(0, bool)
        written = new_text.copy()
        written[1:] |= words.breaks[1:] != words.breaks[:-1]
        self.lines = np.flatnonzero(written)
        families = [(self.lines, True)]
        if running:
            families.append((np.flatnonzero(new_text | np.concatenate([[False], cuts(words)[:-1]])) if len(new_text) else self.lines, False))
        found = []
        for family, (firsts, short) in enumerate(families):
            at, n_lines, stop = _window_spans(firsts, words.text[firsts], len(words.text), short, width)
            hashes = []
            for k, factors in enumerate(PLACES):
                line = words.span_hash(firsts, np.append(firsts[1:], len(words.text)), k)
                total = np.full(len(at), family + 1, np.uint64)
                for j in range(width):
                    total += np.where(j < n_lines, line[np.minimum(at + j, max(len(line) - 1, 0))], 0).astype(np.uint64) * np.uint64(factors[j % 3]) + np.uint64(j)
                hashes.append(finish(total))
            found.append((words.text[firsts[at]], firsts[at], stop, *hashes))
        joined = [np.concatenate(x) for x in zip(*found)]
        order = np.argsort(joined[0], kind="stable")
        self.text, self.first, self.stop, self.h1, self.h2 = (x[order] for x in joined)
        self.h2 = (self.h2 >> np.uint64(32)).astype(np.uint32)

    def places(self) -> np.ndarray:
        """Each window's number within its text; as ~number where an equal window stands before it in the text."""
        n = len(self.text)
        opens = np.flatnonzero(np.concatenate([[True], self.text[1:] != self.text[:-1]])) if n else np.empty(0, np.int64)
        number = np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n)))
        order = np.argsort(finish(self.h1 ^ self.text.astype(np.uint64) * ODD), kind="stable")
        a, b = order[1:], order[:-1]
        same = (self.h1[a] == self.h1[b]) & (self.text[a] == self.text[b]) & (self.h2[a] == self.h2[b])
        number[a[same]] = ~number[a[same]]
        return number


def _hash(width: int, running: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, _, texts in array_chunks(batch, "text"):
                found = Windows(words_in(texts), width, running)
                rows = pa.array(first + found.text)
                yield pa.RecordBatch.from_arrays([batch.column("ord").take(rows), batch.column("sub").take(rows), pa.array(found.h1.view(np.int64)), pa.array(found.h2.view(np.int32)), pa.array(found.places().astype(np.int32))], ["ord", "sub", "h1", "h2", "place"])

    return run


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ord, sub): ord orders documents, (ord, sub) tells rows apart.

    ord is the document id. Rows without one and rows that share one take a number,
    stored with them so that it stays: rows without an id are documents of their
    own and come before the others.
    """
    number = F.monotonically_increasing_id()
    texts = docs.select("doc_id", "text")
    plain = texts.filter("doc_id IS NOT NULL").select("doc_id", "text", F.col("doc_id").cast("long").alias("ord"), F.lit(0).cast("long").alias("sub"))
    none = materialize(texts.filter("doc_id IS NULL").select("doc_id", "text", (F.lit(-(1 << 63)) + number).alias("ord"), F.lit(0).cast("long").alias("sub")), "line-no-id")
    shared = materialize(plain.groupBy("ord").count().filter("count > 1").select(F.col("ord").alias("s_ord")), "line-shared-ids")
    if not shared.isEmpty():
        marked = plain.join(shared, F.col("ord") == F.col("s_ord"), "left").withColumn("sub", F.when(F.col("s_ord").isNull(), F.lit(0).cast("long")).otherwise(number + 1)).drop("s_ord")
        plain = materialize(marked, "line-shared")
    return plain.unionByName(none)


def later_windows(rows: DataFrame, width: int = WIDTH, running: bool = True) -> DataFrame:
    """(ord, sub, places): of each text of ordered rows, the windows that stand earlier in the corpus."""
    keyed = rows.select("ord", "sub", F.col("text").cast("binary").alias("text"))
    each = keyed.mapInArrow(_hash(width, running), WINDOWS)
    first = each.filter("place >= 0").groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "line-repeats")
    met = each.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    again = met.filter("ord > first OR place < 0").select("ord", "sub", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    return again.groupBy(F.col("ord").alias("l_ord"), F.col("sub").alias("l_sub")).agg(F.collect_list("place").alias("places"))  # places of one text at most


def cut(text: bytes, places: list[int], width: int = WIDTH, running: bool = True) -> tuple[bytes, int, int]:
    """(the text without the words that the windows at places cover, lines gone whole, words gone).

    A line that is gone whole takes its break along; of another the words go, and
    the white space after them on the line.
    """
    import pyarrow as pa

    words = words_in(pa.array([text], pa.binary()))
    found = Windows(words, width, running)
    n = len(words.hash)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found.first[places], 1)
    np.add.at(change, found.stop[places], -1)
    gone = np.cumsum(change[:-1]) > 0
    kept, at, whole = [], 0, 0
    for a, b in zip(found.lines.tolist(), np.append(found.lines[1:], n).tolist()):
        inside = gone[a:b]
        if not inside.any():
            continue
        if inside.all():
            whole += 1
            start, stop = text.rfind(b"\n", 0, words.start[a]) + 1, text.find(b"\n", words.stop[b - 1]) + 1 or len(text)
            kept.append(text[at:start])
            at = stop
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8))).reshape(-1, 2) + a
        for i, j in turns.tolist():
            kept.append(text[at : words.start[i]])
            at = int(words.start[j]) if j < b else int(words.stop[j - 1])
    return b"".join(kept) + text[at:], whole, int(gone.sum())


def dedup(docs: DataFrame, width: int = WIDTH, running: bool = True) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_words_removed) of every document, later repeats of windows removed.

    n_lines counts lines with a word, n_removed those gone whole. With running
    False only written lines make windows. Ids are whole numbers and order the
    documents; rows of one id count as one document, in which each text looks for
    repeats by itself; rows without an id are a document each, before the others.
    A null text stays null and an empty one empty; an empty table gives an empty
    result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = ordered(docs)
    joined = rows.join(later_windows(rows, width, running), (F.col("ord") == F.col("l_ord")) & (F.col("sub") == F.col("l_sub")), "left")
    ready = joined.select("doc_id", F.col("text").cast("binary").alias("text"), "places")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                rows = slice(first, last)
                nulls = batch.column("text")[rows].is_null().to_pylist()
                found = [cut(t, p, width, running) if p else (t, 0, 0) for t, p in zip(texts, batch.column("places")[rows].to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[rows],
                    "text": pa.array([None if n else t for n, (t, _, _) in zip(nulls, found)], pa.binary()).view(pa.string()),
                    "n_lines": pa.array([sum(map(bool, map(bytes.strip, t.split(b"\n")))) for t in texts], pa.int64()),
                    "n_removed": pa.array([n for _, n, _ in found], pa.int64()),
                    "n_words_removed": pa.array([n for _, _, n in found], pa.int64()),
                })

    return ready.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_removed long, n_words_removed long")
