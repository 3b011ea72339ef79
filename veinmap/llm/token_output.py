"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped.

A dataset is a folder. Each part has part-NNNNN.tokens, the ids of its documents
one after another, and part-NNNNN.index: four 64-bit words (magic, bytes per id,
documents, ids), then documents + 1 offsets counted from the part's first id,
then the 64-bit document ids and a byte per document that marks a null id.
Parts follow one another in ascending document order, so that a part's base is
the sum of the ids in the parts before it.

Encoding is word by word: the tokenizers meant here drop white space and mark the
ends of words, never merging across them, so a text's ids are those of its words
in a row. Workers
keep the ids of words already seen, in bounded memory; new words go through the
tokenizers library in batches. Special tokens' strings in a text get their ids, as
in the library's plain call; they are looked for before lower-casing, so a chunk
that seems to hold one is encoded with its case.
"""

from __future__ import annotations

import itertools
import os
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array_chunks, scratch, small_batches
from .files import mapped, new_file

MAGIC = int.from_bytes(b"VMTOKIX1", "little")
CACHE_WORDS = 400_000
CACHE_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
STOPS = (b".", b",")


class WordEncoder:
    """Ids of texts by way of a bounded word cache."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends_word[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("AZ") == "az"  # then case need not reach the cache
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_words, self.cache_bytes = cache_words, cache_bytes
        self._reset([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def _reset(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        self.slots = {w: k for k, w in enumerate(words)}
        self.key_bytes = sum(map(len, words))
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts
        self.uses = np.zeros(len(words), np.int64)

    def _add(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words))))
        self.key_bytes += sum(map(len, words))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _encode_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._pending.append((np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts))

    def _encode_letters(self, words: list[str]) -> None:
        """Words of letters only are one piece each, whose last id is one that ends a word: many go as one text."""
        for at in range(0, len(words), 1000):
            block = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(block):
                self._pending.append((ids, np.diff(ends, prepend=-1)))
            else:
                self._encode_each(block)

    def _learn(self, words: list[bytes]) -> None:
        """Words that end in stops after a letter or digit are put together from two pieces; the rest is encoded."""
        whole, joined = [], []
        for w in words:
            if not w.endswith(STOPS):
                whole.append(w)
                continue
            stem = w.rstrip(b".,")
            if stem and (stem[-1] < 128 and stem[-1:].isalnum() or stem.decode("utf-8", "replace")[-1].isalpha()):
                joined.append((w, stem, w[len(stem) :]))
            else:
                whole.append(w)
        new = [w for w in dict.fromkeys(itertools.chain(whole, *((s, t) for _, s, t in joined))) if w not in self.slots]
        pairs = list(zip(new, b"\n".join(new).decode("utf-8", "replace").split("\n")))
        flags = [t.isalpha() and (t.isascii() or t.lower().isalpha()) for _, t in pairs]
        letters, others = list(itertools.compress(pairs, flags)), [x for x, f in zip(pairs, flags) if not f]
        self._pending: list[tuple[np.ndarray, np.ndarray]] = []
        self._encode_letters([t for _, t in letters])
        self._encode_each([t for _, t in others])
        if self._pending:
            self._add([w for w, _ in letters + others], np.concatenate([x for x, _ in self._pending]), np.concatenate([n for _, n in self._pending]))
        joined = [x for x in joined if x[0] not in self.slots]
        if joined:
            pieces = np.array([[self.slots[s], self.slots[t]] for _, s, t in joined], np.int64)
            self._add([w for w, _, _ in joined], self._gather(pieces.ravel()), self.counts[pieces].sum(axis=1))

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        n = self.counts[codes]
        return self.flat[np.repeat(self.starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _shrink(self) -> None:
        """Keep the words used most, half of what fits."""
        words = list(self.slots)
        order = np.argsort(-self.uses, kind="stable")[: self.cache_words // 2]
        order = np.sort(order[self.uses[order] > 1])
        sizes = np.fromiter((len(words[k]) for k in order), np.int64, len(order))
        order = order[np.cumsum(sizes) <= self.cache_bytes // 2]
        self._reset([words[k] for k in order], self._gather(order), self.counts[order])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text). texts: a binary array, nulls count as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, b"").view(pa.string())
        if self.lower and not any(pc.any(pc.match_substring(texts, x, ignore_case=True)).as_py() for x in self.special):
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.view(pa.binary()).to_pylist()
        slots = np.array(list(map(self.slots.get, words, itertools.repeat(-1))), np.int64)
        unknown = np.flatnonzero(slots < 0).tolist()
        if unknown:
            self._learn([words[k] for k in unknown])
            slots[unknown] = np.fromiter((self.slots[words[k]] for k in unknown), np.int64, len(unknown))
        at = flat.indices.to_numpy()
        self.uses[slots] += np.bincount(at, minlength=len(words))
        codes = slots[at]
        upto = np.concatenate([[0], np.cumsum(self.counts[codes])])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        lengths = np.diff(upto[bounds])
        ids = self._gather(codes)
        if len(self.slots) > self.cache_words or self.key_bytes > self.cache_bytes:
            self._shrink()
        return ids, lengths


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class TokenFiles:
    """A written dataset: the folder and, per part, (part, documents, ids, base)."""

    folder: str
    dtype: str
    parts: list[tuple[int, int, int, int]]

    def stem(self, part: int) -> str:
        return f"{self.folder}/part-{part:05d}"


def _writer(folder: str, tokenizer: str, dtype: str, end_id: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        stem = f"{folder}/part-{part:05d}"
        lengths, ids, nulls, any_rows = [], [], [], False
        with new_file(f"{stem}.tokens") as out:
            for batch in batches:
                any_rows |= batch.num_rows > 0
                for first, last, texts in array_chunks(batch, "text", CHUNK_BYTES):
                    found, n = encoder.encode(texts)
                    whole = np.full(len(found) + len(n), end_id, dtype)
                    ends = np.cumsum(n + 1) - 1
                    keep = np.ones(len(whole), bool)
                    keep[ends] = False
                    whole[keep] = found
                    out.write(whole.tobytes())
                    lengths.append(n + 1)
                    column = batch.column("doc_id").slice(first, last - first)
                    nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                    ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if not any_rows:
            return
        n = np.concatenate(lengths)
        with new_file(f"{stem}.index") as out:
            out.write(np.array([MAGIC, np.dtype(dtype).itemsize, len(n), n.sum()], "<u8").tobytes())
            out.write(np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes())
            out.write(np.concatenate(ids).tobytes())
            out.write(np.concatenate(nulls).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(n)], pa.int64()), "ids": pa.array([int(n.sum())], pa.int64())})

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, vocabulary: int = 49_408) -> TokenFiles:
    """Write docs (doc_id, text) in ascending doc_id order, null ids first; equal ids in order of their texts' hashes.

    A null or empty text is the end id alone. Ids take 16 bits where the
    vocabulary allows, else 32. Rows of one hot doc_id may spread over parts. A long
    text is encoded whole, by itself; an empty table writes no parts. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = dealt.mapInArrow(_writer(folder, tokenizer, dtype, end_id), "part int, docs long, ids long").collect()  # one row per file
    parts, base = [], 0
    for part, n_docs, n_ids in sorted(tuple(r) for r in written):
        parts.append((part, n_docs, n_ids, base))
        base += n_ids
    return TokenFiles(folder, dtype, parts)


def _reader(folder: str, dtype: str, block: int = 20_000):
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                stem = f"{folder}/part-{part:05d}"
                magic, width, n_docs, n_ids = (int(x) for x in mapped(f"{stem}.index", "<u8", 0, 4))
                if magic != MAGIC or width != np.dtype(dtype).itemsize:
                    raise ValueError(f"{stem}.index is not an index of {dtype} ids")
                offsets = mapped(f"{stem}.index", "<u8", 32, n_docs + 1).astype(np.int64)
                doc_ids = mapped(f"{stem}.index", "<i8", 32 + 8 * (n_docs + 1), n_docs)
                nulls = mapped(f"{stem}.index", "u1", 32 + 8 * (n_docs + 1) + 8 * n_docs, n_docs).astype(bool)
                tokens = mapped(f"{stem}.tokens", dtype)
                if len(tokens) != n_ids or offsets[-1] != n_ids:
                    raise ValueError(f"{stem}.tokens has {len(tokens)} ids; its index says {n_ids}")
                for at in range(0, n_docs, block):
                    upto = min(n_docs, at + block)
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[at:upto].tolist(), offsets[at + 1 : upto + 1].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.array(doc_ids[at:upto]), pa.int64(), mask=np.array(nulls[at:upto])),
                        "start": pa.array(base + offsets[at:upto], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[at : upto + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return read


def read_index(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.parts:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(p, b) for p, _, _, b in files.parts], "part int, base long").repartition(len(files.parts))
    return rows.mapInArrow(_reader(files.folder, files.dtype), schema)


def tokens_of(files: TokenFiles, start: int, n_tokens: int) -> np.ndarray:
    """The ids of one document, given its start in the whole dataset."""
    for part, _, n, base in files.parts:
        if base <= start < base + n:
            return np.array(mapped(files.stem(part) + ".tokens", files.dtype)[start - base : start - base + n_tokens])
    raise IndexError(start)
