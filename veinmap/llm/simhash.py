"""SimHash near-duplicates: fingerprints linked by a self-join of binary tries.

A fingerprint's bit is set if it is set in over half of the XXH64 values of a
text's shingles. Two fingerprints link at max_bits or fewer differing bits.

The join works on distinct fingerprints. It deals them out by the pigeonhole
principle: of SEGMENTS > max_bits segments, two linked fingerprints agree in at
least SEGMENTS - max_bits, so for each choice of so many segments a trie with
those bits on top finds the pair under one root. More segments mean longer keys
and smaller groups; their number follows from the number of fingerprints, and
any number gives the same links.

Under a root, node pairs of the trie go down together. The trie is path-compressed:
a node's leaves agree up to the bit at which it splits, and a pair goes on at the
first bit at which either node splits. It stops when the bits in which the two
paths differ exceed the budget, and also where all leaves of both nodes are known
to be in one component, which spares most of a dense group. What a task
hands on is a spanning forest, at most one link less than it has fingerprints,
never all pairs. Groups above MAX_GROUP are cut into hash classes, and pairs of
classes become tasks of their own.

Components are joined by repeated min-label contraction (large star, small star)
over the forests' links, as DataFrames.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small_batches, text_chunks

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Leaves that a group may have before it is cut into blocks.
MAX_GROUP = 5_000
#: Rows that a task holds before it links the groups that it has whole.
HELD = 200_000
#: Node pairs that go down together; links that they find spare the blocks after them.
BLOCK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned 64-bit number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


def with_fingerprints(docs: DataFrame, column: str = "fp", width: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, column): fingerprints as signed 64-bit numbers; a null or empty text has zero. tie is the text's hash."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("tie").slice(first, last - first), pa.array(found)], ["doc_id", "tie", column])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, {column} long")


class Forest:
    """Union-find over positions in an array, with vectorised links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            ra, rb = roots[a], roots[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bits before the first one; 64 where there is none."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return 64 - np.bitwise_count(x).astype(np.int64)


class Trie:
    """Path-compressed binary tries over codes that are sorted and distinct within each root. A node has the leaves lo to hi and splits at a bit, 64 for a single leaf, into left and right."""

    def __init__(self, codes: np.ndarray, roots: np.ndarray):
        self.codes = codes
        lo, hi = roots[:-1].astype(np.int64), roots[1:].astype(np.int64)
        self.n_roots, made, parts = len(lo), len(lo), []
        while len(lo):
            split = _leading(codes[lo] ^ codes[hi - 1])
            inner = np.flatnonzero(split < 64)
            bit = np.uint64(1) << (63 - split[inner]).astype(np.uint64)
            below, above = lo[inner], hi[inner] - 1  # leaves with the bit unset and set; the split lies between
            while (open_ := above - below > 1).any():
                mid = (below + above) // 2
                one = (codes[mid] & bit) > 0
                above, below = np.where(open_ & one, mid, above), np.where(open_ & ~one, mid, below)
            left = np.full(len(lo), -1)
            left[inner] = made + 2 * np.arange(len(inner))
            parts.append((lo, hi, split, left))
            made += 2 * len(inner)
            lo, hi = np.stack([lo[inner], above], axis=1).ravel(), np.stack([above, hi[inner]], axis=1).ravel()
        self.lo, self.hi, self.split, self.left = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 4


def descend(codes: np.ndarray, roots: np.ndarray, max_bits: int, forest: Forest) -> tuple[int, int]:
    """Link codes that lie under one root and differ in max_bits bits or fewer, so that the forest's components are those of all such links.

    codes: unsigned, sorted and distinct within each root; roots: the bounds of
    the roots' runs. Returns how many node pairs went down and how many pairs of
    single leaves met.
    """
    trie = Trie(codes, roots)
    start = np.flatnonzero(trie.split[: trie.n_roots] < 64)
    stack, walked, met = [(start, start)], 0, 0
    label, linked = None, True
    while stack:
        a, b = stack.pop()
        if len(a) > BLOCK:
            stack += [(a[k : k + BLOCK], b[k : k + BLOCK]) for k in range(0, len(a), BLOCK)]
            continue
        if not len(a):
            continue
        if linked:
            label = forest.roots()
            change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            linked = False
        alo, blo = trie.lo[a], trie.lo[b]
        split = np.minimum(trie.split[a], trie.split[b])
        paths = codes[alo] ^ codes[blo]
        paths = np.where(split > 0, paths >> np.minimum(64 - split, 63).astype(np.uint64), 0).astype(np.uint64)
        known = (change[alo] == change[trie.hi[a] - 1]) & (change[blo] == change[trie.hi[b] - 1]) & (label[alo] == label[blo])
        go = (np.bitwise_count(paths) <= max_bits) & ~known
        leaves = go & (split == 64)
        if leaves.any():
            met += int(leaves.sum())
            forest.link(alo[leaves], blo[leaves])
            linked = True
        go &= ~leaves
        a, b, split = a[go], b[go], split[go]
        walked += len(a)
        own = a == b
        first, second = trie.left[a], trie.left[b]
        pairs = [(first[own], first[own] + 1), (first[own], first[own]), (first[own] + 1, first[own] + 1)]
        both = ~own & (trie.split[a] == split) & (trie.split[b] == split)
        pairs += [(first[both] + i, second[both] + j) for i, j in ((0, 1), (1, 0), (0, 0), (1, 1))]
        only = ~own & (trie.split[b] > split)
        pairs += [(first[only] + i, b[only]) for i in (0, 1)]
        only = ~own & (trie.split[a] > split)
        pairs += [(a[only], second[only] + i) for i in (0, 1)]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        single = (a == b) & (trie.split[a] == 64)
        stack.append((a[~single], b[~single]))
    return walked, met


def links_within(codes: np.ndarray, keys: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among codes of equal key: pairs (code, the least code of its tree)."""
    order = np.lexsort((codes, keys))
    codes, keys = codes[order], keys[order]
    fresh_ = np.concatenate([[True], (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])]) if len(codes) else np.zeros(0, bool)
    codes, keys = codes[fresh_], keys[fresh_]
    if not len(codes):
        return codes, codes
    bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    forest = Forest(len(codes))
    descend(codes, bounds, max_bits, forest)
    roots = forest.roots()
    child = roots != np.arange(len(codes))
    return codes[child], codes[roots[child]]


def segments(count: int, max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """Segments (shift, width) and how many form a key, so that keys outnumber fingerprints enough for small groups."""
    n = max_bits + 1
    while n < max_bits + 4 and count >> (64 * (n - max_bits) // n) > 4096:
        n += 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)], n - max_bits


def _key_masks(count: int, max_bits: int) -> list[int]:
    """Bit masks, one per choice of segments; two fingerprints within max_bits agree under one of them."""
    parts, chosen = segments(count, max_bits)
    return [sum(((1 << w) - 1) << a for a, w in some) for some in itertools.combinations(parts, chosen)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b) over distinct fingerprints fp: forests of links, b < a as unsigned numbers, whose components are those of all links.

    fps is read more than once and should be a stored table of distinct fingerprints.
    """
    count = fps.count()
    masks = _key_masks(count, max_bits)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("part", "key"))
    hot = dealt.groupBy("part", "key").count().filter(F.col("count") > max_group).select(F.col("part").alias("h_part"), F.col("key").alias("h_key"), F.ceil(F.col("count") / max_group).cast("int").alias("blocks"))
    hot = materialize(hot, "simhash-hot")
    if hot.isEmpty():
        tasks = dealt.select("fp", "part", "key", F.lit(0).alias("block"))
    else:
        # A block is a hash class of a hot group; rows go to every pair of blocks that theirs is in.
        marked = dealt.join(hot, (F.col("part") == F.col("h_part")) & (F.col("key") == F.col("h_key")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
        tasks = marked.withColumn("own", own).select("fp", "part", "key", F.explode(pairs).alias("block"))

    limit = HELD

    def run(batches):
        import pyarrow as pa

        def linked(fp, task):
            a, b = links_within(fp, task, max_bits)
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[at : at + 100_000].view(np.int64)), "b": pa.array(b[at : at + 100_000].view(np.int64))})

        fps_, tasks_, held = [], [], 0
        for batch in batches:
            fps_.append(batch.column("fp").to_numpy().view(np.uint64))
            tasks_.append(batch.column("task").to_numpy())
            held += batch.num_rows
            if held >= limit:  # rows come sorted by task: all groups but the last one are whole
                fp, task = np.concatenate(fps_), np.concatenate(tasks_)
                whole = int(np.searchsorted(task, task[-1]))
                yield from linked(fp[:whole], task[:whole])
                fps_, tasks_, held = [fp[whole:]], [task[whole:]], 0
        if fps_:
            yield from linked(np.concatenate(fps_), np.concatenate(tasks_))

    keyed = tasks.select("fp", F.xxhash64("part", "key", "block").alias("task"))
    return keyed.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in links (a, b): root is the least node of its component.

    Large star links each node's greater neighbours to its least neighbour, small
    star its smaller ones; hubs are pre-aggregated, joins may be split where skewed.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "cc-least")
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "cc-least")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        edges = materialize(small, "cc-small")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the document's own included.

    Null and empty texts have fingerprint zero and link like others;
    rows of equal doc_id keep a row each; a null doc_id is never a component id
    unless all of a component's are null; an empty table gives an empty result.
    """
    marked = materialize(with_fingerprints(docs, width=width), "simhash-fp")
    return marked.join(_classes(marked, max_bits), "fp").select("doc_id", "fp", "component_id")


def _classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) from a stored (doc_id, fp): root is a component's least fingerprint, component_id its least doc_id."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = materialize(components(near_links(distinct.select("fp"), max_bits)), "simhash-roots")
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    least = materialize(least, "simhash-least")
    return materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their component, those of its least doc_id, with all their columns.

    Of rows that repeat that doc_id one stays: the one with the least text hash.
    Components that share an id keep one row together; keep_each keeps one each.
    Null and empty texts are alike; an empty table gives an empty result.
    """
    marked = materialize(with_fingerprints(docs, width=width), "simhash-fp")
    chosen = marked.join(_classes(marked, max_bits), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept_id = fresh(docs, "_simhash_id")
    kept = docs.join(chosen.select(F.col("doc_id").alias(kept_id)), docs["doc_id"].eqNullSafe(F.col(kept_id)), "left_semi")
    if marked.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    from pyspark.sql import Window

    rank = fresh(docs, "_simhash_rank")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)


def keep_each(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """One row of docs for each component, with all its columns: the one with the least doc_id, then the least text hash.

    A component's row does not depend on what other components' ids are: texts
    that share a doc_id, or have none, each stand for their own. Null ids come
    last. Of rows equal in id and text any one stays. Null and empty texts are alike;
    an empty table gives an empty result.
    """
    marked = materialize(with_fingerprints(docs, width=width), "simhash-fp")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    least = marked.join(_classes(marked, max_bits), "fp").groupBy("root").agg(F.min(order).alias("least"))
    chosen = materialize(least.select(F.col("least.doc_id").alias("c_id"), F.col("least.tie").alias("c_tie")), "simhash-chosen")
    tie = fresh(docs, "_simhash_tie")
    tied = docs.withColumn(tie, F.xxhash64("text"))
    kept = tied.join(chosen, tied["doc_id"].eqNullSafe(F.col("c_id")) & (F.col(tie) == F.col("c_tie")), "left_semi")
    repeated = marked.groupBy("doc_id", "tie").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", tie])
    return kept.drop(tie)
