"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, verify the Hamming distance.

A fingerprint has 64 bits.  Two fingerprints with at most ``radius`` differing bits agree on at
least ``blocks - radius`` of ``blocks`` bit blocks, so each is filed under every choice of that
many blocks and meets all its partners.  Equal fingerprints are joined first; only distinct ones
are filed.  The number of blocks follows the counted fingerprints and changes the work, never the
links.  A bucket of up to ``BUCKET`` fingerprints is compared within one task; a larger one is
dealt out by pairs of chunks.  From a comparison only a spanning forest leaves, at most one link
for each fingerprint, never all pairs.

Defined cases: a null or empty text has no words and the fingerprint zero, linked like any other; null ids
take part as rows but name no component, so they are dropped; repeated ids count as one document
each row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common
from cohortlens.llm.graph import components

#: Fingerprints compared within one task; larger buckets are split into pairs of chunks this large.
BUCKET = 1024


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the space-joined k-word shingles of each text, repeats included.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    Returns the hashes and the first hash of every text.
    """
    data = common.LOWER[data]
    starts, ends, first = common.word_spans(data, offsets)
    n_words = np.diff(first)
    space = common.SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.cumsum(keep) - 1
    joined = np.where(space, np.uint8(0x20), data)[keep].tobytes()
    starts, ends = at[starts], at[ends - 1] + 1
    left = first[1:].repeat(n_words) - np.arange(len(starts))
    begins = np.flatnonzero((left >= k) | (np.arange(len(starts)) == first[:-1].repeat(n_words)))
    stops = begins + np.minimum(k, left[begins]) - 1
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hashed(joined[a:b], 42) for a, b in zip(starts[begins].tolist(), ends[stops].tolist(), strict=True)),
        np.uint64, len(begins))
    return hashes, np.searchsorted(begins, first)


def word_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the lower-cased k-word shingles of each text."""
    data = common.LOWER[data]
    starts, ends, first = common.word_spans(data, offsets)
    sums = common.prefix_sums(common.word_hashes(data, starts, ends))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        begins = np.arange(a, max(b - k + 1, a + (b > a)))
        out.append(np.unique(common.span_hash(sums, begins, np.minimum(begins + k, b))))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for a, b, data, offsets in common.text_pieces(texts):
                hashes, first = shingle_hashes(data, offsets, shingle)
                fps = common.majority_bits(common.bit_sums(hashes, first), np.diff(first))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(fps.view(np.int64))], ["id", "fp"])

    return common.arrow(_texts(docs, id_col, text_col), run, "id long, fp long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def block_choice(n: int, radius: int) -> int:
    """Blocks so that an evenly filled bucket holds 48 fingerprints at most (the fewest buckets that do)."""
    for blocks in range(radius + 1, 33):
        if n / 2.0 ** (64 * (blocks - radius) / blocks) <= 48:
            return blocks
    return 32


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks (signed) of every choice of ``blocks - radius`` blocks."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(blocks)]
    masks = (sum(c) for c in itertools.combinations(parts, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each of ``n`` nodes that joins what the given links join."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        left, right = left[label[left] != label[right]], right[label[left] != label[right]]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _close_in_runs(key: np.ndarray, fp: np.ndarray, chunk: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of close fingerprints within runs of equal ``key``; a pair of two chunks only joins across them."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step, alive = 1, np.arange(len(key) - 1)
    while len(alive := alive[alive + step < len(key)]) and len(alive := alive[key[alive] == key[alive + step]]):
        near = np.bitwise_count(fp[alive] ^ fp[alive + step]) <= radius
        if near.any():
            lefts.append(alive[near])
            rights.append(alive[near] + step)
            if sum(map(len, lefts)) > 1 << 20:
                a, b = forest(np.concatenate(lefts), np.concatenate(rights), len(key))
                lefts, rights = [a], [b]
        step += 1
    return forest(np.concatenate(lefts), np.concatenate(rights), len(key))


def _compare(radius: int):
    """Arrow function: links between close fingerprints of each run of (table, key, pair)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> pa.RecordBatch:
            table, key, pair, fp, rep = (t.column(i).to_numpy() for i in range(5))
            new = np.ones(len(key), bool)
            new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            a, b = _close_in_runs(np.cumsum(new), fp.view(np.uint64), pair, radius)
            return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(3))
            t = pa.Table.from_batches(held)
            whole = np.ones(t.num_rows, bool)
            for i in range(3):
                whole &= t.column(i).to_numpy() == last[i]
            cut = t.num_rows - int(whole.sum())
            if cut >= 1:
                yield links(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))
    return run


def close_links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all ids ``rep`` of distinct fingerprints ``fp`` within ``radius`` bits (a spanning forest for each bucket)."""
    blocks = block_choice(fps.count(), radius)
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, radius)])
    filed = fps.select("fp", "rep", F.posexplode(masks).alias("tab", "mask")).select(
        "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    in_bucket = Window.partitionBy("tab", "key")
    numbered = filed.select("*", F.count("*").over(in_bucket).alias("n"), F.row_number().over(in_bucket.orderBy("fp")).alias("r"))
    small = numbered.where(F.col("n").between(2, bucket)).select("tab", "key", F.lit(0).cast("long").alias("pair"), "fp", "rep")
    chunks = F.ceil(F.col("n") / bucket).cast("long")
    mine = F.floor((F.col("r") - 1) / bucket).cast("long")
    large = numbered.where(F.col("n") > bucket).select(
        "tab", "key", "fp", "rep", chunks.alias("chunks"), mine.alias("mine"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"),
    ).select("tab", "key", (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")).alias("pair"), "fp", "rep")
    large = large.repartition("tab", "key", "pair").sortWithinPartitions("tab", "key", "pair")
    run = _compare(radius)
    return common.arrow(small, run, "a long, b long").unionByName(common.arrow(large, run, "a long, b long"))


def linked_fingerprints(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of the distinct fingerprints of ``marked`` (id, fp): the smallest id reached over links of ``radius`` bits or fewer."""
    fps = common.materialised(marked.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    found = components(close_links(fps, radius))
    return fps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component, fingerprint): documents whose fingerprints link at ``radius`` or fewer differing bits.

    ``component`` is the smallest id that can be reached over links, itself included.
    """
    marked = common.materialised(fingerprints(docs, shingle, id_col, text_col), "simhash")
    return marked.join(linked_fingerprints(marked, radius), "fp").select(
        "id", "fp", "component", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


# --- near copies by shared shingles, candidates by SimHash, the rest by MinHash ---------------------

#: Documents whose shingles meet in one task; a larger group is dealt out by pairs of chunks.
CHUNK = 128
#: Shingles that are compared at once.
COLUMNS = 4096
#: Words of the shingles and bits of the links of the fingerprints that near copies are first sought by.
FP_SHINGLE, FP_RADIUS = 3, 3
#: Bands of a text and minima in a band.  Two texts with similarity s agree on no band with probability
#: (1 - s ** ROWS) ** BANDS, whatever was edited and however long they are: 3e-7 at 0.8, 2e-8 at 0.82.
BANDS, ROWS = 64, 7

_g = np.random.Generator(np.random.PCG64(43))
_FLIPS = _g.integers(0, 1 << 32, (BANDS, ROWS), dtype=np.uint32)
_FACTORS = _g.integers(0, 1 << 31, (BANDS, ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each (non-empty) set of hashes; a key stands for the ``ROWS`` minima of its band."""
    first = np.cumsum([0, *map(len, sets)])[:-1]
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for flip, factor in zip(_FLIPS[band], _FACTORS[band], strict=True):
            least = np.minimum.reduceat((low ^ flip) * factor, first)
            key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def banded(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, c1, c2, keys): the SimHash, two hashes that name the set of shingles, and its band keys (none for a text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for a, b, data, offsets in common.text_pieces(texts):
                hashes, first = shingle_hashes(data, offsets, FP_SHINGLE)
                fps = common.majority_bits(common.bit_sums(hashes, first), np.diff(first))
                sets = word_shingles(data, offsets, shingle)
                some = [k for k, s in enumerate(sets) if len(s)]
                names = np.zeros((2, b - a), np.uint64)
                for k in some:
                    mixed = common.mix(sets[k])
                    names[:, k] = np.bitwise_xor.reduce(mixed), mixed.sum(dtype=np.uint64)
                ends = np.zeros(b - a + 1, np.int32)
                ends[np.array(some, np.int64) + 1] = BANDS
                keys = band_keys([sets[k] for k in some]).ravel() if some else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(fps.view(np.int64)), *[pa.array(n.view(np.int64)) for n in names],
                     pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.view(np.int64)))], ["id", "fp", "c1", "c2", "keys"])

    return common.arrow(_texts(docs, id_col, text_col), run, "id long, fp long, c1 long, c2 long, keys array<long>")


def _similar(min_similarity: float, shingle: int):
    """Arrow function: links between texts of one (group, pair) with Jaccard similarity over the threshold."""
    def compare(sets: list[np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
        owner = np.arange(len(sets)).repeat([len(s) for s in sets])
        _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, value = owner[times[value] > 1], value[times[value] > 1]
        order = np.argsort(value, kind="stable")
        owner, column = owner[order], np.unique(value[order], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24: exact
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            holds = np.zeros((len(sets), COLUMNS), np.float32)
            holds[owner[part], column[part] - low] = 1
            both += holds @ holds.T
        size = np.array([len(s) for s in sets], np.int64)
        union = size[:, None] + size[None, :] - both
        a, b = np.nonzero(np.triu((both >= min_similarity * union - 1e-9) & (union > 0), 1))
        a, b = forest(a, b, len(sets))
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            own = batch.column(2).to_pylist()
            for first, last, data, offsets in common.text_pieces(batch.column(3)):
                for i, s in zip(range(first, last), word_shingles(data, offsets, shingle), strict=True):
                    if keys[i] != group:
                        if len(ids) > 1:
                            yield compare(sets, np.array(ids, np.int64))
                        group, ids, sets = keys[i], [], []
                    ids.append(own[i])
                    sets.append(s)
        if len(ids) > 1:
            yield compare(sets, np.array(ids, np.int64))
    return run


def _verified(docs: DataFrame, grouped: DataFrame, min_similarity: float, shingle: int, id_col: str, text_col: str, label: str) -> DataFrame:
    """(a, b): links between texts of a group of ``grouped`` (grp, rep) with Jaccard similarity over the threshold."""
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    members = common.materialised(
        grouped.join(sizes, "grp").select("rep", "grp", "n", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CHUNK)).alias("mine")), label)
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(
        common.broadcast_within(members), "rep")
    paired = texts.select("grp", "rep", "text", chunks.alias("chunks"), "mine", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")).select(
        "grp", (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")).alias("pair"), "rep", "text")
    return common.arrow(paired.repartition("grp", "pair").sortWithinPartitions("grp", "pair"), _similar(min_similarity, shingle), "a long, b long")


def near_copies(docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): texts joined by exact Jaccard similarity of their ``shingle``-word shingles.

    Texts whose SimHashes link are compared exactly first.  A fingerprint does not see every edit, so texts of
    different groups by then that share a MinHash band are compared, too, whatever was edited; texts that are
    joined already meet no more.  Texts with the same shingles are one candidate.  A group of over ``CHUNK``
    candidates is dealt out by pairs of chunks.  Texts without words are copies of each other.
    """
    marked = common.materialised(banded(docs, shingle, id_col, text_col), "near")
    classes = common.materialised(marked.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "near-classes")
    seen = marked.groupBy("c1", "c2", "fp").agg(F.min("id").alias("id"))
    by_fp = seen.join(linked_fingerprints(seen, FP_RADIUS).withColumnRenamed("component", "grp"), "fp").join(classes.select("c1", "c2", "rep"), ["c1", "c2"])
    verified = common.materialised(
        _verified(docs, by_fp.select("grp", "rep").distinct(), min_similarity, shingle, id_col, text_col, "near-fingerprints"), "near-links")
    joined = components(verified).withColumnRenamed("node", "rep")
    filed = classes.select("rep", F.explode("keys").alias("key")).join(joined, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("own"))
    shared = common.materialised(filed.groupBy("key").agg(F.min("rep").alias("least"), F.min("own").alias("low"), F.max("own").alias("high"))
                                 .where("low < high").select("key", "least"), "near-bands")
    links = filed.join(shared, "key").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    grouped = components(links).select(F.col("component").alias("grp"), F.col("node").alias("rep"))
    rest = _verified(docs, grouped, min_similarity, shingle, id_col, text_col, "near-members")
    joined = components(verified.unionByName(rest)).withColumnRenamed("node", "rep")
    named = classes.select("c1", "c2", "rep").join(joined, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    return marked.select("id", "c1", "c2").join(named, ["c1", "c2"]).select("id", "component")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """Keep one document (the smallest id) of every group of ``near_copies``; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    found = near_copies(docs, **options)
    gone = found.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    return docs.join(common.broadcast_within(gone, limit=common.BROADCAST_BYTES), id_col, "left_anti")
