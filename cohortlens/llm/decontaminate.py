"""Benchmark passages in documents: SimHash over item-sized windows, multi-index blocks, exact check.

Words are lower-cased runs of non-space.  For an item of n words the window size is the largest of
a geometric row of sizes that leaves ``stride`` positions within the item, and every window of that
size inside the item has a fingerprint.  A document's windows start at every ``stride``-th word, so
one of them lies at a fingerprinted place of any copied item.  A window is a candidate when its
fingerprint is within ``radius`` bits: with ``radius`` + 1 bit blocks at least one is equal, and the
table of each block gives all items to compare.  Edits spread over a long window can move more bits.
Therefore runs of ``anchor_size`` words of every item are looked up by an equal hash as well: they are so
short that a place with (unweighted) similarity 0.8 or more always keeps one whole, at any start.  For a candidate, the document's words at the item's
place are compared with the item by weighted Jaccard similarity over five-word shingles; a shingle
weighs less the more items share it.  Items shorter than five words are compared as one shingle.

Items are sent to the executors in slices of at most ``ITEM_BYTES`` of text; a larger benchmark is
looked for in one scan for each slice.  Documents are scanned in place and whole: no shuffle, no
window leaves its task.

Defined cases: null or empty texts and items have no windows and never match; repeated items match
each under its own id; null ids of documents and items are left out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

ITEM_BYTES = 4 << 20
STRIDE = 4
SHINGLE = 5
WORDS_AT_ONCE = 1 << 17


def size_row(n: int, step: int) -> int:
    """The largest of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... times ``step`` that is at most ``n``."""
    n //= step
    power = 1 << (max(n, 1).bit_length() - 1)
    return step * (power + power // 2 if power >= 2 and n >= power + power // 2 else power)


def anchor_size(n: int, stride: int) -> int:
    """Words of an anchor of an item of ``n`` words, 0 where the windows themselves need no edit to be near.

    With similarity 0.8 at most (n - 4) / 9 shingles are lost.  An edit inside costs four or more, so
    some unedited run has ``anchor_size`` + ``stride`` - 1 words.
    """
    if n < 13:
        return 0
    lost = (n - 4) // 9
    run = n - lost if lost < 4 else (n - lost) // (lost // 4 + 1)
    return max(0, min(12, run - stride + 1))


def _shingle_set(words: np.ndarray) -> np.ndarray:
    k = min(SHINGLE, len(words))
    sums = common.prefix_sums(words)
    begins = np.arange(len(words) - k + 1)
    return common.span_hash(sums, begins, begins + k)


class Items:
    """Fingerprints of item windows by size, block tables and weighted shingles of one slice of items."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, weights: dict[int, float], stride: int):
        self.radius, self.stride = radius, stride
        column = pa.array([t for _, t in rows], pa.large_string())
        self.ids, self.words = [i for i, _ in rows], []
        for _, _, data, offsets in common.text_pieces(column):
            data = common.LOWER[data]
            starts, ends, first = common.word_spans(data, offsets)
            hashes = common.word_hashes(data, starts, ends)
            self.words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.weights = weights
        self.shingles = [self.weighed(w) for w in self.words]
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        by_size: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, words in enumerate(self.words):
            if len(words):
                step = stride if len(words) >= 2 * stride else 1
                size = size_row(len(words) - step + 1, step)
                for at in range(len(words) - size + 1):
                    bits = common.bit_sums(words[at:at + size], np.array([0, size]))
                    by_size.setdefault((size, step), []).append((int(common.majority_bits(bits, np.array([size]))[0]), k, at))
            if size := anchor_size(len(words), stride):
                begins = np.arange(len(words) - size + 1)
                hashes = common.span_hash(common.prefix_sums(words), begins, begins + size).tolist()
                anchors.setdefault(size, []).extend((h, k, at) for at, h in enumerate(hashes))
        self.anchors = {}
        for size, found in anchors.items():
            found.sort()
            self.anchors[size] = np.array([h for h, _, _ in found], np.uint64), np.array([k for _, k, _ in found]), np.array([a for _, _, a in found])
        self.tables = {key: self.filed(found) for key, found in by_size.items()}
        self.longest = max([1, *(size for size, _ in self.tables), *self.anchors])

    def weighed(self, words: np.ndarray) -> dict[int, float]:
        out: dict[int, float] = {}
        for h in _shingle_set(words).tolist() if len(words) else ():
            out[h] = out.get(h, 0.0) + self.weights.get(h, 1.0)
        return out

    def filed(self, found: list[tuple[int, int, int]]):
        fps = np.array([f for f, _, _ in found], np.uint64)
        ends = [round(64 * i / (self.radius + 1)) for i in range(self.radius + 2)]
        blocks = []
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            key = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << (high - low)) + 1, dtype=np.uint64))
            blocks.append((np.uint64(low), np.uint64((1 << (high - low)) - 1), order, first))
        return fps, np.array([k for _, k, _ in found]), np.array([a for _, _, a in found]), blocks

    def candidates(self, size: tuple[int, int], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) pairs within the radius."""
        fps, _, _, blocks = self.tables[size]
        hits, entries = [], []
        for low, mask, order, first in blocks:
            key = ((windows >> low) & mask).astype(np.int64)
            begin, count = first[key], first[key + 1] - first[key]
            step = 0
            alive = np.flatnonzero(count > 0)
            while len(alive):
                entry = order[begin[alive] + step]
                near = np.bitwise_count(windows[alive] ^ fps[entry]) <= self.radius
                hits.append(alive[near])
                entries.append(entry[near])
                step += 1
                alive = alive[count[alive] > step]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(hits) * len(fps) + np.concatenate(entries))
        return pair // len(fps), pair % len(fps)

    def anchored(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, entry) pairs of equal hashes."""
        known = self.anchors[size][0]
        begin = np.searchsorted(known, hashes, "left")
        count = np.searchsorted(known, hashes, "right") - begin
        hit = np.arange(len(hashes)).repeat(count)
        return hit, np.arange(count.sum()) - (np.cumsum(count) - count).repeat(count) + begin.repeat(count)

    def similarity(self, item: int, words: np.ndarray) -> float:
        mine, theirs = self.weighed(words), self.shingles[item]
        both = sum(min(w, theirs[h]) for h, w in mine.items() if h in theirs)
        whole = sum(mine.values()) + sum(theirs.values()) - both
        return both / whole if whole else 0.0


def _running_votes(words: np.ndarray, groups: np.ndarray, dtype) -> np.ndarray:
    """Set bits per position among the words before each group; differences of counts are right modulo 2^16."""
    sums = np.zeros((len(groups) + 1, 64), dtype)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    np.cumsum(bits if len(groups) == len(words) else np.add.reduceat(bits, groups, axis=0, dtype=np.uint8), axis=0, dtype=dtype, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, first: np.ndarray, count: int, size: int) -> np.ndarray:
    """Majority bits of the ``size`` words in ``count`` groups from each ``first`` one."""
    votes = sums[first + count] - sums[first]
    return np.packbits(votes > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def _scan(items_of, min_similarity: float, text_place: int, only_clean: bool):
    """Arrow function over rows with an id first: the places found, or (``only_clean``) the rows without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of()
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            tried: set[tuple[int, int, int]] = set()

            def judge(words, text, first, row, windows, owners, offsets, found=found, tried=tried):
                """Compare the places that put each window at its offset in its item."""
                for w, k, offset in zip(windows.tolist(), owners.tolist(), offsets.tolist(), strict=True):
                    doc = int(text[w])
                    if (row + doc, k, w - offset) in tried:
                        continue
                    tried.add((row + doc, k, w - offset))
                    begin = max(w - offset, int(first[doc]))
                    stop = min(w - offset + len(items.words[k]), int(first[doc + 1]))
                    key, spot = (row + doc, items.ids[k]), begin - int(first[doc])
                    best = found.get(key)
                    if best and best[0] == 1.0 and best[1] <= spot:
                        continue
                    score = items.similarity(k, words[begin:stop])
                    if score >= min_similarity - 1e-9 and (not best or (-score, spot) < (-best[0], best[1])):
                        found[key] = (score, spot, stop - begin)

            for row, _, data, offsets in common.text_pieces(batch.column(text_place)):
                data = common.LOWER[data]
                starts, ends, first = common.word_spans(data, offsets)
                if not len(starts):
                    continue
                words = common.word_hashes(data, starts, ends)
                n_words = np.diff(first)
                place = np.arange(len(words)) - first[:-1].repeat(n_words)
                left = first[1:].repeat(n_words) - np.arange(len(words))
                text = np.arange(len(n_words)).repeat(n_words)
                for low in range(0, len(words), WORDS_AT_ONCE):
                    high = min(low + WORDS_AT_ONCE, len(words))
                    part, sums = words[low:high + items.longest], {}
                    spot_of = place[low:high + items.longest]
                    for (size, step), (_, owner, offset, _) in items.tables.items():
                        if step not in sums:  # a group is ``step`` words from a place that a window may start at
                            groups = np.flatnonzero(spot_of % step == 0)
                            groups = groups if len(groups) and groups[0] == 0 else np.concatenate([[0], groups])
                            sums[step] = groups, _running_votes(part, groups, np.uint16 if items.longest < 1 << 15 else np.int32)
                        groups, votes = sums[step]
                        begins = np.flatnonzero((groups < high - low) & (spot_of[groups] % step == 0) & (left[low + groups] >= size))
                        windows = low + groups[begins]
                        hit, entry = items.candidates((size, step), _fingerprints(votes, begins, size // step, size))
                        judge(words, text, first, row, windows[hit], owner[entry], offset[entry])
                    hashed = common.prefix_sums(part) if items.anchors else None
                    for size, (_, owner, offset) in items.anchors.items():
                        begins = np.flatnonzero((spot_of[:high - low] % items.stride == 0) & (left[low:high] >= size))
                        hit, entry = items.anchored(size, common.span_hash(hashed, begins, begins + size))
                        judge(words, text, first, row, low + begins[hit], owner[entry], offset[entry])
            if only_clean:
                clean = np.ones(batch.num_rows, bool)
                clean[[k[0] for k in found]] = False
                yield batch.filter(pa.array(clean))
            elif found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k[0] for k in found])), pa.array([k[1] for k in found], pa.int64()),
                     pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.int64()),
                     pa.array([v[2] for v in found.values()], pa.int64())],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"])
    return run


def item_weights(items: DataFrame, mine: DataFrame) -> dict[int, float]:
    """Weight of those shingles of ``mine`` that several items hold: 1 / (1 + ln(items)); all others weigh 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.text_pieces(batch.column(0)):
                data = common.LOWER[data]
                starts, ends, first = common.word_spans(data, offsets)
                words = common.word_hashes(data, starts, ends)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingle_set(words[a:b])).view(np.int64))], ["h"])

    counted = common.arrow(items.select("text"), run, "h long").groupBy("h").count().where("count > 1")
    wanted = common.arrow(mine.select("text"), run, "h long").distinct()
    return {(h & ((1 << 64) - 1)): 1 / (1 + math.log(n)) for h, n in counted.join(wanted, "h").collect()}


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 7, min_similarity: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", stride: int = STRIDE,
                 item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best place of each item in each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items_of in _slices(benchmark, item_id_col, item_text_col, radius, stride, item_bytes):
        found = common.arrow(texts, _scan(items_of, min_similarity, 1, False),
                             "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _slices(benchmark: DataFrame, item_id_col: str, item_text_col: str, radius: int, stride: int, item_bytes: int) -> Iterator:
    """For each slice of the items, a function that gives them to a task."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(
        "item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // item_bytes))
    for part in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part)
        sent = benchmark.sparkSession.sparkContext.broadcast(([tuple(r) for r in mine.collect()], item_weights(items, mine)))

        def items_of(sent=sent):
            rows, weights = sent.value
            return Items(rows, radius, weights, stride)

        yield items_of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 7, min_similarity: float = 0.8, text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", stride: int = STRIDE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows that hold no benchmark item, each judged by itself."""
    out = docs
    for items_of in _slices(benchmark, item_id_col, item_text_col, radius, stride, item_bytes):
        out = common.arrow(out, _scan(items_of, min_similarity, docs.columns.index(text_col), True), docs.schema)
    return out
