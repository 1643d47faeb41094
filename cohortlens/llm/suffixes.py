"""Suffix-array deduplication of byte strings by merging Burrows-Wheeler transforms.

Every byte that is covered by a ``window``-byte string which also starts earlier (in a document with a smaller
id, or earlier in the same one) goes.  ``repeats`` brings together the places that can hold such strings:
equal strings share a seed, so each block of seed groups is complete in itself.

Within a block the contexts are cut into shards.  A shard's suffixes are sorted (prefix doubling) and give its
Burrows-Wheeler transform and its last-to-first mapping.  The shards are then merged by refining their
interleave: a step reads the character before every suffix in the order so far and deals the suffixes stably
by it, which sorts them by one more character; the shards' own order is never sorted again.  A boundary
that first appears at step h marks a common prefix of h - 1 bytes.  Suffixes that are alone between two
boundaries are settled and leave.  After ``window`` steps what is still together is a repeated interval:
its suffixes share a prefix of at least ``window`` bytes; all but the earliest are reported.

Defined cases: a null or empty text has no bytes; a text shorter than the window stays whole; a null id
counts as the largest; rows with one id are judged as one document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm import common, repeats

BLOCK_BYTES = 2 << 20
SHARD_BYTES = 128 << 10


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings joined in ``text``: bytes plus 1, each string ended by 0.

    Seven bytes make the first rank, then known ranks are paired (prefix doubling).  Suffixes that are equal
    up to their end sort by place.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    size = np.diff(np.concatenate([[-1], ends]))
    left = ends.repeat(size) - np.arange(n)  # characters before the end
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.int64)
    rank = np.zeros(n, np.int64)
    for j in range(7):
        rank = rank * 512 + np.where(left >= j, padded[j:j + n], 0)
    order, span, longest = np.argsort(rank), 7, int(size.max())
    while True:
        new = np.ones(n, bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        if new.all():
            return order
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        if span >= longest:
            return np.argsort(dense * n + np.arange(n))
        after = np.zeros(n, np.int64)
        after[:n - span] = np.where(left[:n - span] >= span, dense[span:], 0)
        rank = dense * (n + 1) + after
        order = np.argsort(rank)
        span *= 2


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, Burrows-Wheeler transform, last-to-first mapping) of one shard."""
    order = suffix_order(text)
    before = text[order - 1]  # the first suffix is preceded by the last end
    to_first = np.empty(len(text), np.int64)
    to_first[np.argsort(before, kind="stable")] = np.arange(len(text))
    return order, before, to_first


def repeated_intervals(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interval, place in the joined shards) of all suffixes that share a prefix of ``depth`` bytes with another.

    A step moves a suffix one place back, so only those that start ``depth`` or more places into their string take part.
    """
    parts = [shard_transform(s) for s in shards]
    base = np.cumsum([0, *[len(s) for s in shards]])
    suffix = np.concatenate([p[0] + b for p, b in zip(parts, base, strict=False)])
    before = np.concatenate([p[1] for p in parts])
    to_first = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)])
    joined = np.concatenate(shards)
    ends = np.flatnonzero(joined == 0)
    size = np.diff(np.concatenate([[-1], ends]))
    inner = np.arange(len(joined)) - (ends - size + 1).repeat(size)
    row = np.flatnonzero(inner[suffix] >= depth)
    block = np.zeros(len(row), np.int64)
    for _ in range(depth):
        letter = before[row]
        deal = np.argsort(letter, kind="stable")
        row, letter, block = to_first[row[deal]], letter[deal], block[deal]
        if not len(row):
            break
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (letter[1:] != letter[:-1]) | (block[1:] != block[:-1])
        together = ~(new[:-1] & new[1:])
        row, block = row[together], np.cumsum(new[:-1])[together]
    return block, suffix[row]


def _merge(grp: np.ndarray, doc: np.ndarray, place: np.ndarray, contents: list[bytes], units: repeats.Units):
    """(row, first window, number) of the windows of each row that also start earlier."""
    size = np.array([len(c) + 1 for c in contents])
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(c + b"\0" for c in contents), np.uint8).astype(np.int16) + 1
    text[begin + size - 1] = 0
    cuts, start = [], 0
    for i in range(len(contents)):
        if begin[i] + size[i] - start >= SHARD_BYTES or i == len(contents) - 1:
            cuts.append((start, begin[i] + size[i]))
            start = begin[i] + size[i]
    interval, spot = repeated_intervals([text[a:b] for a, b in cuts], units.window)
    row = np.searchsorted(begin, spot, side="right") - 1
    off = spot - begin[row]
    at = (place[row] >> 16) + off
    order = np.lexsort((at, doc[row], interval))
    interval, row, off, at = interval[order], row[order], off[order], at[order]
    same = np.zeros(len(row), bool)  # not the earliest place of its interval
    if len(row):
        head = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        lead = head.repeat(np.diff(np.concatenate([head, [len(row)]])))
        same = (doc[row] != doc[row[lead]]) | (at != at[lead])
    row, off = row[same], off[same]
    order = np.lexsort((off, row))
    row, off = row[order], off[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], off[first], np.diff(np.concatenate([first, [len(row)]]))


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return common.byte_codes(data), offsets


def units_of(window: int, seed: int) -> repeats.Units:
    return repeats.Units(of=_bytes, window=window, seed=seed, within_document=True, width=1)


def drop_repeated_bytes(docs: DataFrame, window: int = 100, seed: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; ``spans`` are the removed byte runs (start, end)."""
    windows = repeats.removed_windows(docs, units_of(window, seed), _merge, BLOCK_BYTES, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            listed = batch.column(2).to_pylist()
            for row, end, data, offsets in common.text_pieces(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                for t in range(end - row):
                    own = data[offsets[t]:offsets[t + 1]]
                    gone = repeats.covered(listed[row + t] or (), window, len(own))
                    a, b = repeats_of(gone)
                    for column, value in zip(out, (len(own), int(gone.sum()), len(a), hashlib.sha256(own[~gone].tobytes()).hexdigest(),
                                                   [{"start": x, "end": y} for x, y in zip(a, b, strict=True)]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3]), pa.array(out[4], kind)],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return common.arrow(repeats.with_windows(docs, windows, id_col, text_col), run,
                        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def repeats_of(gone: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
