"""Substring deduplication by seed and extend: windows of ``window`` words that an earlier document holds too.

Documents meet on winnowed seeds of five words.  All occurrences of a seed are extended at once: those that
agree on the words so far are split by their next word, to the left and to the right.  Occurrences that
agree on l words before and the rest of the window after the seed hold the same window; the smallest document
among them keeps it.  Neighbouring matches make up the maximal repeats, and every word they cover goes.

Defined cases: a null or empty text has no words; a text shorter than a window keeps everything; repeats
within one document stay; a null id counts as the largest; rows with one id are judged as one document; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm import common, repeats

BLOCK_BYTES = 4 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = common.word_spans(data, offsets)
    return common.word_hashes(data, starts, ends), first


def _extend(grp: np.ndarray, doc: np.ndarray, place: np.ndarray, contents: list[bytes], units: repeats.Units):
    """(row, first window, number) of the windows of each row that a smaller document of its group holds too."""
    rel, count = (place >> 8) & 255, place & 255
    words = np.frombuffer(b"".join(contents), np.uint64)
    size = np.array([len(c) // 8 for c in contents])
    begin = np.cumsum(size) - size
    _, number = np.unique(words, return_inverse=True)
    number, radix = np.concatenate([number, [0]]), int(number.max()) + 2
    spare = units.window - units.seed

    def refined(step: int, origin: np.ndarray) -> list[np.ndarray]:
        """Class of each row after 0, 1, ... further words in one direction."""
        out = [np.unique(grp, return_inverse=True)[1]]
        for i in range(spare):
            at = origin + step * i
            there = (at >= begin) & (at < begin + size)
            word = np.where(there, number[np.where(there, at, 0)] + 1, 0)
            out.append(np.unique(out[-1] * radix + word, return_inverse=True)[1])
        return out

    left = refined(-1, begin + rel - 1)
    right = refined(1, begin + rel + units.seed)
    rows, starts = [], []
    for l in range(spare + 1):  # the window that starts l words before the seed
        own = np.flatnonzero((rel - l >= 0) & (rel - l < count))
        if not len(own):
            continue
        _, same = np.unique(left[l][own] * len(grp) + right[spare - l][own], return_inverse=True)
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[own])
        gone = own[least[same] < doc[own]]
        rows.append(gone)
        starts.append(rel[gone] - l)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return row, start, np.ones(len(row), np.int64)


def units_of(window: int, seed: int) -> repeats.Units:
    return repeats.Units(of=_words, window=window, seed=seed, within_document=False, width=8)


def drop_repeats(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): every row with the words that stay, joined by one space."""
    windows = repeats.removed_windows(docs, units_of(window, seed), _extend, BLOCK_BYTES, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2).to_pylist()
            for row, end, data, offsets in common.text_pieces(batch.column(1)):
                starts, ends, first = common.word_spans(data, offsets)
                raw = data.tobytes()
                n_words, n_removed, kept = np.diff(first), [], []
                for t in range(end - row):
                    a, b = int(first[t]), int(first[t + 1])
                    gone = repeats.covered(listed[row + t] or (), window, b - a)
                    stay = a + np.flatnonzero(~gone)
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(n_words), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["id", "n_words", "n_removed", "kept"])

    return common.arrow(repeats.with_windows(docs, windows, id_col, text_col), run, "id long, n_words long, n_removed long, kept string")
