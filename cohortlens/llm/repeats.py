"""What substring and suffix-array deduplication share: seeds, classes of contexts, and the removal.

Both remove what a window of fixed length covers when the same window also starts earlier.  A window is
named by its seed, the shorter gram with the smallest hash inside it (winnowing), so equal windows have equal
seeds at equal places.  Neighbouring windows with the same seed form one occurrence with one context.

1. Seeds that occur once are dropped: a count with partial aggregation, and a join that splits hot seeds.
2. Occurrences with equal seed and context are one class; its earliest member stands for it, all later ones go.
3. Only where a seed has several classes are the contexts of their first members read and compared, which
   is where the two operators differ.  A seed with very many classes is dealt out by single windows.
4. Removed windows are gathered for each document and applied to its text.

A context is recognised by two 64-bit hashes.  No step holds more than one group of bounded size, one
text or one block in a task; occurrences of a text are at most its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

#: Classes of one seed that are compared within one task.
HOT_CLASSES = 4096
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Units:
    """How a text is cut into units: ``of`` gives the codes and the first unit of each text."""

    of: Callable
    window: int
    seed: int
    within_document: bool  # does an earlier place of the same document count?
    width: int  # bytes of a unit in a stored context


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of ``values[i:i + width]`` for each i; the last bits of a value do not count.

    Values are cut into blocks of ``width``.  A window is the end of one block and the beginning of the next, so
    running minima from both ends of every block are enough.  A value's last bits hold its place in the block.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << int(width - 1).bit_length()) - 1)
    key = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    key[:len(values)] = values & ~low
    key = key.reshape(-1, width)
    key[:] = (key & ~low) | np.arange(width, dtype=np.uint64)
    ahead = np.minimum.accumulate(key, axis=1).ravel()[width - 1:width - 1 + n]
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    block = np.arange(n) // width * width
    later = (np.arange(n) + width - 1) // width * width
    return np.where((back | low) <= (ahead | low), block + (back & low).astype(np.int64), later + (ahead & low).astype(np.int64))


def occurrences(codes: np.ndarray, first: np.ndarray, units: Units):
    """(text, seed hash, context hash, first window, windows, seed place in the first window) of every occurrence."""
    n, length, k = len(codes), units.window, units.seed
    if n < length:
        return (np.zeros(0, np.int64),) * 6
    sums = common.prefix_sums(codes)
    at = np.arange(n - k + 1)
    hashes = common.span_hash(sums, at, at + k)
    best = sliding_argmin(hashes, length - k + 1)
    size = np.diff(first)
    windows = np.maximum(size - length + 1, 0)
    start = np.arange(windows.sum()) - (np.cumsum(windows) - windows).repeat(windows) + first[:-1].repeat(windows)
    text = np.arange(len(size)).repeat(windows)
    seed = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(start)]]))
    j, a = start[begin], seed[begin]
    context = common.mix(common.span_hash(sums, j, j + count + length - 1) + (a - j).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return text[begin], hashes[a], context, j - first[text[begin]], count, a - j


def _found(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in common.text_pieces(batch.column(1)):
                text, seed, context, at, count, rel = occurrences(*units.of(data, offsets), units)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[row + text]),
                     pa.array((at << 16) | (rel << 8) | count)], ["seed", "context", "doc", "place"])
    return run


def _contents(units: Units):
    """Arrow function: the stored context of each wanted occurrence that is really there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for row, end, data, offsets in common.text_pieces(batch.column(1)):
                codes, first = units.of(data, offsets)
                raw = (data if units.width == 1 else codes).view(np.uint8)
                sums = common.prefix_sums(codes)
                rows = []
                for t in range(row, end):
                    for w in wanted[t]:
                        at, rel, count = w["place"] >> 16, (w["place"] >> 8) & 255, w["place"] & 255
                        j = int(first[t - row]) + at
                        stop = j + count + units.window - 1
                        if stop > first[t - row + 1]:
                            continue
                        here = common.mix(common.span_hash(sums, np.array([j]), np.array([stop])) + np.array([rel], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                        if int(here.view(np.int64)[0]) == w["context"]:
                            rows.append((w["seed"], w["context"], ids[t], w["place"], raw[j * units.width:stop * units.width].tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())],
                                                     ["seed", "context", "doc", "place", "content"])
    return run


def _single_windows(units: Units):
    """Arrow function: split a context into its windows, each grouped by its own hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seed, context, doc, place, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, rel, count = place >> 16, (place >> 8) & 255, place & 255
                codes = np.frombuffer(content, np.uint8 if units.width == 1 else np.uint64)
                sums = common.prefix_sums(common.byte_codes(codes) if units.width == 1 else codes)
                off = np.arange(count)
                marks = common.span_hash(sums, off, off + units.window).view(np.int64).tolist()
                for o in range(count):
                    rows.append((marks[o], seed, context, doc, ((at + o) << 16) | ((rel - o) << 8) | 1, o,
                                 content[o * units.width:(o + units.window) * units.width]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())],
                                                 ["grp", "seed", "context", "doc", "place", "off", "content"])
    return run


def _blocks(compare: Callable, units: Units, limit: int):
    """Arrow function: run ``compare`` on blocks of whole groups of sorted rows."""
    names = ["seed", "context", "off", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(t: pa.Table) -> pa.RecordBatch:
            grp, seed, context, doc, place, off = (t.column(i).to_numpy() for i in range(6))
            row, start, size = compare(grp, doc, place, t.column(6).to_pylist(), units)
            return pa.RecordBatch.from_arrays([pa.array(seed[row]), pa.array(context[row]), pa.array(off[row] + start), pa.array(size)], names)

        held: list[pa.RecordBatch] = []
        volume = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                held.append(part)
                volume += part.column(6).nbytes
                if volume < limit:
                    continue
                t = pa.Table.from_batches(held)
                grp = t.column(0).to_numpy()
                cut = int(np.searchsorted(grp, grp[-1]))
                if cut:
                    yield settle(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    volume = sum(b.column(6).nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))
    return run


def removed_windows(docs: DataFrame, units: Units, compare: Callable, block: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, windows): runs of removed windows (first, number) of each document that has any; a null id counts as the largest."""
    if units.window - units.seed > 254 or units.seed > units.window:
        raise ValueError("the seed must be at most the window, and at most 254 units shorter")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = common.arrow(texts, _found(units), "seed long, context long, doc long, place long")
    # small sides are written first: a join of two plain exchanges is one whose hot seeds Spark can split
    twice = common.materialised(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeat-seeds")
    repeated = common.materialised(found.join(twice, "seed"), "repeats")
    classes = repeated.groupBy("seed", "context").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"))
    classes = common.materialised(classes.select("seed", "context", "n", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place")), "repeat-classes")
    several = common.materialised(classes.groupBy("seed").agg(F.count("*").alias("n_classes")).where("n_classes > 1"), "repeat-several")
    reps = classes.join(several, "seed")
    wanted = reps.groupBy(F.col("first_doc").alias("doc")).agg(F.collect_list(F.struct(
        "seed", "context", F.col("first_place").alias("place"))).alias("wanted"))
    wanted = common.materialised(wanted, "repeat-wanted")
    contents = common.arrow(
        texts.join(wanted, "doc").select("doc", "text", "wanted"), _contents(units),
        "seed long, context long, doc long, place long, content binary").dropDuplicates(["seed", "context"])
    contents = common.materialised(contents, "repeat-contents")
    hot = several.where(F.col("n_classes") > HOT_CLASSES).select("seed")
    cool = several.where(F.col("n_classes") <= HOT_CLASSES).select("seed")
    rows = contents.join(cool, "seed").select(F.col("seed").alias("grp"), "seed", "context", "doc", "place", F.lit(0).cast("long").alias("off"), "content")
    split = common.arrow(contents.join(hot, "seed").select("seed", "context", "doc", "place", "content"), _single_windows(units),
                         "grp long, seed long, context long, doc long, place long, off long, content binary")
    run = _blocks(compare, units, block)
    kind = "seed long, context long, off long, len long"
    settled = common.arrow(rows.repartition("grp").sortWithinPartitions("grp"), run, kind).unionByName(
        common.arrow(split.repartition("grp").sortWithinPartitions("grp"), run, kind))
    partly = settled.groupBy("seed", "context").agg(F.collect_list(F.struct("off", "len")).alias("part"))
    known = common.materialised(classes.join(partly, ["seed", "context"], "left").where("n > 1 or part is not null"), "repeat-known")
    at, number = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    later = F.col("doc") > F.col("first_doc")
    if units.within_document:
        later = later | ((F.col("doc") == F.col("first_doc")) & (F.col("place") > F.col("first_place")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("off"), number.alias("len")))
    gone = repeated.join(known, ["seed", "context"]).select(
        "doc", F.explode(F.transform(F.when(later, whole).otherwise(F.col("part")), lambda w: F.struct((at + w["off"]).alias("at"), w["len"].alias("len")))).alias("w"))
    return common.materialised(gone.groupBy("doc").agg(F.collect_list("w").alias("windows")), "repeat-windows")


def covered(windows: list[dict], length: int, size: int) -> np.ndarray:
    """Units of a text of ``size`` units that the removed windows cover."""
    edge = np.zeros(size + 1, np.int64)
    for w in windows:
        edge[w["at"]] += 1
        edge[min(w["at"] + w["len"] + length - 1, size)] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_windows(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, windows) of every row."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("doc", F.coalesce("id", F.lit(LAST)))
    return keyed.join(windows, "doc", "left").select("id", "text", "windows")
