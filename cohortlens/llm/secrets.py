"""Secrets: fixed patterns, and strings that look random to character Markov models.

First-order character models, of random strings and of ordinary identifiers, are counted over the whole
corpus.  The labelled samples are the corpus's own: the values that the fixed patterns catch are random
strings, all other runs of token characters are identifiers.  Random strings have a model for each class of
alphabet (hexadecimal digits; capitals and digits; all), so that one common kind does not speak for the others.
Identifiers of at least ``MIN_RUN`` characters count once each, however often they are repeated, and one is
judged by what the others leave when its own transitions are taken out.  A run of that length is reported
as ``random`` when its log-likelihood ratio, in sum and per step, exceeds the thresholds.  With smoothing, a
class without a caught value has a flat model.

The patterns work on UTF-8 bytes, so letter case folds only in A-Z; places are turned into code points.
Texts are scanned in place; only transition counts (at most 66 x 66 rows for each task and model) and the runs
of at least ``MIN_RUN`` characters are shuffled.

Defined cases: a null or empty text has no spans; repeated and null ids give a row each; extra columns are
ignored.  Spans of the method never touch a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "random"]
#: Every keyword of ASSIGN holds one of these, in lower case.
HINTS = [re.compile(re.escape(w)) for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")]
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RUN = 8, 16, 32, 16
MIN_RATIO, MIN_RATIO_PER_STEP = 4.0, 0.1

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
CODE = np.full(256, -1, np.int16)
CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
N = len(ALPHABET)
IS_HEX = np.zeros(256, bool)
IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
#: Characters of each class of random strings; the first class that has all characters of a string is its own.
CLASSES = np.zeros((3, N), bool)
for k, characters in enumerate((b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET)):
    CLASSES[k, CODE[np.frombuffer(characters, np.uint8)]] = True


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true places of at least ``least``, never across texts."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(padded[1:] & (~padded[:-1] | cut))
    ends = np.flatnonzero(padded[:-1] & (~padded[1:] | cut))
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, start, kind, end, value start, value end) in bytes of every base secret."""
    found = []
    starts, ends = runs(IS_HEX[data], offsets, MIN_HEX)
    for t, a, b in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        found.append((t, a, 2, b, a, b))
    raw, lower = data.tobytes(), common.LOWER[data].tobytes()

    def texts_with(pattern, where: bytes) -> list[int]:
        at = np.array([m.start() for m in pattern.finditer(where)], np.int64)
        return np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()

    for t in texts_with(re.compile(b"AKIA"), raw):
        for m in ACCESS.finditer(raw, int(offsets[t]), int(offsets[t + 1])):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((t, m.start(), 1, m.end(), m.start(), m.end()))
    for t in sorted({t for hint in HINTS for t in texts_with(hint, lower)}):
        for m in ASSIGN.finditer(raw, int(offsets[t]), int(offsets[t + 1])):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                found.append((t, m.start(), 0, m.end(), m.start(2), m.end(2)))
    return sorted(found)


def _free_runs(data: np.ndarray, offsets: np.ndarray, base: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of token characters outside every base span."""
    free = CODE[data] >= 0
    for _, a, _, b, _, _ in base:
        free[a:b] = False
    starts, ends = runs(free, offsets, least)
    if not base:
        return starts, ends
    touched = np.zeros(len(data) + 2, bool)  # a run cut by a base span is a part of it
    for _, a, _, b, _, _ in base:
        touched[a:b + 1] = True
    keep = ~touched[starts] & ~touched[ends]
    return starts[keep], ends[keep]


def _class_of(code: np.ndarray) -> int:
    return int(np.argmax(CLASSES[:, code].all(axis=1)))


def _pairs(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Transitions within runs, as first character times N plus the next."""
    size = ends - starts - 1
    at = np.arange(size.sum()) - (np.cumsum(size) - size).repeat(size) + starts.repeat(size)
    return code[at] * N + code[at + 1]


def transition_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of every transition: table 0 has the identifiers, table 1 + k the random strings of class k."""
    def tally(total: np.ndarray, long: list[str]) -> pa.RecordBatch:
        model, pair = np.nonzero(total)
        n = len(model)
        return pa.RecordBatch.from_arrays([
            pa.array([*model.tolist(), *[None] * len(long)], pa.int64()), pa.array([*pair.tolist(), *[None] * len(long)], pa.int64()),
            pa.array([*total[model, pair].tolist(), *[None] * len(long)], pa.int64()), pa.array([None] * n + long, pa.string())], ["model", "pair", "n", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, N * N), np.int64)
        for batch in batches:
            for _, _, data, offsets in common.text_pieces(batch.column(0)):
                base = base_spans(data, offsets)
                code = CODE[data].astype(np.int64)
                starts, ends = _free_runs(data, offsets, base, 2)
                short = ends - starts < MIN_RUN
                total[0] += np.bincount(_pairs(code, starts[short], ends[short]), minlength=N * N)
                raw = data.tobytes()
                long = {raw[a:b].decode() for a, b in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)}
                for _, _, _, _, a, b in base:
                    value = code[a:b]
                    inside = value[value >= 0]
                    if len(inside):
                        pair = value[:-1] * N + value[1:]
                        total[1 + _class_of(inside)] += np.bincount(pair[(value[:-1] >= 0) & (value[1:] >= 0)], minlength=N * N)
                if long:
                    yield tally(np.zeros((1, 1), np.int64), sorted(long))
        yield tally(total, [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, N * N), np.int64)
        for batch in batches:
            for _, _, data, offsets in common.text_pieces(batch.column(0)):
                total[0] += np.bincount(_pairs(CODE[data].astype(np.int64), offsets[:-1], offsets[1:]), minlength=N * N)
        yield tally(total, [])

    schema = "model long, pair long, n long, run string"
    found = common.materialised(common.arrow(docs.select(F.col(text_col).cast("string")), run, schema), "transitions")
    once = common.arrow(found.where("run is not null").select("run").distinct(), count, schema)
    counted = found.where("run is null").unionByName(once).groupBy("model", "pair").agg(F.sum("n").alias("n"))
    table = np.zeros((4, N, N))
    for r in counted.collect():  # at most one row for each model and transition
        table[r["model"], r["pair"] // N, r["pair"] % N] = r["n"]
    return table


class Ratios:
    """log P(next | char) of a run under the random strings of its class minus the same under identifiers.

    A row of a table is smoothed with as many counts as the alphabet has characters, shared out like the model's
    characters (identifiers) or evenly over the class (random strings).
    """

    def __init__(self, table: np.ndarray):
        self.known, self.rows = table[0], table[0].sum(axis=1)
        self.share = (table[0].sum(axis=0) + 1) / (table[0].sum() + N)
        even = CLASSES / CLASSES.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.random = np.log((table[1:] + N * even[:, None, :]) / (table[1:].sum(axis=2, keepdims=True) + N))

    def score(self, code: np.ndarray) -> float:
        """Of one run, judged by the identifiers without it."""
        before, after = code[:-1], code[1:]
        _, place, times = np.unique(before * N + after, return_inverse=True, return_counts=True)
        own = np.bincount(before, minlength=N)
        left = np.maximum(self.known[before, after] - times[place], 0)
        ordinary = np.log((left + N * self.share[after]) / (np.maximum(self.rows[before] - own[before], 0) + N))
        return float((self.random[_class_of(code), before, after] - ordinary).sum())


def random_runs(data: np.ndarray, offsets: np.ndarray, base: list[tuple], ratios: Ratios, min_ratio: float, per_step: float) -> list[tuple]:
    starts, ends = _free_runs(data, offsets, base, MIN_RUN)
    code = CODE[data].astype(np.int64)
    found = []
    for t, a, b in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        score = ratios.score(code[a:b])
        if score >= min_ratio and score >= per_step * (b - a - 1):
            found.append((t, a, 3, b, a, b))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO,
                 min_ratio_per_step: float = MIN_RATIO_PER_STEP) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row.

    ``spans`` lists kind:start:end by start, then kind (code points, end exclusive); ``base_sha256`` is the
    digest of the same list without the method's own kind.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Ratios(transition_counts(docs, text_col)))

    def listed(spans: list[tuple]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_pieces(batch.column(1)):
                base = base_spans(data, offsets)
                every = sorted(base + random_runs(data, offsets, base, sent.value, min_ratio, min_ratio_per_step))
                spans: list[list[tuple]] = [[] for _ in range(last - first)]
                if every:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for t, a, k, b, _, _ in every:
                        spans[t].append((int(points[a] - points[offsets[t]]), k, int(points[b] - points[offsets[t]])))
                number = [pa.array([sum(s[1] == k for s in own) for own in spans], pa.int64()) for k in range(4)]
                digest = [hashlib.sha256(listed([s for s in own if s[1] < 3]).encode()).hexdigest() for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *number, pa.array(digest), pa.array([listed(own) for own in spans])],
                    ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return common.arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run,
                        "id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
