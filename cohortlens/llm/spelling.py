"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Words are counted over the whole corpus, with sums per task before the shuffle.  Two words one edit
apart share the first half of the shorter word or its last half.  Every word is therefore filed under
both halves, once as the shorter and once as the longer of a pair; a file of more than ``FILE`` words
is split again in the same way by what its words do not yet share, so no file needs all pairs.

Files that are neighbours in key order form a vocabulary of about ``FILE`` words with one bit set (a
bit for each word) per position and letter.  All words of one length are looked up together: while
their letters are read, one set of words holds those equal so far, one those with one letter replaced,
and one, read from the sets of the next position, those with one letter more.

Defined cases: null texts and rows without a document id have no words; other columns are ignored;
repeated documents count again; without words the result is empty.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

#: Words of a file, and of an index, and letters of either for each word that would fit.
FILE, LETTERS = 8192, 32
#: Distinct words a task counts before it sends them on.
HELD = 500_000
#: 64-bit words of a set of pairs that are worked on at once.
SET_WORDS = 1 << 20


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = 0, held: int = HELD) -> DataFrame:
    """(word, n): runs of letters with A-Z lowered, of at least ``least_length`` letters and ``least_count`` occurrences.

    With ``slip`` a run of a document loses a letter if ``slip`` divides h, the CRC-32 of ``<doc_id>:<run>``: the letter at
    h modulo its length.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
    lower = bytes(common.LOWER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                if raw is None:
                    continue
                found = runs.findall(raw.translate(lower).decode("utf-8", "replace"))
                if not slip:
                    total.update(found)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in Counter(found).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % slip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                        total[run] += n
                if len(total) > held:
                    yield ready()
                    total.clear()
        if total:
            yield ready()

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    counted = common.arrow(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def filed(vocabulary: DataFrame, file: int = FILE) -> DataFrame:
    """(word, n, m, key): every word under the parts that it may share with a word one edit apart.

    m is the length of the shorter word of a pair, a and b the letters shared at the start and the end.
    The rest of the shorter word, k letters, is halved; with k of at most 1 a file can't be divided.
    """
    def split(rows: DataFrame) -> DataFrame:
        half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
        both = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")),
                       F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b")))
        parts = rows.select("word", "n", "m", F.explode(both).alias("s")).select("word", "n", "m", "s.a", "s.b")
        fields = ["m", "a", "b", F.expr("substring(word, 1, a)"), F.expr("substring(word, length(word) - b + 1, b)")]
        return parts.withColumn("key", F.concat_ws(" ", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields]))

    lengths = F.array(F.length("word") - 1, F.length("word"))
    zero = F.lit(0)
    rows = common.materialised(split(vocabulary.select("word", "n", F.explode(lengths).alias("m"), zero.alias("a"), zero.alias("b"))), "filed")
    while True:
        large = common.materialised(rows.where("m - a - b > 1").groupBy("key").agg(
            F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("letters")).where(
            (F.col("words") > file) | ((F.col("letters") > LETTERS * file) & (F.col("words") > 1))).select("key"), "large")
        if large.isEmpty():
            return rows.select("word", "n", "m", "key")
        again = rows.join(large, "key", "left_semi")
        rows = common.materialised(rows.join(large, "key", "left_anti").unionByName(split(again.drop("key"))), "filed")


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all ordered pairs of distinct words one edit apart."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters, code = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
    first = np.cumsum(lengths) - lengths
    word = np.arange(len(words)).repeat(lengths)
    at = (np.arange(len(code)) - first.repeat(lengths)) * len(letters) + code
    keys, row = np.unique(at, return_inverse=True)
    width = -(-len(words) // 64)
    bit = np.uint64(1) << (np.arange(len(words)) & 63).astype(np.uint64)
    index = np.zeros((len(keys) + 1, width), np.uint64)  # the last row is empty
    np.bitwise_or.at(index, (row, word >> 6), bit[word])
    of_length = {}
    for m in np.unique(lengths).tolist():
        of_length[m] = np.zeros(width, np.uint64)
        own = np.flatnonzero(lengths == m)
        np.bitwise_or.at(of_length[m], own >> 6, bit[own])

    def sets(position: int, letter: np.ndarray) -> np.ndarray:
        key = position * len(letters) + letter
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return index[np.where(keys[found] == key, found, len(keys))]

    out: list[tuple[np.ndarray, np.ndarray]] = []
    chunk = max(1, SET_WORDS // max(width, 1))
    for m, same in of_length.items():
        own, longer = np.flatnonzero(lengths == m), of_length.get(m + 1)
        for low in range(0, len(own), chunk):
            query = own[low:low + chunk]
            equal = np.full((len(query), width), ~np.uint64(0))
            replaced, more = np.zeros_like(equal), np.zeros_like(equal)
            here = sets(0, code[first[query]])
            for i in range(m):
                letter = code[first[query] + i]
                if longer is not None:
                    more = (more | equal) & sets(i + 1, letter)
                if i:
                    here = sets(i, letter)
                replaced = (replaced & here) | (equal & ~here)
                equal &= here
            for found, twice in ((replaced & same, False), *([((more | equal) & longer, True)] if longer is not None else [])):
                q, w = np.nonzero(found)
                bits = np.unpackbits(found[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, b = np.nonzero(bits)
                pair = query[q[k]], w[k] * 64 + b
                out += [pair, pair[::-1]] if twice else [pair]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _near(batches: Iterator[pa.RecordBatch], file: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the words of neighbouring whole files."""
    words: list[str] = []
    counts: list[int] = []
    letters, current = 0, None

    def ready() -> Iterator[pa.RecordBatch]:
        n_of = dict(zip(words, counts, strict=True))
        own = list(n_of)
        i, j = near_pairs(own)
        n = np.array(list(n_of.values()), np.int64)
        table = pa.array(own, pa.string())
        for low in range(0, len(i), 100_000):
            a, b = i[low:low + 100_000], j[low:low + 100_000]
            yield pa.RecordBatch.from_arrays([table.take(pa.array(a)), table.take(pa.array(b)), pa.array(n[b])], names=["word", "near", "near_n"])

    for batch in batches:
        for word, n, key in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if key != current and (len(words) >= file or letters >= LETTERS * file):
                yield from ready()
                words, counts, letters = [], [], 0
            current = key
            letters += len(word)
            words.append(word)
            counts.append(n)
    if words:
        yield from ready()


def near_words(vocabulary: DataFrame, file: int = FILE) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one inserted, deleted or replaced letter apart, once."""
    rows = filed(vocabulary, file).repartition("key").sortWithinPartitions("m", "key").select("word", "n", "key")
    return common.arrow(rows, functools.partial(_near, file=file), "word string, near string, near_n long").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms ends.  Every round doubles the steps, so a chain of k needs log2(k)."""
    current = common.materialised(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.materialised(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                                    "roots")
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_groups(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """Every word of ``vocabulary`` (word, n) with its form, the most frequent near word if at least ``times`` as frequent.

    Columns: word, form, root, n, n_near, form_n.
    """
    vocabulary = common.materialised(vocabulary, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    found = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= times * F.col("n")
    joined = common.materialised(vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
