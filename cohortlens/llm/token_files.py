"""Token ids of a corpus in binary files: canonical Huffman codes from global counts, decoded block by block.

Texts are encoded by a given tokenizer (never trained here) and end with ``end_id``.  The ids are
counted over the whole corpus; only one count for each id of the vocabulary reaches the driver,
which makes the code (``huffman``).  Documents are then coded one by one, ordered by id by sorted
ranges, and written as segments of about ``SEGMENT`` ids.

A set of files is a folder with two Parquet tables, used as containers that every file system of
Spark can write and read:

- ``code``: (id, length), the code length of each id that occurs; canonical codes follow from it.
- ``segments``: (part, seq, before, n_tokens, payload); ``part`` and ``seq`` give the order of the
  documents, ``before`` the ids of the earlier segments of its part.

A payload is little-endian: the bytes ``TOK1``, then the number of documents d and of blocks b as
64-bit integers; d document ids (64 bits); d bytes, 1 where the document id is null; d counts of
ids (64 bits); b checkpoints, the bit offset of every block of 256 ids of a document in the stream
(64 bits); and the stream.  Every document starts at a new 32-bit word, so each block, and each document, can be decoded
alone.

Defined cases: a null or empty text has the end id only; null document ids come first; documents of
equal id are all kept, ordered by the CRC-32 of their coded bits and their number of ids; other columns are ignored; without
documents both tables are empty.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common, huffman

#: Ids of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 20
#: Ids that are coded at once.
PIECE = 1 << 20
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 4 << 20
#: Words, and pieces, whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64
MAGIC = b"TOK1"

_encoders: dict[tuple[int, bool], "TextEncoder"] = {}


class TextEncoder:
    """A tokenizer with the ids of words and pieces seen before.

    With ``by_word`` the tokenizer must drop white space and never join what white space divides; then
    the ids of a text are those of its words (bytes between ASCII white space), and each is looked up.
    New words go through the tokenizer's own normalizer and pre-tokenizer together, and each new piece
    through its model.  A word of Latin letters, maybe with punctuation behind, needs no cutting if the
    tokenizer is seen to keep letters together and to cut before that punctuation.
    """

    LATIN = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c.isalpha())
    MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
    WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, definition: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(definition), by_word
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Added tokens are found before anything else, and a zero divides the words below; such words are encoded alone.
        self.alone = re.compile(b"|".join(map(re.escape, [*added, b"0"])))
        self.mark = self._split("0")
        cut = {c: self._split(c) for c in self.LATIN}
        self.letter = {ord(c): p[0] for c, p in cut.items()}
        self.keeps = all(len(p) == 1 for p in cut.values()) and self._split(self.LATIN) == ["".join(p[0] for p in cut.values())]
        self.tails: dict[bytes, bytes | None] = {b"": b""}

    def _split(self, text: str) -> list[str]:
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = text if normal is None else normal.normalize_str(text)
        return [p for p, _ in cut.pre_tokenize_str(text)] if cut is not None else [text]

    def _each(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(f.ids, self.kind).tobytes() for f in found]

    def _ids(self, piece: str) -> bytes:
        size = self.kind.itemsize
        return b"".join([t.id.to_bytes(size, "little") for t in self.tokenizer.model.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self._ids(piece)
            if len(piece) <= LONGEST:
                self.pieces[piece] = found
        return found

    def _tail(self, tail: bytes) -> bytes | None:
        """Ids of punctuation behind a letter; None if the tokenizer does not cut there."""
        if tail not in self.tails:
            text = tail.decode()
            apart = all(self._split(c + text) == self._split(c) + self._split(text) for c in ("a", "Z", "é", "ß"))
            found = self._each([tail])[0] if apart else None
            if len(tail) > LONGEST:
                return found
            self.tails[tail] = found
        return self.tails[tail]

    def _new_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words without zeros.  Those that have to be cut are cut in one call, with zeros between them, which are one piece each."""
        out, rest, stems, tails = {}, [], self.stems, self.tails
        for word in words:
            stem = word.rstrip(self.MARKS)
            if self.keeps and stem.isalpha():  # A-Z and a-z only, as these are bytes
                end = word[len(stem):]
                tail = tails[end] if end in tails else self._tail(end)
                if tail is None:
                    rest.append(word)
                    continue
                ids = stems.get(stem)
                if ids is None:
                    ids = self._ids(stem.decode().translate(self.letter))
                    if len(stem) <= LONGEST:
                        stems[stem] = ids
                out[word] = ids + tail
                continue
            match = self.WORD.fullmatch(word) if self.keeps else None
            tail = self._tail(match[2]) if match else None
            if tail is None:
                rest.append(word)
                continue
            out[word] = self._piece(match[1].decode().translate(self.letter)) + tail
        for low in range(0, len(rest), 2000):
            part = rest[low:low + 2000]
            found: list[list[bytes]] = [[]]
            for piece in self._split(b" 0 ".join(part).decode("utf-8", "replace")):
                if piece == self.mark[0]:
                    found.append([])
                else:
                    found[-1].append(self._piece(piece))
            ids = [b"".join(f) for f in found] if len(found) == len(part) else self._each(part)
            out.update(zip(part, ids, strict=True))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word or len(self.mark) != 1:
            return self._each(texts)
        split = [t.split() for t in texts]
        words = self.words
        new = set().union(*split).difference(words)
        if len(words) + len(new) > REMEMBERED:
            words.clear()
            new = set().union(*split)
        for kept in (self.pieces, self.stems):
            if len(kept) > REMEMBERED:
                kept.clear()
        alone = [w for w in new if self.alone.search(w)]
        words.update(self._new_words(list(new.difference(alone))))
        if alone:
            words.update(zip(alone, self._each(alone), strict=True))
        out = [b"".join(map(words.__getitem__, own)) for own in split]
        for w in new:
            if len(w) > LONGEST:
                del words[w]
        return out


def _encoder(definition: str, by_word: bool) -> TextEncoder:
    key = (zlib.crc32(definition.encode()), by_word)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(definition, by_word)
    return _encoders[key]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every text and the end id, as little-endian 16-bit (or, for large vocabularies, 32-bit) integers."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(shared.value, by_word)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for a, b, data, offsets in common.text_pieces(batch.column(1), TEXT_BYTES):
                raw, cuts = data.tobytes(), offsets.tolist()
                found = encoder.encode([raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([f + end for f in found], pa.large_binary())],
                                                 names=["doc_id", "ids"])

    return common.arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), _binary(encode),
                        "doc_id long, ids binary")


def _binary(function: Callable) -> Callable:
    """Batches of at most ``TEXT_BYTES`` or so of large binaries as ordinary ones."""
    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in batch.columns],
                                             names=batch.schema.names)
    return narrowed


def id_counts(coded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; every task adds up its own rows first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for _, _, data, _ in common.text_pieces(batch.column(0), 2 * PIECE):
                own = np.bincount(data.view(kind))
                if len(own) > len(total):
                    own[:len(total)] += total
                    total = own
                else:
                    total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return common.arrow(coded.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coded(batches: Iterator[pa.RecordBatch], kind: str, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, checkpoints, bits) of every document; checkpoints count from the document's first bit."""
    codes = huffman.canonical_codes(lengths)
    for batch in batches:
        for a, b, data, offsets in common.text_pieces(batch.column(1), PIECE * np.dtype(kind).itemsize):
            ids, sizes = data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize
            stream, at, words = huffman.encode(ids, sizes, codes, lengths)
            ends, blocks = np.cumsum(words) * 4, np.cumsum(-(-sizes // huffman.BLOCK))
            local = at - (32 * (np.cumsum(words) - words)).repeat(np.diff(blocks, prepend=0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[a:b], pa.array(sizes),
                pa.array([local[x:y].astype("<u8").tobytes() for x, y in zip([0, *blocks[:-1]], blocks, strict=True)], pa.binary()),
                pa.array([stream[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())],
                names=["doc_id", "n", "checkpoints", "bits"])


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents in order, gathered into payloads of about ``most`` ids."""
    rows: list[tuple] = []
    held = before = seq = part = 0

    def ready() -> pa.RecordBatch:
        sizes = np.array([r[1] for r in rows], np.int64)
        words = np.array([len(r[3]) for r in rows], np.int64) * 8
        starts = np.cumsum(words) - words
        marks = [np.frombuffer(r[2], "<u8").astype(np.int64) + s for r, s in zip(rows, starts, strict=True)]
        at = np.concatenate(marks)
        payload = b"".join([
            MAGIC, np.array([len(rows), len(at)], "<i8").tobytes(), np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
            bytes(r[0] is None for r in rows), sizes.astype("<i8").tobytes(), at.astype("<i8").tobytes(), *[r[3] for r in rows]])
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([before]), pa.array([held]), pa.array([payload], pa.binary())],
                                          names=["part", "seq", "before", "n_tokens", "payload"])

    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            part, *row = (c[i].as_py() for c in columns)
            if rows and held + row[1] > most:
                yield ready()
                rows, before, held, seq = [], before + held, 0, seq + 1
            rows.append(tuple(row))
            held += row[1]
    if rows:
        yield ready()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_word: bool = False, segment: int = SEGMENT) -> None:
    """Tokenize all texts and write their ids, ordered by document, as a set of files below ``path``."""
    spark = docs.sparkSession
    encoded = token_ids(docs, tokenizer, end_id, by_word)
    scratch = common.scratch_path(spark, "token-ids")
    encoded.write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.schema(encoded.schema).parquet(scratch)
    with open(tokenizer, encoding="utf-8") as file:
        kind = TextEncoder(file.read(), False).kind.str
    counts = id_counts(encoded, kind).toPandas()  # at most one row for each id of the vocabulary
    n = int(counts.id.max()) + 1 if len(counts) else 1
    total = np.zeros(n, np.int64)
    total[counts.id.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
    lengths = huffman.code_lengths(total)
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id long, length int")
    code.coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)
    coded = common.arrow(encoded, lambda batches: _coded(batches, kind, shared.value), "doc_id long, n long, checkpoints binary, bits binary")
    coded = coded.withColumn("check", F.crc32("bits"))
    # Written, since the ends of the ranges are sampled in a run of their own, which would code everything again.
    bits = common.scratch_path(spark, "token-bits")
    coded.write.parquet(bits)
    common.discard(spark, scratch)
    order = ["doc_id", "check", "n"]
    ranged = spark.read.schema(coded.schema).parquet(bits).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "n", "checkpoints", "bits")
    common.arrow(numbered, functools.partial(_segments, most=segment), "part long, seq long, before long, n_tokens long, payload binary").write.parquet(f"{path}/segments")
    common.discard(spark, bits)


def _code_lengths(spark: SparkSession, path: str) -> np.ndarray:
    code = spark.read.schema("id long, length int").parquet(f"{path}/code").toPandas()  # a row for each id of the vocabulary
    lengths = np.zeros(int(code.id.max()) + 1 if len(code) else 1, np.uint8)
    lengths[code.id.to_numpy(np.int64)] = code.length.to_numpy(np.uint8)
    return lengths


def payload_parts(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, bytes]:
    """Document ids, ids of each document, checkpoints and stream of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of token ids")
    d, b = np.frombuffer(payload, "<i8", 2, 4).tolist()
    ids = np.frombuffer(payload, "<i8", d, 20).tolist()
    at = 20 + 8 * d
    null = payload[at:at + d]
    sizes = np.frombuffer(payload, "<i8", d, at + d).astype(np.int64)
    checkpoints = np.frombuffer(payload, "<i8", b, at + 9 * d).astype(np.int64)
    return [None if x else i for i, x in zip(ids, null, strict=True)], sizes, checkpoints, payload[at + 9 * d + 8 * b:]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from a set of files.

    ``start`` is the number of ids of all documents before; the CRC-32 is that of the ids as little-endian
    unsigned 32-bit integers, which ``ids`` holds.
    """
    shared = spark.sparkContext.broadcast(_code_lengths(spark, path))
    files = spark.read.schema("part long, seq long, before long, n_tokens long, payload binary").parquet(f"{path}/segments")
    # One row for each part that was written; the running total over them is the only thing counted in one task.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.join(common.broadcast_within(parts.select("part", earlier.alias("start"))), "part").select(
        (F.col("start") + F.col("before")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.Decoder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, checkpoints, stream = payload_parts(batch.column(1)[k].as_py())
                raw = memoryview(decoder.decode(stream, checkpoints, sizes).astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                spans = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(batch.column(0)[k].as_py() + ends - sizes), pa.array(sizes),
                           pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.arrow(placed, decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
