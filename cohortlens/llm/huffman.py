"""Canonical length-limited Huffman codes over token ids, and their bit streams in blocks.

Lengths come from the package-merge algorithm; codes of one length are numbered in the order of
their ids, so a table of lengths is all that has to be stored.  A stream is cut into blocks of
``BLOCK`` ids; the bit offset of each block is its checkpoint.  Blocks are decoded by a table of
all ``limit``-bit windows, one id of every block at a time.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
BLOCK = 256
#: Longest code in bits, more only if the ids need it.
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each symbol with a count above zero, at most ``limit``; 0 for the others.

    Package-merge: in each of ``limit`` rounds neighbours of the sorted list are packed in twos and merged
    with the symbols.  A symbol's length is the number of rounds in which it is among the items used.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    level, leaves = weights, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        packed = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packed])
        by = np.argsort(both, kind="stable")
        level = both[by]
        leaves.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaves):
        symbols = int(is_leaf[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol (lowest bits, first bit highest); shorter codes first, then smaller symbols."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        steps = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        codes[order] = (np.cumsum(steps) - steps) >> (top - lengths[order]).astype(np.uint64)
    return codes


def block_counts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in every block of documents of ``sizes`` ids, and whether it is the last of its document."""
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    last = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
    last[ends[blocks > 0] - 1] = True
    counts = np.full(len(last), BLOCK, np.int64)
    some = sizes[blocks > 0]
    counts[last] = some - BLOCK * (blocks[blocks > 0] - 1)
    return counts, last


def encode(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bit stream of documents of ``sizes`` ids, each from a new 32-bit word on (first byte highest).

    Returns the stream, the bit offset of every block, and the words of every document.
    """
    own = lengths[ids].astype(np.int64)
    if len(own) and not own.all():
        raise ValueError("an id without a code")
    sums = np.append(0, np.cumsum(own))
    first = np.cumsum(sizes) - sizes
    words = (sums[first + sizes] - sums[first] + 31) // 32
    start = 32 * (np.cumsum(words) - words)
    at = sums[:-1] + (start - sums[first]).repeat(sizes)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    if len(at):
        placed = codes[ids] << (64 - (at & 31) - own).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.append(True, np.diff(word) != 0))
        out[word[new]] += np.add.reduceat(placed >> np.uint64(32), new)
        out[word[new] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), new)
    begins = (np.arange(len(ids)) - first.repeat(sizes)) % BLOCK == 0
    return out[:-1].astype(">u4").tobytes(), at[begins], words


class Decoder:
    """The window table of a code; decodes streams of ``encode``."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=0)), 1)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        self.symbol[:spans.sum()] = order.repeat(spans)
        self.length[:spans.sum()] = lengths[order].repeat(spans)

    def decode(self, stream: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of all documents of a stream; a block that does not end at the next checkpoint raises.

        The blocks stand side by side and give one id each in a step, the longer ones first, so that
        finished blocks drop out at the end.
        """
        counts, last = block_counts(sizes)
        words = np.frombuffer(stream, ">u4").astype(np.uint64)
        pairs = (np.append(words, np.uint64(0)) << np.uint64(32)) | np.append(words[1:], np.zeros(2, np.uint64))
        order = np.argsort(-counts, kind="stable")
        at, left = checkpoints[order].astype(np.int64), counts[order]
        out, place = np.empty(int(counts.sum()), np.uint32), (np.cumsum(counts) - counts)[order]
        mask = np.uint64((1 << self.bits) - 1)
        for i in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -i, side="left"))
            now = at[:n]
            window = ((pairs[now >> 5] >> (64 - self.bits - (now & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[place[:n] + i] = self.symbol[window]
            at[:n] = now + self.length[window]
        ends = np.empty_like(at)
        ends[order] = at
        ends = np.where(last, -(-ends // 32) * 32, ends)
        if (ends != np.append(checkpoints[1:], 32 * len(words))).any():
            raise ValueError("a block does not end at the next checkpoint")
        return out
