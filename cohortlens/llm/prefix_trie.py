"""The trie of conversation prefixes: minimal-perfect-hash node tables, one for each shard of conversations.

A node is a distinct sequence of first turns.  Its digest (128 bits) is the exclusive-or of one hash
for each (depth, turn), so that the prefixes of a conversation are running values and the parent's
digest is the node's own without its last turn.  One grouped count over all (conversation, depth)
rows gives the members and the smallest member, the owner, of every node.  A second hash of parent
and turn is compared within every group; a collision raises.

Sums over subtrees need no rounds over the depth of the trie.  The nodes that a conversation owns
are the lower end of its path, so each shard (a set of conversations) takes their nodes together
with the paths above them, gives every distinct digest a verified slot of a minimal perfect hash,
scatters the counts of the owned nodes into flat arrays and adds them up through the array of
parent slots, deepest nodes first.  Every node is owned once, so the shards' sums add up, and each
shard sends one row for each of its nodes, however many conversations share it.

Long conversations: positions are counted by ranges of the sorted turns, and paths are cut into
blocks of ``BLOCK`` depths, with what lies below a block carried in, so no task needs a whole
conversation.  Ids of members that end at a node are joined by sorted ranges and hashed as a stream.

Defined cases: a null role or text is empty; rows without a conversation id belong to none and are
left out; turns of equal number are ordered by role (null as empty), then by the SHA-256 of their
content, equal ones being interchangeable; repeated rows are turns of their own; without
conversations there is no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common
from cohortlens.llm.slots import SlotTable, distinct

#: Depths of a path that are handled together.
BLOCK = 1024
#: Rows that a shard's table is made from (whole blocks of paths, so at least one).
SHARD_ROWS = 400_000
#: Pattern of a word of a turn's text.
WORD = r"[^\x20\x09-\x0D]+"
#: Most turns that a conversation takes from the head of another one.
MOST_HEAD = 3

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _number(sha: Column, start: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(sha, start, 15), 16, 10).cast("long")


def slim_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, k1, k2, k3, words): 180 bits of the SHA-256 of role and text instead of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), sha.alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.select("conv_id", "turn", "role", *[_number(F.col("sha"), 1 + 15 * i).alias(f"k{i + 1}") for i in range(3)], "words")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Add ``pos``, the number of a turn within its conversation from 1.

    Ranges of the sorted turns count their own rows.  A conversation that goes on into a range brings
    one number of earlier rows with it, so the table of those has at most one row for each range.
    """
    order = ["turn", "role", "k1", "k2", "k3"]
    ranged = common.materialised(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = (ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("earlier", earlier).where("earlier > 0").select("conv_id", "part", "earlier"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return (ranged.join(common.broadcast_within(carried), ["conv_id", "part"], "left")
            .withColumn("pos", own + F.coalesce("earlier", F.lit(0))).drop("part", "earlier", "turn", "role"))


def rebuilt_paths(conversations: DataFrame, every: int = 20, heads: int = MOST_HEAD + 1) -> DataFrame:
    """(conv_id, depth, k1, k2, k3, words, length) of rebuilt conversations, with a row of depth 0 for each.

    A conversation takes the first h turns of the conversation whose id is the next smaller multiple of
    ``every`` and goes on with its own turns after its first h; h is the CRC-32 of its id modulo ``heads``.
    """
    turns = common.materialised(numbered_turns(slim_turns(conversations)), "numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    content = ["k1", "k2", "k3", "words"]
    first = (turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", *content))).alias("head")))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    taken = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast(first.schema["head"].dataType)).otherwise(
        F.slice("head", 1, F.greatest("h", F.lit(1))))
    convs = common.materialised(
        convs.join(first, "base", "left").select("conv_id", "n", "h", taken.alias("head"))
        .withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    none = [F.lit(0).cast("long").alias(c) for c in content]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *none, "length")
    head = convs.select("conv_id", "length", F.posexplode("head").alias("i", "t")).select(
        "conv_id", (F.col("i") + 1).cast("long").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in content], "length")
    own = turns.where(F.col("pos") > h).join(convs.select("conv_id", "h", F.size("head").alias("b"), "length"), "conv_id").select(
        "conv_id", (F.col("b") + F.col("pos") - F.col("h")).cast("long").alias("depth"), *content, "length")
    return root.unionByName(head).unionByName(own)


def with_digests(paths: DataFrame, depths: int = BLOCK) -> DataFrame:
    """(conv_id, depth, block, d1, d2, p1, p2, check, words, last): digest of the prefix and of its parent at every depth."""
    hashed = [F.xxhash64(F.lit(s), "depth", "k1", "k2", "k3") for s in (11, 23)]
    rows = paths.select("conv_id", "depth", F.floor(F.col("depth") / depths).alias("block"), hashed[0].alias("t1"), hashed[1].alias("t2"),
                        F.xxhash64("k3", "k2", "k1", "depth").alias("turn_check"), "words", (F.col("depth") == F.col("length")).alias("last"), "length")
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.where(F.col("length") >= depths).groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    carry = whole.select("conv_id", "block", F.bit_xor("x1").over(earlier).alias("x1"), F.bit_xor("x2").over(earlier).alias("x2")).where("block > 0")
    later = rows.where("block > 0").join(carry, ["conv_id", "block"])
    none = F.lit(0).cast("long")
    both = rows.where("block = 0").withColumns({"x1": none, "x2": none}).unionByName(later)
    for i in "12":
        both = both.withColumn(f"d{i}", F.bit_xor(f"t{i}").over(running).bitwiseXOR(F.col(f"x{i}")))
    parents = [F.when(F.col("depth") > 0, F.col(f"d{i}").bitwiseXOR(F.col(f"t{i}"))).alias(f"p{i}") for i in "12"]
    return both.select("conv_id", "depth", "block", "d1", "d2", *parents, "turn_check", "words", "last").withColumn(
        "check", F.xxhash64("p1", "p2", "turn_check")).drop("turn_check")


def nodes_of(paths: DataFrame) -> DataFrame:
    """A row for each node: digest, parent, depth, members, owner, members that end here, words of its last text."""
    counted = paths.groupBy("d1", "d2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("owner"), F.count_if("last").alias("ends"), F.min("words").alias("words"),
        F.min("check").alias("least"), F.max("check").alias("most"))
    one = F.when(F.col("least") == F.col("most"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return counted.withColumn("n_convs", one).drop("least", "most")


ROWS = ["conv", "block", "depth", "d1", "d2", "p1", "p2", "own", "leaf", "tokens"]


def shard_rows(paths: DataFrame, nodes: DataFrame, depths: int = BLOCK) -> DataFrame:
    """What the shards work on: owned nodes, the paths above them, and what is carried into the blocks of long paths."""
    own = nodes.select(
        F.col("owner").alias("conv"), F.floor(F.col("depth") / depths).alias("block"), "depth", "d1", "d2", "p1", "p2", F.lit(1).alias("own"),
        (F.col("n_convs") == F.col("ends")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    none = F.lit(0).cast("long")
    ghosts = paths.select(F.col("conv_id").alias("conv"), "block", "depth", "d1", "d2", "p1", "p2", F.lit(0).alias("own"),
                          none.alias("leaf"), none.alias("tokens"))
    # The lowest node of each block but the last of a path takes what the path owns below.
    ends = ghosts.join(paths.where((F.col("block") > 0) & (F.col("depth") % depths == 0)).select(
        F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")), ["conv", "depth"], "left_semi")
    below = own.join(ends.select("conv").distinct(), "conv", "left_semi").groupBy("conv", "block").agg(
        F.sum("leaf").alias("leaf"), F.sum("tokens").alias("tokens"))
    deeper = Window.partitionBy("conv").orderBy(-F.col("block")).rangeBetween(Window.unboundedPreceding, -1)
    sums = ends.withColumn("end", F.lit(True)).unionByName(below, allowMissingColumns=True)
    carried = sums.select("end", *[c for c in ROWS if c not in ("own", "leaf", "tokens")], F.lit(0).alias("own"), *[
        F.coalesce(F.sum(c).over(deeper), none).alias(c) for c in ("leaf", "tokens")]).where("end").drop("end")
    return own.select(ROWS).unionByName(ghosts.select(ROWS)).unionByName(carried.select(ROWS))


def _accumulate(rows: dict[str, np.ndarray], depths: int) -> tuple[np.ndarray, ...]:
    """Sums of one shard: (d1, d2, children, leaves, tokens) of its nodes."""
    unit = np.ones(len(rows["conv"]), dtype=bool)
    unit[1:] = (rows["conv"][1:] != rows["conv"][:-1]) | (rows["block"][1:] != rows["block"][:-1])
    starts = np.flatnonzero(unit)
    used = np.add.reduceat(rows["own"] + rows["leaf"] + rows["tokens"], starts) > 0
    keep = used.repeat(np.diff(np.append(starts, len(unit))))
    rows = {name: column[keep] for name, column in rows.items()}
    high, low = rows["d1"].view(np.uint64), rows["d2"].view(np.uint64)
    deep = rows["depth"] > 0
    above = rows["p1"][deep].view(np.uint64), rows["p2"][deep].view(np.uint64)
    table = SlotTable(*distinct(np.concatenate([high, above[0]]), np.concatenate([low, above[1]])))
    own_slot, above_slot = table.slots(high, low), table.slots(*above)
    depth, parent = np.zeros(len(table), np.int64), np.full(len(table), -1, np.int64)
    depth[own_slot] = rows["depth"]
    inside = rows["depth"][deep] % depths != 0
    parent[own_slot[deep][inside]] = above_slot[inside]
    children, leaves, tokens = (np.zeros(len(table), np.int64) for _ in range(3))
    np.add.at(children, above_slot, rows["own"][deep])
    np.add.at(leaves, own_slot, rows["leaf"])
    np.add.at(tokens, own_slot, rows["tokens"])
    linked = np.flatnonzero(parent >= 0)
    linked = linked[np.argsort(-depth[linked], kind="stable")]
    for level in np.split(linked, np.flatnonzero(np.diff(depth[linked])) + 1) if len(linked) else []:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(tokens, parent[level], tokens[level])
    some = (children + leaves + tokens) > 0
    return tuple(x[some] for x in (table.high.view(np.int64), table.low.view(np.int64), children, leaves, tokens))


def _shards(batches: Iterator[pa.RecordBatch], depths: int, most: int) -> Iterator[pa.RecordBatch]:
    names = ["d1", "d2", "children", "leaves", "tokens"]
    held: dict[str, list[np.ndarray]] = {c: [] for c in ROWS}
    n = 0

    def ready(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _accumulate(rows, depths)], names=names)

    for batch in batches:
        for c in ROWS:
            held[c].append(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        n += batch.num_rows
        if n < most:
            continue
        rows = {c: np.concatenate(parts) for c, parts in held.items()}
        cut = np.flatnonzero((np.diff(rows["conv"]) != 0) | (np.diff(rows["block"]) != 0))
        end = cut[-1] + 1 if len(cut) else 0
        held = {c: [column[end:]] for c, column in rows.items()}
        n -= end
        if end:
            yield ready({c: column[:end] for c, column in rows.items()})
    if n:
        yield ready({c: np.concatenate(parts) for c, parts in held.items()})


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, conv_id) to comma-joined ids, a row for each digest of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2, ids = (batch.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.append(True, (np.diff(d1) != 0) | (np.diff(d2) != 0)))
        words = list(map(str, ids.tolist()))
        joined = [",".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(ids[starts]), pa.array(joined)],
                                         names=["d1", "d2", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each digest over its chunks, which come in order; only the running hash is held."""
    current, running, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()),
                                           pa.array([r[2] for r in done], pa.string())], names=["d1", "d2", "ends_sha256"])

    for batch in batches:
        for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (d1, d2) == current:
                running.update(b"," + ids.encode())
                continue
            if current is not None:
                done.append((*current, running.hexdigest()))
            current, running = (d1, d2), hashlib.sha256(ids.encode())
        if done:
            yield out()
            done = []
    if current is not None:
        done.append((*current, running.hexdigest()))
        yield out()


def end_hashes(paths: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of nodes at which conversations end."""
    ends = paths.where("last").select("d1", "d2", "conv_id")
    ranged = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    chunks = common.arrow(ranged, _joined_ids, "d1 long, d2 long, first long, ids string")
    dealt = chunks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return common.arrow(dealt, _hashed_ids, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame, depths: int = BLOCK, most: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of ``paths`` (as of ``rebuilt_paths``).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (members but one times the words of a node's last text, summed over its subtree), ends_sha256.  ``depths`` and ``most`` bound a block of a path and the rows of a shard.
    """
    paths = common.materialised(with_digests(paths, depths), "paths")
    nodes = common.materialised(nodes_of(paths), "nodes")
    dealt = shard_rows(paths, nodes, depths).repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    sums = common.arrow(dealt, functools.partial(_shards, depths=depths, most=most), "d1 long, d2 long, children long, leaves long, tokens long").groupBy("d1", "d2").agg(
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    return nodes.join(sums, ["d1", "d2"]).join(end_hashes(paths), ["d1", "d2"], "left").join(parents, ["p1", "p2"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
