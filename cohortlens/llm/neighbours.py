"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node, named by the smallest id; of its members only as many as an answer can hold are
kept.  The graph starts from exact neighbours within leaves of a few random-hyperplane trees; a leaf of over
``LEAF`` nodes is dealt into random parts.  A round of NN-descent then joins every node's neighbours, forward
and reverse, with their vectors, scores all pairs in which one is new, and keeps for each node the best
``k``; a pair leaves its task only if it beats the node's worst neighbour.  Rounds end when few lists change.
Of a hub's reverse neighbours, ``k`` (by hash) are joined per round: that is a part of the method, which
samples, and loses no row of the index.

A query starts at its own node and its neighbours, expands the best unexpanded nodes of a pool of ``pool``
and ends when all of the pool are expanded.  Scores are inner products in double precision.

Every step is a Spark join on a node or a query; a task holds one leaf part, some nodes' lists or one query.
Rounds are written to the shared folder.

Defined cases: vectors that are null, zero or empty, or hold null or non-finite components, take no part;
vectors of another length than the most common one (ties: the shorter) neither; of repeated ids the
smallest vector counts; null ids are ignored; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common

LEAF, TREES = 1536, 5
NODES_AT_ONCE = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Stored vectors (float64 bytes) of a binary column as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): the rows that take part, components as double."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usual = rows.where(F.size("vector") == (sizes["n"] if sizes else 0))
    return usual.groupBy("id").agg(F.min("vector").alias("vector"))


def _packed(df: DataFrame) -> DataFrame:
    """(node, vector): vectors as float64 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["node", "vector"])
    return common.arrow(df.select("node", "vector"), run, "node long, vector binary")


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first column, sorted) of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(t: pa.Table, i: int) -> pa.Array:
    return t.column(i).combine_chunks() if t.column(i).num_chunks != 1 else t.column(i).chunk(0)


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the best ``k`` distinct others of each owner, best first (ties to the smaller)."""
    order = np.lexsort((-score, other, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (other[order][1:] == other[order][:-1])
    order = order[~same]
    order = order[np.lexsort((other[order], -score[order], owner[order]))]
    own = owner[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - head.repeat(np.diff(np.concatenate([head, [len(own)]])))
    return order[place < k]


LINKS = "node long, other long, score double"


def _links(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(score)], ["node", "other", "score"])


def start_links(vectors: DataFrame, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """Exact neighbours within the leaves of random-hyperplane trees."""
    n = vectors.count()
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((m.shape[1], trees * max(levels, 1)))
            signs = (m @ planes > 0).reshape(len(m), trees, -1)[:, :, :levels]
            code = (signs << np.arange(levels)).sum(axis=2) * trees + np.arange(trees)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code[:, t].astype(np.int64)), batch.column(1)], ["node", "leaf", "vector"])

    placed = common.arrow(vectors, leaves, "node long, leaf long, vector binary")
    sizes = common.arrow(vectors, leaves, "node long, leaf long, vector binary").groupBy("leaf").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("node", "leaf"), F.ceil(F.col("n") / leaf))
    dealt = placed.join(sizes, "leaf").select(F.xxhash64("leaf", parts).alias("part"), "node", "vector").repartition("part").sortWithinPartitions("part")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1):
            part, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                m = _matrix(_one(t, 2).take(pa.array(own)))
                for low in range(0, len(own), 512):
                    score = m[low:low + 512] @ m.T
                    score[np.arange(len(score)), low + np.arange(len(score))] = -np.inf
                    top = np.argpartition(-score, min(k, len(own) - 1), axis=1)[:, :k]
                    owner = node[own][low:low + 512].repeat(top.shape[1])
                    other, value = node[own][top.ravel()], np.take_along_axis(score, top, axis=1).ravel()
                    real = np.isfinite(value)
                    yield _links(owner[real], other[real], value[real])

    return common.arrow(dealt, near, LINKS)


def merged(links: DataFrame, known: DataFrame | None, k: int) -> DataFrame:
    """(node, other, score, new): the best ``k`` of each node; ``new`` are those that ``known`` does not have."""
    rows = links.select("node", "other", "score", F.lit(True).alias("new"))
    rows = rows if known is None else rows.unionByName(known.select("node", "other", "score", F.lit(False).alias("new")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1 << 16):
            node, other, score, new = (t.column(i).to_numpy() for i in range(4))
            order = np.lexsort((new, other, node))  # an old link hides its repetition
            first = np.ones(len(order), bool)
            first[1:] = (node[order][1:] != node[order][:-1]) | (other[order][1:] != other[order][:-1])
            order = order[first]
            keep = order[_best(node[order], other[order], score[order], k)]
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(other[keep]), pa.array(score[keep]), pa.array(new[keep])],
                                             ["node", "other", "score", "new"])

    return common.arrow(rows.repartition("node").sortWithinPartitions("node"), run, LINKS + ", new boolean")


def descent_round(graph: DataFrame, vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """Links that the neighbours of a common node give each other, where they beat a node's worst link."""
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("worst"))
    by_hash = Window.partitionBy("centre").orderBy(F.xxhash64("member", F.lit(seed)), "member")
    forward = graph.select(F.col("node").alias("centre"), F.col("other").alias("member"), "new")
    back = graph.select(F.col("other").alias("centre"), F.col("node").alias("member"), "new").withColumn(
        "r", F.row_number().over(by_hash)).where(F.col("r") <= k).drop("r")
    known = vectors.join(worst, "node", "left").select(F.col("node").alias("member"), F.coalesce("worst", F.lit(float("-inf"))).alias("worst"), "vector")
    active = forward.unionByName(back).groupBy("centre", "member").agg(F.max("new").alias("new"))
    rows = active.join(known, "member").select("centre", "member", "new", "worst", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1 << 13):
            centre, member, new, worst = (t.column(i).to_numpy() for i in range(4))
            m = _matrix(_one(t, 4))
            head = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
            size = np.diff(np.concatenate([head, [len(centre)]]))
            out = []
            for width in np.unique(size):  # centres with as many members are multiplied together
                first = head[size == width]
                for low in range(0, len(first), NODES_AT_ONCE):
                    rows = first[low:low + NODES_AT_ONCE, None] + np.arange(width)
                    score = np.matmul(m[rows], m[rows].transpose(0, 2, 1))
                    fresh = new[rows][:, :, None] | new[rows][:, None, :]
                    good = fresh & (score > worst[rows][:, :, None]) & ~np.eye(width, dtype=bool)
                    c, a, b = np.nonzero(good)
                    out.append((member[rows[c, a]], member[rows[c, b]], score[c, a, b]))
            if out:
                node, other, score = (np.concatenate(x) for x in zip(*out, strict=True))
                keep = _best(node, other, score, k)
                yield _links(node[keep], other[keep], score[keep])

    return common.arrow(rows.repartition("centre").sortWithinPartitions("centre"), run, LINKS)


def neighbour_graph(vectors: DataFrame, k: int = 32, trees: int = TREES, leaf: int = LEAF, settled: float = 0.02, max_rounds: int = 8, seed: int = 3) -> DataFrame:
    """(node, other, score, new): ``k`` near neighbours of each node.  Rounds end when at most ``settled`` of the links are new."""
    graph = common.materialised(merged(start_links(vectors, k, trees, leaf, seed), None, k), "graph")
    for number in range(max_rounds):
        graph = common.materialised(merged(descent_round(graph, vectors, k, seed + number), graph, k), "graph")
        total, fresh = graph.agg(F.count("*"), F.sum(F.col("new").cast("long"))).first()
        if not total or fresh <= settled * total:
            break
    return graph


def _settle(query: int, vector: bytes, ids: np.ndarray, scores: np.ndarray, visited: np.ndarray, expanded: set, pool: int, wide: int) -> list:
    order = np.lexsort((ids, -scores))[:pool]
    frontier = [i for i in ids[order].tolist() if i not in expanded][:wide]
    return [query, vector, ids[order].tolist(), scores[order].tolist(), visited.tolist(), frontier]


def greedy_search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, pool: int = 192, wide: int = 96) -> DataFrame:
    """(query, ids, scores): the pool of each query node, best first, without the node itself."""
    lists = common.materialised(graph.groupBy("node").agg(F.collect_list("other").alias("others")), "graph-lists")
    kind = pa.schema([("query", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())),
                      ("visited", pa.list_(pa.int64())), ("frontier", pa.list_(pa.int64())), ("expanded", pa.list_(pa.int64()))])

    def step(key, left: pa.Table, right: pa.Table) -> pa.Table:
        s = left.slice(0, 1).to_pylist()[0]
        vector = np.frombuffer(s["vector"], np.float64)
        cand = right.column("cand").to_numpy()
        score = np.einsum("nd,d->n", _matrix(_one(right, right.schema.get_field_index("cand_vector"))), vector) if len(cand) else np.zeros(0)
        ids = np.concatenate([np.array(s["ids"], np.int64), cand])
        scores = np.concatenate([np.array(s["scores"], np.float64), score])
        visited = np.concatenate([np.array(s["visited"], np.int64), cand])
        expanded = set(s["expanded"]) | set(s["frontier"])
        row = _settle(s["query"], s["vector"], ids, scores, visited, expanded, pool, wide)
        return pa.Table.from_pylist([dict(zip(kind.names, [*row, sorted(expanded)], strict=True))], schema=kind)

    own = queries.select(F.col("node").alias("query"))
    empty = F.array().cast("array<long>")
    state = own.join(vectors.withColumnRenamed("node", "query"), "query").select(
        "query", "vector", empty.alias("ids"), F.array().cast("array<double>").alias("scores"), F.array("query").alias("visited"),
        F.array("query").alias("frontier"), empty.alias("expanded"))
    state = common.materialised(state, "search")
    while not (open_ := state.where(F.size("frontier") > 0)).isEmpty():
        asked = open_.select("query", F.explode("frontier").alias("node"))
        seen = open_.select("query", "visited")
        met = asked.join(lists, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")).join(seen, "query").select(
            "query", F.explode(F.array_except("others", "visited")).alias("cand"))
        scored = met.join(vectors.select(F.col("node").alias("cand"), F.col("vector").alias("cand_vector")), "cand").select(
            F.col("query").alias("for_query"), "cand", "cand_vector")
        moved = open_.groupBy("query").cogroup(scored.groupBy("for_query")).applyInArrow(step, state.schema)
        state = common.materialised(moved.unionByName(state.where(F.size("frontier") == 0)), "search")
    return state.select("query", "ids", "scores")


def nearest(table: DataFrame, wanted, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32, pool: int = 192, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every row for which column ``wanted`` of ``id`` holds, its own row left out."""
    rows = common.materialised(clean_vectors(table, id_col, vector_col), "vectors")
    same = Window.partitionBy("vector").orderBy("id")
    members = common.materialised(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1), "members")
    named = members.groupBy("vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    named = common.materialised(named, "nodes")
    vectors = common.materialised(_packed(named), "node-vectors")
    graph = neighbour_graph(vectors, k, **options)
    asking = common.materialised(rows.where(wanted(F.col("id"))).join(named.select("vector", "node"), "vector").select("id", "node"), "queries")
    found = greedy_search(asking.select("node").distinct(), vectors, graph, pool)
    self_score = vectors_self(vectors)
    hits = found.select(F.col("query").alias("node"), F.inline(F.arrays_zip(F.col("ids").alias("hit"), F.col("scores").alias("score")))).unionByName(
        found.select(F.col("query").alias("node"), F.col("query").alias("hit")).join(self_score, "node"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    rows_of = hits.join(named.select(F.col("node").alias("hit"), "ids"), "hit").select("node", "score", F.explode("ids").alias("vec_id")).withColumn(
        "r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    lists = rows_of.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    return asking.join(lists, "node").select("id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, top).alias("best")).select(
        F.col("id").alias("query_id"), F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def vectors_self(vectors: DataFrame) -> DataFrame:
    """(node, score): the inner product of each vector with itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.einsum("nd,nd->n", m, m))], ["node", "score"])
    return common.arrow(vectors, run, "node long, score double")
