"""Additive explanations of single predictions.

Contributions stay one array per row until they are reported, so the strongest
ones of a row are found by sorting that array, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import scratch_path

#: Features of a leaf up to which it has a table of all patterns, and cells of the tables built at once.
TABLE_BITS, TABLE_CELLS = 12, 1 << 15
#: Inner nodes of a subtree whose leaves share one table, if the rows are so many times its patterns.
JOINT, JOINT_ROWS = 7, 4
#: Rows explained at once, cells of rows held for one round of tables, and bytes of trees in one broadcast.
CHUNK, HELD_CELLS, SLICE_BYTES = 8192, 4 << 20, 16 << 20

# Words and sentences of the explanations.
RAISES, LOWERS = "Tăng rủi ro", "Giảm rủi ro"
BASE_TEXT = "Giá trị kỳ vọng nền của mô hình (base value) ≈ %.4f."
UP_TEXT = "Yếu tố làm tăng nguy cơ nghỉ việc: "
DOWN_TEXT = "Yếu tố giúp giảm nguy cơ: "
SIGN_TEXT = "SHAP dương đẩy xác suất nghỉ việc lên; SHAP âm kéo xác suất xuống so với mức nền."
NO_GLOBAL_TEXT = "Chưa đủ dữ liệu để giải thích SHAP toàn cục."
GLOBAL_TEXT = "Theo SHAP toàn cục, các yếu tố ảnh hưởng mạnh nhất tới dự báo nghỉ việc là: "
GLOBAL_END = ". Giá trị mean(|SHAP|) càng cao thì feature càng quan trọng trên mẫu đã giải thích."
SECTION_TITLE = "Giải thích mô hình (SHAP)"


def shap_linear(df: DataFrame, weights: dict[str, float], intercept: float, id_col: str) -> DataFrame:
    """(id, base_value, unit, contributions) of a linear score in log-odds.

    A feature contributes its weight times its distance from the feature's mean.
    """
    means = df.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in weights]).alias("m")).scalar()
    base = F.lit(float(intercept))
    for c, w in weights.items():
        base = base + means[c] * F.lit(float(w))
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c).cast("double") - means[c])).alias("shap"))
        for c, w in weights.items()
    ])
    return df.select(id_col, base.alias("base_value"), F.lit("log-odds").alias("unit"), cells.alias("contributions"))


def _label(names: list[str], values: Column) -> Column:
    """Array of (feature, shap) out of an array of numbers."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.transform(values, lambda v, i: F.struct(listed[i].alias("feature"), v.alias("shap")))


def _shap_logistic(encoded: DataFrame, model: LogisticRegressionModel, names: list[str], id_col: str) -> DataFrame:
    # As many numbers as the model has features.
    means = encoded.agg(Summarizer.mean(F.col("scaled"))).first()[0].toArray()
    weights = model.coefficients.toArray()
    base = float(model.intercept + weights @ means)
    middle, slope = (F.array(*[F.lit(float(v)) for v in values]) for values in (means, weights))
    parts = F.zip_with(F.zip_with(vector_to_array("scaled"), middle, lambda x, m: x - m), slope, lambda d, w: d * w)
    return encoded.select(id_col, F.lit(base).alias("base_value"), F.lit("log-odds").alias("unit"),
                          _label(names, parts).alias("contributions"))


def tree_nodes(model, spark) -> tuple[pd.DataFrame, list[float], bool]:
    """Node table of a fitted tree ensemble, its tree weights, and whether it boosts.

    The size is that of the model (trees times nodes), not of the data.
    """
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories",
    ).toPandas()
    return nodes, list(model.treeWeights), isinstance(model, GBTClassificationModel)


@dataclass
class FlatTree:
    """A tree as arrays over its nodes: node 0 is the root, and a leaf has no ``low`` child (-1).

    Rows with ``x[feature] <= cut`` go to ``low``, the others to ``high``.  ``share`` is the part of its
    parent's training weight that a node has, ``value`` what a leaf adds to the score.
    """

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())


def flat_trees(nodes: pd.DataFrame, weights: list[float], boosts: bool) -> list[FlatTree]:
    """The trees of a node table (``tree_nodes``).

    Boosted trees add up to half the log-odds; forests average class shares.  A split of an indicator lists
    the values that go left; it becomes a cut at a half.
    """
    trees = []
    for tree, table in nodes.groupby("treeID"):
        table = table.sort_values("id")
        stats = np.stack([np.asarray(v, dtype=float) for v in table.impurityStats])
        cover = stats[:, 0] if boosts else stats.sum(axis=1)
        left, right = table.leftChild.to_numpy(int), table.rightChild.to_numpy(int)
        listed = [list(v) for v in table.leftCategoriesOrThreshold]
        inner = left >= 0
        flag = inner & (table.numCategories.to_numpy() >= 0)
        swapped = np.array([f and 0.0 not in v for f, v in zip(flag, listed, strict=True)])
        cut = np.array([0.5 if f else (v[0] if v else 0.0) for f, v in zip(flag, listed, strict=True)])
        share = np.ones(len(table))
        for child in (left, right):
            share[child[inner]] = cover[child[inner]] / np.maximum(cover[inner], 1e-300)
        value = 2.0 * weights[int(tree)] * table.prediction.to_numpy(float) if boosts else (
            stats[:, 1] / np.maximum(cover, 1e-300) / len(weights))
        trees.append(FlatTree(table.featureIndex.to_numpy(int), cut, np.where(swapped, right, left), np.where(swapped, left, right), share, value))
    return trees


def _leaves(tree: FlatTree) -> list[tuple]:
    """(node, features, low, high, share) of each leaf, features in the order of their first split on the path."""
    found, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree.low[node] < 0:
            found.append((node, list(path), *(np.array([b[i] for b in path.values()], dtype=float) for i in range(3))))
            continue
        f, cut = int(tree.feature[node]), float(tree.cut[node])
        old = path.get(f, (-np.inf, np.inf, 1.0))
        for child, low, high in ((int(tree.low[node]), -np.inf, cut), (int(tree.high[node]), cut, np.inf)):
            stack.append((child, {**path, f: (max(old[0], low), min(old[1], high), old[2] * tree.share[child])}))
    return found


def pattern_tables(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Contributions (leaf, feature, pattern) of leaves with d features each, for every pattern of met conditions.

    Bit i of a pattern tells whether feature i of the leaf meets the path's conditions.  Products over the
    features are taken at Gauss points, where the Shapley integral of degree d - 1 is exact.
    """
    n, d = shares.shape
    points, gauss = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
    points, gauss = (points[:, None, None] + 1) / 2, gauss[:, None] / 2
    off = shares * (1 - points)
    on = off + points
    product = np.broadcast_to(values[:, None], (len(points), n, 1))
    for i in range(d):
        product = np.concatenate([product * off[:, :, i, None], product * on[:, :, i, None]], axis=2)
    out = np.empty((n, d, 1 << d))
    for i in range(d):
        # What the other features give is the same whether feature i meets its conditions or not.
        met = product.reshape(len(points), n, -1, 2, 1 << i)[:, :, :, 1]
        others = sum(part * c[:, None, None] for part, c in zip(met, gauss / on[:, :, i], strict=True))
        own, share = out[:, i].reshape(n, -1, 2, 1 << i), shares[:, i, None, None]
        own[:, :, 0], own[:, :, 1] = -share * others, (1 - share) * others
    return out


def _leaf_tables(tree: FlatTree, leaves: list[tuple]) -> dict[int, np.ndarray]:
    """Pattern tables of the leaves of up to ``TABLE_BITS`` features, built for all leaves of equal width at once."""
    tables: dict[int, np.ndarray] = {}
    for d in {len(leaf[1]) for leaf in leaves if 0 < len(leaf[1]) <= TABLE_BITS}:
        same = [leaf for leaf in leaves if len(leaf[1]) == d]
        step = max(1, TABLE_CELLS >> d)
        for low in range(0, len(same), step):
            part = same[low:low + step]
            found = pattern_tables(tree.value[[leaf[0] for leaf in part]], np.stack([leaf[4] for leaf in part]))
            tables.update((leaf[0], t) for leaf, t in zip(part, found, strict=True))
    return tables


def _met_below(tree: FlatTree, node: int, met: np.ndarray, features: list[int], below: np.ndarray) -> Iterator[tuple]:
    """(child, pattern, features) of both children of a node that rows pass with ``below``."""
    f = int(tree.feature[node])
    known = f in features
    bit = 1 << (features.index(f) if known else len(features))
    for child, side in ((int(tree.low[node]), below), (int(tree.high[node]), ~below)):
        yield child, np.where(side, met, met & ~bit) if known else met + side * bit, features if known else [*features, f]


def _inner(tree: FlatTree, limit: int) -> dict[int, list[int]]:
    """The inner nodes below and at each node that has ``limit`` of them at most."""
    found: dict[int, list[int]] = {}
    order, at = [0], 0
    while at < len(order):
        node, at = order[at], at + 1
        order += [] if tree.low[node] < 0 else [int(tree.low[node]), int(tree.high[node])]
    for node in reversed(order):
        if tree.low[node] < 0:
            found[node] = []
            continue
        low, high = found.get(int(tree.low[node])), found.get(int(tree.high[node]))
        if low is not None and high is not None and len(low) + len(high) < limit:
            found[node] = [node, *low, *high]
    return found


def _joint_table(tree: FlatTree, top: int, inner: list[int], features: list[int], tables: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Feature -> contributions of all leaves under ``top``, by the pattern at ``top`` and one bit for each of its ``inner`` nodes."""
    codes = np.arange(1 << (len(features) + len(inner)))
    out: dict[int, np.ndarray] = {}
    stack = [(top, codes & ((1 << len(features)) - 1), features)]
    while stack:
        node, met, path = stack.pop()
        if tree.low[node] < 0:
            for f, contribution in zip(path, tables.get(node, ()), strict=node in tables):
                out[f] = out.get(f, 0.0) + contribution[met]
            continue
        stack += _met_below(tree, node, met, path, (codes >> (len(features) + inner.index(node))) & 1 == 1)
    return out


def tree_contributions(x: np.ndarray, tree: FlatTree, out: np.ndarray) -> None:
    """Add the path-dependent contributions of one tree to ``out``; ``x`` and ``out`` are (feature, row).

    Going down the tree each row carries the pattern of conditions it meets, one bit a feature.  At the top of
    a small subtree (``JOINT`` inner nodes) the pattern, with a bit for each of those nodes, looks up what all its leaves
    contribute together.  Tables are built once, however many rows there are.
    """
    leaves = _leaves(tree)
    tables = _leaf_tables(tree, leaves)
    wide = [(tree.value[node], np.array(features), low, high, share) for node, features, low, high, share in leaves if len(features) > TABLE_BITS]
    joint, small = {}, _inner(tree, JOINT)
    for start in range(0, x.shape[1], CHUNK):
        rows, sums = x[:, start:start + CHUNK], out[:, start:start + CHUNK]
        if wide:
            sums += leaf_contributions(rows.T, wide).T
        held = np.empty(rows.shape[1])
        stack = [(0, np.zeros(rows.shape[1], np.int64), [])]
        while stack:
            node, met, features = stack.pop()
            if node not in small or small[node] and JOINT_ROWS << (len(features) + len(small[node])) > x.shape[1]:
                stack += _met_below(tree, node, met, features, rows[int(tree.feature[node])] <= tree.cut[node])
                continue
            if node not in joint:
                joint[node] = _joint_table(tree, node, small[node], features, tables)
            if joint[node]:
                for j, n in enumerate(small[node]):
                    met = met + ((rows[int(tree.feature[n])] <= tree.cut[n]).astype(np.int64) << (len(features) + j))
                for f, contribution in joint[node].items():
                    sums[f] += np.take(contribution, met, out=held, mode="clip")


def leaf_contributions(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Path-dependent tree contributions of a batch of rows.

    The game of one leaf is a product over its features, so each Shapley sum is an
    integral over [0, 1] of a polynomial, which Gauss points give exactly.
    """
    out = np.zeros_like(x, dtype=float)
    depth = max((len(leaf[1]) for leaf in leaves), default=1)
    points, gauss = np.polynomial.legendre.leggauss(max(1, (depth + 1) // 2))
    points, gauss = (points + 1) / 2, gauss / 2
    for value, features, low, high, share in leaves:
        if len(features) == 0:
            continue
        cells = x[:, features]
        met = ((cells > low) & (cells <= high)).astype(float)
        total = np.zeros_like(met)
        for t, w in zip(points, gauss):
            factors = share * (1 - t) + met * t
            total += w * factors.prod(axis=1, keepdims=True) / factors
        out[:, features] += value * (met - share) * total
    return out


def base_of(trees: list[FlatTree]) -> float:
    return float(sum(tree.value[node] * np.prod(share) for tree in trees for node, _, _, _, share in _leaves(tree)))


def tree_slices(trees: list[FlatTree], limit: int) -> list[list[FlatTree]]:
    """Runs of trees of at most ``limit`` bytes each (a larger tree alone)."""
    out: list[list[FlatTree]] = [[]]
    held = 0
    for tree in trees:
        if out[-1] and held + tree.nbytes > limit:
            out.append([])
            held = 0
        out[-1].append(tree)
        held += tree.nbytes
    return out


def _shap_trees(encoded: DataFrame, model, names: list[str], id_col: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Every slice of the trees is one broadcast within ``limit`` and one pass over the rows, which add up what they got."""
    trees = flat_trees(*tree_nodes(model, encoded.sparkSession))
    base, boosts = base_of(trees), isinstance(model, GBTClassificationModel)
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(id_col, vector_to_array("features").alias("x"), F.array().cast("array<double>").alias("parts"))

    def explain(shared):
        def sums(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = np.ascontiguousarray(np.concatenate([np.stack(rows["x"].to_numpy()) for rows in held]).T)
            out = np.zeros_like(x)
            for tree in shared.value:
                tree_contributions(x, tree, out)
            done = 0
            for rows in held:
                parts, before = out[:, done:done + len(rows)].T, rows["parts"].to_list()
                done += len(rows)
                yield rows.assign(parts=list(parts if not len(before[0]) else parts + np.stack(before)))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, cells = [], 0
            for batch in batches:
                for low in range(0, len(batch), CHUNK):
                    held.append(batch.iloc[low:low + CHUNK])
                    cells += len(held[-1]) * len(held[-1]["x"].iloc[0])
                    if cells >= HELD_CELLS:
                        yield from sums(held)
                        held, cells = [], 0
            if held:
                yield from sums(held)
        return add

    for part in tree_slices(trees, limit):
        shared = encoded.sparkSession.sparkContext.broadcast(part)
        rows = rows.mapInPandas(explain(shared), f"`{id_col}` {kind}, x array<double>, parts array<double>")
    return rows.select(id_col, F.lit(base).alias("base_value"), F.lit("log-odds" if boosts else "probability").alias("unit"),
                       _label(names, F.col("parts")).alias("contributions"))


def explain_rows(model: PipelineModel, df: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """(id, base_value, unit, contributions) for every row.

    Base value plus contributions is the probability of a forest, and the log-odds
    of the other models.
    """
    encoded = PipelineModel(model.stages[:-1]).transform(df).select(id_col, "features", "scaled")
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        return _shap_logistic(encoded, last, names, id_col)
    return _shap_trees(encoded, last, names, id_col)


def shap_long(explained: DataFrame, id_col: str) -> DataFrame:
    """(id, base_value, unit, feature, shap): one row per contribution."""
    return explained.select(id_col, "base_value", "unit", F.inline("contributions"))


def shap_global(explained: DataFrame, id_col: str, top: int | None = 15, sample: float | None = None) -> DataFrame:
    """(feature, mean_abs_shap, n) over all rows, or over a sampled share if asked for."""
    rows = explained.sample(sample, 42) if sample else explained
    table = shap_long(rows, id_col).groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("mean_abs_shap"), "feature")
    return table.limit(top) if top else table


def _strongest(top: int) -> Column:
    keyed = F.transform("contributions", lambda c: F.struct(
        (-F.abs(c["shap"])).alias("k"), c["feature"].alias("feature"), c["shap"].alias("shap")))
    return F.slice(F.array_sort(keyed), 1, top)


def shap_local(explained: DataFrame, id_col: str, top: int = 10) -> DataFrame:
    """(id, rank, feature, shap, abs_shap, direction, base_value, unit): strongest first."""
    ranked = explained.select(id_col, "base_value", "unit", F.posexplode(_strongest(top)))
    return ranked.select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("col.feature").alias("feature"), F.col("col.shap").alias("shap"),
        F.abs("col.shap").alias("abs_shap"), F.when(F.col("col.shap") >= 0, RAISES).otherwise(LOWERS).alias("direction"),
        "base_value", "unit",
    )


def _listing(items: Column, sign: str) -> Column:
    return F.array_join(F.transform(items, lambda c: F.format_string(f"%s (%{sign}.4f)", c["feature"], c["shap"])), "; ")


def shap_report(explained: DataFrame, id_col: str, top: int = 10, side: int = 5, told: int = 3) -> DataFrame:
    """(id, base_value, unit, contributions, top_increase, top_decrease, narrative), one row per row."""
    best = _strongest(top)
    up, down = F.filter(best, lambda c: c["shap"] > 0), F.filter(best, lambda c: c["shap"] < 0)
    plain = lambda items: F.transform(items, lambda c: F.struct(
        c["feature"].alias("feature"), c["shap"].alias("shap"), F.when(c["shap"] >= 0, RAISES).otherwise(LOWERS).alias("direction")))
    sentences = F.array_compact(F.array(
        F.format_string(BASE_TEXT, F.col("base_value")),
        F.when(F.size(up) > 0, F.concat(F.lit(UP_TEXT), _listing(F.slice(up, 1, told), "+"), F.lit("."))),
        F.when(F.size(down) > 0, F.concat(F.lit(DOWN_TEXT), _listing(F.slice(down, 1, told), ""), F.lit("."))),
        F.lit(SIGN_TEXT),
    ))
    return explained.select(
        id_col, "base_value", "unit", plain(best).alias("contributions"),
        plain(F.slice(up, 1, side)).alias("top_increase"), plain(F.slice(down, 1, side)).alias("top_decrease"),
        F.array_join(sentences, " ").alias("narrative"),
    )


def global_narrative(importance: DataFrame, top: int = 5) -> DataFrame:
    """One row of text on the features with the largest mean contribution."""
    parts = importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(top).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mean_abs_shap")).alias("k"), "feature"))).alias("l")
    )
    listed = F.array_join(F.transform("l", lambda c: F.format_string("%s (mean|SHAP|=%.4f)", c["feature"], -c["k"])), "; ")
    return parts.select(F.when(F.size("l") == 0, NO_GLOBAL_TEXT).otherwise(F.concat(
        F.lit(GLOBAL_TEXT), listed,
        F.lit(GLOBAL_END),
    )).alias("narrative"))


def shap_section(explained: DataFrame, id_col: str, scored: DataFrame, model_name: str, top: int = 10) -> DataFrame:
    """(id, title, model_name, prediction, global_narrative, local_narrative, global_top, local_top), one row per row.

    ``scored`` has the id, probability_pct, risk_band and prediction.  The strongest ``top`` features of all
    rows are found once and are the same in every row.
    """
    found = shap_global(explained, id_col, top).collect()
    strongest = explained.sparkSession.createDataFrame([(r["feature"], r["mean_abs_shap"]) for r in found], "feature string, mean_abs_shap double")
    told = global_narrative(strongest).first()["narrative"]
    items = [F.struct(F.lit(r["feature"]).alias("feature"), F.lit(r["mean_abs_shap"]).alias("value")) for r in found]
    values = F.array(*items) if items else F.array().cast("array<struct<feature:string,value:double>>")
    chosen = scored.select(id_col, F.struct("probability_pct", "risk_band", "prediction").alias("prediction"))
    return shap_report(explained, id_col, top).join(chosen, id_col).select(
        id_col, F.lit(SECTION_TITLE).alias("title"), F.lit(model_name).alias("model_name"), "prediction", F.lit(told).alias("global_narrative"),
        F.col("narrative").alias("local_narrative"), values.alias("global_top"), F.col("contributions").alias("local_top"))
