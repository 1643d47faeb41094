"""Training, cross-validation and comparison of classifiers, and the regression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import to_number
from cohortlens.operators.features import MAX_LEVELS, FeatureSpec, bounded, feature_names, fit_encoder, level_stages
from cohortlens.operators.metrics import class_metrics, fold_summary
from cohortlens.operators.splits import random_split, stratified_folds, stratified_split
from cohortlens.operators.target import event_value
from cohortlens.operators.trees import Fit, fit_trees
from cohortlens.session import enable_checkpoints

LOGISTIC, FOREST, BOOSTED, REGULARISED = (
    "Logistic Regression", "Random Forest", "Gradient Boosting", "Regularised Boosting",
)


@dataclass(frozen=True)
class ZooSizes:
    """Sizes of the compared models."""

    logistic_iterations: int = 1000
    forest_trees: int = 200
    forest_depth: int = 12
    boosted_rounds: int = 150
    boosted_depth: int = 3
    regularised_rounds: int = 200
    regularised_depth: int = 4
    rate: float = 0.08
    seed: int = 42


@dataclass(frozen=True)
class Balance:
    """Class counts of a training table and the weights they give."""

    events: int
    others: int

    @property
    def total(self) -> int:
        return self.events + self.others

    def balanced(self, y: str = "y") -> Column:
        others, events = self.balanced_weights
        return F.when(F.col(y) == 1, events).otherwise(others)

    @property
    def balanced_weights(self) -> tuple[float, float]:
        """Weights of other rows and events that give both classes the same sum."""
        return self.total / (2.0 * max(self.others, 1)), self.total / (2.0 * max(self.events, 1))

    @property
    def positive_weights(self) -> tuple[float, float]:
        return 1.0, max(self.others / max(self.events, 1), 1.0)


@dataclass
class TrainedZoo:
    models: dict[str, PipelineModel]
    spec: FeatureSpec
    names: list[str]
    balance: Balance
    test: DataFrame | None = None
    train: DataFrame | None = None
    split: DataFrame | None = None
    cv: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def classifiers(balance: Balance, sizes: ZooSizes) -> dict[str, object]:
    """The four estimators; each writes its own output columns.

    The logistic penalty equals an inverse strength of 1 on the summed loss.
    Boosting here has no leaf penalty and samples columns per node, not per tree.  Trees are trained by ``tree_models``.
    """
    deep = {"labelCol": "y", "featuresCol": "features", "seed": sizes.seed}
    built = {
        LOGISTIC: LogisticRegression(labelCol="y", featuresCol="scaled", weightCol="w_balanced", maxIter=sizes.logistic_iterations,
                                     regParam=1.0 / max(balance.total, 1), elasticNetParam=0.0, standardization=False),
        FOREST: RandomForestClassifier(weightCol="w_balanced", numTrees=sizes.forest_trees, maxDepth=sizes.forest_depth,
                                       minInstancesPerNode=2, **deep),
        BOOSTED: GBTClassifier(maxIter=sizes.boosted_rounds, stepSize=sizes.rate, maxDepth=sizes.boosted_depth, **deep),
        REGULARISED: GBTClassifier(weightCol="w_positive", maxIter=sizes.regularised_rounds, stepSize=sizes.rate,
                                   maxDepth=sizes.regularised_depth, subsamplingRate=0.9, featureSubsetStrategy="0.9", **deep),
    }
    for i, (name, estimator) in enumerate(built.items()):
        built[name] = estimator.setPredictionCol(f"pred{i}").setRawPredictionCol(f"raw{i}").setProbabilityCol(f"prob{i}")
    return built


def class_balance(labelled: DataFrame, y: str = "y") -> Balance:
    row = labelled.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    return Balance(row[0], row[1])


def model_input(df: DataFrame, spec: FeatureSpec, target: str, id_col: str, positive: object | None = None,
                rule: str = "auto", extra: list[str] | None = None) -> DataFrame:
    """Only the columns a model needs, with the 0/1 column ``y``; unlabelled rows drop out."""
    spec.require(df)
    kept = list(dict.fromkeys([id_col, *spec.columns, *(extra or [])]))
    return df.select(*kept, event_value(df, target, positive, rule).alias("y")).where("y IS NOT NULL")


def tree_fit(name: str, balance: Balance, sizes: ZooSizes, fold: int = -1) -> Fit:
    """How a tree model is trained: its estimator and the weights of the classes."""
    weights = {FOREST: balance.balanced_weights, REGULARISED: balance.positive_weights}
    return Fit(classifiers(balance, sizes)[name], weights.get(name, (1.0, 1.0)), fold)


def indexed(levels: PipelineModel, spec: FeatureSpec) -> dict[str, int]:
    """The index column of each category, and how many levels it has."""
    found = next((s.labelsArray for s in levels.stages if hasattr(s, "labelsArray")), [])
    return {f"{c}__idx": len(labels) for c, labels in zip(spec.categorical, found, strict=True)}


def fit_zoo(train: DataFrame, spec: FeatureSpec, sizes: ZooSizes | None = None, only: list[str] | None = None,
            parallelism: int = 4, partitions: int | None = None, max_levels: int = MAX_LEVELS
            ) -> tuple[dict[str, PipelineModel], FeatureSpec, list[str], Balance]:
    """Fit the encoder once, keep the encoded table, and fit all models on it.

    The logistic model and the trees share the cluster, if ``parallelism`` allows.  The spec that comes
    back names the categories that were found to be wide.
    """
    sizes = sizes or ZooSizes()
    enable_checkpoints(train.sparkSession)
    balance = class_balance(train)
    if min(balance.events, balance.others) == 0:
        raise ValueError("training needs rows of both classes")
    prepared, spec = fit_encoder(train, spec, max_levels)
    chosen = [n for n in classifiers(balance, sizes) if only is None or n in only]
    trees, numbers, levels = [n for n in chosen if n != LOGISTIC], [f"{c}__num" for c in spec.numeric], indexed(prepared, spec)
    encoded = prepared.transform(train.repartition(partitions) if partitions else train).select(
        "y", *(["scaled", balance.balanced().alias("w_balanced")] if LOGISTIC in chosen else []),
        *([F.lit(-1).alias("fold"), *[f"`{c}`" for c in [*numbers, *levels]]] if trees else [])).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(some: list[str]) -> list:
        if some == [LOGISTIC]:
            return [classifiers(balance, sizes)[LOGISTIC].fit(encoded)]
        return fit_trees(encoded, numbers, levels, [tree_fit(n, balance, sizes) for n in some])

    try:
        groups = [g for g in ([LOGISTIC] if LOGISTIC in chosen else [], trees) if g]
        with ThreadPool(max(1, min(parallelism, len(groups)))) as pool:
            fitted = pool.map(inheritable_thread_target(train.sparkSession)(fit), groups, chunksize=1)
    finally:
        encoded.unpersist()
    models = {n: PipelineModel([*prepared.stages, m]) for g, found in zip(groups, fitted, strict=True) for n, m in zip(g, found, strict=True)}
    return {n: models[n] for n in chosen}, spec, feature_names(prepared, spec), balance


def probability_column(model: PipelineModel) -> str:
    return model.stages[-1].getOrDefault("probabilityCol")


def predictions(models: dict[str, PipelineModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., model, score): the encoder runs once, each model adds one array item."""
    first = next(iter(models.values()))
    encoded = PipelineModel(first.stages[:-1]).transform(df).select(*keep, "features", "scaled")
    for model in models.values():
        encoded = model.stages[-1].transform(encoded)
    scores = F.array(*[
        F.struct(F.lit(n).alias("model"), vector_to_array(probability_column(m))[1].alias("score"))
        for n, m in models.items()
    ])
    return encoded.select(*keep, F.inline(scores))


def others_scaling(facts: list, fold: int, columns: int) -> list[tuple[float, float]]:
    """(mean, sample deviation) of each number over all folds but one, from (fold, n, mean and deviation of each number) rows."""
    rows = [r for r in facts if r["fold"] != fold]
    total = sum(r["n"] for r in rows)
    out = []
    for i in range(columns):
        mean = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        spread = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows)
        out.append((mean, (spread / max(total - 1, 1)) ** 0.5))
    return out


def fold_metrics(df: DataFrame, spec: FeatureSpec, id_col: str, k: int = 5, sizes: ZooSizes | None = None,
                 only: list[str] | None = None, parallelism: int = 4, seed: int = 42, partitions: int | None = None,
                 max_levels: int = MAX_LEVELS) -> DataFrame:
    """(fold, model, tn, fp, fn, tp, accuracy, ...): each of ``k`` stratified folds, scored by models of the other folds.

    Rows are encoded once, with the levels of all folds, and kept.  What a fit sees follows from the other
    folds alone: a level that they lack is a column of zeros to it, as for an unseen level, and its scaling
    comes from their counts, means and deviations, which one aggregate gives for every fold.  All fits
    run on that table: the trees of all folds grow side by side, while ``parallelism`` bounds the logistic fits, and one job measures all scores.
    """
    sizes = sizes or ZooSizes()
    enable_checkpoints(df.sparkSession)
    spec = bounded(df, spec, max_levels)
    folded = stratified_folds(df, "y", id_col, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    numbers, hot = [f"{c}__num" for c in spec.numeric], [f"{c}__hot" for c in spec.categorical]
    levels = Pipeline(stages=level_stages(spec)).fit(folded)
    index = indexed(levels, spec)
    encoded = levels.transform(folded.repartition(partitions) if partitions else folded).select(
        "y", "fold", *[f"`{c}`" for c in [*numbers, *hot, *index]]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = encoded.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("events"),
            *[f(f"`{c}`").alias(f"{a}{i}") for i, c in enumerate(numbers) for f, a in ((F.avg, "m"), (F.var_pop, "v"))]).collect()
        features = VectorAssembler(inputCols=numbers + hot, outputCol="features")
        scaled = VectorAssembler(inputCols=[f"s{i}" for i in range(len(numbers))] + hot, outputCol="scaled")

        def prepared(fold: int, model: str, held_out: bool) -> DataFrame:
            rows = encoded.where(F.col("fold") == fold if held_out else F.col("fold") != fold)
            if model != LOGISTIC:
                return features.transform(rows)
            ways = others_scaling(facts, fold, len(numbers))
            return scaled.transform(rows.withColumns({
                f"s{i}": (F.col(f"`{c}`") - m) / s if s else F.lit(0.0) for i, (c, (m, s)) in enumerate(zip(numbers, ways, strict=True))}))

        def balance_without(fold: int) -> Balance:
            others = [r for r in facts if r["fold"] != fold]
            events = sum(r["events"] for r in others)
            balance = Balance(events, sum(r["n"] for r in others) - events)
            if min(balance.events, balance.others) == 0:
                raise ValueError("training needs rows of both classes")
            return balance

        def fit(some: list[tuple[int, str]]) -> list:
            if some[0][1] != LOGISTIC:
                return fit_trees(encoded.where("fold IS NOT NULL"), numbers, index, [tree_fit(n, balance_without(fold), sizes, fold) for fold, n in some])
            balance = balance_without(some[0][0])
            rows = prepared(some[0][0], LOGISTIC, False).select("y", "scaled", balance.balanced().alias("w_balanced"))
            return [classifiers(balance, sizes)[LOGISTIC].fit(rows)]

        def scored(fold: int, name: str, model) -> DataFrame:
            score = vector_to_array(model.getProbabilityCol())[1]
            return model.transform(prepared(fold, name, True)).select("y", "fold", F.lit(name).alias("model"), score.alias("score"))

        names = [n for n in (LOGISTIC, FOREST, BOOSTED, REGULARISED) if only is None or n in only]
        # The trees of all folds first: they take longest.
        trees = [(fold, n) for n in names if n != LOGISTIC for fold in range(k)]
        groups = ([trees] if trees else []) + [[(fold, LOGISTIC)] for fold in range(k) if LOGISTIC in names]
        with ThreadPool(max(1, min(parallelism, len(groups)))) as pool:
            fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), groups, chunksize=1)
        scores = [scored(*item, model) for g, found in zip(groups, fitted, strict=True) for item, model in zip(g, found, strict=True)]
        measured = class_metrics(reduce(DataFrame.unionByName, scores), ["model", "fold"])
        rows = measured.collect()  # one for each model and fold
    finally:
        encoded.unpersist()
        folded.unpersist()
    return df.sparkSession.createDataFrame(rows, measured.schema)


def cross_validate(df: DataFrame, spec: FeatureSpec, id_col: str, k: int = 5, **more) -> DataFrame:
    """(model, cv_accuracy, cv_accuracy_std, ...) over ``k`` stratified folds; ``more`` as in ``fold_metrics``."""
    return fold_summary(fold_metrics(df, spec, id_col, k, **more))


def train_classifiers(
    df: DataFrame,
    target: str,
    id_col: str,
    spec: FeatureSpec,
    positive: object | None = None,
    rule: str = "auto",
    sizes: ZooSizes | None = None,
    only: list[str] | None = None,
    cv_folds: int | None = 5,
    test_share: float = 0.2,
    parallelism: int = 4,
    partitions: int | None = None,
    max_levels: int = MAX_LEVELS,
) -> TrainedZoo:
    """Split, fit the zoo on the training part, and cross-validate on all rows.

    ``partitions`` deals the rows out anew before fitting; without it their places, on which bagging
    depends, stay as they are.
    """
    table = model_input(df, spec, target, id_col, positive, rule).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        split = stratified_split(table, "y", id_col, test_share)
        train, test = split.where(~F.col("is_test")), split.where("is_test")
        split = split.where("is_test IS NOT NULL")
        models, spec, names, balance = fit_zoo(train, spec, sizes, only, parallelism, partitions, max_levels)
        result = TrainedZoo(models, spec, names, balance, test=test, train=train, split=split)
        if cv_folds:
            result.cv = cross_validate(table, spec, id_col, cv_folds, sizes=sizes, only=only, parallelism=parallelism, partitions=partitions,
                                       max_levels=max_levels)
    finally:
        table.unpersist()
    return result


def forest_importance(model: PipelineModel, names: list[str], df: DataFrame, top: int = 15) -> DataFrame:
    """(feature, importance) of a tree model, largest first; one row per encoded feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(names, values))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


def train_regression(df: DataFrame, measure: str, id_col: str, spec: FeatureSpec, test_share: float = 0.2,
                     seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Unregularised linear regression of ``measure``; gives the model and the test rows.

    The measure itself, the id and the target do not belong into ``spec``.
    """
    spec.require(df)
    if measure in spec.columns or id_col in spec.columns:
        raise ValueError("the measure and the id cannot be features")
    table = df.select(id_col, *spec.columns, to_number(df, measure).alias("y")).where("y IS NOT NULL")
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        split = random_split(table, id_col, test_share, seed)
        train, test = split.where(~F.col("is_test")), split.where("is_test")
        prepared, _ = fit_encoder(train, spec)
        encoded = prepared.transform(train).select("y", "scaled")
        fitted = LinearRegression(featuresCol="scaled", labelCol="y", solver="auto", regParam=0.0).fit(encoded)
    finally:
        table.unpersist()
    return PipelineModel([*prepared.stages, fitted]), test
