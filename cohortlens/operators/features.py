"""Feature encoding as a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import to_number
from cohortlens.operators.profile import column_profile, feature_rule, number_type_rule, unpivot_cells

MISSING_LEVEL = "(missing)"
#: Levels of a category that get an indicator each; a category with more keeps ``FREQUENT`` and hashes the rest into ``BUCKETS``.
MAX_LEVELS, FREQUENT, BUCKETS = 20_000, 64, 1024


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns feed a model; ``wide`` has the frequent levels of the categories whose other levels are hashed."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    wide: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def require(self, df: DataFrame) -> None:
        absent = [c for c in self.columns if c not in df.columns]
        if absent:
            raise ValueError(f"missing features: {absent}")


def choose_features(df: DataFrame, target: str, id_col: str | None = None, junk: list[str] | None = None,
                    max_levels: int | None = None) -> FeatureSpec:
    """Features by the rules of ``feature_projection``; reads one profile row per column.

    Categories of any number of levels can be encoded (see ``bounded``); with ``max_levels`` a column
    with more is refused instead.
    """
    role = F.when(number_type_rule(df), "numeric").otherwise("categorical").alias("role")
    rows = column_profile(df).where(feature_rule(df, target, id_col, junk)).select("column", "n_unique", "position", role).orderBy("position").collect()
    wide = [r["column"] for r in rows if max_levels is not None and r["role"] == "categorical" and r["n_unique"] > max_levels]
    if wide:
        raise ValueError(f"too many levels to one-hot encode (limit {max_levels}): {wide}")
    spec = FeatureSpec(
        [r["column"] for r in rows if r["role"] == "numeric"],
        [r["column"] for r in rows if r["role"] == "categorical"],
    )
    if not spec.columns:
        raise ValueError("no usable features")
    return spec


def _level(column: str) -> str:
    return f"coalesce(CAST(`{column}` AS STRING), '{MISSING_LEVEL}')"


def _level_text(column: str, spec: FeatureSpec) -> str:
    """SQL of the level a row has: its own, or for a wide category its own if frequent, else a bucket."""
    level = _level(column)
    if column not in spec.wide:
        return level
    bucket = f"concat('#', pmod(xxhash64({level}), {BUCKETS}))"
    known = ", ".join(f"'{v}'" for v in spec.wide[column])
    return f"CASE WHEN {level} IN ({known}) THEN {level} ELSE {bucket} END" if known else bucket


def bounded(df: DataFrame, spec: FeatureSpec, max_levels: int = MAX_LEVELS, frequent: int = FREQUENT) -> FeatureSpec:
    """``spec`` with ``wide`` filled in, so that its encoder has a bounded number of levels, whatever the table holds.

    Sketches decide: one scan estimates the levels of every category, one more finds the ``frequent`` levels of
    those with over ``max_levels``.  Only these reach the driver.  Levels that cannot stand in a SQL text or look
    like a bucket are hashed like rare ones.
    """
    open_ = [c for c in spec.categorical if c not in spec.wide]
    if not open_:
        return spec
    counts = df.agg(*[F.approx_count_distinct(F.expr(_level(c))).alias(f"n{i}") for i, c in enumerate(open_)]).first()
    wide = [c for c, n in zip(open_, counts, strict=True) if n > max_levels]
    if not wide:
        return spec
    tops = df.agg(*[F.expr(f"approx_top_k({_level(c)}, {frequent}, {max(1000, 20 * frequent)})").alias(f"t{i}") for i, c in enumerate(wide)]).first()
    plain = {c: [t["item"] for t in top if not any(x in t["item"] for x in ("'", "\\", "__THIS__")) and not t["item"].startswith("#")]
             for c, top in zip(wide, tops, strict=True)}
    return FeatureSpec(spec.numeric, spec.categorical, spec.wide | plain)


def fit_encoder(train: DataFrame, spec: FeatureSpec, max_levels: int = MAX_LEVELS) -> tuple[PipelineModel, FeatureSpec]:
    """The fitted encoder, and the spec with the wide categories that it found."""
    spec = bounded(train, spec, max_levels)
    return encoder(spec).fit(train), spec


def level_stages(spec: FeatureSpec) -> list:
    """Raw columns -> ``<c>__num``, and one indicator vector ``<c>__hot`` for each category."""
    texts = [f"{_level_text(c, spec)} AS `{c}__text`" for c in spec.categorical]
    numbers = [f"CAST(`{c}` AS DOUBLE) AS `{c}__num`" for c in spec.numeric]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join([*numbers, *texts])} FROM __THIS__")]
    if spec.categorical:
        stages.append(StringIndexer(inputCols=[f"{c}__text" for c in spec.categorical],
                                    outputCols=[f"{c}__idx" for c in spec.categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in spec.categorical],
                                    outputCols=[f"{c}__hot" for c in spec.categorical], dropLast=True))
    return stages


def encoder(spec: FeatureSpec) -> Pipeline:
    """Raw columns -> ``features`` (plain numbers) and ``scaled`` (centred, unit deviation).

    Every known level gets an indicator, a level unseen in training gets zeros,
    and NULL is a level of its own; wide categories have buckets (see ``bounded``).  A NULL number
    fails the job; fill it first (``cleaning.default_fill``).
    """
    stages = level_stages(spec)
    hot = [f"{c}__hot" for c in spec.categorical]
    blocks, scaled_blocks = [], []
    if spec.numeric:
        stages.append(VectorAssembler(inputCols=[f"{c}__num" for c in spec.numeric], outputCol="numbers",
                                      handleInvalid="error"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True))
        blocks.append("numbers")
        scaled_blocks.append("numbers_scaled")
    stages.append(VectorAssembler(inputCols=blocks + hot, outputCol="features"))
    stages.append(VectorAssembler(inputCols=scaled_blocks + hot, outputCol="scaled"))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, spec: FeatureSpec) -> list[str]:
    """Names of the encoded vector: numbers first, then ``column_level``."""
    names = list(spec.numeric)
    levels = next((s.labelsArray for s in model.stages if hasattr(s, "labelsArray")), [])
    for column, labels in zip(spec.categorical, levels):
        names += [f"{column}_{label}" for label in labels]
    return names


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre and scale by the population deviation; a constant column becomes 0."""
    values = {c: to_number(df, c) for c in columns}
    facts = df.agg(F.struct(*[
        F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(c) for c, v in values.items()
    ]).alias("f")).scalar()
    return df.select(*[
        F.when(facts[c]["s"] == 0, values[c] - facts[c]["m"])
        .otherwise((values[c] - facts[c]["m"]) / facts[c]["s"]).alias(c) if c in values else F.col(c)
        for c in df.columns
    ])


def onehot_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, n): the column sums of the indicators."""
    return unpivot_cells(df, columns).groupBy(
        "column", F.coalesce("value", F.lit(MISSING_LEVEL)).alias("level")
    ).agg(F.count(F.lit(1)).alias("n"))


def unseen_levels(train: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level) of category values that the training table never had."""
    known = unpivot_cells(train, columns).where("value IS NOT NULL").distinct()
    seen = unpivot_cells(batch, columns).where("value IS NOT NULL").distinct()
    return seen.join(known, ["column", "value"], "left_anti").select("column", F.col("value").alias("level"))
