"""Store and load fitted pipelines with the features they need, as versions with a manifest.

A version is a folder of pipelines, small tables and ``manifest`` (one JSON row).  It is written under
a name of its own and becomes visible by one rename, so readers see whole versions only.  The manifest
names the input by a fingerprint of its rows; a version that was trained on other rows or with other
parameters is stale and is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.features import FeatureSpec
from cohortlens.operators.quality import comparable

METADATA = "model string, folder string, numeric array<string>, categorical array<string>, encoded array<string>, wide map<string, array<string>>"


class StaleModel(ValueError):
    """The stored models belong to other rows or parameters."""


@dataclass
class StoredModels:
    """What a version holds."""

    models: dict[str, PipelineModel]
    spec: FeatureSpec
    names: list[str]
    version: int = 0
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _folder(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def save_models(spark: SparkSession, path: str, models: dict[str, PipelineModel], spec: FeatureSpec,
                names: list[str]) -> None:
    """Every pipeline in its own folder, and one small metadata table."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{_folder(name)}")
    rows = [(n, _folder(n), spec.numeric, spec.categorical, names, spec.wide) for n in models]
    spark.createDataFrame(rows, METADATA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_models(spark: SparkSession, path: str, only: list[str] | None = None) -> tuple[dict[str, PipelineModel], FeatureSpec, list[str]]:
    rows = spark.read.schema(METADATA).json(f"{path}/metadata").collect()
    chosen = [r for r in rows if only is None or r["model"] in only]
    if not chosen:
        raise FileNotFoundError(f"no such model under {path}: {only}")
    models = {r["model"]: PipelineModel.load(f"{path}/{r['folder']}") for r in chosen}
    first = chosen[0]
    spec = FeatureSpec(list(first["numeric"]), list(first["categorical"]), {c: list(v) for c, v in (first["wide"] or {}).items()})
    return models, spec, list(first["encoded"])


def input_fingerprint(df: DataFrame) -> str:
    """Names, types, row count and the sum of 64-bit row hashes: the same for the same rows in any order."""
    hashed = F.xxhash64(*[comparable(df, c) for c in df.columns]).cast("decimal(20,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("h")).first()
    return f"{df.schema.simpleString()}|{row['n']}|{row['h']}"


def _files(spark: SparkSession, root: str):
    """Hadoop's file context, whose rename fails if the new name is taken, and a maker of paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.FileContext.getFileContext(hadoop.Path(root).toUri(), spark._jsc.hadoopConfiguration()), hadoop.Path


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.util().exists(place(path))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions, in ascending order."""
    files, path = _files(spark, root)
    if not files.util().exists(path(root)):
        return []
    found = [re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in files.util().listStatus(path(root))]
    return sorted(int(m[1]) for m in found if m)


def publish(spark: SparkSession, root: str, models: dict[str, PipelineModel], spec: FeatureSpec, names: list[str], inputs: str,
            params: dict | None = None, tables: dict[str, DataFrame] | None = None) -> int:
    """Write a new version below ``root`` and return its number; a number taken meanwhile is passed over."""
    files, path = _files(spark, root)
    incoming = f"{root}/incoming-{uuid.uuid4().hex}"
    save_models(spark, incoming, models, spec, names)
    for name, table in (tables or {}).items():
        table.write.parquet(f"{incoming}/tables/{name}")
    manifest = json.dumps({"inputs": inputs, "params": params or {}, "models": list(models), "tables": sorted(tables or {})}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{incoming}/manifest")
    number = max(versions(spark, root), default=0) + 1
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        try:
            files.rename(path(incoming), path(f"{root}/v{number}"), plain)
            return number
        except Exception:
            if not files.util().exists(path(f"{root}/v{number}")):
                raise
            number += 1


def version_tables(spark: SparkSession, root: str, number: int, names: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/v{number}/tables/{t}") for t in names}


def load_version(spark: SparkSession, root: str, inputs: str | None = None, params: dict | None = None, only: list[str] | None = None,
                 version: int | None = None) -> StoredModels:
    """The newest version, or the one asked for; ``inputs`` and ``params`` given must be those it was trained with."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no version {version or ''} under {root}")
    number = found[-1] if version is None else version
    at = f"{root}/v{number}"
    manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    if inputs is not None and manifest["inputs"] != inputs:
        raise StaleModel(f"version {number} was trained on other rows")
    if params is not None and manifest["params"] != json.loads(json.dumps(params)):
        raise StaleModel(f"version {number} was trained with other parameters")
    models, spec, names = load_models(spark, at, only)
    return StoredModels(models, spec, names, number, version_tables(spark, root, number, manifest["tables"]))
