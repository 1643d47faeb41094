"""Named queries over the test tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (decontaminate, mixing, neighbours, pii, prefix_trie, secrets, simhash, spelling, substrings, suffixes, token_files,
                            toxicity, urlrules)
from cohortlens.llm.common import read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


#: (host, path, verdict) of the fixed rules of op7.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


def _url_sql() -> str:
    longest_first = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = {h + p: f"(ends_with('.' || host, '.{h}') AND starts_with(path, '{p}'))" for h, p, _ in URL_RULES}
    rule = " ".join(f"WHEN {fits[h + p]} THEN '{h}{p}'" for h, p, _ in longest_first)
    verdict = " ".join(f"WHEN {fits[h + p]} THEN '{v}'" for h, p, v in longest_first)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(r, '^[^/?#]*', 0), '{urlrules.UPPER}', '{urlrules.LOWER}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""


@query("op7_url_rules", _url_sql())
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])))
    judged = urlrules.judge_urls(read_table(spark, sf_dir, "pages"), rules)
    return judged.withColumnRenamed("id", "page_id")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[number(k) for k in pii.KINDS],
                        F.sha2(pii.spans_text(F.col("spans"), len(pii.PATTERNS)), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Wanted token shares of op1 and the pipeline.
MIX_WEIGHTS = {"q1t0": 0.8, "q0t0": 0.15, "q1t1": 0.05}


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_of(read_table(spark, sf_dir, "labels"))
    found = mixing.mixed(read_table(spark, sf_dir, "documents"), labelled, MIX_WEIGHTS, keep=["doc_id"])
    return found.select("doc_id", "n_tokens", "domain", "posterior", "rate", "copies")


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_nn_descent")
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(read_table(spark, sf_dir, "conversations")))


#: The public tokenizer of op12, by name in its package; it drops white space.  Its id for the end of a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID, by_word=True)
    return token_files.read_token_files(spark, path)


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(read_table(spark, sf_dir, "documents"), slip=199))
