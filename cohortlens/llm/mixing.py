"""Mix a corpus to target weights with soft domain membership.

A naive Bayes classifier, counted on all labelled rows, gives each document a posterior over domains from
binned text features.  Document rates x >= 0 then minimise the sum over domains k of
(expected tokens of k - target of k)^2, with expected tokens of k the sum of
rate x tokens x posterior, by projected gradient steps from rate 1.  A rate depends on the posterior alone,
so the steps run on one row for each distinct feature vector with its summed tokens: a few sums per step
reach the driver, and no step touches the documents.

Everything is built-in column functions.  A hot source or a hot vector is folded by partial aggregation.

Defined cases: a null or empty text has 0 tokens and its own bins; labels with a null part or without a
document are ignored; repeated labels count each; with one or no labelled domain every posterior is 1 for it
(``unlabelled`` without any); a domain without target gets weight 0; null ids are kept; extra columns are
passed on by ``mixed``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

STEPS = 60
#: Steps without a clearly smaller miss (2 %) after which a target counts as out of reach.
PATIENCE = 8
TOLERANCE = 1e-3
BINS = 12


def _share_bin(part: Column, chars: Column) -> Column:
    """0 for none, then by halves of the share: 1/2 and more is 1, 1/4 and more is 2, ..."""
    return F.when(part <= 0, F.lit(0)).otherwise(
        F.least(F.floor(F.log2(chars / part)) + 1, F.lit(BINS - 1)).cast("int"))


def text_features(text: Column, lang: Column | None = None) -> tuple[Column, Column]:
    """(tokens, bins): words of a text and its binned features."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(text)

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    words = F.size(F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), 0))
    parts = [kept("[^!?]+"), kept("[^#$%&*]+"), kept("[^|]+"), kept("[^0-9]+"), kept("[^A-Z]+"), kept("[^\\n]+")]
    bins = [F.least(F.floor(F.log2(words + 1)), F.lit(BINS - 1)).cast("int"),
            F.when(words > 0, F.least(F.floor(chars / words), F.lit(BINS - 1))).otherwise(0).cast("int"),
            *[_share_bin(p, chars) for p in parts]]
    if lang is not None:
        bins.append(F.pmod(F.xxhash64(lang), F.lit(BINS)).cast("int"))
    return words.cast("long"), F.array(*bins)


def _constants(values: list[float]) -> Column:
    """A constant array that the optimizer folds, so that plans with other numbers share their compiled code."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def classifier(features: DataFrame, labelled: DataFrame, n_features: int) -> tuple[list[str], list[list[float]], list[float]]:
    """Domains, log P(bin | domain) of (feature, bin) by domain, and log priors, with add-one smoothing."""
    own = labelled.where("id is not null and domain is not null").join(features.select("id", "bins"), "id")
    counted = own.select("domain", F.posexplode("bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").count().collect()
    counts = {(r["domain"], r["feature"], r["bin"]): r["count"] for r in counted}
    totals: dict[str, int] = {}
    for (domain, feature, _), n in counts.items():
        if feature == 0:
            totals[domain] = totals.get(domain, 0) + n
    domains = sorted(totals) or ["unlabelled"]
    table = [[math.log((counts.get((d, f, b), 0) + 1) / (totals.get(d, 0) + BINS)) for d in domains]
             for f in range(n_features) for b in range(BINS)]
    whole = sum(totals.values())
    return domains, table, [math.log((totals.get(d, 0) + 1) / (whole + len(domains))) for d in domains]


def log_posteriors(bins: Column, table: list[list[float]], priors: list[float]) -> Column:
    """Array of the log posteriors of the domains, up to a constant."""
    k, n_features = len(priors), len(table) // BINS
    flat = _constants([v for row in table for v in row])

    def of(domain: int) -> Column:
        out = F.lit(priors[domain])
        for f in range(n_features):
            out = out + F.element_at(flat, (F.element_at(bins, f + 1) + f * BINS) * k + (domain + 1))
        return out

    return F.array(*[of(domain) for domain in range(k)])


def fit_rates(vectors: DataFrame, k: int, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[float], float]:
    """The scaled residuals of the steps taken, k numbers each, and the largest miss of a target as a share of all tokens.

    ``vectors`` has p, the posteriors, and n, the tokens of all documents with them.  A residual is divided by
    the domain's present share, with which no direction is steeper than 1.
    """
    n, p = F.col("n"), F.col("p")
    taken: list[float] = []
    share: np.ndarray | None = None
    best: tuple[float, list[float]] = (math.inf, [])
    stale = 0
    for _ in range(steps + 1):
        row = vectors.withColumn("at", _steps_of(taken, k)).agg(
            F.sum("n"), *[F.sum(n * F.col(c) * p[i]) for c in ("at.x", "at.ahead") for i in range(k)]).first()
        whole = float(row[0] or 0)
        if not whole:
            return [], 0.0
        totals, leading = (np.array([float(v) for v in part]) / whole for part in (row[1:k + 1], row[k + 1:]))
        share = np.maximum(totals, 1e-9) if share is None else share
        miss = float(np.abs(totals - targets).max())
        if miss < best[0]:
            stale = 0 if miss < 0.98 * best[0] else stale + 1
            best = miss, list(taken)
        else:
            stale += 1
        if miss <= tolerance or len(taken) >= steps * k or stale >= PATIENCE:
            break
        taken += ((leading - targets) / share).tolist()
    return best[1], best[0]


def _steps_of(taken: list[float], k: int) -> Column:
    """(x, before, ahead) after the given steps: from the point ahead of x by momentum, down the gradient, projected on x >= 0.

    All numbers sit in one folded array, so every step runs the same compiled code.
    """
    flat, p = _constants([0.0, *taken]), F.col("p")
    start = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("before"), F.lit(1.0).alias("ahead"))

    def step(at: Column, i: Column) -> Column:
        slope = F.lit(0.0)
        for j in range(k):
            slope = slope + p[j] * F.element_at(flat, i * k + (j + 2))
        x = F.greatest(F.lit(0.0), at["ahead"] - slope)
        return F.struct(x.alias("x"), at["x"].alias("before"), (x + (x - at["x"]) * ((i + 1) / (i + 4))).alias("ahead"))

    numbers = F.filter(F.sequence(F.lit(0), F.size(flat)), lambda i: (i + 1) * k < F.size(flat))
    return F.aggregate(numbers, start, step)


def rate_of(taken: list[float], k: int) -> Column:
    """The rate after the given steps."""
    return _steps_of(taken, k)["x"]


def domain_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain): quality and toxicity of each labelled document, such as ``q1t0``."""
    return labels.select(F.col(id_col).alias("id"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          lang_col: str | None = "lang", steps: int = STEPS, keep: list[str] | None = None) -> DataFrame:
    """Every row with n_tokens, domain, posterior, rate and copies added (replacing columns of these names).

    Texts are read once; the rows with their features are written to the shared folder.  ``keep`` names the
    columns to pass on besides the id, all if not given.

    ``labelled`` is (id, domain).  ``weights`` are the wanted shares of the token total, taken relative to the
    domains that are there; with none of them wanted, rates stay 1.  ``domain`` is the likeliest one;
    ``copies`` rounds the rate up or down by a hash of the id, so that its mean is the rate.
    """
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else None
    tokens, bins = text_features(F.col(text_col), lang)
    n_features = 8 + (lang is not None)
    added = ["n_tokens", "domain", "posterior", "rate", "copies"]
    kept = [c for c in docs.columns if c not in added and (keep is None or c in keep or c == id_col)]
    marked = common.materialised(docs.select(*kept, tokens.alias("n_tokens"), bins.alias("_bins")), "mix-rows")
    features = marked.select(F.col(id_col).alias("id"), F.col("n_tokens").alias("n"), F.col("_bins").alias("bins"))
    domains, table, priors = classifier(features, labelled, n_features)
    k = len(domains)

    logs = features.groupBy("bins").agg(F.sum("n").alias("n")).withColumn("logs", log_posteriors(F.col("bins"), table, priors))
    odds = logs.withColumn("odds", F.transform("logs", lambda v: F.exp(v - F.array_max("logs"))))
    whole = odds.withColumn("whole", F.aggregate("odds", F.lit(0.0), lambda a, v: a + v))
    vectors = common.materialised(whole.select("bins", "n", F.transform("odds", lambda v: v / F.col("whole")).alias("p")), "mix-vectors")
    wanted = [max(weights.get(d, 0.0), 0.0) for d in domains]
    taken = fit_rates(vectors, k, [w / sum(wanted) for w in wanted], steps)[0] if sum(wanted) else []
    names = F.array(*[F.lit(d) for d in domains])
    p = F.col("p")
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    rated = vectors.select(F.col("bins").alias("_bins"), F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("domain"),
                           F.array_max(p).alias("posterior"), rate_of(taken, k).alias("rate"))
    return marked.join(common.broadcast_within(rated, F.lit(128)), "_bins").select(
        *kept, "n_tokens", "domain", "posterior", "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"))
