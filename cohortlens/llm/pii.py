"""Personal data: fixed patterns, and terms that reveal them by co-occurrence.

Base entities are e-mail addresses, IP addresses, card numbers and telephone numbers.  Terms are whole words
of ``LETTERS`` or more letters.  Over the whole corpus, a term t reveals an entity value e when more than the share
``disclosure`` of the documents with t hold e, P(e | t), and when that is no chance: the log-likelihood ratio of the
two document counts is at least ``evidence``.  The ratio also decides for a value in one or two documents; a word that
only its document holds reveals it as soon as the corpus has some eighty documents.  A revealing term is generalised
wherever it occurs in the corpus.

Everything is built-in column functions.  Document frequencies of terms, values and of both together are counts with
partial aggregation; a hot word or entity is folded before the shuffle.  Pairs are made in documents with an entity
only.  A term that no other document holds is looked for in these documents only.  Found spans are written without
the texts; the texts are never shuffled unless the found terms or spans outgrow a broadcast.

Defined cases: a null or empty text has no spans; repeated rows get the same spans and count as often as they stand;
null ids are kept; extra columns are ignored (``sanitised`` passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

#: Kinds in their fixed order; a match is dropped when its check fails.  Possessive parts never backtrack.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
LETTERS = 4
EDGE = r"[\p{L}\p{N}]"
WORD = rf"(?<!{EDGE})\p{{L}}{{{LETTERS},}}+(?!{EDGE})"
#: Least log-likelihood ratio: the 0.1 % point of chi-squared with one degree of freedom.
EVIDENCE = 10.83


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str | Column, matches: Column | None = None) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive.

    The gaps between matches are what ``split`` leaves; starts are running sums of gaps and matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, 0) if matches is None else matches
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPANS).alias("found"))

    def add(acc: Column, match: Column) -> Column:
        begin = acc["at"] + F.element_at(gaps, acc["i"] + 1)
        end = begin + F.length(match)
        one = F.struct(begin.alias("start"), end.alias("end"), match.alias("value"))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(matches, start, add, lambda acc: acc["found"])).otherwise(F.array().cast(SPANS))


def _base(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base``: array of (start, kind, end, value), sorted by start, then kind."""
    may = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+"),
           "ip": F.lit(True), "card": F.lit(True)}
    out = docs.withColumns({f"m_{k}": F.when(may[k], F.regexp_extract_all(text, F.lit(p), 0)).otherwise(F.array().cast("array<string>"))
                            for k, p in PATTERNS.items()})
    found = out.withColumns({f"s_{k}": spans_of(F.col(text), p, F.col(f"m_{k}")) for k, p in PATTERNS.items()})
    def checked(kind: str) -> Column:
        number = list(PATTERNS).index(kind)
        return F.transform(F.filter(f"s_{kind}", lambda s: _passes(kind, s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    every = F.concat(*[checked(kind) for kind in PATTERNS])
    return found.withColumn("base", F.array_sort(every)).drop(*[f"m_{k}" for k in PATTERNS], *[f"s_{k}" for k in PATTERNS])


def _ratio(both: Column, one: Column, other: Column, every: int) -> Column:
    """Log-likelihood ratio of two marks of ``every`` documents, from the documents with both and with either."""
    def part(seen: Column, a: Column, b: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen.cast("double") * every / (a.cast("double") * b))).otherwise(0.0)

    return 2 * (part(both, one, other) + part(one - both, one, every - other) + part(other - both, every - one, other)
                + part(every - one - other + both, every - one, every - other))


def _outside(terms: Column, base: Column) -> Column:
    return F.filter(terms, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def find_personal_data(docs: DataFrame, disclosure: float = 0.5, evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans): every row's spans as array of (start, kind, end), sorted; kinds are numbered as in ``KINDS``."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))
    found = common.materialised(_base(texts, "text").select(
        "id", "text_hash", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
        F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("entities"),
        F.when(F.size("base") > 0, words).alias("words")), "pii")
    private = found.where(F.size("base") > 0)

    def terms(column) -> Column:
        return F.array_distinct(F.transform(column, F.lower))

    shown = private.select(F.explode(terms("words")).alias("term"), "entities").select("term", F.explode("entities").alias("entity")).groupBy(
        "term", "entity").agg(F.count("*").alias("n_both"))
    frequency = texts.select(F.explode(terms(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    values = private.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    close = shown.join(frequency, "term").where(F.col("n_both") > disclosure * F.col("n_term")).join(values, "entity")
    revealing = common.materialised(
        close.where(_ratio(F.col("n_both"), F.col("n_term"), F.col("n_entity"), found.count()) >= evidence).groupBy("term").agg(
            (F.max("n_both") < F.max("n_term")).alias("elsewhere")), "pii-terms")

    def holding(rows: DataFrame, column, wanted: DataFrame) -> DataFrame:
        placed = rows.select("id", "text_hash", F.explode(column).alias("word")).withColumn("term", F.lower("word"))
        return placed.join(common.broadcast_within(wanted), "term").select("id", "text_hash", "word")

    hits = holding(private, "words", revealing.select("term"))
    wide = revealing.where("elsewhere").select("term")
    if not wide.isEmpty():
        hits = hits.unionByName(holding(texts, words, wide))
    hits = common.materialised(hits.groupBy(F.col("id").alias("own"), F.col("text_hash").alias("own_hash")).agg(
        F.sort_array(F.collect_set("word")).alias("held")), "pii-hits")
    here = F.col("id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash"))
    pattern = F.concat(F.lit(f"(?<!{EDGE})(?:"), F.array_join("held", "|"), F.lit(f")(?!{EDGE})"))
    more = F.transform(spans_of(F.col("text"), pattern), lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end")))
    extra = common.materialised(
        texts.join(common.broadcast_within(hits, F.lit(32) + 24 * F.size("held")), here).select("own", "own_hash", more.alias("more")).dropDuplicates(
            ["own", "own_hash"]), "pii-more")
    joined = found.join(common.broadcast_within(extra, F.lit(32) + 12 * F.size("more")), here, "left")
    return joined.select("id", "text_hash", F.array_sort(F.concat(
        "base", F.coalesce(_outside(F.col("more"), F.col("base")), F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def spans_text(spans: Column, kinds: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """All rows with every span replaced by its kind in angle brackets; spans that overlap give one replacement."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
    spans = common.materialised(found.groupBy(F.col("id").alias("_own"), F.col("text_hash").alias("_hash")).agg(F.first("spans").alias("_spans")), "pii-spans")
    text = F.col(text_col)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(tags, s["kind"] + 1))
        out = F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def done(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    joined = docs.join(common.broadcast_within(spans, F.lit(32) + 12 * F.size("_spans")),
                       F.col(id_col).eqNullSafe(F.col("_own")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")), "left")
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", begin, cut, done)).otherwise(text)
    changed = joined.withColumn(text_col, clean)
    if length_col and length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(F.size("_spans") > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return changed.select(*docs.columns)
