"""Quality rules whose cutoffs carry an exact bound on false rejections. DataFrame functions only."""
from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stash

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Share of good documents that all rules of a stratum together may reject, and the chance that any stratum exceeds it.
ALPHA, DELTA = 0.05, 0.1
#: Rejected good documents weigh this many rejected bad ones when a cutoff is chosen among the safe ones.
COST = 20
#: Cutoffs of every signal, in thousandths.
CUTOFFS = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500)
#: signal: (numerator, denominator); a document is rejected if the ratio reaches the cutoff.
SIGNALS = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def count_of(text: str, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of every whole text. Words of 5-word windows that occur twice are found by sorting the
    windows' hashes with their positions, in texts that have any equal hashes; each step is linear or n log n in the text."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    base = text.select(
        "doc_id", "stratum", F.filter(F.split("text", WORD_SPLIT), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"), count_of("text", "#*$%&|<>").alias("n_symbols"),
        count_of("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), count_of("text", "!").alias("n_exclamations"))
    counts = ["doc_id", "stratum", "word_chars", "n_symbols", "n_capitals", "n_exclamations"]
    n = F.size("words")
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("words", i, 5))))
    base = base.select(*counts, n.cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), grams.alias("grams"))
    counts += ["n_words", "n_lines", "n_dup_lines"]
    ordered = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    base = base.select(*counts, ordered.alias("ordered"))
    same = F.filter("ordered", lambda s, k: ((k > 0) & (F.get("ordered", k - 1)["g"] == s["g"])) | F.coalesce(F.get("ordered", k + 1)["g"] == s["g"], F.lit(False)))
    base = base.select(*counts, F.array_sort(F.transform(same, lambda s: s["i"])).alias("repeated"))
    covered = F.aggregate("repeated", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
                          lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return base.select(*counts, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series behind a shift of 8; relative error under 1e-12 for x >= 1."""
    y, shift = x + 8.0, F.lit(0.0)
    for k in range(8):
        shift = shift + F.ln(x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p) for k < n*p, else 1. The terms fall from X = k down; those under 1e-16 of the sum
    are beyond 12 standard deviations and left out."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 50).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
                        lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * total)


def bucket(numerator: str, denominator: str) -> Column:
    """How many cutoffs the ratio reaches."""
    reached = [F.when(F.col(numerator) * 1000 >= F.col(denominator) * c, 1).otherwise(0) for c in CUTOFFS]
    total = reached[0]
    for r in reached[1:]:
        total = total + r
    return F.when((F.col(denominator) > 0), total).otherwise(0)


def cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, signal, level): reject documents that reach at least `level` cutoffs of the signal.

    All labelled documents serve as the holdout, as no signal is learned. For a stratum and signal, the share of good
    documents rejected at a cutoff is certified to be under alpha / signals if the exact binomial tail of the rejected
    good ones is at most delta / (strata * signals) (Bonferroni). Cutoffs are tested from the most lenient one on until
    the first failure, so that one test level serves them all. Among the certified ones the most useful is taken."""
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    signals = F.array(*(F.struct(F.lit(name).alias("signal"), bucket(*own).alias("bucket")) for name, own in SIGNALS.items()))
    each = measures.join(quality, "doc_id").select("stratum", "quality", F.inline(signals))
    counts = each.groupBy("stratum", "signal", "bucket").agg(F.sum((F.col("quality") == 1).cast("bigint")).alias("good"), F.sum((F.col("quality") != 1).cast("bigint")).alias("bad"))
    whole = counts.groupBy("stratum", "signal").agg(F.sum("good").alias("n"), F.collect_list(F.struct("bucket", "good", "bad")).alias("by"))
    strata = whole.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))

    def reached(level: Column, field: str) -> Column:
        return F.aggregate("by", F.lit(0).cast("bigint"), lambda a, b: a + F.when(b["bucket"] >= level, b[field]).otherwise(0))

    tested = whole.select("stratum", "signal", "n", "by", F.explode(F.sequence(F.lit(1), F.lit(len(CUTOFFS)))).alias("level"))
    tested = tested.select("stratum", "signal", "n", "level", reached(F.col("level"), "good").alias("good"), reached(F.col("level"), "bad").alias("bad"))
    tested = tested.withColumn("p", binomial_tail(F.col("good"), F.col("n"), alpha / len(SIGNALS))).crossJoin(F.broadcast(strata))
    failed = F.max((F.col("p") > delta / (F.col("strata") * len(SIGNALS))).cast("int")).over(Window.partitionBy("stratum", "signal").orderBy(F.desc("level")))
    safe = tested.withColumn("failed", failed).where("failed = 0").withColumn("use", F.col("bad") - COST * F.col("good")).where("use > 0")
    return safe.groupBy("stratum", "signal").agg(F.max(F.struct("use", "level"))["level"].alias("level"))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts of every document, `base_failed`, `rejected_by` (signals) and `kept`.

    Strata are the values of `lang`, null being one of its own. A null text has no words; repeated rows are judged each;
    labels without a document count for nothing, and a repeated label counts with its smallest value; without labels no
    rule is certified and only the base rule rejects. Other columns are ignored."""
    measures = stash(measured(docs))
    rules = cutoffs(measures, labels, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "level"))).alias("levels"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    by = F.array_compact(F.array(*(F.when(bucket(*own) >= F.try_element_at("levels", F.lit(name)), F.lit(name)) for name, own in SIGNALS.items())))
    both = measures.join(rules, "stratum", "left").withColumn("base_failed", base_failed).withColumn("rejected_by", by)
    return both.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def _sql() -> str:
    levels = "[" + ", ".join(map(str, CUTOFFS)) + "]"
    ratios = ", ".join(f"{{'signal': '{name}', 'bucket': CASE WHEN {den} > 0 THEN list_sum(list_transform({levels}, lambda c: CAST({num} * 1000 >= {den} * c AS INT))) ELSE 0 END}}" for name, (num, den) in SIGNALS.items())
    a, m = ALPHA / len(SIGNALS), len(SIGNALS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1) GROUP BY k),
b AS (SELECT k, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  length(text) - length(replace(text, '!', '')) AS n_exclamations, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (k)),
e AS (SELECT k, doc_id, stratum, s.signal, s.bucket FROM (SELECT *, unnest([{ratios}]) AS s FROM b)),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT stratum, signal, bucket, sum(CAST(quality = 1 AS BIGINT)) AS good, sum(CAST(quality <> 1 AS BIGINT)) AS bad FROM e JOIN q USING (doc_id) GROUP BY ALL),
h AS (SELECT stratum, signal, level, sum(good) AS n, coalesce(sum(good) FILTER (bucket >= level), 0) AS good, coalesce(sum(bad) FILTER (bucket >= level), 0) AS bad FROM c, range(1, {len(CUTOFFS) + 1}) AS l(level) GROUP BY ALL),
p AS (SELECT *, CASE WHEN good >= n * {a!r} THEN 1 ELSE list_sum(list_transform(range(0, CAST(good AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a!r}) + (n - i) * ln(1 - {a!r})))) END AS p FROM h),
f AS (SELECT *, max(CAST(p > {DELTA!r} / ((SELECT count(DISTINCT stratum) FROM c) * {m}) AS INT)) OVER (PARTITION BY stratum, signal ORDER BY level DESC) AS failed FROM p),
u AS (SELECT stratum, signal, max_by(level, (bad - {COST} * good) * 1000 + level) AS level FROM f WHERE failed = 0 AND bad - {COST} * good > 0 GROUP BY ALL),
x AS (SELECT DISTINCT k FROM e JOIN u USING (stratum, signal) WHERE bucket >= level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND k NOT IN (SELECT k FROM x) AS kept FROM b
"""


SQL = _sql()
