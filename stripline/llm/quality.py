"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose statistic is above a cutoff.  The cutoffs of a rule are tried from the most lenient to the strictest, in each stratum
apart, on the labelled holdout: a cutoff is certified while the exact binomial test rejects, at level ``delta`` / (rules x strata), that
it turns away more than ``alpha`` / rules of the stratum's good documents (fixed sequence testing within a rule, Bonferroni across rules and strata).  So,
with probability 1 - ``delta``, no stratum loses more than ``alpha`` of its good documents to the rules.  Of the certified cutoffs the one
that catches most bad documents beyond the good ones is taken, the more lenient of equals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from stripline.session import cut

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.02, 0.05
#: Statistic of each rule and the cutoffs that are tried, from lenient to strict; fixed beforehand, as the test needs it.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07),
    "repeats": (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05),
    "lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "length": (20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
    "brief": (-11.0, -12.0, -15.0, -20.0, -25.0, -30.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def measured(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the statistics of its texts: the five base counts, lines with a word, ``base_failed``.

    A null text has no words.  Windows of five words are compared by a 64-bit hash within their text.
    """
    p = lambda n: f"{prefix}{n}"
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(p("_words"), F.array_remove(F.split(t, SPACES), ""))
    w, n = F.col(p("_words")), F.size(p("_words"))
    five = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    df = df.withColumn(p("_five"), F.when(n >= 5, five).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(p("_lines"), F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    h = F.col(p("_five"))
    ranked = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn(p("_ranked"), ranked)
    r = F.col(p("_ranked"))
    twin = lambda x, k: F.get(r, k)["h"].eqNullSafe(x["h"])
    df = df.withColumn(p("_again"), F.sort_array(F.transform(F.filter(r, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"])))
    a = F.col(p("_again"))
    covered = _sum(F.transform(a, lambda s, k: F.least(F.lit(5), F.coalesce(F.get(a, k + 1) - s, F.lit(5)))))
    chars = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    df = df.withColumns({
        p("n_words"): n.cast("long"), p("word_chars"): F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"), p("n_symbols"): chars(SYMBOLS).cast("long"),
        p("n_dup_lines"): (F.size(p("_lines")) - F.size(F.array_distinct(p("_lines")))).cast("long"), p("n_lines"): F.size(p("_lines")).cast("long"),
        p("n_repeat_words"): F.coalesce(covered, F.lit(0)).cast("long")})
    df = df.withColumn(p("base_failed"), (F.col(p("n_words")) < 10) | (100 * F.col(p("n_repeat_words")) > 20 * F.col(p("n_words"))))
    return df.drop(*[p(x) for x in ("_words", "_five", "_lines", "_ranked", "_again")])


def statistics(prefix: str = "") -> dict[str, Column]:
    """Statistic of each rule from the measured columns; null where it has no meaning."""
    c = lambda n: F.col(prefix + n)
    over = lambda a, b: F.when(b > 0, a / b)
    return {
        "symbols": over(c("n_symbols"), c("word_chars")), "repeats": over(c("n_repeat_words"), c("n_words")), "lines": over(c("n_dup_lines"), c("n_lines")),
        "length": over(c("word_chars"), c("n_words")), "brief": -c("n_words").cast("double"),
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial with ``n`` trials, in logarithms: terms follow one another by a ratio, so no factorial is needed."""
    import math

    odds, miss = math.log(rate / (1 - rate)), math.log1p(-rate)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    start = F.struct((n * miss).cast("double").alias("term"), (n * miss).cast("double").alias("total"))
    return F.exp(F.when(k >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step)["total"]).otherwise(n * miss))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Mapping[str, Sequence[float]] = RULES, alpha: float = ALPHA,
               delta: float = DELTA) -> DataFrame:
    """``stratum`` and one cutoff column for each rule (null: none is certified), from all labelled documents.

    labels: ``doc_id, quality`` (1 good, 0 bad, null ignored; several labels of a document count each).  Documents that the base rules reject don't count.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_q")).filter("_q in (0, 1)")
    rows = measured.filter(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"),
                                                         *[v.alias(f"_x_{r}") for r, v in statistics().items() if r in rules])
    held = rows.join(lab, "doc_id")
    good, bad = F.col("_q") == 1, F.col("_q") == 0
    # one aggregate row per stratum: numbers of good and bad documents, and for each cutoff how many of either it turns away
    aggs = [F.count_if(good).alias("_good"), F.count_if(bad).alias("_bad")]
    for r, cutoffs in rules.items():
        for i, c in enumerate(cutoffs):
            aggs += [F.count_if(good & (F.col(f"_x_{r}") > c)).alias(f"_g_{r}_{i}"), F.count_if(bad & (F.col(f"_x_{r}") > c)).alias(f"_b_{r}_{i}")]
    per = held.groupBy("_s").agg(*aggs)
    tries = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"_g_{r}_{i}").alias("k"),
                               F.col(f"_b_{r}_{i}").alias("caught")) for r, cutoffs in rules.items() for i, c in enumerate(cutoffs)])
    strata = F.count(F.lit(1)).over(W.partitionBy())
    t = per.withColumn("_strata", strata).select("_s", "_good", "_bad", "_strata", F.inline(tries)).filter("_good > 0")
    rate = alpha / len(rules)
    # far above the allowed rate the test can't reject, so the tail need not be summed there
    tail = F.when(F.col("k") > rate * F.col("_good"), 1.0).otherwise(binomial_tail(F.col("k"), F.col("_good"), rate))
    t = t.withColumn("_ok", tail <= delta / len(rules) / F.col("_strata"))
    seq = W.partitionBy("_s", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_all", F.min("_ok").over(seq)).filter("_all")
    gain = F.when(F.col("_bad") > 0, F.col("caught") / F.col("_bad")).otherwise(0.0) - F.col("k") / F.col("_good")
    best = t.groupBy("_s", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("g"), -F.col("i"))).alias("cutoff"), F.max(gain).alias("gain")).filter("gain > 0")
    return best.groupBy(F.col("_s").alias("_stratum")).pivot("rule", list(rules)).agg(F.first("cutoff")).select(
        "_stratum", *[F.col(r).alias(f"_cut_{r}") for r in rules])


def verdict(rules: Mapping[str, Sequence[float]] = RULES, prefix: str = "") -> Column:
    """True for documents that neither the base rules nor a cutoff of their stratum reject."""
    kept = ~F.col(f"{prefix}base_failed")
    for r, x in statistics(prefix).items():
        if r in rules:
            kept = kept & ~F.coalesce(x > F.col(f"_cut_{r}"), F.lit(False))
    return kept


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **params) -> DataFrame:
    """Per document: ``doc_id``, the base counts, ``base_failed``, the rules' statistics and ``kept``.

    docs: ``doc_id, text`` and the stratum (null is a stratum).  A row for each row; a stratum without labels has the base rules only; a null doc_id
    has no label.
    """
    rules = params.get("rules", RULES)
    m = cut(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias(stratum), "text")).drop("text"))
    limits = cut(thresholds(m, labels, stratum, **params))
    out = m.join(limits, F.coalesce(m[stratum], F.lit("")) == limits["_stratum"], "left")
    return out.select("doc_id", *BASE, "base_failed", verdict(rules).alias("kept"), *[v.alias(f"rule_{r}") for r, v in statistics().items() if r in rules])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **params) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns."""
    rules = params.get("rules", RULES)
    m = cut(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias(stratum), "text")).drop("text"))
    limits = cut(thresholds(m, labels, stratum, **params))
    p = "_quality_"
    out = measured(docs, prefix=p).join(limits, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == limits["_stratum"], "left")
    # one condition on both sides of the join: parts of it alone would be pushed below the measures and repeat these many times over
    good = F.when(F.col(f"{p}base_failed"), False).otherwise(verdict(rules, p))
    return out.filter(good).select(*docs.columns)
