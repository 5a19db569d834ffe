"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose measure (symbols, repeated lines, repeated windows or word length)
lies above a cutoff. Cutoffs are chosen from labelled holdouts, one for each stratum and measure. For a cutoff
to be usable, an exact binomial test must refute that it rejects more than its part of `RISK` of the
good documents of the stratum. Cutoffs of one measure are tested from the most lenient on, ending at
the first that fails, which needs no further correction; the level `LEVEL` is divided by the number of
measures and strata (Bonferroni), and `RISK` by the number of measures. So with probability
1 - LEVEL at least, no stratum loses more than RISK of its good documents to the rules.

All measures are column expressions over the whole text; windows of eight words are compared by
64-bit hash within one text. Only labels and measures are shuffled, never texts.

Nulls and ties: a null text counts as empty and fails the base rule. A null stratum is a stratum of its
own. A stratum without enough good labels gets no cutoff, and its documents stay if they pass the
base rule. Labels of unknown ids and null labels are ignored; a document with several good labels
counts once. Equal measures fare alike. Empty tables work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, cut

RISK = 0.02
LEVEL = 0.05
WINDOW = 8
_TOKENS = r"[\x20\x09-\x0D]+"
_LINE_BREAKS = "\n"

#: Measures and the cutoffs tried for each, most lenient first.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1),
    "mean_word_chars": (100.0, 50.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0),
}


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window whose words stand in the text twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n >= WINDOW, windows)


def measures(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("_text"))
    df = df.withColumn("_words", F.filter(F.split("_text", _TOKENS, -1), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(
        F.split("_text", _LINE_BREAKS, -1), lambda line: F.translate(line, SPACES, "") != ""))
    df = df.withColumn("_windows", _repeated_words(F.col("_words")))
    # Windows are put in order only where some hash comes twice: pairs of a hash and its place, sorted.
    ordered = F.array_sort(F.zip_with(
        "_windows", F.sequence(F.lit(1), F.size("_windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    def same(x, k):
        return F.coalesce(F.get("_sorted", k).getField("h") == x.getField("h"), F.lit(False))

    twice = F.filter("_sorted", lambda x, k: same(x, k + 1) | same(x, k - 1))
    df = df.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x.getField("i"))))
    covered = F.aggregate(
        "_places", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc.getField("sum") + F.least(F.lit(WINDOW), i - acc.getField("last"))).alias("sum"), i.alias("last")),
        lambda acc: acc.getField("sum"))
    kept = [c for c in df.columns if not c.startswith("_") or c in ("_id", "_stratum")]
    return df.select(
        *kept, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _shares() -> dict[str, Column]:
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_share": over("n_symbols", "word_chars"), "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"), "mean_word_chars": over("word_chars", "n_words"),
    }


def binomial_tail(rejected: str, n: str, risk: float) -> Column:
    """The chance of at most so many of n at rate `risk`, summed exactly term by term in logarithms."""
    odds = math.log(risk) - math.log1p(-risk)
    return F.expr(
        f"aggregate(sequence(0L, {rejected}), named_struct('term', {n} * {math.log1p(-risk)!r}D, 'sum', 0.0D),"
        f" (acc, j) -> named_struct('term', acc.term + ln(greatest({n} - j, 1L) / (j + 1)) + {odds!r}D,"
        " 'sum', acc.sum + exp(acc.term)), acc -> acc.sum)")


def cutoffs(measured: DataFrame, good: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum: the strictest usable cutoff of each measure, null where there is none.

    `measured` has _id, _stratum and the measures; `good` has the _id of documents labelled good.
    """
    shares = _shares()
    held = measured.filter(~base_failed()).join(good.distinct(), "_id")
    # One counter for each measure and cutoff, so that labelled rows combine before the shuffle.
    tried = [(m, k, c) for m, cs in CUTOFFS.items() for k, c in enumerate(cs)]
    counts = cut(held.groupBy("_stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(shares[m] > c).alias(f"{m}_{k}") for m, k, c in tried)))
    tests = counts.select("_stratum", "n", F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.lit(k).alias("k"), F.lit(c).alias("cutoff"), F.col(f"{m}_{k}").alias("rejected"))
        for m, k, c in tried))).alias("t")).select("_stratum", "n", "t.*")
    tests = tests.withColumn("p", binomial_tail("rejected", "n", risk / len(CUTOFFS)))
    passed = F.col("p") * counts.count() * len(CUTOFFS) <= level
    upto = Window.partitionBy("_stratum", "measure").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    tests = tests.withColumn("_usable", F.min(passed.cast("int")).over(upto) == 1)
    return tests.groupBy("_stratum").agg(
        *(F.min(F.when(F.col("_usable") & (F.col("measure") == m), F.col("cutoff"))).alias(f"max_{m}") for m in CUTOFFS))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK,
                  level: float = LEVEL) -> DataFrame:
    """One row per row of `docs`: id, the measures, `base_failed` and `kept`.

    `labels` holds out documents with `label_col` 1 for good ones.
    """
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("t"))
    measured = cut(measures(docs, text_col, F.col(id_col).alias("_id"), stratum.alias("_stratum")))
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id"))
    limits = cutoffs(measured, good, risk, level)
    judged = measured.join(limits, "_stratum", "left")
    above = F.lit(False)
    for m, share in _shares().items():
        above = above | F.coalesce(share > F.col(f"max_{m}"), F.lit(False))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))
