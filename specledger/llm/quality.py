"""Quality rules with adaptive thresholds (operator 8).

Every document gets counts over its whole text. The counts of a language and source are summarised in KLL quantile sketches,
which merge: the sketches of the sources of a language give those of the language, and these the ones of the corpus. A
document fails where a ratio lies outside the fence of its own group; a group with few documents uses its language's
fence, then the corpus's. Nothing is compared with a fixed cutoff; ``slack`` is only the least width of a fence, so that a group
in which nearly all values are equal does not reject the first that differs.

Defined results: a null or blank text has zero counts and fails the base rules; null language or source is a group of
its own; repeated rows count and are judged as often as they occur; an empty table gives an empty result. Only the named columns are
read, and columns that clash with names used here are kept as they are by ``filter_quality``.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from specledger.llm.words import words
from specledger.session import stage_table

STATS = StructType([StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
WINDOW = 5
# Metric: (numerator, denominator, fence below, least width of the fence).
METRICS = {
    "symbols": ("n_symbols", "word_chars", False, 0.02),
    "dup_lines": ("n_dup_lines", "n_words", False, 0.02),
    "repeats": ("n_repeat_words", "n_words", False, 0.15),
    "word_length": ("word_chars", "n_words", True, 2.0),
}
SKETCH_K = 2048


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one whole text."""
    if not isinstance(text, str):
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                repeated_lines += 1
            seen.add(line)
    return len(tokens), len(text) - blanks, symbols, repeated_lines, _repeated_words(tokens)


def _repeated_words(tokens: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more."""
    windows = list(zip(*[tokens[k:] for k in range(WINDOW)]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


@F.pandas_udf(STATS)
def text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=STATS.names)


def base_failed(stat) -> Column:
    """Too few words, or over a fifth of them in repeated windows. ``stat`` gives the column of a count."""
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


def _ratio(name: str, stat) -> Column:
    top, bottom, _, _ = METRICS[name]
    return F.when(stat(bottom) > 0, stat(top) / stat(bottom)).otherwise(F.lit(0.0))


def sketches(stats: DataFrame, stat, groups: list[str]) -> DataFrame:
    """One KLL sketch per metric and group, over the documents that pass the base rules."""
    return stats.filter(~base_failed(stat)).groupBy(*groups).agg(
        *[F.kll_sketch_agg_double(_ratio(m, stat), F.lit(SKETCH_K)).alias(f"s_{m}") for m in METRICS],
        F.count(F.lit(1)).alias("n_docs"))


def merge_sketches(parts: DataFrame, groups: list[str]) -> DataFrame:
    return parts.groupBy(*groups).agg(
        *[F.kll_merge_agg_double(f"s_{m}", F.lit(SKETCH_K)).alias(f"s_{m}") for m in METRICS], F.sum("n_docs").alias("n_docs"))


def fences(parts: DataFrame, width: float, prefix: str) -> DataFrame:
    """Median plus and minus ``width`` times the distance to the quartiles, at least the metric's slack."""
    bounds = []
    for m, (_, _, below, slack) in METRICS.items():
        # Without a document the sketch is empty and has no quantile.
        low, mid, high = (F.when(F.col("n_docs") > 0, F.expr(f"kll_sketch_get_quantile_double(s_{m}, {q}D)")) for q in (0.25, 0.5, 0.75))
        bounds.append((mid + F.greatest(width * (high - mid), F.lit(slack))).alias(f"{prefix}hi_{m}"))
        if below:
            bounds.append((mid - F.greatest(width * (mid - low), F.lit(slack))).alias(f"{prefix}lo_{m}"))
    keep = [c for c in parts.columns if not c.startswith("s_") and c != "n_docs"]
    return parts.select(*keep, F.col("n_docs").alias(f"{prefix}n"), *bounds)


def thresholds(stats: DataFrame, stat, groups: tuple[str, str] = ("lang", "source"), width: float = 8.0,
               least: int = 100) -> DataFrame:
    """Fences per language and source, with the fallback for small groups resolved: one row per group.

    The result is staged, so its real size decides whether later joins broadcast it.
    """
    lang, source = groups
    own = stage_table(sketches(stats, stat, list(groups)), "quality-sketches")
    by_lang = merge_sketches(own, [lang])
    corpus = fences(merge_sketches(by_lang, []), width, "c_")
    joined = (fences(own, width, "o_").alias("o")
              .join(fences(by_lang, width, "l_").alias("l"), F.col(f"o.{lang}").eqNullSafe(F.col(f"l.{lang}")), "left")
              .select(f"o.{lang}", f"o.{source}", *[c for c in fences(own, width, "o_").columns if c.startswith("o_")],
                      *[c for c in fences(by_lang, width, "l_").columns if c.startswith("l_")])
              # one row, repeated for each group
              .join(F.broadcast(corpus)))
    names = [c.removeprefix("c_") for c in corpus.columns if c != "c_n"]
    return stage_table(joined.select(
        F.col(lang).alias("t_lang"), F.col(source).alias("t_source"),
        *[F.when(F.col("o_n") >= least, F.col(f"o_{n}")).when(F.col("l_n") >= least, F.col(f"l_{n}"))
          .otherwise(F.col(f"c_{n}")).alias(n) for n in names]), "quality-thresholds")


def judge(stats: DataFrame, stat, limits: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Add ``_kept``: base rules hold and no ratio lies outside its group's fence.

    A group without thresholds has no document that passes the base rules, so all of its documents fail anyway.
    """
    lang, source = (F.col(f"d.{c}") for c in groups)
    joined = stats.alias("d").join(limits.alias("t"), lang.eqNullSafe(F.col("t_lang")) & source.eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m, (_, _, below, _) in METRICS.items():
        inside = inside & (_ratio(m, stat) <= F.col(f"t.hi_{m}"))
        if below:
            inside = inside & (_ratio(m, stat) >= F.col(f"t.lo_{m}"))
    return joined.select("d.*", F.coalesce(~base_failed(stat) & inside, F.lit(False)).alias("_kept"))


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """Counts and verdict of every document: one row per input row."""
    stats = stage_table(docs.select("doc_id", "lang", "source", text_stats("text").alias("_s")), "quality-stats")
    stat = lambda name: F.col(f"_s.{name}")
    return judge(stats, stat, thresholds(stats, stat, **options)).select(
        "doc_id", "_s.*", base_failed(stat).alias("base_failed"), F.col("_kept").alias("kept"))


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    # The document goes into one column, so that no name of its own clashes.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    staged = stage_table(docs.select("lang", "source", whole, text_stats("text").alias("_s")), "quality-docs")
    stat = lambda name: F.col(f"_s.{name}")
    kept = judge(staged, stat, thresholds(staged.select("lang", "source", "_s"), stat, **options))
    return kept.filter("_kept").select("_doc.*")
