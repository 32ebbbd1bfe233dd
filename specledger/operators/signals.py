"""Finding the signals of a dictionary inside texts, for dictionaries of any size.

A text is looked through in its own task: at each place the first three characters are hashed and tested against one bit per
signal head; where a head fits, the substrings of the lengths that signals have are hashed and tested as well. What passes is settled by equality.

A dictionary of no more than ``INLINE_BYTES`` travels to the tasks as a hash table of signals, so that rows are matched where they are. For a larger
one the second test is a bit per signal, and the substrings that pass (those found, and a small share of others) are joined with the dictionary; texts without
any never leave their task. Both ways give the same matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from specledger.functions.text import clean_string
from specledger.operators.once import once
from specledger.operators.skew import join_spread
from specledger.session import stage_table

MIN_CONTAINED = 3
# Largest dictionary (its texts and a hundred bytes a signal) that is sent to the tasks.
INLINE_BYTES = 8 << 20
# Words of 64 bits in a bit table: 16 bits per signal, up to 1 MB.
LEAST_WORDS, MOST_WORDS, SIGNALS_PER_WORD = 64, 1 << 17, 4
# One signal of the dictionary: its entry, in dictionary order.
SIGNAL = T.StructType([
    T.StructField("entry_pos", T.LongType()),
    T.StructField("signal_pos", T.IntegerType()),
    T.StructField("signal", T.StringType()),
    T.StructField("low", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("trade_name", T.StringType()),
])


def signals(dictionary: DataFrame) -> DataFrame:
    """Dictionary by signal. Entries may hold a ``raw_signals`` list, or come with one row per ``signal``.

    The order within an entry is that of the list; rows without one are ordered by text. Null and empty signals match nothing and are left out.
    """
    if "raw_signals" in dictionary.columns:
        dictionary = dictionary.select("*", F.posexplode("raw_signals").alias("signal_pos", "signal"))
    return dictionary.filter(F.col("signal") != "").select(
        F.col("entry_pos").cast("long").alias("entry_pos"), "signal_pos", "signal", F.lower("signal").alias("low"),
        F.col("canonical_manufacturer").alias("manufacturer"), F.col("canonical_brand").alias("brand"),
        F.coalesce("trade_name", F.lit("")).alias("trade_name"))


@dataclass
class SignalIndex:
    """A dictionary prepared for matching: its first entry by signal, and what goes to the tasks: two tables of ``words`` words and the lengths of its signals."""

    first: DataFrame
    heads: Column
    wholes: Column
    lengths: list[int]
    words: int
    inline: bool


def signal_index(dictionary: DataFrame, ignore_case: bool = True, inline_bytes: int = INLINE_BYTES) -> SignalIndex:
    """Prepare a dictionary. Of equal signals the first in dictionary order counts."""
    entries = signals(dictionary)
    if not ignore_case:
        entries = entries.withColumn("low", F.col("signal"))
    first = stage_table(entries.groupBy("low").agg(F.min(F.struct(*SIGNAL.names)).alias("m")), "signals")
    texts = sum((F.coalesce(F.octet_length(F.col(f"m.{c}")), F.lit(0)) for c in ("signal", "low", "manufacturer", "brand", "trade_name")), F.lit(100))
    # The distinct lengths are fewer than the characters of the longest signal.
    size = first.agg(F.count(F.lit(1)).alias("n"), F.sum(texts).alias("bytes"), F.sort_array(F.collect_set(F.length("low"))).alias("lengths")).first()
    words = LEAST_WORDS
    while words * SIGNALS_PER_WORD < size["n"] and words < MOST_WORDS:
        words *= 2
    inline = (size["bytes"] or 0) <= inline_bytes

    def table(hashed: str, rows: DataFrame, value: Column, none: Column) -> Column:
        """An array with a value for each word, from the rows whose hash falls on it: of a fixed size, so one task can hold it."""
        filled = rows.withColumn("h", F.expr(f"xxhash64({hashed})")).groupBy(F.expr(f"shiftrightunsigned(h, 6) & {words - 1}").alias("w")).agg(value.alias("v"))
        every = dictionary.sparkSession.range(words, numPartitions=1).join(filled, F.col("id") == F.col("w"), "left")
        return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", none).alias("v")))).alias("t")).select("t.v").scalar()

    bits = F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))"), F.lit(0).cast("long")
    # Signals shorter than MIN_CONTAINED have no head: they match whole texts only.
    heads = table(f"left(low, {MIN_CONTAINED})", first.filter(F.length("low") >= MIN_CONTAINED), *bits)
    wholes = table("low", first, *((F.collect_list("m"), F.array().cast(T.ArrayType(SIGNAL))) if inline else bits))
    lengths = [n for n in size["lengths"] if n >= MIN_CONTAINED]
    return SignalIndex(first, heads, wholes, lengths, words, inline)


# In these expressions a table is named once: then the optimiser puts the table itself in the place of its column, which a row would carry as a copy of up to
# ``INLINE_BYTES`` (see ``match_columns``).

def _word(table: str, text: str, index: SignalIndex) -> str:
    return f"{table}[cast(shiftrightunsigned(xxhash64({text}), 6) & {index.words - 1} as int)]"


def _bit(table: str, text: str, index: SignalIndex) -> str:
    return f"(shiftright({_word(table, text, index)}, cast(xxhash64({text}) & 63 as int)) & 1L) = 1L"


def _parts(low: str, heads: str, index: SignalIndex) -> str:
    """A lower-case text, and its substrings of the lengths of signals where the head of a signal may be."""
    lengths = f"cast(array({', '.join(map(str, index.lengths))}) as array<int>)"
    places = (f"filter(case when length({low}) >= {MIN_CONTAINED} then sequence(1, length({low}) - {MIN_CONTAINED - 1}) else cast(array() as array<int>) end,"
              f" i -> {_bit(heads, f'substr({low}, i, {MIN_CONTAINED})', index)})")
    return f"concat(array({low}), flatten(transform({places}, i -> transform(filter({lengths}, n -> i + n <= length({low}) + 1), n -> substr({low}, i, n)))))"


def likely_signals(low: str, heads: str, wholes: str, index: SignalIndex) -> Column:
    """Substrings that pass both tests: all signals in a text, and few others."""
    return F.expr(f"array_distinct(filter({_parts(low, heads, index)}, s -> {_bit(wholes, 's', index)}))")


def first_signal(low: str, heads: str, wholes: str, index: SignalIndex) -> Column:
    """The first signal of the dictionary in a text, with its entry."""
    return F.expr(f"array_min(flatten(transform({_parts(low, heads, index)}, s -> filter({_word(wholes, 's', index)}, m -> m.low = s))))")


def match_columns(rows: DataFrame, texts: dict[str, Column], index: SignalIndex, find: Callable[[str, str, str, SignalIndex], Column]) -> DataFrame:
    """Add a column for each lower-case text, found by one of the functions above. A null text gives null.

    Each text has columns of its own for the tables, so that each of these is used once and never becomes part of a row.
    """
    low = once(rows, {f"_low_{n}": t for n, t in texts.items()})
    tables = {f"_{t}_{n}": c for n in texts for t, c in (("heads", index.heads), ("wholes", index.wholes))}
    found = {n: F.when(F.col(f"_low_{n}").isNotNull(), find(f"_low_{n}", f"_heads_{n}", f"_wholes_{n}", index)) for n in texts}
    return once(low.withColumns(tables), found).drop(*tables, *[f"_low_{n}" for n in texts])


def match_texts(texts: DataFrame, index: SignalIndex, low: Column) -> tuple[DataFrame, DataFrame]:
    """For a large dictionary: the rows that may hold a signal in ``text`` (``low`` as it is compared), and ``text``, its match ``m`` and ``n_rows`` of each distinct one."""
    likely = match_columns(texts, {"_likely": low}, index, likely_signals).filter("size(_likely) > 0")
    counted = stage_table(likely.groupBy("text").agg(F.count(F.lit(1)).alias("n_rows"), F.first("_likely").alias("likely")), "likely-texts")
    found = counted.select("text", F.explode("likely").alias("low")).join(index.first, "low").groupBy("text").agg(F.min("m").alias("m"))
    return likely.drop("_likely"), stage_table(found.join(counted.select("text", "n_rows"), "text"), "matched-texts")


def match_signal(df: DataFrame, text: str, dictionary: DataFrame, ignore_case: bool = True, placeholders: bool = True,
                 inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Add ``m``: the first dictionary signal that equals the text or, from three characters on, is contained in it; null without one.

    Texts are trimmed, and those that stand for nothing are null, unless ``placeholders`` is false.
    """
    return match_indexed(df, text, signal_index(dictionary, ignore_case, inline_bytes), ignore_case, placeholders)


def match_indexed(df: DataFrame, text: str, index: SignalIndex, ignore_case: bool = True, placeholders: bool = True) -> DataFrame:
    """``match_signal`` with a prepared dictionary, for several tables of texts. ``ignore_case`` is that of the index."""
    own = clean_string(F.col(text)) if placeholders else F.col(text)
    if index.inline:
        return match_columns(df, {"m": F.lower(own) if ignore_case else own}, index, first_signal)
    clean = df.withColumn("_text", own)
    _, matched = match_texts(clean.select(F.col("_text").alias("text")), index, F.lower("text") if ignore_case else F.col("text"))
    matched = matched.withColumnRenamed("text", "_text")
    return join_spread(clean, matched.select("_text", "m"), ["_text"], spread=df.columns, counts=matched.select("_text", "n_rows")).drop("_text")
