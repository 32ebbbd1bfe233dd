"""CSV files as numbered records, one file being read by many tasks.

A quoted value may hold line breaks, so whether a line begins a record depends on all quotes before it. Each line is therefore read as a small function from
the state before it (outside or inside quotes) to the state after it. Such a function keeps the state, swaps it, or ends in one state whatever came before; so
the state at any place follows from the last line of the third kind and the number of swaps since. Splits are summed up the same way, one row each, which tells
every split how it begins and how many records come before it. Only records of several lines are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A field from its first character to the next comma, and the beginning of a quoted value up to a quote or the end.
_VALUE = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:"{_VALUE}"[^,]*+|[^",][^,]*+|)'
# Lines that end inside quotes if they begin outside, respectively inside.
_OPENS = rf'(?s)^(?:{_FIELD},)*+"{_VALUE}$'
_STAYS = rf'(?s)^{_VALUE}$|^{_VALUE}"[^,]*+,(?:{_FIELD},)*+"{_VALUE}$'
# --- fixed values: bytes 0x80 to 0x9F of the code page that differs from Latin-1 there, without the five that stand for nothing ---
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
ENCODINGS = ("utf-8", "iso-8859-1", "cp1252", "windows-1252")


def decoded_line(value: Column, encoding: str) -> Column:
    """Text of a line of bytes; bytes that are no text are replaced."""
    name = encoding.lower().replace("utf8", "utf-8")
    if name not in ENCODINGS:
        raise ValueError(f"encoding must be one of {', '.join(ENCODINGS)}")
    if name == "utf-8":
        return F.make_valid_utf8(value)
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return latin if name == "iso-8859-1" else F.translate(latin, "".join(map(chr, _CP1252_BYTES)), _CP1252)


def _state(start: Column, const: Column, swaps: Column) -> Column:
    """State after a run of lines: ``const`` holds the last fixed state and the swaps up to there, ``swaps`` those up to here."""
    flip = F.pmod(swaps - F.coalesce(const["swaps"], F.lit(0)), F.lit(2)) == 1
    return F.coalesce(const["inside"], start) != flip


def _composed(df: DataFrame, over: Window, inside_from_out: Column, inside_from_in: Column) -> DataFrame:
    """Add ``_out`` and ``_in``: the state before each row if the first one begins outside, respectively inside quotes."""
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_swap", (inside_from_out & ~inside_from_in).cast("int")).withColumn(
        "_swaps", F.sum("_swap").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = F.when(inside_from_out == inside_from_in, F.struct(inside_from_out.alias("inside"), F.col("_swaps").alias("swaps")))
    last = counted.withColumn("_const", F.last(fixed, ignorenulls=True).over(before)).withColumn("_before", F.coalesce(F.sum("_swap").over(before), F.lit(0)))
    return last.select("*", *[_state(F.lit(s), F.col("_const"), F.col("_before")).alias(n) for n, s in (("_out", False), ("_in", True))]).drop(
        "_swap", "_swaps", "_const", "_before")


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """``row_id``, ``value``: the records after the header of each file, numbered from 1 in the order of file names and lines.

    Lines end in a line feed, with or without a carriage return. Blank lines between records do not count. A record of several lines keeps its line feeds.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"),
        decoded_line(F.rtrim("value", F.lit("\r")), encoding).alias("value"))
    of_split = Window.partitionBy("file", "split").orderBy("n")
    opens, stays = F.col("value").rlike(_OPENS), F.col("value").rlike(_STAYS)
    # A line without a quote keeps the state: no pattern has to run.
    quoted = F.contains("value", F.lit('"'))
    marked = lines.select("*", (quoted & opens).alias("opens"), (~quoted | stays).alias("stays"))
    placed = _composed(marked, of_split, F.col("opens"), F.col("stays"))
    so_far = of_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def begins(state: str) -> Column:
        return ~F.col(state) & (F.col("value") != "")

    counted = placed.select("*", *[F.sum(begins(s).cast("long")).over(so_far).alias(f"{s}_records") for s in ("_out", "_in")])

    def after(state: str) -> Column:
        return F.when(F.col(state), F.col("stays")).otherwise(F.col("opens"))

    # One row for each split.
    splits = counted.groupBy("file", "split").agg(*[F.max_by(c, "n").alias(n) for n, c in (
        ("opens", after("_out")), ("stays", after("_in")), ("from_out", F.col("_out_records")), ("from_in", F.col("_in_records")))])
    begun = _composed(splits, Window.partitionBy("file").orderBy("split"), F.col("opens"), F.col("stays"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_out"), F.col("from_in")).otherwise(F.col("from_out"))
    sums = begun.select("file", "split", F.col("_out").alias("inside"), own.alias("own")).select(
        "*", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.coalesce(F.sum("own").over(in_file), F.lit(0)).alias("in_file"))
    # The first record of each file is its header.
    files = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headers = F.sum(((F.col("in_file") == 0) & (F.col("own") > 0)).cast("long")).over(files)
    table = sums.select("file", "split", "inside", "offset", "in_file", headers.alias("headers"))
    joined = counted.join(table, ["file", "split"]).select(
        "file", "split", "n", "value", F.when(F.col("inside"), F.col("_in")).otherwise(F.col("_out")).alias("state"),
        F.when(F.col("inside"), F.col("_in_records")).otherwise(F.col("_out_records")).alias("record"), "offset", "in_file", "headers", "opens", "stays")
    named = joined.filter("state or value <> ''").select(
        "split", "n", "value", "state", (F.col("offset") + F.col("record") - F.col("headers")).alias("row_id"), (F.col("in_file") + F.col("record") == 1).alias("header"),
        F.when(F.col("state"), F.col("stays")).otherwise(F.col("opens")).alias("goes_on")).filter("not header")
    single = named.filter("not state and not goes_on").select("row_id", "value")
    several = named.filter("state or goes_on").groupBy("row_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "n", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return single.unionByName(several)


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """The columns of the header of the first file, all as text, and ``row_id``. Names are trimmed and freed of a byte-order mark."""
    by_byte = encoding.lower() not in ("utf-8", "utf8")
    header = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="ISO-8859-1" if by_byte else "UTF-8").columns
    if by_byte:
        header = [c.encode("latin-1").decode(encoding, "replace") for c in header]
    parsed = csv_records(spark, path, encoding).select(
        "row_id", F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(header)))), {"quote": '"', "escape": '"'}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c.lstrip("﻿").strip()) for i, c in enumerate(header)], "row_id")
