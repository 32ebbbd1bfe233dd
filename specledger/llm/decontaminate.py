"""Benchmark decontamination with SimHash windows (operator 9). DataFrame functions only.

A text leaks an item if some window of the item's length in words has a weighted similarity of ``least`` or more with it: the sum over
five-word shingles of weight times the smaller count, over the same with the larger count. A shingle that few items share weighs more.

1. Such a window shares a shingle with the item, so shingles of all texts are joined with those of the items, and only windows in which a
   shared shingle stands where it stands in the item are looked at. Equal windows are looked at once, however many texts hold them.
2. Windows and items get 64-bit SimHash fingerprints. Eight blocks of eight bits: within ``RADIUS`` = 15 differing bits, one block differs in at
   most one bit, so items are filed under each block value and its eight neighbours, together with their length. Every window within
   the radius of an item of its length meets it.
3. The exact weighted similarity decides.

The items' shingles are staged; Spark broadcasts them if the stored size allows it and shuffles by shingle otherwise.

Defined results: null or short texts (under five words) have no shingles and no leaks; items under five words are not searched for;
repeated rows of a document are reported once; rows with a null ``doc_id`` are not reported and are kept by ``drop_leaks``; of equally similar
windows the first is reported. Other columns are not read. An empty benchmark gives no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specledger.session import stage_table

SHINGLE = 5
RADIUS = 15
BLOCKS, BLOCK_BITS = 8, 8
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def with_shingles(df: DataFrame, *keys: str) -> DataFrame:
    """``_h``: the word hashes first, in a projection of their own, so that they are made once per text."""
    words = df.select(*keys, F.explode(F.array(F.transform(
        F.filter(F.split(F.lower("text"), BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w)))).alias("_w"))
    return words.filter(F.size("_w") >= SHINGLE).select(*keys, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, SHINGLE))).alias("_h"))


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is one if it is set in over half of them."""
    votes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(
        hashes, F.lit(0), lambda acc, h: acc + F.call_function("getbit", h, b).cast("int")))
    return F.aggregate(F.transform(votes, lambda v, b: F.when(2 * v > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b))
                                   .otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def block_keys(fp: Column, near: bool) -> Column:
    """Block number and value; with ``near`` also the values one bit away."""
    flips = [0, *(1 << b for b in range(BLOCK_BITS))] if near else [0]
    return F.array(*[(block(fp, k).bitwiseXOR(F.lit(x)) + (k << BLOCK_BITS)).cast("int") for k in range(BLOCKS) for x in flips])


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id``, ``n`` (words), ``q`` (place), ``g`` (shingle), one row per place; staged."""
    shingled = with_shingles(items.filter(F.col("item_id").isNotNull()).dropDuplicates(["item_id"]), "item_id")
    return stage_table(shingled.select("item_id", (F.size("_h") + SHINGLE - 1).alias("n"), F.posexplode("_h").alias("q", "g")), "item-shingles")


def candidate_windows(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n``: windows in which a shared shingle stands where it stands in an item of ``n`` words."""
    known = stage_table(grams.select("g").distinct(), "known-shingles")
    hits = with_shingles(docs.filter(F.col("doc_id").isNotNull()), "doc_id").select("doc_id", F.posexplode("_h").alias("pos", "g")).join(
        known, "g", "left_semi")
    hits = stage_table(hits, "shared-shingles")
    return hits.join(grams.select("g", "q", "n").distinct(), "g").select(
        "doc_id", F.greatest(F.col("pos") - F.col("q"), F.lit(0)).alias("start"), "n").distinct()


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` and ``start`` (word) of the most similar window of each leak."""
    grams = item_shingles(items)
    windows = candidate_windows(docs, grams)
    listed = stage_table(windows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_windows")), "windows-by-text")
    held = with_shingles(docs.select("doc_id", "text").join(listed, "doc_id"), "doc_id", "_windows")
    # A window that would run past the end of the text starts earlier.
    cut = held.select("doc_id", "_h", F.explode(F.transform("_windows", lambda w: F.struct(
        F.greatest(F.least(w["start"], F.size("_h") - (w["n"] - SHINGLE + 1)), F.lit(0)).alias("start"), w["n"].alias("n")))).alias("w"))
    found = stage_table(cut.select("doc_id", "w.start", "w.n", F.slice("_h", F.col("w.start") + 1, F.col("w.n") - SHINGLE + 1).alias("s"))
                        .withColumn("c", F.xxhash64("s", "n")), "windows")
    kinds = stage_table(found.groupBy("c", "n").agg(F.first("s").alias("s")).withColumn("fp", fingerprint(F.col("s"))), "window-kinds")
    targets = stage_table(grams.groupBy("item_id", "n").agg(F.collect_list("g").alias("s")).select(
        "item_id", "n", fingerprint(F.col("s")).alias("item_fp")), "item-fingerprints")

    left = kinds.select("c", "n", "fp", F.explode(block_keys(F.col("fp"), near=False)).alias("k"))
    right = targets.select("item_id", "n", "item_fp", F.explode(block_keys(F.col("item_fp"), near=True)).alias("k"))
    near = left.join(right, ["n", "k"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = stage_table(near.select("c", "item_id").distinct(), "near-windows")

    total = grams.select("item_id").distinct().count()
    weights = grams.groupBy("g").agg(F.countDistinct("item_id").alias("df"))
    counts = grams.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n_item"))
    of_window = pairs.join(kinds.select("c", "s"), "c").select("c", "item_id", F.explode("s").alias("g")).groupBy("c", "item_id", "g").agg(
        F.count(F.lit(1)).alias("n_window"))
    both = of_window.select("c", "item_id", "g", "n_window", F.lit(0).cast("long").alias("n_item")).unionByName(
        pairs.join(counts, "item_id").select("c", "item_id", "g", F.lit(0).cast("long").alias("n_window"), "n_item"))
    both = both.groupBy("c", "item_id", "g").agg(F.sum("n_window").alias("x"), F.sum("n_item").alias("y")).join(weights, "g", "left")
    weight = F.log1p(F.lit(float(total)) / F.coalesce("df", F.lit(1)))
    alike = both.groupBy("c", "item_id").agg(
        F.round(F.sum(weight * F.least("x", "y")) / F.sum(weight * F.greatest("x", "y")), 9).alias("similarity")).filter(
        F.col("similarity") >= least)
    return found.select("doc_id", "start", "c").join(alike, "c").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without a leak, with all columns."""
    bad = stage_table(leaks(docs, items, least).select("doc_id").distinct(), "leaking")
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
