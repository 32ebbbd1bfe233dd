"""SimHash near-duplicates with Golay-code keys (operator 2).

``link_fingerprints`` is exact: it finds the connected components of all 64-bit fingerprints that differ in at most two bits. A
fingerprint is cut into three segments. At most two errors leave one segment intact (pigeonhole), and the next segment then has at most
two errors, so the two fingerprints share one of its Golay keys. Key = intact segment + Golay index: 18 keys per distinct fingerprint.
Buckets of up to ``PAIRS`` members are compared pair by pair. Members of larger buckets are linked through the words one bit
away from them: fingerprints within two bits share such a word, all that share one are within two bits, and at most 65 do. So the work
stays in proportion to the fingerprints however similar they are, and no link is lost.

``near_dedup`` is the filter for whole documents: it links the texts whose sets of five-word shingles have a Jaccard similarity of at
least 0.8. SimHash gives the first pairs, those whose fingerprints are within two bits; texts with more changed words are out of its reach, and these are found
by their shingles. Both kinds of pairs get the same exact check. All shingles are put in one order, rare ones first; two sets that similar share one of the first fifth of each (prefix filter), whatever
the lengths of the texts, so buckets of those shingles hold every such pair. The place of the shared shingle in both sets bounds how many
can follow it, which drops most other pairs before their sets are compared. Large buckets are linked through a central text first; what that leaves
in different components is then paired in full, in blocks, so no link is lost and one key is the work of many tasks. Its work grows with the
square of the texts of a large bucket that are not linked: those pairs have to be compared.

Defined results: null and blank texts have fingerprint zero and are linked like any others by ``link_fingerprints``; in ``near_dedup``
texts without words are copies of each other. Repeated rows: each is reported by the first; the second takes ``doc_id`` as the
document and keeps one row of it. Rows with a null ``doc_id`` get the component of their fingerprint (null if nobody in it
has an id); ``near_dedup`` cannot name them and passes them on. Only ``doc_id`` and ``text`` are read; other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from specledger.llm.components import components
from specledger.llm.golay import near_indices
from specledger.llm.words import bounded, shingles, words
from specledger.session import drop_stages, stage_table

SEED = 42
CUTS = ((0, 22), (22, 21), (43, 21))  # first bit and length of the segments of 64 bits
PAIRS = 16  # larger buckets take the way whose work does not grow with their square
# The search of near_dedup.
FEATURE_WORDS, FINGERPRINT_WORDS, SHINGLE_WORDS, SIMILARITY = 2, 3, 5, 0.8
GROUP_PAIRS = 32
BLOCK = 256  # members of a large bucket that one task pairs with those outside its largest component
CROWD = 4096  # and at most so many of these
COUNTERS, COUNTER_ROW = 1 << 20, 1 << 14
SLIP = 1e-9  # rounding errors must not drop a pair at the bound


def simhash(grams: list[bytes]) -> int:
    """A bit is one if it is set in over half of the XXH64 values."""
    if not grams:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    return int(_majority(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def _majority(rows: np.ndarray) -> np.ndarray:
    """Rows of little-endian bytes in, the bytes of the majority bits out. Long texts go in pieces of bounded size."""
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for start in range(0, len(rows), 65536):
        total += np.unpackbits(rows[start:start + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(rows), bitorder="little")


def fingerprint_udf(size: int):
    """64-bit fingerprint of a whole text over lower-cased shingles of ``size`` words, as a signed long."""

    @F.pandas_udf(LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingles(t, size)) for t in texts], dtype="uint64").astype("int64")

    return fingerprint


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def exact_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys for two errors, and the position in ``values`` of each."""
    parts = [((values >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in CUTS]
    keys, owner = [], []
    for k, part in enumerate(parts):
        index = near_indices(parts[(k + 1) % len(parts)])
        row, column = np.nonzero(index >= 0)
        keys.append((k << 40) | (part[row] << 12) | index[row, column])
        owner.append(row)
    return np.concatenate(keys), np.concatenate(owner)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = batch["fp"].to_numpy(np.int64)
        keys, owner = exact_keys(values.view(np.uint64))
        yield pd.DataFrame({"key": keys, "fp": values[owner]})


def close_pairs(fps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints whose components are those of all pairs within two bits."""
    keys = stage_table(fps.select("fp").mapInPandas(_key_rows, "key long, fp long"), "golay-keys")
    sizes = stage_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "golay-buckets")
    small = (keys.join(sizes.filter(F.col("n") <= PAIRS).select("key"), "key").groupBy("key")
             .agg(F.array_sort(F.collect_list("fp")).alias("m")))
    pairs = small.select(F.inline(F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.size("m")), lambda y: distance(x, y) <= 2), lambda y: F.struct(x.alias("a"), y.alias("b")))))))
    large = keys.join(sizes.filter(F.col("n") > PAIRS).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    words_near = large.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("w"))
    stars = words_near.groupBy("w").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1).select(
        F.array_min("m").alias("a"), F.explode("m").alias("b"))
    edges = stage_table(pairs.unionByName(stars.filter("a <> b")).distinct(), "close-pairs")
    drop_stages(keys, sizes)
    return edges


def link_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id`` of every row."""
    fps = stage_table(docs.select("doc_id", fingerprint_udf(size)("text").alias("fp")), "fingerprints")
    nodes = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(close_pairs(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage_table(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the search for similar texts ---
SIGNATURE = StructType([*[StructField(n, LongType()) for n in ("f0", "f1", "n", "c0", "c1", "fp", "size")], StructField("first", ArrayType(LongType()))])


def signature(text: str | None) -> tuple[int, int, int, int, int, int]:
    """128-bit SimHash over short shingles, number of words, a 128-bit hash of the lower-cased words, and the 64-bit fingerprint."""
    tokens = words(text, lower=True)
    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(tokens)), "<i8")
    if not tokens:
        return 0, 0, 0, int(digest[0]), int(digest[1]), 0
    grams = shingles(text, FEATURE_WORDS)
    rows = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), np.uint8).reshape(-1, 16)
    bits = _majority(rows).view("<i8")
    fp = np.uint64(simhash(shingles(text, FINGERPRINT_WORDS))).view(np.int64)
    return int(bits[0]), int(bits[1]), len(tokens), int(digest[0]), int(digest[1]), int(fp)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles of a text."""
    grams = shingles(text, SHINGLE_WORDS)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams)).view(np.int64))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return hashes & (COUNTERS - 1)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for start, end in bounded(batch["text"]):
            total += np.bincount(_counter(np.concatenate([shingle_hashes(t) for t in batch["text"].iloc[start:end]])), minlength=COUNTERS)
    rows = np.flatnonzero(total.reshape(-1, COUNTER_ROW).any(axis=1))
    yield pd.DataFrame({"row": rows, "counts": [zlib.compress(r.tobytes(), 1) for r in total.reshape(-1, COUNTER_ROW)[rows]]})


def _add_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
    return pd.DataFrame({"row": group["row"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur. The table has a fixed size; shingles that share a counter only make the order less sharp."""
    schema = "row long, counts binary"
    counts = np.zeros((COUNTERS // COUNTER_ROW, COUNTER_ROW), np.int64)
    for r in texts.select("text").mapInPandas(_count_rows, schema).groupBy("row").applyInPandas(_add_counts, schema).collect():
        counts[r["row"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return counts.reshape(-1)


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set, so many that another set as similar as ``least`` has one of them among its own."""
    order = np.lexsort((hashes, counts[_counter(hashes)]))
    return hashes[order[:len(hashes) - int(np.ceil(least * len(hashes) - SLIP)) + 1]]


def signatures(counts: Broadcast, least: float):
    """Signature of a text with the size of its set of shingles and the prefix of the set."""

    @F.pandas_udf(SIGNATURE)
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_hashes(text)
            rows.append((*signature(text), len(hashes), prefix(hashes, counts.value, least)))
        return pd.DataFrame(rows, columns=SIGNATURE.names)

    return sign


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of ids (``a`` < ``b``) by SimHash: texts of one fingerprint with the first of them, and the first ones of fingerprints within two bits."""
    fps = stage_table(nodes.groupBy("fp").agg(F.min("id").alias("first_id")), "node-fingerprints")
    same = nodes.join(fps, "fp").select(F.col("first_id").alias("x"), F.col("id").alias("y"))
    one, two = (fps.select(F.col("fp").alias(c), F.col("first_id").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    near = close_pairs(fps).join(one, "a").join(two, "b").select("x", "y")
    return same.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def central(crowd: DataFrame) -> DataFrame:
    """``key``, ``h_id``, ``h_size``, ``h_rest``: the member of each bucket that is nearest to the majority of its members, bit by bit.

    Of a text and its edited copies that is the text, which all of them resemble more than they do each other. A sum counts two bits at once, 32
    places apart.
    """
    lanes, low = F.lit((1 << 32) | 1), F.lit((1 << 32) - 1)
    votes = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.shiftrightunsigned(f, k).bitwiseAND(lanes)).alias(f"{f}_{k}") for f in ("f0", "f1") for k in range(32)])

    def majority(f: str) -> Column:
        counts = {k: F.col(f"{f}_{k}").bitwiseAND(low) for k in range(32)} | {k + 32: F.shiftrightunsigned(f"{f}_{k}", 32) for k in range(32)}
        return reduce(Column.bitwiseOR, [F.when(2 * c > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long"))
                                         .otherwise(F.lit(0).cast("long")) for b, c in counts.items()])

    centres = votes.select("key", majority("f0").alias("c0"), majority("f1").alias("c1"))
    off = distance(F.col("f0"), F.col("c0")) + distance(F.col("f1"), F.col("c1"))
    nearest = crowd.join(centres, "key").groupBy("key").agg(F.min(F.struct(off.alias("off"), "id", "size", "rest")).alias("m"))
    return nearest.select("key", *[F.col(f"m.{c}").alias(f"h_{c}") for c in ("id", "size", "rest")])


def within(size_a: Column, rest_a: Column, size_b: Column, rest_b: Column, least: float) -> Column:
    """Whether two sets can be as similar as ``least`` if a shingle with ``rest`` ones from it on is the first they share."""
    return F.least(rest_a, rest_b) >= least / (1 + least) * (size_a + size_b) - SLIP


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``key``, ``id``, ``size``, ``rest``, ``n``: the texts that share a shingle of their prefixes, ``n`` of them.

    ``rest`` counts the shingles of the text from the shared one on, in the common order.
    """
    dealt = nodes.select("id", "size", F.posexplode("first").alias("pos", "key")).select(
        "key", "id", "size", (F.col("size") - F.col("pos")).alias("rest")).repartition("key")
    many = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stage_table(dealt.join(many.hint("shuffle_hash"), "key"), "bucket-members")


def candidate_pairs(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of ids (``a`` < ``b``) that share a shingle of their prefixes, and the members of the buckets of more than ``GROUP_PAIRS``.

    Members of other buckets are paired with each other, those of the large ones with the central one only; ``remaining_pairs`` has the rest.
    """
    members = bucket_members(nodes)
    few = members.filter(F.col("n") <= GROUP_PAIRS).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "size", "rest"))).alias("m")).select(
        F.inline(F.flatten(F.transform("m", lambda x, i: F.transform(
            F.filter(F.slice("m", i + 2, F.size("m")), lambda y: within(x["size"], x["rest"], y["size"], y["rest"], least)),
            lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))))
    crowd = stage_table(members.filter(F.col("n") > GROUP_PAIRS).join(nodes.select("id", "f0", "f1"), "id"), "crowds")
    heads = stage_table(central(crowd), "crowd-heads")
    stars = crowd.join(heads, "key").filter(within(F.col("size"), F.col("rest"), F.col("h_size"), F.col("h_rest"), least)).select(
        F.least("h_id", "id").alias("a"), F.greatest("h_id", "id").alias("b"))
    return stage_table(few.unionByName(stars).filter("a < b").distinct(), "candidates"), crowd


def remaining_pairs(crowd: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """All pairs of members of a large bucket that are in different components so far.

    One of such a pair is outside the largest component of its bucket. These are dealt to blocks of all members, so a bucket whose members are
    nearly all linked costs little more than its rows, and one of which none are is the work of many tasks.
    """
    rooted = stage_table(crowd.select("key", "id", "size", "rest").join(roots.withColumnRenamed("node", "id"), "id", "left")
                         .withColumn("root", F.coalesce("root", "id")), "crowd-roots")
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    split = stage_table(parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n")).filter("n > most.c").select(
        "key", F.col("most.root").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most.c")) / CROWD).alias("crowds")), "crowd-splits")
    apart = rooted.join(split, "key")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", "block", "crowd", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "size", "rest", "root")])

    def each(column: str, n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(column)

    outside = apart.filter("root <> main").withColumn("crowd", F.pmod(F.xxhash64("id", F.lit(1)), F.col("crowds"))).select("*", each("block", "blocks"))
    member = apart.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Members are repeated only where those outside the largest component are many.
    members = member.filter("crowds = 1").withColumn("crowd", F.lit(0).cast("long")).unionByName(member.filter("crowds > 1").select("*", each("crowd", "crowds")))
    fit = within(*[F.col(c) for c in ("size_a", "rest_a", "size_b", "rest_b")], least)
    both = side(outside, "a").join(side(members, "b"), ["key", "block", "crowd"]).filter((F.col("root_a") != F.col("root_b")) & fit)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_hashes(t) for t in texts])


def similar_pairs(docs: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of five-word shingles have a Jaccard similarity of at least ``least``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stage_table(texts.select("doc_id", shingle_set("text").alias("s")), "shingle-sets")
    a, b = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), both.alias("both"))
    return joined.filter(F.col("both") >= least * (F.col("total") - F.col("both"))).select("a", "b")


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``keep_id`` of every document that has a near or exact copy; ``keep_id`` is the smallest id of its group."""
    named = docs.filter(F.col("doc_id").isNotNull())
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(named))
    signed = stage_table(named.select("doc_id", signatures(counts, least)("text").alias("s")).select("doc_id", "s.*"), "signatures")
    nodes = stage_table(signed.groupBy("c0", "c1").agg(
        F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("f0", "f1", "n", "fp", "size", "first")]), "signature-nodes")
    close = fingerprint_pairs(nodes.filter("n > 0"))
    pairs, crowd = candidate_pairs(nodes.filter("n > 0"), least)
    pairs = stage_table(close.unionByName(pairs).distinct(), "compared")
    links = stage_table(similar_pairs(named, pairs, least), "links")
    roots = components(links)
    if not crowd.isEmpty():
        rest = stage_table(remaining_pairs(crowd, roots, least).join(pairs, ["a", "b"], "left_anti"), "remaining")
        roots = components(links.unionByName(similar_pairs(named, rest, least)))
    least_id = roots.groupBy("root").agg(F.min("node").alias("keep_id"))
    renamed = stage_table(roots.join(least_id, "root").select(F.col("node").alias("id"), "keep_id"), "near-groups")
    kept = nodes.join(renamed, "id", "left").select("c0", "c1", F.coalesce("keep_id", "id").alias("keep_id"))
    return signed.select("doc_id", "c0", "c1").join(kept, ["c0", "c1"]).select("doc_id", "keep_id")


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of near or exact copies, the one with the smallest ``doc_id``, with all columns."""
    removed = stage_table(near_groups(docs, least).filter("doc_id <> keep_id").select("doc_id").distinct(), "near-copies")
    left = docs.filter(F.col("doc_id").isNotNull()).join(removed, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))
