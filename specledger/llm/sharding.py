"""Shards as contiguous runs of atomic groups with the smallest possible largest shard (operator 6). DataFrame functions only.

Equal texts form a group that is never split. Groups are ordered by the SHA-256 of their text, so a shard is a range of digests and a row finds its
shard by comparing its digest with the cuts. The capacity is found by binary search, many candidates at a time: for each, shards are filled
greedily from the left, and the smallest capacity for which the groups fit is kept. Only sums over buckets of digests (``BUCKETS`` rows) and the few
groups at a fill limit come to the driver: a limit names a bucket, and the last group below it is looked up in that bucket alone.

Places in a shard come from row counts of small slices, so no group of copies is one task: the slice of a row is its bucket and a hash of its id, with
as many slices as the bucket's rows need.

Defined results: a null text has size 1, CRC-32 of the empty string, and is a group of its own with the empty text; repeated rows are rows of
one group; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from specledger.session import drop_stages, stage_table

BUCKET_HEX = 3
BUCKETS = 16 ** BUCKET_HEX
FANOUT = 64
SLICE_ROWS = 20_000


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       digest.alias("digest"), F.conv(F.substring(digest, 1, BUCKET_HEX), 16, 10).cast("int").alias("bucket"))


class Prefix:
    """Sums of group sizes in order of digest: ``below(limits)`` gives, per limit, the largest sum of leading groups that is not above it."""

    def __init__(self, rows: DataFrame):
        groups = rows.groupBy("bucket", "digest").agg(F.sum("size").alias("size"))
        running = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
        self.groups = stage_table(groups.select("bucket", "digest", "size", F.sum("size").over(running).alias("upto")), "shard-groups")
        sums = {r["bucket"]: (r["total"], r["most"]) for r in self.groups.groupBy("bucket").agg(
            F.sum("size").alias("total"), F.max("size").alias("most")).collect()}
        self.starts, self.order, total = [], sorted(sums), 0
        for bucket in self.order:
            self.starts.append(total)
            total += sums[bucket][0]
        self.total = total
        self.largest = max((most for _, most in sums.values()), default=0)

    def below(self, limits: list[int]) -> dict[int, int]:
        """A bucket's own sums are only looked at for the limits inside it."""
        out = {limit: self.total for limit in limits if limit >= self.total}
        inside = [(limit, k) for limit in set(limits) if limit < self.total for k in [bisect_right(self.starts, limit) - 1]]
        if inside:
            asked = F.explode(F.array(*[F.struct(F.lit(self.order[k]).alias("bucket"), F.lit(limit).cast("long").alias("limit"),
                                                 F.lit(limit - self.starts[k]).cast("long").alias("rest")) for limit, k in inside])).alias("a")
            table = self.groups.sparkSession.range(1).select(asked).select("a.*")
            wanted = self.groups.filter(F.col("bucket").isin({self.order[k] for _, k in inside})).select("bucket", "upto")
            found = {r["limit"]: r["upto"] for r in wanted.join(F.broadcast(table), "bucket").filter("upto <= rest").groupBy("limit").agg(
                F.max("upto").alias("upto")).collect()}
            out |= {limit: self.starts[k] + found.get(limit, 0) for limit, k in inside}
        return out


def greedy(prefix: Prefix, capacities: list[int], shards: int) -> dict[int, list[int]]:
    """The sums at which shards end when each is filled up to the capacity, all capacities at once."""
    ends: dict[int, list[int]] = {c: [] for c in capacities}
    for _ in range(shards):
        limits = {c: (e[-1] if e else 0) + c for c, e in ends.items()}
        got = prefix.below(list(limits.values()))
        for c, limit in limits.items():
            ends[c].append(got[limit])
    return ends


def smallest_capacity(prefix: Prefix, shards: int, fanout: int = FANOUT) -> tuple[int, list[int]]:
    """The smallest capacity with which all groups fit, and where its shards end."""
    low = max(-(-prefix.total // shards), prefix.largest)
    # A shard leaves less than one group's room unused, so this always fits.
    high = -(-prefix.total // shards) + prefix.largest
    best = greedy(prefix, [high], shards)[high]
    while low < high:
        step = max(1, (high - low) // fanout)
        tried = list(range(low, high, step))
        ends = greedy(prefix, tried, shards)
        fits = [c for c in tried if ends[c][-1] == prefix.total]
        if fits:
            high, best = fits[0], ends[fits[0]]
            misses = [c for c in tried if c < high]
        else:
            misses = tried
        if misses:
            low = misses[-1] + 1
    return high, best


def cut_digests(prefix: Prefix, ends: list[int]) -> list[str]:
    """The last digest of each shard but the last; a shard without groups repeats the one before."""
    places = [(end, bisect_right(prefix.starts, end - 1) - 1) for end in ends[:-1] if end > 0]
    if not places:
        return ["" for _ in ends[:-1]]
    match = F.lit(False)
    for end, k in places:
        match = match | ((F.col("bucket") == prefix.order[k]) & (F.col("upto") == end - prefix.starts[k]))
    rows = prefix.groups.filter(match).select("bucket", "upto", "digest").collect()
    found = {(r["bucket"], r["upto"]): r["digest"] for r in rows}
    at = {end: found[prefix.order[k], end - prefix.starts[k]] for end, k in places}
    return [at.get(end, "") for end in ends[:-1]]


def shard_of(digest: Column, cuts: list[str]) -> Column:
    return sum([(digest > F.lit(c)).cast("int") for c in cuts], F.lit(0))


def slots(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Gapless places in each shard, in order of bucket, slice and id."""
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    slices = stage_table(sizes.select("shard", "bucket", (1 + F.floor(F.col("n") / slice_rows)).cast("int").alias("slices")), "slices")
    dealt = rows.join(slices, ["shard", "bucket"]).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    dealt = stage_table(dealt.drop("slices"), "sliced")
    counts = dealt.groupBy("shard", "bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage_table(counts.select("shard", "bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "slice-bases")
    own = Window.partitionBy("shard", "bucket", "slice").orderBy("doc_id", "digest")
    return dealt.withColumn("own", F.row_number().over(own)).join(bases, ["shard", "bucket", "slice"]).withColumn(
        "slot", (F.col("base") + F.col("own") - 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    rows = stage_table(sized(docs), "sized")
    prefix = Prefix(rows)
    cuts = cut_digests(prefix, smallest_capacity(prefix, shards)[1]) if prefix.total else []
    drop_stages(prefix.groups)
    return slots(rows.withColumn("shard", shard_of(F.col("digest"), cuts).cast("int"))).select("doc_id", "size", "text_crc32", "shard", "slot")
