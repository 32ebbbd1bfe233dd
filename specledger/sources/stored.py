"""Stored evidence, catalog files, and how sources come together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from specledger import dims
from specledger.functions.text import clean_string, literal_map, strip
from specledger.operators.skew import join_few
from specledger.schema import CATALOG_INPUT, ENVELOPE, EVIDENCE, STORED_FACT, conform
from specledger.sources.records import read_csv

FAILED = "failed"

# An evidence file holds one envelope, or a bare list of facts: one schema reads both.
_FILE = T.StructType(ENVELOPE.fields + [f for f in STORED_FACT.fields if f.name not in ENVELOPE.names])


def _envelopes(spark: SparkSession, path: str | list[str], lines: bool) -> DataFrame:
    """One envelope or list per file, or with ``lines`` one envelope per line, so that a large file is read by many tasks."""
    return spark.read.schema(_FILE).json(path, multiLine=not lines)


def read_extraction_log(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row per stored source read: status, error and number of facts, without the facts."""
    raw = _envelopes(spark, path, lines)
    return raw.filter(F.col("status").isNotNull()).select(
        "source_id", "source_type", "product_id", "status", "error", "source_ref",
        F.coalesce(F.size("evidence"), F.lit(0)).alias("n_facts"))


def read_evidence_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Facts of stored evidence files. A failed source gives none; a bare list of facts is read as well.

    ``pos`` counts from 0 in each envelope; the source tells envelopes apart (see ``fact_key``).
    """
    raw = _envelopes(spark, path, lines)
    raw = raw.filter(F.coalesce(F.col("status"), F.lit("")) != FAILED)
    wrapped = raw.filter(F.col("evidence").isNotNull()).select(F.posexplode("evidence").alias("pos", "e")).select(
        "e.*", F.col("pos").cast("long").alias("pos"))
    bare = raw.filter(F.col("attribute").isNotNull()).select(
        *STORED_FACT.names, F.monotonically_increasing_id().alias("pos"))
    facts = wrapped.unionByName(bare)
    return conform(facts.withColumn("source_rank", source_rank(F.col("source_type"), F.col("product_id"))), EVIDENCE)


def source_rank(source_type: Column, product_id: Column) -> Column:
    """Fixed order of sources: by type, with facts that hold for all products last."""
    rank = literal_map(source_type, dims.SOURCE_RANKS).cast("int")
    return F.when(product_id == dims.GLOBAL_ID, dims.GLOBAL_RANK).otherwise(F.coalesce(rank, F.lit(2)))


def split_global(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of single products, and facts that hold for all of them."""
    is_global = F.col("product_id") == dims.GLOBAL_ID
    return evidence.filter(~is_global), evidence.filter(is_global)


def compact_global(facts: DataFrame) -> DataFrame:
    """Facts for all products, one row per distinct content: the first one, with the number of copies.

    Page constants repeat on every page; what differs between copies is only the place.
    """
    content = ["source_type", "attribute", "raw_value", "value", "unit", "confidence"]
    places = ["source_id", "page", "row", "column", "url", "section", "evidence_text", "method"]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in places]), "pos").alias("first")
    out = facts.groupBy(*content).agg(first, F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_copies"))
    return out.select(*content, "first.*", "pos", "n_copies",
                      F.lit(dims.GLOBAL_ID).alias("product_id"), F.lit(dims.GLOBAL_RANK).alias("source_rank"))


def collect_sources(sources: list[DataFrame], products: DataFrame, global_facts: DataFrame) -> DataFrame:
    """All facts in source order, with the facts for all products repeated for each product.

    The normaliser does not need this: it merges those facts once per field (see ``assemble_fields``). This is the
    explicit table, which has a row per product and distinct shared fact by its nature; its work is dealt by products (see ``join_few``).
    """
    own = sources[0]
    for other in sources[1:]:
        own = own.unionByName(other)
    shared = compact_global(global_facts).drop("product_id").withColumn("_all", F.lit(1))
    ids = products.select("product_id").distinct().withColumn("_all", F.lit(1))
    met = join_few(ids, shared, "_all", "product_id")
    return own.select(*EVIDENCE.names, F.lit(1).cast("long").alias("n_copies")).unionByName(met.select(*EVIDENCE.names, "n_copies"))


def extraction_summary(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attempted, succeeded and failed sources per type over the manifest, and total facts.

    ``total_evidence`` leaves out web facts; ``total_with_web`` has all. A partial web read counts as a success.
    """
    types = list(dims.SOURCE_RANKS)
    tried = manifest.select("product_id").distinct().withColumn(
        "source_type", F.explode(F.array(*[F.lit(t) for t in types])))
    ok = (F.col("status") == "success") | ((F.col("source_type") == "web") & (F.col("status") == "partial"))
    state = log.groupBy("product_id", "source_type").agg(F.max(ok).alias("ok"))
    joined = tried.join(state, ["product_id", "source_type"], "left").withColumn(
        "ok", F.coalesce(F.col("ok"), F.lit(False)))
    per_type = []
    for t in types:
        here = F.col("source_type") == t
        per_type += [F.count_if(here).alias(f"{t}_attempted"), F.count_if(here & F.col("ok")).alias(f"{t}_succeeded"),
                     F.count_if(here & ~F.col("ok")).alias(f"{t}_failed")]
    counts = joined.agg(F.count_if(F.col("source_type") == types[0]).alias("products_discovered"), *per_type)
    totals = log.agg(
        F.coalesce(F.sum(F.when(F.col("source_type") != "web", F.col("n_facts"))), F.lit(0)).cast("long")
        .alias("total_evidence"),
        F.coalesce(F.sum("n_facts"), F.lit(0)).cast("long").alias("total_with_web"))
    return counts.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k").drop("_k")


def catalog_rows(df: DataFrame) -> DataFrame:
    """Input rows under their internal names, trimmed, with placeholders as null."""
    def brand(c: str) -> Column:
        return clean_string(F.col(c))

    return conform(df.select(
        "row_id",
        F.coalesce(strip(F.col("Mfg_Part_Num")), F.lit("")).alias("mfg_part_num"),
        F.coalesce(strip(F.col("Part_Desc")), F.lit("")).alias("part_desc"),
        brand("E1_Brand").alias("e1_brand"), brand("Unilog_Brand").alias("unilog_brand"),
        brand("DIB_Brand").alias("dib_brand"), brand("Part_Manuf").alias("part_manuf"),
    ), CATALOG_INPUT)


def _own_ids(df: DataFrame, row_id: str | None) -> DataFrame:
    return df.withColumn("row_id", F.col(f"`{row_id}`").cast("long")) if row_id else df


def read_catalog(spark: SparkSession, path: str | list[str], row_id: str | None = None,
                 encoding: str = "UTF-8") -> DataFrame:
    """Catalog CSV. Rows are numbered in file order unless ``row_id`` names an id column."""
    return catalog_rows(_own_ids(read_csv(spark, path, encoding), row_id))


# --- fixed values: gold columns by internal name ---
GOLD_COLUMNS = {
    "sku": "SKU - MY_PART_NUMBER",
    "part_number": "PART_NUMBER",
    "part_desc": "Part_Desc",
    "raw_manuf": "Part_Manuf",
    "expected_manufacturer": "MANUFACTURER_NAME",
    "expected_brand": "BRAND_NAME",
    "expected_trade_name": "TRADE_NAME",
    "expected_classpath": "Classpath",
    "expected_product_name": "Product Name",
    "expected_short_desc": "SHORT_DESC",
    "expected_long_desc": "LONG_DESC1",
}


def gold_rows(df: DataFrame) -> DataFrame:
    """Expected values under internal names; the part number comes from either of two columns."""
    have = set(df.columns)

    def text(c: str) -> Column:
        return F.col(f"`{c}`") if c in have else F.lit(None).cast("string")

    part = strip(F.coalesce(F.nullif(text("Mfg_Part_Num"), F.lit("")), text("MANUFACTURER_PART_NUMBER"), F.lit("")))
    mfr_part = F.coalesce(text("MANUFACTURER_PART_NUMBER"), F.lit("")) if "MANUFACTURER_PART_NUMBER" in have else part
    return df.select(
        F.col("row_id").cast("long").alias("row_id"), part.alias("mfg_part_num"),
        mfr_part.alias("expected_mfr_part_num"),
        *[(F.coalesce(text(c), F.lit("")) if n.startswith("expected_") else text(c)).alias(n)
          for n, c in GOLD_COLUMNS.items()])


def gold_attributes(df: DataFrame, n: int = dims.MAX_TRIPLES) -> DataFrame:
    """Label, value and unit columns 1..n as rows; kept when label or value is filled."""
    have = set(df.columns)

    def text(kind: str, i: int) -> Column:
        name = f"ATTRIBUTE_{kind} {i}"
        return strip(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in have else F.lit("")

    triples = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), text("LABEL", i).alias("label"), text("VALUE", i).alias("value"),
                 F.nullif(text("UOM", i), F.lit("")).alias("uom"))
        for i in range(1, n + 1) if {f"ATTRIBUTE_LABEL {i}", f"ATTRIBUTE_VALUE {i}"} & have
    ])
    return df.select(F.col("row_id").cast("long").alias("row_id"), F.inline(triples)).filter(
        (F.col("label") != "") | (F.col("value") != ""))


def read_gold(spark: SparkSession, path: str | list[str], row_id: str | None = None,
              encoding: str = "UTF-8") -> DataFrame:
    """Gold CSV with its wide columns and a ``row_id``; see ``gold_rows`` and ``gold_attributes``."""
    return _own_ids(read_csv(spark, path, encoding), row_id)
