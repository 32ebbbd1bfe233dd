"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# One extracted fact. ``source_rank`` and ``pos`` make the order of facts explicit:
# sources in rank order, facts of one source in ``pos`` order.
EVIDENCE = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("row", T.LongType()),
    T.StructField("column", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("attribute", T.StringType()),
    T.StructField("raw_value", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("evidence_text", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_rank", T.IntegerType()),
    T.StructField("pos", T.LongType()),
])

# A fact as stored in JSON: no rank or position, these come with the file.
STORED_FACT = T.StructType([f for f in EVIDENCE.fields if f.name not in ("source_rank", "pos")])

# One source read for one product.
ENVELOPE = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("evidence", T.ArrayType(STORED_FACT)),
    T.StructField("error", T.StringType()),
    T.StructField("source_ref", T.StringType()),
    T.StructField("pages_read", T.LongType()),
    T.StructField("rows_read", T.LongType()),
])

CLAIM = T.StructType([
    T.StructField("claim_text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("evidence_sources", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("notes", T.StringType()),
])

OPEN_CONFLICT = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("action_needed", T.StringType()),
])

RESPONSE = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("technical_description", T.StringType()),
    T.StructField("key_selling_points", T.ArrayType(T.StringType())),
    T.StructField("target_applications", T.ArrayType(T.StringType())),
    T.StructField("suggested_keywords", T.ArrayType(T.StringType())),
    T.StructField("inferred_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source_backed_claims", T.ArrayType(CLAIM)),
    T.StructField("inferred_claims", T.ArrayType(CLAIM)),
    T.StructField("unresolved_conflicts", T.ArrayType(OPEN_CONFLICT)),
    T.StructField("missing_information_notes", T.ArrayType(T.StringType())),
    T.StructField("enrichment_warnings", T.ArrayType(T.StringType())),
])

CATALOG_INPUT = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("mfg_part_num", T.StringType()),
    T.StructField("part_desc", T.StringType()),
    T.StructField("e1_brand", T.StringType()),
    T.StructField("unilog_brand", T.StringType()),
    T.StructField("dib_brand", T.StringType()),
    T.StructField("part_manuf", T.StringType()),
])

# The fields of a provenance pointer, taken from an evidence row.
REF_COLUMNS = ["source_id", "source_type", "product_id", "attribute", "raw_value", "unit", "value", "method",
               "confidence", "page", "row", "column", "url", "section"]


def ref_struct(alias: str = "ref") -> F.Column:
    """Provenance pointer of an evidence row as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in REF_COLUMNS]).alias(alias)


def conform(df: DataFrame, schema: T.StructType = EVIDENCE) -> DataFrame:
    """Select ``schema``'s columns in order; absent ones become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])
