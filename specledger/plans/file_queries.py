"""Queries over real files: tables are written as a user's files would be, and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from specledger.plans import catalog_oracle as co
from specledger.plans import inputs, oracle
from specledger.plans.catalog_queries import EXPORT, HEADERS, enriched
from specledger.plans.inputs import K
from specledger.plans.registry import register
from specledger.session import stage_dir
from specledger.sinks import delivery
from specledger.sources import stored


def folder(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """Several files whose names follow the order of the rows, with line breaks and quotes inside values."""
    parts = df.repartitionByRange(4, order).sortWithinPartitions(order).drop(order)
    parts.write.csv(path, header=True, quote='"', escape='"', emptyValue="")


# Every eleventh description has a line break, every seventh a quoted word.
_DESC = f"case when {K} % 11 = 0 then replace(part_desc, 'V ', concat('V', chr(10))) when {K} % 7 = 0 then concat('\"', part_desc, '\", said') else part_desc end"
_FILE_ROWS = "SELECT row_id, mfg_part_num, " + _DESC.replace(K, "(row_id - 1)") + " AS part_desc, e1_brand, unilog_brand, dib_brand, part_manuf FROM rows"


@register("read_catalog_csv", _FILE_ROWS, co.INPUT)
def _catalog(spark, sf):
    """Catalog files with values of several lines; rows are numbered in file order."""
    raw = inputs.catalog_raw(spark, sf).withColumn(K, F.col("row_id") - 1)
    path = folder(spark, "catalog-csv")
    write_csv(raw.select("row_id", F.col("mfg_part_num").alias("Mfg_Part_Num"), F.expr(_DESC).alias("Part_Desc"), F.col("e1_brand").alias("E1_Brand"),
                         F.col("unilog_brand").alias("Unilog_Brand"), F.col("dib_brand").alias("DIB_Brand"), F.col("part_manuf").alias("Part_Manuf")), path, "row_id")
    return stored.read_catalog(spark, path)


_PART_NO = f"case when {K} % 4 = 0 then '' else {inputs.GOLD['mfg_part_num']} end"
_GOLD_FILE = {"Mfg_Part_Num": _PART_NO, "MANUFACTURER_PART_NUMBER": inputs.GOLD["expected_mfr_part_num"],
              **{c: inputs.GOLD[n] for n, c in stored.GOLD_COLUMNS.items() if n in inputs.GOLD}, **inputs.GOLD_WIDE}


def _gold_file(spark, sf) -> DataFrame:
    path = folder(spark, "gold-csv")
    part = inputs.table(spark, sf, "part")
    write_csv(part.select(F.expr(inputs.GOLD["row_id"]).alias("row_id"), *[F.expr(e).alias(n) for n, e in _GOLD_FILE.items()]), path, "row_id")
    return stored.read_gold(spark, path)


_GOLD_NAMES = [n for n in stored.GOLD_COLUMNS if n.startswith("expected_")]


@register("read_gold_csv", f"SELECT {inputs.GOLD['row_id']} AS row_id, trim(coalesce(nullif({_PART_NO}, ''), {inputs.GOLD['expected_mfr_part_num']})) AS mfg_part_num,"
          f" {inputs.GOLD['expected_mfr_part_num']} AS expected_mfr_part_num, {inputs.GOLD['raw_manuf']} AS raw_manuf, "
          + ", ".join(f"{inputs.GOLD[n]} AS {n}" for n in _GOLD_NAMES) + " FROM part")
def _gold(spark, sf):
    return stored.gold_rows(_gold_file(spark, sf)).select("row_id", "mfg_part_num", "expected_mfr_part_num", "raw_manuf", *_GOLD_NAMES)


@register("read_gold_attributes_csv", "SELECT * FROM gold_attrs", co.GOLD_ATTRS)
def _gold_attributes(spark, sf):
    return stored.gold_attributes(_gold_file(spark, sf))


@register("delivery_round_trip", "SELECT * FROM delivery", EXPORT)
def _delivery(spark, sf):
    """The export as CSV files, read back with the header as it was written."""
    path = folder(spark, "delivery-csv")
    delivery.write_delivery_csv(delivery.to_delivery(enriched(spark, sf), HEADERS), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in back.columns])


_FACT = ["source_type", "product_id", "attribute", "raw_value", "value", "unit", "source_rank", "pos"]
_STATUS = "case when {k} % 7 = 0 then 'failed' when {k} % 7 = 1 then 'partial' else 'success' end"


@register("read_evidence_json", f"SELECT {', '.join(_FACT[:-1])}, row_number() OVER (PARTITION BY product_id, source_type ORDER BY pos) - 1 AS pos FROM ev WHERE product_id <> 'GLOBAL' AND source_type <> 'web' AND"
          f" ({_STATUS.format(k='length(product_id)')} <> 'failed' OR source_type = 'csv')", oracle.EVIDENCE)
def _evidence(spark, sf):
    """An envelope per product and source as JSON lines. Of the products whose reading failed only the CSV facts count."""
    facts = inputs.evidence(spark, sf, with_web=False).filter("product_id <> 'GLOBAL'")
    columns = [F.col(f"`{c}`") for c in stored.STORED_FACT.names]
    envelopes = facts.groupBy("product_id", "source_type", "source_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("e")))), lambda x: x["e"]).alias("evidence"))
    path = folder(spark, "evidence-json")
    status = F.when(F.col("source_type") == "csv", "success").otherwise(F.expr(_STATUS.format(k="length(product_id)")))
    envelopes.withColumn("status", status).write.json(path)
    read = stored.read_evidence_json(spark, path, lines=True)
    return read.select(*_FACT)

