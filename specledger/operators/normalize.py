"""Evidence to canonical values, disagreements and per-field results.

The working form is long: one row per fact, then one row per product and field. A product's facts are never gathered
into one list, so a product with a very large share of the facts costs no more than its rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.functions import units, values
from specledger.functions.text import blank_to_null, literal_map
from specledger.operators.once import once
from specledger.operators.skew import join_few, join_spread
from specledger.schema import REF_COLUMNS, ref_struct

KEYS = ["product_id", "canonical_field"]
SUCCESS = ["normalized", "passthrough"]


def fact_order() -> Column:
    """Source rank and position as one sortable number."""
    return F.shiftleft(F.col("source_rank").cast("long"), 56) + F.col("pos")


def fact_key() -> Column:
    """Total order of facts: rank, source, position, then all that tells two facts apart. Ties are equal in every column that is read."""
    return F.struct(F.col("source_rank"), F.col("source_id").alias("_source"), F.col("pos"), F.col("url").alias("_url"), ref_struct("ref"))


# The fields of a provenance pointer that the order of facts does not begin with.
_REF_REST = [c for c in REF_COLUMNS if c not in ("source_id", "product_id", "url")]


def _narrow_key() -> Column:
    """``fact_key`` of one product's facts, each field once."""
    return F.struct("source_rank", "source_id", "pos", "url", *[F.col(f"`{c}`") for c in _REF_REST])


def _key_ref(key: Column, product_id: Column) -> Column:
    """The provenance pointer in a narrow key."""
    return F.when(key.isNotNull(), F.struct(*[(product_id if c == "product_id" else key[c]).alias(c) for c in REF_COLUMNS]))


def map_attributes(evidence: DataFrame, attributes: Mapping[str, Sequence[str]] = dims.CANONICAL_ATTRIBUTES,
                   metadata: Sequence[str] = tuple(dims.METADATA_ATTRIBUTES),
                   skipped: Sequence[str] = tuple(dims.SKIPPED_ATTRIBUTES)) -> DataFrame:
    """Add ``canonical_field`` and ``kind`` (canonical, metadata, skip, unmapped).

    Names match exactly first, then in lower case.
    """
    kinds = {**{n: "metadata" for n in metadata}, **{n: "skip" for n in skipped}}
    fields = {n: f for f, names in attributes.items() for n in names}
    lower = _names({n.lower(): f for n, f in fields.items()}, {n.lower(): k for n, k in kinds.items()}, evidence)
    exact = _names(fields, kinds, evidence)
    rows = evidence.join(exact.toDF("attribute", "_field", "_kind"), "attribute", "left").withColumn("_lower", F.lower("attribute")).join(
        lower.toDF("_lower", "_lower_field", "_lower_kind"), "_lower", "left")
    field = F.coalesce("_field", "_lower_field")
    return rows.select(*[F.col(f"`{c}`") for c in evidence.columns], field.alias("canonical_field"), F.when(field.isNotNull(), "canonical").otherwise(
        F.coalesce("_kind", "_lower_kind", F.lit("unmapped"))).alias("kind"))


def _names(fields: Mapping[str, str], kinds: Mapping[str, str], evidence: DataFrame) -> DataFrame:
    """Field and kind of each known name. The lists are fixed, so their join is a hash look-up in the task that holds the fact."""
    rows = [{"name": n, "field": fields.get(n), "kind": kinds.get(n)} for n in {**fields, **kinds}]
    names = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,field:string,kind:string>>")
    return F.broadcast(evidence.sparkSession.range(0, 1, 1, 1).select(F.inline(names)))


def route(mapped: DataFrame) -> dict[str, DataFrame]:
    """Facts by what happens to them."""
    return {
        "canonical": mapped.filter(F.col("kind") == "canonical"),
        "unmapped": mapped.filter(F.col("kind") == "unmapped"),
        "dropped": mapped.filter(F.col("kind").isin("metadata", "skip")),
    }


def unmapped_evidence(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("kind") == "unmapped").drop("canonical_field", "kind")


def normalize_values(mapped: DataFrame) -> DataFrame:
    """Value in the canonical unit for each canonical fact, or the reason why there is none.

    Adds ``value_num`` or ``value_str``, ``canonical_unit`` and ``outcome``. A value parsed by the source is
    preferred; a unit in the text counts only when the fact has none of its own.
    """
    facts = mapped.filter(F.col("kind") == "canonical")
    field, raw = F.col("canonical_field"), F.col("raw_value")
    is_text = field.isin(dims.STRING_FIELDS)
    # Parsing is done once per fact; the small steps after it may be copied into filters.
    given = once(facts, {
        "_num": F.coalesce("value", values.number_of(raw)),
        "_unit": F.when(F.col("value").isNull(), F.coalesce("unit", values.unit_of(raw))).otherwise(F.col("unit"))})
    parts = given.withColumn("_part", units.unit_part(F.col("_unit")))
    ready = once(parts, {"_factor": units.unit_factor(field, F.col("_part"))})
    num = units.canonical_value(field, F.col("_num"), F.col("_part"), F.col("_factor"))
    text = F.when(field == "ip_rating", F.coalesce(values.parse_ip_rating(raw), F.lit(""))).otherwise(
        values.parse_frame_size(raw))
    expected = literal_map(field, {f: u for f, u in dims.CANONICAL_FIELDS if u is not None})
    outcome = (
        F.when(is_text, F.when((field == "ip_rating") | (blank_to_null(raw).isNotNull()), "passthrough")
               .otherwise("parse_error"))
        .when(F.col("_num").isNull(), "parse_error")
        .when(F.col("_factor").isNull(), "unknown_unit")
        .when(F.col("_unit").eqNullSafe(expected), "passthrough").otherwise("normalized")
    )
    return ready.select(
        *facts.columns,
        F.when(~is_text & F.col("_factor").isNotNull(), num).alias("value_num"),
        F.when(is_text, text).alias("value_str"),
        F.when(~is_text & F.col("_num").isNotNull() & F.col("_factor").isNotNull(), expected).alias("canonical_unit"),
        outcome.alias("outcome"))


def failure_reason() -> Column:
    """Why a fact has no canonical value."""
    text = F.coalesce(F.concat(F.lit("'"), F.col("raw_value"), F.lit("'")), F.lit("no text"))
    return F.when(F.col("outcome") == "parse_error", F.concat(F.lit("cannot read "), text)).when(
        F.col("outcome") == "unknown_unit", F.concat_ws(" ", F.lit("no conversion for"), F.col("canonical_field"), F.lit(
            "from unit"), F.coalesce("unit", values.unit_of(F.col("raw_value")))))


def normalize(evidence: DataFrame) -> DataFrame:
    return normalize_values(map_attributes(evidence))


def normalization_issues(normalized: DataFrame) -> DataFrame:
    """Facts that could not be read or converted, with reason and provenance."""
    return normalized.filter(F.col("outcome").isin("parse_error", "unknown_unit")).select(
        "product_id", "canonical_field", F.col("attribute").alias("evidence_attribute"), "raw_value",
        F.col("unit").alias("raw_unit"), "outcome", failure_reason().alias("reason"), ref_struct("source_ref"), "source_rank", "pos")


def field_grid(products: DataFrame) -> DataFrame:
    """Every product with every canonical field."""
    cells = F.array(*[F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("canonical_field"),
                               F.lit(u).cast("string").alias("canonical_unit"))
                      for i, (f, u) in enumerate(dims.CANONICAL_FIELDS)])
    return products.select("product_id", F.inline(cells))


def manifest_join(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """Identity columns of each id, Unknown where the manifest has none."""
    return ids.join(manifest.select("product_id", "manufacturer", "model"), "product_id", "left").select(
        *ids.columns, F.coalesce("manufacturer", F.lit("Unknown")).alias("manufacturer"),
        F.coalesce("model", F.lit("Unknown")).alias("model"))


def _is_ok() -> Column:
    return F.col("value_num").isNotNull() | F.col("value_str").isNotNull()


def _field_aggregates(copies: Column) -> list[Column]:
    """What one pass over the facts of a field must know; every part combines before the shuffle.

    The first fact comes as one struct that begins with its place in the order, so a single minimum finds it with all it brings. Most rows of the
    shuffle stand for one fact, so a fact is in them once: ``rep`` is the first usable fact, ``first`` the first of the others.
    """
    ok, order = _is_ok(), F.col("_key")
    kilowatt = (F.col("canonical_field") == "rated_power") & F.col("value").isNotNull() & F.col("unit").isin("kW", "kw")
    return [
        F.sum(F.when(order.isNotNull(), copies).otherwise(0)).cast("long").alias("n_refs"),
        F.sum(F.when(ok, copies).otherwise(0)).cast("long").alias("n_ok"),
        F.min(F.when(ok, F.struct(order.alias("key"), "value_num", "value_str", "outcome"))).alias("rep"),
        # The first of all facts is this one or that of ``rep``.
        F.min(F.when(~ok, order)).alias("first"),
        F.min("value_num").alias("min_num"), F.max("value_num").alias("max_num"),
        F.min("value_str").alias("min_str"), F.max("value_str").alias("max_str"),
        F.min("value").alias("raw_low"), F.max("value").alias("raw_high"),
        # Exact sums, so that the mean does not depend on the order of the rows.
        F.sum(F.when(ok, F.col("confidence").cast("decimal(12,6)") * copies)).alias("sum_confidence"),
        F.collect_set("source_type").alias("source_types"),
        F.min(F.when(kilowatt, F.struct(F.abs("value").alias("size"), F.col("_key.source_rank").alias("rank"), F.col("_key.pos").alias("pos"), "value"))).alias("kw"),
    ]


def _with_refs(agg: DataFrame, product_id: Column) -> DataFrame:
    """``rep`` and ``first`` with whole provenance pointers, ``first`` over all facts."""
    first = F.least(F.col("rep.key"), F.col("first"))
    rep = F.struct(_key_ref(F.col("rep.key"), product_id).alias("ref"), F.col("rep.value_num"), F.col("rep.value_str"), F.col("rep.outcome"))
    return agg.withColumns({"rep": F.when(F.col("rep").isNotNull(), rep), "first": _key_ref(first, product_id)})


def global_field_values(global_normalized: DataFrame) -> DataFrame:
    """Facts that hold for all products, merged per field: at most one row per canonical field."""
    copies = F.col("n_copies") if "n_copies" in global_normalized.columns else F.lit(1)
    out = global_normalized.withColumn("_key", _narrow_key()).groupBy("canonical_field").agg(*_field_aggregates(copies))
    out = _with_refs(out, F.lit(dims.GLOBAL_ID))
    return out.select("canonical_field", *[F.col(c).alias(f"g_{c}") for c in out.columns if c != "canonical_field"])


def assemble_fields(normalized: DataFrame, products: DataFrame, global_normalized: DataFrame | None = None,
                    tolerance: float = dims.CONFLICT_TOLERANCE) -> DataFrame:
    """One row per product and canonical field.

    The first successful fact stands for the field. Any other successful fact that differs from it makes the field a
    conflict with a null value: no winner is picked. Missing fields get a row as well: the grid is united with the facts
    before the aggregation, so one shuffle of pre-aggregated rows does both.
    """
    columns = [*KEYS, "value_num", "value_str", "outcome", "confidence", "source_type", "value", "unit", "_key"]
    facts = normalized.withColumn("_key", _narrow_key()).select(*columns, F.lit(False).alias("_grid"))
    grid = field_grid(products).select(*[
        F.col(c) if c in KEYS else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in columns
    ], F.lit(True).alias("_grid"))
    agg = facts.unionByName(grid).groupBy(*KEYS).agg(F.max("_grid").alias("_listed"), *_field_aggregates(F.lit(1)))
    agg = _with_refs(agg.filter("_listed").drop("_listed"), F.col("product_id"))
    if global_normalized is not None:
        shared = global_field_values(global_normalized)
        own = F.col("n_ok") > 0
        # One row per canonical field: the size of this side is fixed by the field list.
        agg = agg.join(F.broadcast(shared), "canonical_field", "left").select(
            *KEYS,
            (F.col("n_refs") + F.coalesce("g_n_refs", F.lit(0))).alias("n_refs"),
            (F.col("n_ok") + F.coalesce("g_n_ok", F.lit(0))).alias("n_ok"),
            F.when(own, F.col("rep")).otherwise(F.col("g_rep")).alias("rep"), F.coalesce("first", "g_first").alias("first"),
            F.least("min_num", "g_min_num").alias("min_num"), F.greatest("max_num", "g_max_num").alias("max_num"),
            F.least("raw_low", "g_raw_low").alias("raw_low"), F.greatest("raw_high", "g_raw_high").alias("raw_high"),
            F.least("min_str", "g_min_str").alias("min_str"), F.greatest("max_str", "g_max_str").alias("max_str"),
            F.when(F.col("n_ok") + F.coalesce("g_n_ok", F.lit(0)) > 0,
                   F.coalesce("sum_confidence", F.lit(0)) + F.coalesce("g_sum_confidence", F.lit(0)))
            .alias("sum_confidence"),
            F.array_union("source_types", F.coalesce("g_source_types", F.array().cast("array<string>")))
            .alias("source_types"),
            F.when(F.col("g_kw.size") < F.col("kw.size"), F.col("g_kw")).otherwise(F.coalesce("kw", "g_kw")).alias("kw"))
    agg = agg.select("*", F.col("rep.value_num").alias("rep_num"), F.col("rep.value_str").alias("rep_str"), F.col("rep.outcome").alias("rep_outcome"))
    differs = F.coalesce(
        (F.col("max_num") - F.col("rep_num") > tolerance) | (F.col("rep_num") - F.col("min_num") > tolerance),
        F.col("min_str") != F.col("max_str"), F.lit(False))
    order = {f: i for i, (f, _) in enumerate(dims.CANONICAL_FIELDS)}
    kept = ~F.col("has_conflict")
    return agg.withColumn("has_conflict", differs).select(
        "product_id", literal_map(F.col("canonical_field"), order).alias("field_pos"), "canonical_field",
        literal_map(F.col("canonical_field"), {f: u for f, u in dims.CANONICAL_FIELDS if u}).alias("canonical_unit"),
        F.when(F.col("n_ok") == 0, "missing").when(F.col("has_conflict"), "conflict")
        .otherwise(F.col("rep_outcome")).alias("outcome"),
        F.when(kept, F.col("rep_num")).alias("value_num"), F.when(kept, F.col("rep_str")).alias("value_str"),
        F.round(F.col("sum_confidence").cast("double") / F.col("n_ok"), 4).alias("confidence"),
        "has_conflict", "n_refs", "n_ok", F.array_sort("source_types").alias("source_types"),
        F.when(F.col("n_refs") == 0, "no evidence").when(F.col("n_ok") == 0, "no usable evidence").alias("note"),
        "rep_num", "rep_str", F.col("rep.ref").alias("rep_ref"), F.col("first").alias("first_ref"), F.col("kw.value").alias("kw_raw"),
        # The values farthest out among those that are in conflict, and among the parsed ones.
        F.when(F.col("rep_num") - F.col("min_num") > tolerance, F.col("min_num")).otherwise(F.col("rep_num")).alias("low_num"),
        F.when(F.col("max_num") - F.col("rep_num") > tolerance, F.col("max_num")).otherwise(F.col("rep_num")).alias("high_num"), "raw_low", "raw_high")


def representative(normalized: DataFrame) -> DataFrame:
    """First successful fact per product and field."""
    facts = normalized.filter(_is_ok()).withColumn("_key", fact_key())
    picked = [*[c for c in REF_COLUMNS if c != "product_id"], "value_num", "value_str", "canonical_unit", "outcome"]
    return facts.groupBy(*KEYS).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in picked]), "_key").alias("f"), F.count(F.lit(1)).alias("n_ok")
    ).select(*KEYS, "n_ok", "f.*")


def conflicts(normalized: DataFrame, fields: DataFrame, global_normalized: DataFrame | None = None,
              tolerance: float = dims.CONFLICT_TOLERANCE) -> DataFrame:
    """One row per successful fact that differs from the field's first successful fact.

    Only conflicted fields take part. Hot fields are split over several tasks (see ``join_spread``); facts for all
    products are met by field (see ``join_few``), those of fields without a conflict by none.
    """
    reps = fields.filter("has_conflict").select(*KEYS, "rep_num", "rep_str", "rep_ref",
                                                F.col("canonical_unit").alias("unit_a"))
    ok = normalized.filter(_is_ok())
    other = ok.select(*KEYS, "value_num", "value_str", "canonical_unit", ref_struct("ref_b"), "source_rank", "pos",
                      F.lit(1).cast("long").alias("n_copies"))
    counts = fields.filter("has_conflict").select(*KEYS, F.col("n_refs").alias("n_rows"))
    pairs = join_spread(other, reps, KEYS, spread=["source_rank", "pos"], how="inner", counts=counts)
    if global_normalized is not None:
        copies = F.col("n_copies") if "n_copies" in global_normalized.columns else F.lit(1).cast("long")
        dealt = global_normalized.filter(_is_ok()).select(
            "canonical_field", "value_num", "value_str", "canonical_unit", ref_struct("ref_b"), "source_rank", "pos",
            copies.alias("n_copies"))
        pairs = pairs.unionByName(join_few(reps, dealt, "canonical_field", "product_id").select(*pairs.columns))
    numeric = F.abs(F.col("value_num") - F.col("rep_num")) > tolerance
    texts = F.col("value_str") != F.col("rep_str")
    return pairs.filter(F.coalesce(numeric, texts)).select(
        *KEYS,
        F.col("rep_num").alias("value_a"), F.col("rep_str").alias("text_a"),
        F.when(F.col("rep_num").isNotNull(), F.col("unit_a")).alias("unit_a"),
        F.col("value_num").alias("value_b"), F.col("value_str").alias("text_b"), F.col("canonical_unit").alias("unit_b"),
        F.col("rep_ref").alias("ref_a"), "ref_b", "source_rank", "pos", "n_copies")


def conflict_note() -> Column:
    def side(value: str, text: str, unit: str) -> Column:
        return F.coalesce(F.concat_ws(" ", F.col(value).cast("string"), F.col(unit)), F.col(text))

    return F.when(F.col("value_a").isNull(), F.concat(F.lit("text conflict: "), F.col("text_a"), F.lit(" / "),
                                                      F.col("text_b"))).otherwise(
        F.concat(F.lit("numeric conflict: "), side("value_a", "text_a", "unit_a"), F.lit(" / "),
                 side("value_b", "text_b", "unit_b")))


def fact_counts(mapped: DataFrame, normalized: DataFrame) -> DataFrame:
    """Unmapped facts and issues per product."""
    unmapped = mapped.filter(F.col("kind") == "unmapped").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("unmapped_evidence"))
    issues = normalized.filter(~F.col("outcome").isin(SUCCESS)).groupBy("product_id").agg(
        F.count_if(F.col("outcome") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("outcome") == "unknown_unit").alias("unknown_units"))
    return unmapped.join(issues, "product_id", "full").select(
        "product_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                        for c in ("unmapped_evidence", "parse_errors", "unknown_units")])


def product_summary(fields: DataFrame, counts: DataFrame, global_counts: DataFrame | None = None) -> DataFrame:
    """Field and fact totals per product. ``global_counts`` holds the counts of facts for all products."""
    per = fields.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("fields_total"),
        F.count_if(F.col("outcome").isin(SUCCESS)).alias("fields_normalized"),
        F.count_if("has_conflict").alias("fields_conflicted"),
        F.count_if(F.col("outcome") == "missing").alias("fields_missing"),
        F.sum("n_refs").alias("field_refs"))
    names = ["unmapped_evidence", "parse_errors", "unknown_units"]
    out = per.join(counts, "product_id", "left").select(
        *per.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    if global_counts is not None:
        for c in names:
            extra = global_counts.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)).scalar()
            out = out.withColumn(c, F.col(c) + extra)
    return out.withColumn("issues", F.col("parse_errors") + F.col("unknown_units"))


def normalization_report(summary: DataFrame, manifest: DataFrame) -> DataFrame:
    """Batch totals. A manifest entry without an id counts as failed."""
    listed = manifest.agg(
        F.count(F.lit(1)).alias("products_processed"),
        F.count_if(F.coalesce("product_id", F.lit("")) == "").alias("products_failed"))
    totals = summary.agg(
        F.count(F.lit(1)).alias("products_succeeded"),
        *[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(n) for n, e in {
            "evidence_consumed": F.col("field_refs") + F.col("unmapped_evidence"),
            "fields_normalized": F.col("fields_normalized"),
            "fields_conflicted": F.col("fields_conflicted"),
            "fields_missing": F.col("fields_missing"),
            "unmapped_attrs": F.col("unmapped_evidence"),
            "parse_errors": F.col("parse_errors"),
            "unknown_units": F.col("unknown_units"),
        }.items()])
    return listed.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k").drop("_k")


def field_sources(normalized: DataFrame) -> DataFrame:
    """Distinct source labels of each field, in order of first appearance (``first_order``)."""
    from specledger.functions.text import evidence_label

    label = evidence_label(F.col("source_type"), F.col("page"), F.col("row"), F.col("attribute"))
    return normalized.withColumn("label", label).groupBy(*KEYS, "label").agg(
        F.min(fact_order()).alias("first_order"), F.count(F.lit(1)).alias("n_facts"))
