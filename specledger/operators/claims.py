"""Claims made by an external text model: what it is given, and how its answers are checked.

The model call itself is not part of the library. Answers come as a table of ``product_id, response``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specledger.functions.text import blank_to_null, strip
from specledger.operators.normalize import SUCCESS, fact_key, fact_order
from specledger.schema import OPEN_CONFLICT, RESPONSE


def _side(side: str) -> Column:
    value = F.coalesce(F.concat_ws(" ", F.col(f"value_{side}").cast("string"), F.col(f"unit_{side}")), F.lit(""))
    shown = F.when(F.col(f"value_{side}").isNull(), F.col(f"text_{side}")).otherwise(value)
    return F.concat(F.col(f"ref_{side}.source_type"), F.lit(" ("), F.col(f"ref_{side}.attribute"), F.lit("): "), shown)


def grounding_payload(products: DataFrame, fields: DataFrame, unmapped: DataFrame, summary: DataFrame,
                      findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the model is given, as JSON lines: ``product_id, section, ordinal, payload``.

    The ``facts`` line (verified values, missing fields, validation counts) is one bounded document per product.
    Conflicts, unmapped numbers and engineering findings can be many, so each is a line of its own: no product is
    gathered into one list. Sort by section and ordinal to write a product's prompt.
    """
    ok = F.col("outcome").isin(SUCCESS)
    spec = F.struct(F.col("canonical_field").alias("key"), F.struct(
        F.coalesce(F.col("value_num").cast("string"), F.col("value_str")).alias("value"),
        F.col("canonical_unit").alias("unit"), F.col("source_types").alias("sources")).alias("value"))
    per = fields.groupBy("product_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(ok, spec)))).alias("verified_specifications"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "missing",
                                                       F.struct("field_pos", "canonical_field")))),
                    lambda x: x["canonical_field"]).alias("missing_fields"))
    checks = summary.select("product_id", F.struct(
        "overall_status", F.col("n_pass").alias("pass_count"), F.col("n_conflict").alias("conflict_count"),
        F.col("n_warning").alias("warning_count")).alias("validation_summary"))
    document = F.struct("product_id", "manufacturer", "model", "verified_specifications", "missing_fields",
                        "validation_summary")
    facts = products.select("product_id", "manufacturer", "model").join(per, "product_id").join(
        checks, "product_id", "left")

    def lines(df: DataFrame, section: str, ordinal: Column, item: Column) -> DataFrame:
        return df.select("product_id", F.lit(section).alias("section"), ordinal.cast("long").alias("ordinal"),
                         F.to_json(item).alias("payload"))

    conflict = F.struct(F.col("canonical_field").alias("field"), _side("a").alias("source_a"),
                        _side("b").alias("source_b"), F.col("n_copies").alias("copies"))
    # The last number given for an unmapped attribute stands for it.
    last = unmapped.filter(F.col("value").isNotNull()).groupBy("product_id", "attribute").agg(
        F.max_by(F.struct("value", F.coalesce("unit", F.lit("")).alias("unit"),
                          F.col("source_type").alias("source")), fact_key()).alias("spec"),
        F.max(fact_order()).alias("at"))
    notes = findings.filter(F.col("rule_id").contains("ENGINEERING") | (
        F.col("rule_id") == "CONFLICT_RATED_CURRENT_PDF_VS_CSV"))
    note = F.struct(F.concat("rule_id", F.lit(": ["), "status", F.lit("] "), "explanation").alias("note"), F.col("n_copies").alias("copies"))
    return lines(facts, "facts", F.lit(0), document).unionByName(
        lines(pairs, "conflicts", fact_order(), conflict)).unionByName(
        lines(last, "unmapped_specifications", F.col("at"), F.struct("attribute", "spec"))).unionByName(
        lines(notes, "engineering_findings", F.col("item"), note))


def clean_response(col: Column) -> Column:
    """Answer text without code fences."""
    text = strip(col)
    unfenced = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```$", "")
    return strip(F.when(text.startswith("```"), unfenced).otherwise(text))


def _parse(col: Column) -> Column:
    """Typed answer, null when the text is not one JSON object."""
    parsed = F.from_json(col, RESPONSE, {"mode": "PERMISSIVE"})
    # A malformed text gives nulls in every field; only a real object has keys.
    return F.when(F.json_object_keys(col).isNotNull(), parsed)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``answer`` (typed) or ``error``. Prose around the outermost braces is tolerated."""
    text = clean_response(F.col("response"))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    out = responses.withColumn("_text", text).withColumn("_inner", inner)
    answer = F.coalesce(_parse(F.col("_text")), _parse(F.col("_inner")))
    return out.withColumn("answer", answer).withColumn(
        "error", F.when(F.col("answer").isNull(), F.concat(F.lit("no JSON object: "), F.left("_text", F.lit(300))))
    ).drop("_text", "_inner")


def explode_claims(parsed: DataFrame) -> DataFrame:
    """Both claim lists as rows, with defaults filled in; an entry without text is dropped."""
    def claims(column: str, backed: bool) -> DataFrame:
        rows = parsed.filter("answer is not null").select("product_id", F.posexplode(f"answer.{column}").alias("i", "c"))
        sources = F.array(F.lit("normalized_evidence")) if backed else F.array().cast("array<string>")
        return rows.filter(F.col("c.claim_text").isNotNull()).select(
            "product_id", F.lit("SOURCE_BACKED" if backed else "INFERRED").alias("claim_type"),
            F.col("i").cast("int").alias("claim_no"), F.col("c.claim_text").alias("claim_text"),
            F.coalesce("c.category", F.lit("specification" if backed else "application")).alias("category"),
            F.col("c.field").alias("field"), F.coalesce("c.evidence_sources", sources).alias("evidence_sources"),
            F.coalesce("c.confidence", F.lit(1.0 if backed else 0.85)).alias("confidence"),
            (F.col("c.notes") if backed else F.coalesce("c.notes", F.lit("model inference"))).alias("notes"))

    return claims("source_backed_claims", True).unionByName(claims("inferred_claims", False))


def inferred_fields(parsed: DataFrame) -> DataFrame:
    """Fields whose value the model inferred: ``product_id, field, inferred_value``."""
    return parsed.filter("answer is not null").select(
        "product_id", F.explode("answer.inferred_fields").alias("field", "inferred_value"))


def fill_unknown(motors: DataFrame, inferred: DataFrame) -> DataFrame:
    """Fill unknown frequency and poles from inferred values; other fields and other states stay as they are.

    ``motors`` has ``product_id, field, value_num, status, confidence, sources``.
    """
    rows = motors.join(inferred, ["product_id", "field"], "left")
    raw = F.col("inferred_value")
    hertz = F.when(raw.contains("50"), 50.0).when(raw.contains("60"), 60.0)
    digits = F.regexp_replace(raw, r"\D", "").try_cast("int")
    poles = F.when(digits.isin(2, 4, 6, 8), digits.cast("double"))
    value = F.when(F.col("field") == "frequency", hertz).when(F.col("field") == "poles", poles)
    filled = (F.col("status") == "Unknown") & value.isNotNull()
    confidence = F.when(F.col("field") == "poles", 0.95).otherwise(0.90)
    return rows.select(
        "product_id", "field", F.when(filled, value).otherwise(F.col("value_num")).alias("value_num"),
        F.when(filled, "Inferred").otherwise(F.col("status")).alias("status"),
        F.when(filled, confidence).otherwise(F.col("confidence")).alias("confidence"),
        F.when(filled, F.array(F.lit("text-model"))).otherwise(F.col("sources")).alias("sources"))


def open_conflicts(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """Conflicts named in the answers, plus every validated conflict an answer left out.

    One row per conflict; ``added`` marks those the answer did not mention, with a warning text.
    """
    named = parsed.filter("answer is not null").select(
        "product_id", F.posexplode("answer.unresolved_conflicts").alias("i", "c")).select(
        "product_id", F.col("i").cast("long").alias("ordinal"), *[F.col(f"c.{n}").alias(n) for n in OPEN_CONFLICT.names])
    answered = parsed.filter("answer is not null").select("product_id").distinct()
    found = findings.filter(F.col("status") == "CONFLICT").groupBy("product_id", "field").agg(
        F.min_by("explanation", F.struct("rule_no", "field_pos", "item")).alias("description"),
        F.min(F.struct("rule_no", "field_pos", "item")).alias("o"))
    missed = found.join(answered, "product_id", "left_semi").join(named, ["product_id", "field"], "left_anti").select(
        "product_id", (F.lit(1 << 32) + F.col("o.rule_no") * 100 + F.col("o.field_pos")).cast("long").alias("ordinal"),
        "field", "description", F.lit("verify against the nameplate or drawing").alias("action_needed"),
        F.concat(F.lit("unresolved conflict in "), F.col("field")).alias("warning"))
    return named.withColumn("warning", F.lit(None).cast("string")).withColumn("added", F.lit(False)).unionByName(
        missed.withColumn("added", F.lit(True)))


def enrichment_report(manifest: DataFrame, parsed: DataFrame, claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Processed, enriched and failed products; claims and open conflicts of the products in the manifest."""
    def counts(df: DataFrame, **columns: Column) -> DataFrame:
        return df.groupBy("product_id").agg(*[c.alias(n) for n, c in columns.items()])

    rows = manifest.select("product_id").join(
        counts(parsed, ok=F.max(F.col("answer").isNotNull())), "product_id", "left").join(
        counts(claims, n_backed=F.count_if(F.col("claim_type") == "SOURCE_BACKED"),
               n_inferred=F.count_if(F.col("claim_type") == "INFERRED")), "product_id", "left").join(
        counts(conflicts, n_open=F.count(F.lit(1))), "product_id", "left")
    ok = F.coalesce("ok", F.lit(False))

    def total(column: Column, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(name)

    return rows.agg(
        F.count(F.lit(1)).alias("products_processed"), F.count_if(ok).alias("products_enriched"),
        F.count_if(~ok).alias("products_failed"),
        total(F.coalesce("n_backed", F.lit(0)) + F.coalesce("n_inferred", F.lit(0)), "total_claims_generated"),
        total(F.col("n_backed"), "source_backed_claims_count"), total(F.col("n_inferred"), "inferred_claims_count"),
        total(F.col("n_open"), "unresolved_conflicts_count"))


def response_lists(parsed: DataFrame) -> DataFrame:
    """Trimmed text and lists of each answer, blanks dropped."""
    def items(column: str) -> Column:
        return F.filter(F.transform(F.col(f"answer.{column}"), strip), lambda x: x != "").alias(column)

    return parsed.filter("answer is not null").select(
        "product_id", blank_to_null(F.col("answer.summary")).alias("summary"),
        blank_to_null(F.col("answer.technical_description")).alias("technical_description"),
        *[items(c) for c in ("key_selling_points", "target_applications", "suggested_keywords",
                             "missing_information_notes", "enrichment_warnings")])
