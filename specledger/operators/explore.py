"""Lists, details and summaries over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from specledger import dims
from specledger.functions.text import location_text, source_display
from specledger.operators.normalize import KEYS
from specledger.operators.signals import SignalIndex, match_indexed, signal_index

CATEGORY = "Industrial Electric Motor"
# --- fixed values: wide columns of the product list by field ---
LISTED_SPECS = {"rated_power": "rated_power_kw", "rated_voltage": "rated_voltage_v", "rated_speed": "rated_speed_rpm",
                "poles": "poles"}


def _contains(column: str, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(term.lower())), F.lit(False))


def _any_contains(columns: list[str], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | _contains(c, term)
    return out


def product_list(reports: DataFrame, attributes: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Report rows with the listed specification values as columns."""
    specs = attributes.groupBy("product_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value_num"))).alias(n) for f, n in LISTED_SPECS.items()],
        F.max(F.when(F.col("field") == "frame_size", F.col("value_str"))).alias("frame_size"))
    out = reports.join(specs, "product_id", "left").withColumn("category", F.lit(category))
    return out.withColumn("poles", F.col("poles").cast("int"))


def list_products(products: DataFrame, search: str | None = None, status: str | None = None,
                  publishability: str | None = None) -> DataFrame:
    if search:
        products = products.filter(_any_contains(["product_id", "model", "manufacturer", "category"], search))
    if status:
        products = products.filter(F.upper("overall_trust_status") == status.upper())
    if publishability:
        products = products.filter(F.upper("overall_publishability") == publishability.upper())
    return products


def sort_products(products: DataFrame, by: str = "id", ascending: bool = True, search: str = "",
                  tab: str = "ALL") -> DataFrame:
    """Product table with its own filters: a search also matches power text such as ``1.1kw``.

    A power without a value sorts as zero. The review tab goes by publishability.
    """
    if search:
        power = F.col("rated_power_kw")
        shown = F.concat(F.when(power == F.floor(power), F.floor(power).cast("string")).otherwise(power.cast("string")),
                         F.lit("kw"))
        by_power = (power != 0) & F.contains(shown, F.lit(search.lower()))
        products = products.filter(_any_contains(["product_id", "model"], search) | F.coalesce(by_power, F.lit(False)))
    if tab in ("CONFLICTED", "TRUSTED"):
        products = products.filter(F.col("overall_trust_status") == tab)
    elif tab == "REVIEW_REQUIRED":
        products = products.filter(F.col("overall_publishability") == tab)
    elif tab != "ALL":
        products = products.filter(F.lit(False))
    key = {"power": F.coalesce("rated_power_kw", F.lit(0.0)), "score": F.col("trust_score")}.get(by, F.col("product_id"))
    return products.orderBy(key.asc() if ascending else key.desc(), "product_id")


def filter_catalog(records: DataFrame, status: str | None = None, has_conflicts: bool | None = None,
                   search: str | None = None) -> DataFrame:
    if status:
        records = records.filter(F.lower("overall_status") == status.lower())
    if has_conflicts is not None:
        records = records.filter(F.col("has_conflicts") == has_conflicts)
    if search:
        records = records.filter(_any_contains(["mfg_part_num", "part_desc", "brand"], search))
    return records


def list_catalog(records: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """One page of the filtered records by row id."""
    return filter_catalog(records, **filters).orderBy("row_id").offset((page - 1) * page_size).limit(page_size)


def page_index(records: DataFrame, width: int = 100_000) -> DataFrame:
    """Rows of each range of ``width`` row ids, and rows in all ranges before it: what is kept to find a page.

    One row per range, so the index of a large catalog is small; a filtered list has an index of its own.
    """
    counts = records.groupBy(F.floor(F.col("row_id") / width).alias("range_no")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("range_no", "n_rows", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("rows_before"), F.lit(width).alias("width"))


def page_at(records: DataFrame, index: DataFrame, page: int, page_size: int = 20) -> DataFrame:
    """A page of records by row id, however deep: only the ranges that hold its rows are read, and what is skipped is less than one range."""
    start = (page - 1) * page_size
    held = index.filter((F.col("rows_before") < start + page_size) & (F.col("rows_before") + F.col("n_rows") > start)).agg(
        F.min("range_no").alias("low"), F.max("range_no").alias("high"), F.min("rows_before").alias("skipped"), F.max("width").alias("width")).first()
    if held["low"] is None:
        return records.limit(0)
    low, high = held["low"] * held["width"], (held["high"] + 1) * held["width"]
    return next_page(records.filter(F.col("row_id") < high), low - 1, start - held["skipped"] + page_size).offset(start - held["skipped"])


def next_page(records: DataFrame, after: int, page_size: int = 20) -> DataFrame:
    """The records after the last row id seen; the filter reaches the scan."""
    return records.filter(F.col("row_id") > after).orderBy("row_id").limit(page_size)


def catalog_pages(records: DataFrame, page_size: int = 20, **filters) -> DataFrame:
    """Total rows and pages of the filtered records."""
    return filter_catalog(records, **filters).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / page_size).cast("long"))


def get_detail(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


# --- reviews ---

def latest_resolutions(log: DataFrame, key: str = "review_id", order: tuple[str, ...] = ("resolved_at", "entry_no")) -> DataFrame:
    """Last entry per key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def product_index(products: DataFrame) -> SignalIndex:
    """Product ids prepared for ``attach_product``, for callers that add to a log more than once."""
    ids = products.select(F.lit(0).alias("entry_pos"), F.lit(0).alias("signal_pos"), F.col("product_id").alias("signal"),
                          *[F.lit("").alias(c) for c in ("canonical_manufacturer", "canonical_brand", "trade_name")])
    return signal_index(ids, ignore_case=False)


def attach_product(new: DataFrame, products: DataFrame | SignalIndex) -> DataFrame:
    """Product of a resolution: the first product id contained in its review id, '' when there is none."""
    index = products if isinstance(products, SignalIndex) else product_index(products)
    found = match_indexed(new.drop("product_id"), "review_id", index, ignore_case=False, placeholders=False)
    return found.withColumn("product_id", F.coalesce("m.signal", F.lit(""))).drop("m")


def resolve_review(log: DataFrame, new: DataFrame, products: DataFrame) -> DataFrame:
    """Resolutions after adding new entries: the last one per review id wins."""
    return latest_resolutions(log.unionByName(attach_product(new, products).select(*log.columns)))


# Folders of the stored log. An answer and all later ones to the same review are in one.
LOG_BUCKETS = 32


def _write_log(entries: DataFrame, path: str, mode: str) -> None:
    bucket = F.pmod(F.xxhash64("review_id"), F.lit(LOG_BUCKETS)).cast("int")
    # Spread over the entries of a bucket as well, so that a busy bucket is not one task.
    spread = F.pmod(F.xxhash64("review_id", "entry_no"), F.lit(8))
    entries.withColumn("bucket", bucket).repartition("bucket", spread).write.mode(mode).partitionBy("bucket").parquet(path)


def append_resolutions(new: DataFrame, products: DataFrame | SignalIndex, path: str) -> None:
    """Add answers to a stored log, with their product. Nothing is read or rewritten, so several writers may add at once."""
    known = new.drop("product_id") if "product_id" in new.columns else new
    _write_log(attach_product(known.withColumn("product_id", F.lit(None).cast("string")), products), path, "append")


def read_resolutions(spark: SparkSession, path: str, review_id: str | None = None) -> DataFrame:
    """The last answer of each review in a stored log. For one review only its folder is read."""
    log = spark.read.parquet(path)
    if review_id is not None:
        one = spark.range(1).select(F.pmod(F.xxhash64(F.lit(review_id)), F.lit(LOG_BUCKETS)).cast("int").alias("b")).first()["b"]
        log = log.filter((F.col("bucket") == one) & (F.col("review_id") == review_id))
    return latest_resolutions(log.drop("bucket"))


def compact_resolutions(spark: SparkSession, path: str, target: str) -> None:
    """A new log with the last answers only. It appears whole or not at all; the old one stays until its owner removes it."""
    _write_log(read_resolutions(spark, path), target, "errorifexists")


def join_resolutions(reviews: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Reviews with status, note, value and reviewer."""
    done = resolutions.select("review_id", F.lit(True).alias("_done"), "resolution_note", "resolved_value", "resolved_by")
    return reviews.join(done, "review_id", "left").withColumn(
        "status", F.when(F.col("_done"), "RESOLVED").otherwise("OPEN")).drop("_done")


def list_reviews(reviews: DataFrame, severity: str | None = None, issue_type: str | None = None,
                 status: str | None = None, product_id: str | None = None, search: str = "") -> DataFrame:
    for column, value in (("severity", severity), ("issue_type", issue_type), ("status", status)):
        if value:
            reviews = reviews.filter(F.upper(column) == value.upper())
    if product_id:
        reviews = reviews.filter(F.col("product_id") == product_id)
    if search:
        reviews = reviews.filter(_any_contains(["review_id", "product_id", "target_name", "description"], search))
    return reviews


def review_counters(reviews: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "RESOLVED")
    total = F.count(F.lit(1))
    return reviews.agg(
        total.alias("total"), (total - done).alias("open"), done.alias("resolved"),
        F.count_if(F.col("issue_type") == "CONFLICT").alias("conflicts"),
        F.count_if(F.col("issue_type") == "WARNING").alias("warnings"))


# --- conflicts and details ---

def _source_columns(ref: str, value: Column, unit: Column) -> list[Column]:
    r = F.col(ref)
    kind = F.lower(F.coalesce(r["source_type"], F.lit("pdf")))
    return [r["source_id"].alias("source_id"), kind.alias("source_type"), source_display(r["source_type"]).alias("source_name"),
            value.alias("value"), unit.alias("unit"), r["raw_value"].alias("raw_value"),
            location_text(r["section"], r["page"], r["row"], r["column"], r["url"]).alias("location"),
            r["confidence"].alias("confidence")]


def conflict_sources(pairs: DataFrame) -> DataFrame:
    """Distinct sides (source type, raw text, value) of the conflicts of each field, first appearance kept.

    ``first_order`` keeps their order. Every conflicted field has pairs, so no fallback to other facts is needed here;
    ``field_source_list`` gives the sources of any field.
    """
    order = F.struct("source_rank", "pos")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), *_source_columns("ref_a", F.col("value_a"), F.col("unit_a"))),
        F.struct(F.lit(1).alias("side"), *_source_columns("ref_b", F.col("value_b"), F.col("unit_b"))))
    rows = pairs.select(*KEYS, order.alias("o"), F.inline(sides))
    return _first_sides(rows, F.struct("o", "side"))


def field_source_list(normalized: DataFrame) -> DataFrame:
    """Distinct sources of every field, from its facts."""
    ref = F.struct(*[F.col(f"`{c}`") for c in ("source_id", "source_type", "raw_value", "page", "row", "column", "url",
                                               "section", "confidence")])
    rows = normalized.withColumn("_r", ref).select(
        *KEYS, F.struct("source_rank", "pos").alias("o"), F.lit(0).alias("side"),
        *_source_columns("_r", F.col("value"), F.col("unit")))
    return _first_sides(rows, F.struct("o", "side"))


def _first_sides(rows: DataFrame, order: Column) -> DataFrame:
    rest = ["source_id", "source_name", "unit", "location", "confidence"]
    return rows.groupBy(*KEYS, "source_type", "raw_value", "value").agg(
        F.min_by(F.struct(*rest), order).alias("f"), F.min(order).alias("first_order")
    ).select(*KEYS, "source_type", "raw_value", "value", "f.*", "first_order")


def product_detail(product_id: str, reports: DataFrame, attributes: DataFrame, reviews: DataFrame, claims: DataFrame,
                   pairs: DataFrame, evidence: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """Everything stored about one product, one table per part; every filter reaches its scan."""
    one = F.col("product_id") == product_id
    return {
        "report": reports.filter(one), "specifications": attributes.filter(one).orderBy("field_pos"),
        "reviews": reviews.filter(one).orderBy("part", "seq"), "claims": claims.filter(one),
        "conflicts": conflict_sources(pairs.filter(one)), "evidence": evidence.filter(one), "answers": answers.filter(one),
    }


def detail_rows(reports: DataFrame, attributes: DataFrame, reviews: DataFrame, claims: DataFrame,
                evidence: DataFrame) -> DataFrame:
    """Detail header of every product: report with the counts of its parts. Parts are counted before the joins."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("product_id").agg(F.count(F.lit(1)).alias(name))

    out = reports
    for df, name in ((attributes, "n_specifications"), (reviews, "n_reviews"), (claims, "n_claims"),
                     (evidence, "n_evidence")):
        out = out.join(counted(df, name), "product_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def nested_details(reports: DataFrame, attributes: DataFrame, reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """Each product as one row: ``report``, ``specifications``, ``reviews`` and ``claims`` (arrays in their order).

    The parts are united and gathered by one shuffle on the product. All of them are bounded: specifications by the field list, reviews by rules, fields and claim
    categories, claims by the answer they come from. Facts and conflicts of a product are not; they stay tables (see ``evidence_view``, ``conflict_sources``).
    """
    def part(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c != "product_id" and c not in order]
        return df.select("product_id", F.struct(*order, *[F.col(f"`{c}`") for c in rest]).alias(name))

    parts = {"specifications": (attributes, ["field_pos"]), "reviews": (reviews, ["part", "seq", "review_id"]), "claims": (claims, ["claim_type", "claim_no"])}
    united = reports.select("product_id", F.struct(*[c for c in reports.columns if c != "product_id"]).alias("report"))
    for name, (df, order) in parts.items():
        united = united.unionByName(part(df, name, order), allowMissingColumns=True)
    return united.groupBy("product_id").agg(
        F.first("report", ignorenulls=True).alias("report"), *[F.sort_array(F.collect_list(n)).alias(n) for n in parts]).filter("report is not null")


def trust_view(attributes: DataFrame) -> DataFrame:
    return attributes.select("product_id", "field", "trust_status", "publishability", "confidence_score", "reason")


def evidence_view(evidence: DataFrame) -> DataFrame:
    return evidence.select("product_id", "source_id", "source_type", "attribute", "raw_value", "unit", "value", "method",
                           "confidence", "page", "row", "column", "url", "section")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("product_id", "source_type").agg(F.count(F.lit(1)).alias("n_facts"))


def enrichment_view(lists: DataFrame, claims: DataFrame) -> DataFrame:
    """Answer texts with the number of claims."""
    n = claims.groupBy("product_id").agg(F.count(F.lit(1)).alias("total_claims"))
    return lists.join(n, "product_id", "left").withColumn("total_claims", F.coalesce("total_claims", F.lit(0)).cast("long"))


def evidence_for(evidence: DataFrame, attribute: str) -> DataFrame:
    return evidence.filter(F.lower("attribute") == attribute.lower())


# --- fixed values: trust statuses shown under each tab ---
SPEC_TABS = {"VERIFIED": ["TRUSTED"], "INFERRED": ["UNVERIFIED", "REVIEW_REQUIRED"], "CONFLICTED": ["CONFLICTED"],
             "UNKNOWN": ["MISSING", "UNSUPPORTED"]}


def filter_specs(attributes: DataFrame, tab: str = "ALL") -> DataFrame:
    """Specifications of a tab; an unknown tab shows all."""
    return attributes.filter(F.col("trust_status").isin(SPEC_TABS[tab])) if tab in SPEC_TABS else attributes


def spec_conflicts(attributes: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """Specifications with the number of open conflicts on their field, names compared in lower case."""
    n = open_conflicts.groupBy("product_id", F.lower("field").alias("_f")).agg(F.sum("n_copies").cast("long").alias("n_conflicts"))
    return attributes.withColumn("_f", F.lower("field")).join(n, ["product_id", "_f"], "left").drop("_f").withColumn(
        "n_conflicts", F.coalesce("n_conflicts", F.lit(0)).cast("long"))


# --- summaries ---

def zero_filled(df: DataFrame, column: str, names: list[str], kind: str) -> DataFrame:
    """Count of each value of ``names``, zero where absent, and of any other value found."""
    listed = df.agg(*[F.count_if(F.upper(column) == n).alias(n) for n in names]).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])))
    others = df.filter(~F.upper(column).isin(names)).groupBy(F.upper(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return listed.unionByName(others).select(F.lit(kind).alias("kind"), "name", "n")


def batch_distributions(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Trust, publishability and severity distributions."""
    return zero_filled(products, "overall_trust_status", dims.TRUST_STATUSES, "trust").unionByName(
        zero_filled(products, "overall_publishability", dims.PUBLISHABILITIES, "publishability")).unionByName(
        zero_filled(reviews, "severity", dims.SEVERITIES, "severity"))


def top_n(df: DataFrame, order: Column, n: int = 6) -> DataFrame:
    """First rows by an order, for a card list."""
    return df.orderBy(order).limit(n)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value of a column."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share_pct", F.round(F.col("n") / total * 100.0, 2))


def score_bands(products: DataFrame) -> DataFrame:
    """Score in percent and its band."""
    score = F.floor(F.col("trust_score") * 100 + 0.5).cast("int")
    return products.select("product_id", score.alias("score_pct"),
                           F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low").alias("band"))


def coverage_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each loaded table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
