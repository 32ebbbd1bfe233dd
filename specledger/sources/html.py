"""Stored web pages to evidence: tables, definition lists and free text. ``markup`` reads the pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from specledger import dims
from specledger.functions.values import PLAIN_FLOAT
from specledger.schema import EVIDENCE, conform
from specledger.session import stage_table
from specledger.sources import markup
from specledger.sources.markup import PAGE

Patterns = Sequence[tuple[str, str, str | None]]
KEEP = ("product_id", "url")
# Patterns ignore case and know the white space, digits and letters of Unicode: pages write "50&nbsp;Hz".
FLAGS = "(?iU)"
SPAN = 60
CONTEXT_LENGTH = 300
# Methods in the order in which their facts count.
METHODS = (("html_table", 0.70), ("html_dl", 0.65), ("html_text", 0.55))


def html_strip(pages: DataFrame, keep: Sequence[str] = KEEP) -> DataFrame:
    """The columns ``keep`` and ``text``: the main block of each page as plain text, empty where there is none."""
    return markup.page_texts(markup.tokens(pages, keep)).select(*[F.col(f"{PAGE}.`{c}`") for c in keep], "text")


def html_tokens(pages: DataFrame) -> DataFrame:
    """Stored tokens of pages (``product_id, url, html``), for the functions below that read them more than once.

    They are stored by page and shuffled so, once for each reader; then the tokens of a page are together.
    """
    token = F.struct("pos", "name", "delta", "text")
    pages = markup.tokens(pages, KEEP).groupBy(PAGE).agg(F.collect_list(token).alias("tokens"))
    return stage_table(pages, "page-tokens").repartition(PAGE).select(PAGE, F.inline("tokens"))


def _number(raw: Column) -> Column:
    text = F.replace(raw, F.lit(","), F.lit("."))
    return F.when(text.rlike(PLAIN_FLOAT), text.try_cast("double"))


def _facts(df: DataFrame, method: str, order: Sequence[str], source_rank: int = 2) -> DataFrame:
    """Evidence of one method. ``pos`` counts the facts of a page in the order of the columns ``order``, after those of the methods before."""
    place = [m for m, _ in METHODS].index(method)
    number = F.row_number().over(Window.partitionBy(PAGE).orderBy(*order))
    out = df.select(
        f"{PAGE}.*", *[c for c in df.columns if c != PAGE], _number(F.col("raw_value")).alias("value"), F.lit("web").alias("source_type"),
        F.lit(method).alias("method"), F.lit(dict(METHODS)[method]).alias("confidence"), F.lit(source_rank).alias("source_rank"),
        (F.lit(place << 40) + number).alias("pos"))
    if "source_id" not in out.columns:
        out = out.withColumn("source_id", F.concat(F.lit("web_"), F.col("product_id")))
    return conform(out, EVIDENCE)


def found_places(texts: DataFrame, patterns: Patterns, keys: Sequence[str]) -> DataFrame:
    """Every match of every pattern: ``keys``, ``i`` (of the pattern), ``n``, ``start`` (from 0), ``whole``, ``raw`` (first group).

    A text is cut at the matches of a pattern; running sums over the lengths of the pieces and the matches give the places, in linear time.
    """
    def pieces(pattern: str) -> Column:
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        group = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        gaps = F.transform(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(whole)), F.length)
        return F.when(F.col("text").rlike(pattern), F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), group.alias("raw")))

    cut = F.array(*[F.struct(F.lit(i).alias("i"), pieces(FLAGS + pattern).alias("found")) for i, (pattern, _, _) in enumerate(patterns)])
    rows = texts.select(*keys, F.explode(F.filter(cut, lambda c: c["found"].isNotNull())).alias("p")).select(
        *keys, "p.i", F.posexplode("p.found").alias("n", "m")).select(*keys, "i", "n", "m.*")
    so_far = Window.partitionBy(*keys, "i").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.length("whole")).cast("long")).over(so_far)
    return rows.select(*keys, "i", "n", (end - F.length("whole")).alias("start"), "whole", "raw")


def html_text_specs(pages: DataFrame, patterns: Patterns = tuple(dims.SPEC_PATTERNS), span: int = SPAN) -> DataFrame:
    """Every pattern match in the text (``product_id, url, text``), with the text around it.

    Matches are short rows; the text joins them once, by page, when the surroundings are cut out of it.
    """
    texts = stage_table(pages.filter(F.coalesce("text", F.lit("")) != "").select(
        F.struct(F.monotonically_increasing_id().alias("id"), *KEEP).alias(PAGE), "text"), "page-texts")
    names = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(u).cast("string").alias("unit")) for _, a, u in patterns])
    joined = found_places(texts, patterns, [PAGE]).join(texts, PAGE).withColumn("spec", F.get(names, F.col("i")))
    begin = F.greatest(F.lit(0), F.col("start") - span)
    end = F.least(F.length("text"), F.col("start") + F.length("whole") + span)
    around = F.substring(F.col("text"), (begin + 1).cast("int"), (end - begin).cast("int"))
    return _facts(joined.select(
        PAGE, "i", "n", "spec.attribute", "spec.unit", F.col("raw").alias("raw_value"),
        F.left(markup.trimmed(around), F.lit(CONTEXT_LENGTH)).alias("evidence_text")), "html_text", ["i", "n"])


def _first_spec(text: Column, patterns: Patterns) -> Column:
    """Attribute, unit and group of the first pattern found in the text."""
    return F.coalesce(*[
        F.when(text.rlike(FLAGS + pattern), F.struct(
            F.lit(attribute).alias("attribute"), F.lit(unit).cast("string").alias("unit"),
            F.regexp_extract(text, FLAGS + pattern, 1).alias("raw_value")))
        for pattern, attribute, unit in patterns
    ])


def html_table_specs(tokens: DataFrame, patterns: Patterns = tuple(dims.SPEC_PATTERNS), header_units: bool = False) -> DataFrame:
    """First pattern found in each cell of the tables in stored tokens; see ``markup.tables`` for what a table holds.

    ``header_units`` lets a cell take the unit its header gives in brackets.
    """
    rows = markup.tables(tokens).withColumn("pairs", F.slice(
        F.arrays_zip(F.col("headers").alias("header"), F.col("cells").alias("cell")), F.lit(1), F.least(F.size("headers"), F.size("cells"))))
    row_text = F.concat_ws(" | ", F.transform(
        F.filter("pairs", lambda p: p["cell"] != ""), lambda p: F.concat(p["header"], F.lit(": "), p["cell"])))
    cells = rows.select(PAGE, "container", "section", "row", F.left(row_text, F.lit(CONTEXT_LENGTH)).alias("evidence_text"),
                        F.posexplode("pairs").alias("i", "pair")).filter(F.col("pair.cell") != "")
    text = F.col("pair.cell")
    if header_units:
        unit = F.regexp_extract("pair.header", r"\(([^()]+)\)\s*$", 1)
        text = F.when(text.rlike(r"^[\d.,+-]+$") & (unit != ""), F.concat(text, F.lit(" "), unit)).otherwise(text)
    specs = cells.withColumn("s", _first_spec(text, patterns)).filter("s is not null")
    return _facts(specs.select(PAGE, "container", "row", "i", "section", "evidence_text", "s.*"), "html_table", ["container", "row", "i"])


def html_dl_specs(tokens: DataFrame, patterns: Patterns = tuple(dims.SPEC_PATTERNS)) -> DataFrame:
    """First pattern found in each definition of the definition lists in stored tokens."""
    pairs = markup.definition_lists(tokens).filter("definition <> ''").withColumn("s", _first_spec(F.col("definition"), patterns))
    return _facts(pairs.filter("s is not null").select(
        PAGE, "container", "i", "section", F.left(F.concat("term", F.lit(": "), "definition"), F.lit(CONTEXT_LENGTH)).alias("evidence_text"), "s.*"),
        "html_dl", ["container", "i"])


def html_specs(pages: DataFrame, patterns: Patterns = tuple(dims.SPEC_PATTERNS)) -> DataFrame:
    """Facts of all three strategies from pages (``product_id, url, html``)."""
    tokens = html_tokens(pages)
    texts = markup.page_texts(tokens).select(f"{PAGE}.product_id", f"{PAGE}.url", "text")
    return html_table_specs(tokens, patterns).unionByName(html_dl_specs(tokens, patterns)).unionByName(html_text_specs(texts, patterns))
