"""Stored web pages as tables of tokens with element depths.

A page becomes one row per tag and per text between tags. Depths are running sums over these rows, so nested elements of one name need no special
pattern: an element is open while its depth is above zero, the innermost table of a token is its table depth, and a token inside nested tables
belongs to one table on each level up to its depth. All windows and groups run over one page or less, so pages are shuffled once, before they are cut, and tokens never.

Reading follows HTML where authors rely on it: attribute values may hold ``>``, scripts and styles end at their own end tag only, comments are no text,
cells, rows and list entries end where the next one begins, character references are decoded by number and by name.
Limits: an element of a kind that needs an end tag and has none runs to the end of its page; a named reference without a semicolon is decoded only
if nothing follows that could belong to the name.
"""

from __future__ import annotations

import html as standard
import html.entities
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from specledger.functions.text import literal_map

PAGE = "_page"
NOISE = ("nav", "footer", "header")
MAIN = ("main", "article")
HEADINGS = ("h1", "h2", "h3", "h4")
_TOKEN = (r"(?is)<!--.*?(?:-->|\z)"  # comment
          r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
          r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\z)"
          r"|<[/!?a-z][^>]*+(?:>|\z)"
          r"|(?:[^<]++|<(?![/!?a-z]))++|<")
_REFERENCE = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);?|[^&]++|&"
# What Unicode counts as white space, for trimming text nodes.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _named_references() -> dict[str, str]:
    """Names with their semicolon, and without it those that HTML allows so."""
    return dict(html.entities.html5)


def _replaced_numbers() -> dict[str, str]:
    """Numbers that do not stand for their own character: controls of an old code page, and no character at all."""
    return {str(n): standard.unescape(f"&#{n};") for n in (0, 13, *range(128, 160))}


def decoded(text: Column) -> Column:
    """Text with its character references replaced; unknown ones stay as they are."""
    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+)", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1)
        # Numbers of more than nine digits are beyond every character.
        number = F.when(hexed != "", F.conv(F.when(F.length(F.ltrim(hexed, F.lit("0"))) > 8, "FFFFFFFF").otherwise(hexed), 16, 10).cast("long")).otherwise(
            F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(1 << 31)).otherwise(digits.try_cast("long")))
        no_character = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        by_number = F.coalesce(literal_map(number.cast("string"), _replaced_numbers()), F.when(no_character, "\ufffd").otherwise(own))
        common = F.when(piece == "&amp;", "&").when(piece == "&nbsp;", " ").when(piece == "&lt;", "<").when(piece == "&gt;", ">").when(piece == "&quot;", '"')
        by_name = F.coalesce(common, literal_map(F.substring(piece, 2, 40), _named_references()), piece)
        return F.when(~piece.startswith("&") | (F.length(piece) == 1), piece).when(F.substring(piece, 2, 1) == "#", by_number).otherwise(by_name)

    return F.when(~F.contains(text, F.lit("&")), text).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one), ""))


def _running(*page: str) -> Window:
    return Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_depths(tokens: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add a column of depth per entry: open elements of those names after each token. Stray end tags do not count."""
    over = _running(PAGE)
    sums = tokens.select("*", *[F.sum(F.when(F.col("name").isin(*tags), F.col("delta")).otherwise(0)).over(over).alias(f"_sum_{d}") for d, tags in names.items()])
    return sums.select(*tokens.columns, *[
        (F.col(f"_sum_{d}") - F.least(F.lit(0), F.min(f"_sum_{d}").over(over))).alias(d) for d in names])


# Bytes of pages that one task cuts up: their tokens take some thirty times as much memory, and are sorted in it.
TASK_BYTES = 8 << 20


def _by_page(pages: DataFrame) -> DataFrame:
    """Pages (``_page, html``) shuffled whole: their tokens are many times as large, and stay where their page is.

    The number of tasks goes by the size of the pages as they are. Shuffled bytes would not tell it, as pages are packed to any small part of that.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), PAGE)


def tokens(pages: DataFrame, keep: Sequence[str] = ("product_id", "url"), html: str = "html") -> DataFrame:
    """``_page``, ``pos``, ``name``, ``delta`` (1 start tag, -1 end tag, 0 text), ``text`` of every token outside noise.

    ``_page`` is a struct of a number and the columns ``keep``, so repeated rows stay apart. Noise is scripts, styles, comments, and what is inside navigation,
    footers and headers. The first token of a page stays, without a name and text if it is noise, so that every page has a row.
    """
    numbered = pages.select(F.struct(F.monotonically_increasing_id().alias("id"), *[F.col(f"`{c}`") for c in keep]).alias(PAGE), F.col(html).alias("html"))
    numbered = _by_page(numbered)
    cut = numbered.select(PAGE, F.posexplode_outer(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0))).alias("at", "token")).withColumn(
        "pos", F.coalesce("at", F.lit(0)))
    token = F.coalesce("token", F.lit("<!"))
    is_tag = token.rlike(r"^</?[a-zA-Z]")
    raw = token.rlike(r"(?i)^<(script|style)\b")
    kinds = cut.select(
        PAGE, "pos", F.when(raw, "").when(is_tag, F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))).alias("name"),
        F.when(raw | ~is_tag, 0).when(token.startswith("</"), -1).otherwise(1).alias("delta"),
        F.when(~raw & ~is_tag & ~token.rlike(r"^<[!?/]"), token).alias("text"))
    depths = with_depths(kinds, {f"_{n}": [n] for n in NOISE})
    noise = (F.greatest(*[F.col(f"_{n}") for n in NOISE]) > 0) | F.coalesce("name", F.lit("x")).isin("", *NOISE) | (F.col("name").isNull() & F.col("text").isNull())
    return depths.withColumn("_noise", noise).filter("not _noise or pos = 0").select(
        PAGE, "pos", F.when(~F.col("_noise"), F.col("name")).alias("name"), F.when(F.col("_noise"), 0).otherwise(F.col("delta")).alias("delta"),
        F.when(~F.col("_noise"), trimmed(decoded(F.col("text")))).alias("text"))


def joined(where: Column | None = None, sep: str = "") -> Column:
    """Aggregate: the texts of a group in page order."""
    wanted = F.col("text") != "" if where is None else where & (F.col("text") != "")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", "text")))), lambda x: x["text"]), sep)


def page_texts(found: DataFrame) -> DataFrame:
    """``_page`` and ``text``: text nodes of the first main or article element, else of the body, joined by one blank.

    A page with an empty main element has an empty text. Where there is no body tag all outside head and title is the body.
    """
    over = _running(PAGE)
    opens = F.col("name").isin(*MAIN) & (F.col("delta") == 1)
    first = found.withColumn("_main", F.first(F.when(opens, F.col("name")), ignorenulls=True).over(over))
    seen = first.withColumn("delta", F.when(F.col("name").isin(*MAIN) & (F.col("name") != F.col("_main")), 0).otherwise(F.col("delta")))
    depths = with_depths(seen, {"_in": MAIN, "_head": ["head"], "_title": ["title"]})
    ended = F.max((F.col("_main").isNotNull() & (F.col("_in") == 0)).cast("int")).over(over)
    body = F.max(((F.col("name") == "body") & (F.col("delta") == 1)).cast("int")).over(over)
    marked = depths.withColumn("_ended", ended).withColumn("_body", F.coalesce(body, F.lit(0)))
    texts = marked.groupBy(PAGE).agg(
        F.max("_main").alias("main"), F.max("_body").alias("body"),
        joined((F.col("_in") > 0) & (F.col("_ended") == 0), " ").alias("in_main"), joined(F.col("_body") == 1, " ").alias("in_body"),
        joined((F.col("_head") == 0) & (F.col("_title") == 0), " ").alias("in_page"))
    return texts.select(PAGE, F.when(F.col("main").isNotNull(), F.col("in_main")).when(F.col("body") == 1, F.col("in_body")).otherwise(F.col("in_page")).alias("text"))


def with_headings(found: DataFrame) -> DataFrame:
    """Add ``heading``: the position of the heading that a token lies in, below zero or null outside of one."""
    named = F.col("name").isin(*HEADINGS)
    current = F.last(F.when(named & (F.col("delta") == 1), F.col("pos")).when(named, F.lit(-1)), ignorenulls=True).over(_running(PAGE))
    return found.withColumn("heading", current)


def levels(found: DataFrame, container: str, parts: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """A row for each token inside ``container`` elements and each level of these that is open around it, and one of level 0 for each text of a heading outside.

    Adds ``heading`` (see ``with_headings``), ``depth`` (of the token), ``level`` (1 up to the depth), ``container`` (position of the element of that level) and, for every entry
    of ``parts``, the position of the part of that level which is open, null if none. A part begins at a start tag of the first names and ends at its end tag, where the next
    begins, or at a tag of the second names. Tags of a deeper level change nothing.
    """
    deep = with_depths(with_headings(found), {"depth": [container]}).filter(
        ((F.col("depth") > 0) & ~((F.col("name") == container) & (F.col("delta") == -1))) | ((F.col("heading") >= 0) & (F.col("text") != "")))
    starts = (F.col("name") == container) & (F.col("delta") == 1)
    spread = deep.withColumn("level", F.explode(F.when(starts | (F.col("depth") == 0), F.array("depth")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("depth")))))
    over, own = _running(PAGE, "level"), F.col("level") == F.col("depth")
    columns = {"container": F.last(F.when(starts, F.col("pos")), ignorenulls=True).over(over)}
    for part, (begin, end) in parts.items():
        is_begin = F.col("name").isin(*begin) & (F.col("delta") == 1)
        stops = starts | (F.col("name").isin(*begin) & (F.col("delta") == -1)) | F.col("name").isin(*end)
        columns[part] = F.last(F.when(own & is_begin, F.col("pos")).when(own & stops, F.lit(-1)), ignorenulls=True).over(over)
    return spread.select("*", *[c.alias(n) for n, c in columns.items()])


def begins(names: Sequence[str]) -> Column:
    return F.col("name").isin(*names) & (F.col("delta") == 1)


def parts_with_words(inside: DataFrame, names: Sequence[str], part: str, keep: Sequence[str]) -> DataFrame:
    """A row per element of the ``names`` (by its start tag) with its text and ``starts``, and per heading with a text: ``_page``, ``key``, ``words``, ``starts``, ``titled``.

    ``key`` is the position of the start tag. Texts belong to the open ``part`` and to their heading. ``starts`` has ``name`` and the columns ``keep`` for every level of the element.
    """
    has_text, start = F.col("text") != "", begins(names) & (F.col("level") > 0)
    keys = F.array_compact(F.array(
        F.when(start, F.col("pos")), F.when(has_text & (F.col(part) >= 0), F.col(part)),
        F.when(has_text & (F.col("heading") >= 0) & (F.col("level") == F.col("depth")), F.col("heading"))))
    return inside.withColumn("key", F.explode(keys)).groupBy(PAGE, "key").agg(
        joined().alias("words"), F.collect_list(F.when(start, F.struct("name", *keep))).alias("starts"),
        F.max(has_text & F.coalesce(F.col("key") == F.col("heading"), F.lit(False))).alias("titled"))


def with_section(items: DataFrame) -> DataFrame:
    """Add ``section``: the nearest heading with a text that begins before ``container``, cut to 100 characters.

    ``items`` holds the headings as well: rows with a ``title`` and its place ``at``, without a container. They are dropped.
    """
    over = Window.partitionBy(PAGE).orderBy(F.coalesce("container", "at"))
    return items.withColumn("section", F.left(F.last("title", ignorenulls=True).over(over), F.lit(100))).filter("container is not null").drop("title", "at")


TABLE_PARTS = {"row": (["tr"], ["tbody", "thead", "tfoot"]), "cell": (["td", "th"], ["tr", "tbody", "thead", "tfoot"]),
               "head": (["thead"], ["tbody", "tfoot"])}


def tables(found: DataFrame) -> DataFrame:
    """A row per data row of every table: ``_page``, ``container``, ``row``, ``section``, ``headers``, ``cells`` (arrays of texts).

    A table holds the rows of the tables inside it as well, and a row the cells inside its cells, each with the text of all it contains. Headers are the
    cells of the first ``thead``, whose rows count as data too, or else of the first row. Tables need two rows.

    Tokens become cells, cells become rows and heads, and these are seen table by table. Each step groups what the step before gave by more than the page, so
    nothing is joined, and nothing is shuffled once the tokens are with their page.
    """
    inside = levels(found, "table", TABLE_PARTS)
    words = parts_with_words(inside, ["td", "th", "tr", "thead"], "cell", ["container", "row", "head"])
    starts = words.select(PAGE, "key", "words", "titled", F.explode_outer("starts").alias("s"))
    is_cell = F.col("s.name").isin("td", "th")
    held = F.array_compact(F.array(*[F.when(F.col(f"s.{c}") >= 0, F.col(f"s.{c}")) for c in ("row", "head")]))
    lists = starts.select(PAGE, F.explode(F.when(is_cell, held).otherwise(F.array("key"))).alias("at"), F.when(is_cell, F.struct("key", "words")).alias("cell"),
                          F.when(~is_cell, F.col("s.container")).alias("container"), (F.col("s.name") == "thead").alias("is_head"), F.when(F.col("titled"), F.col("words")).alias("title"))
    gathered = lists.groupBy(PAGE, "at").agg(
        F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["words"]).alias("cells"), F.collect_list("container").alias("containers"),
        F.coalesce(F.max("is_head"), F.lit(False)).alias("is_head"), F.max("title").alias("title"))
    placed = gathered.select(PAGE, "at", "cells", "is_head", "title", F.explode_outer("containers").alias("container"))
    over = Window.partitionBy(PAGE, "container")
    row, head = F.when(~F.col("is_head"), F.col("at")), F.when(F.col("is_head"), F.col("at"))
    seen = placed.select(
        "*", F.count(row).over(over).alias("_rows"), F.min(row).over(over).alias("_first"), F.min(head).over(over).alias("_head"),
        F.when(F.min(head).over(over).isNotNull(), F.min_by("cells", head).over(over)).otherwise(F.min_by("cells", row).over(over)).alias("headers"))
    data = ~F.col("is_head") & (F.col("_rows") >= 2) & (F.size("cells") > 0) & (F.col("_head").isNotNull() | (F.col("at") > F.col("_first")))
    return with_section(seen.filter(F.col("container").isNull() | data).withColumn("row", F.col("at"))).select(
        PAGE, "container", "row", "section", "headers", "cells")


def definition_lists(found: DataFrame) -> DataFrame:
    """A row per pair of every definition list: ``_page``, ``container``, ``i``, ``section``, ``term``, ``definition``.

    The i-th term goes with the i-th definition. A list holds the entries of the lists inside it as well.
    """
    words = parts_with_words(levels(found, "dl", {"entry": (["dt", "dd"], [])}), ["dt", "dd"], "entry", ["container"])
    entries = words.select(PAGE, "key", "words", "titled", F.explode_outer("starts").alias("s")).select(PAGE, "key", "words", "titled", "s.*")
    numbered = entries.withColumn("i", F.row_number().over(Window.partitionBy(PAGE, "container", "name").orderBy("key")) - 1)
    pairs = numbered.groupBy(PAGE, "container", "i").agg(
        *[F.max(F.when(F.col("name") == n, F.col("words"))).alias(c) for n, c in (("dt", "term"), ("dd", "definition"))],
        F.max(F.when(F.col("titled"), F.col("words"))).alias("title"), F.max("key").alias("at"))
    return with_section(pairs.filter("container is null or (term is not null and definition is not null)"))
