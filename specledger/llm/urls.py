"""URL verdicts from rules and trust propagated over the host graph (operator 4). DataFrame functions only.

Rules (host, path) decide first; the longest that fits a URL wins. Other URLs get the verdict of their host: trust flows from trusted seeds
along host edges (personalised PageRank), distrust flows from blocked seeds against them, to the hosts that link there. A host whose
distrust exceeds its trust by ``THRESHOLD`` is blocked. Seeds follow from the rules: a host most of whose pages are blocked is a blocked seed, one
with allowed and no blocked pages a trusted one. Edges are the links of the pages to other hosts and the step from a subdomain to its parent.

The rules are a list in the code of the caller, so they are matched inside each row. Edges, degrees and scores are tables; each iteration is
one join and one pre-aggregated sum, and every ``STAGED`` iterations are stored, which cuts the lineage.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the verdict allow; pages with an empty host are not
part of the graph; a null ``html`` has no links; repeated rows are judged as often as they occur; an empty table gives an empty result. Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specledger.session import stage_table

Rule = tuple[str, str, str]  # verdict, host, path
ITERATIONS, STAGED = 8, 4
DAMPING = 0.85
THRESHOLD = 0.05
LINKS = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, null if none does."""
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"),
                               F.lit(p).alias("path")) for v, h, p in rules])
    return F.array_max(F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                                & F.startswith(path, r["path"])))


def parse_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    parsed = pages.select("page_id", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
                          F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"), "html")
    if not rules:
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("by_rule", F.lit(None).cast("string"))
    return parsed.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "html", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("by_rule"))


def seeds(parsed: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust``: one of them is 1, for hosts of pages."""
    counts = parsed.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    return counts.select("host", ((F.col("good") > 0) & (F.col("bad") == 0)).cast("double").alias("trust"),
                         (2 * F.col("bad") > F.col("n")).cast("double").alias("distrust"))


def host_edges(parsed: DataFrame) -> DataFrame:
    """Distinct (``src``, ``dst``)."""
    pages = parsed.filter("host <> ''")
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINKS), F.lit(1))))
                         .alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    hosts = pages.select(F.col("host").alias("src")).distinct()
    parents = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst")).filter("dst <> ''")
    return links.filter("src <> dst").unionByName(parents).distinct()


def propagate(edges: DataFrame, start: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """``host``, ``trust``, ``distrust`` after some iterations from the seeds ``start``."""
    forth = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    back = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    ways = stage_table(
        edges.join(forth, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (1.0 / F.col("n")).alias("w_trust"), zero.alias("w_distrust"))
        .unionByName(edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("w_trust"),
                                                    (1.0 / F.col("n")).alias("w_distrust"))), "host-ways")
    base = start.filter("trust > 0 or distrust > 0").select("host", *[((1 - DAMPING) * F.col(c)).alias(c) for c in ("trust", "distrust")])
    state = base
    for turn in range(iterations):
        flow = ways.join(state, "host").select(F.col("to").alias("host"), *[
            (DAMPING * F.col(f"w_{c}") * F.col(c)).alias(c) for c in ("trust", "distrust")])
        state = flow.unionByName(base).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if turn % STAGED == STAGED - 1:
            state = stage_table(state, "host-scores")
    return state


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page, with the scores of its host."""
    parsed = parse_pages(pages, rules)
    start = stage_table(seeds(parsed.select("host", "by_rule")), "host-seeds")
    edges = stage_table(host_edges(parsed.select("host", "html")), "host-edges")
    scores = stage_table(propagate(edges, start).select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust")), "scores")
    none = F.lit(0.0)
    found = parsed.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", "by_rule", F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def oracle(rules: list[Rule], pages: str = "pages") -> str:
    """The same as SQL, the iterations written out."""
    rest = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    values = ", ".join(f"('{v}', '{h}', '{p}', {len(h + p)})" for v, h, p in rules)
    steps = []
    before = "base"
    for turn in range(ITERATIONS):
        steps.append(
            f"s{turn} as (select host, sum(trust) trust, sum(distrust) distrust from (select w.dst as host, {DAMPING} * w.wt * s.trust as trust,"
            f" {DAMPING} * w.wd * s.distrust as distrust from ways w join {before} s on s.host = w.src union all select * from base) group by host)")
        before = f"s{turn}"
    return f"""
with rules(verdict, rhost, rpath, size) as (values {values}),
rest as (select page_id, html, coalesce({rest}, '') as rest from {pages}),
parsed as (select page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} as host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from rest),
ruled as (select page_id, host, path, html, (select arg_max(struct_pack(r := rhost || rpath, v := verdict), size) from rules
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as m from parsed),
counts as (select host, count(*) n, count(*) filter (m.v = 'allow') good, count(*) filter (m.v = 'block') bad from ruled where host <> '' group by host),
base as (select host, {1 - DAMPING!r} * (good > 0 and bad = 0)::int::double as trust, {1 - DAMPING!r} * (2 * bad > n)::int::double as distrust from counts
  where (good > 0 and bad = 0) or 2 * bad > n),
links as (select host as src, {lower.format("unnest(list_distinct(regexp_extract_all(coalesce(html, ''), $re${LINKS}$re$, 1)))")} as dst from ruled where host <> ''),
edges as (select src, dst from links where src <> dst union
  select host, regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) from counts where regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) <> ''),
ways as (select src, dst, 1.0::double / count(*) over (partition by src) as wt, 0.0::double as wd from edges union all
  select dst, src, 0.0::double, 1.0::double / count(*) over (partition by dst) from edges),
{", ".join(steps)}
select page_id, r.host as host, path, m.r as rule, coalesce(m.v, case when round(coalesce(distrust, 0), 9) - round(coalesce(trust, 0), 9) > {THRESHOLD}
  then 'block' else 'allow' end) as verdict, coalesce(round(trust, 9), 0) as trust, coalesce(round(distrust, 9), 0) as distrust
from ruled r left join {before} s on s.host = r.host"""
