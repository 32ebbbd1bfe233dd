import json
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from specledger.sources import html, markup, records, stored, tabular

PUMP = """<html><head><title>Shop 3 kW</title><style>p{}</style><script>if (a < b) document.write('<p>9 kW</p>');</script></head><body><header>1 kW</header><article>
<h1>Pond pump</h1><table><thead><tr><th>Draw (kW)<th>Turns (rpm)</thead><tr><td>0.3</td><td>2850</td></tr></table>
<h3>In the box</h3><dl><dt>Seal<dd>IP68, tight<dt>Colour<dd>blue<dt>Feed<dd>230 V</dl>
<p>Needs 0.25 kW idle &amp; 0.3 kW at work; it weighs 4.5&nbsp;kg.</article><footer>2 kW</footer></body></html>"""
LAMP = "<body><h4>Lamp <i>heads</i></h4><table><tr><th>Load</th><th>Flow</th></tr><tr><td>0.1 kW</td><td>0.4 A</td></tr></table></body>"


def pages(spark):
    return spark.createDataFrame([("p1", "u1", PUMP), ("p2", "u2", LAMP)], "product_id string, url string, html string")


def test_melt_skips_blanks_and_keeps_unknown_columns(spark):
    df = spark.createDataFrame(
        [("M-4P-1.1", "W", "1.1", "7.22", " ", "red", 1), ("  ", "W", "2", "3", "x", "blue", 2), ("M-4P-2", "", "", "", "", "", 3)],
        "product_id string, manufacturer string, rated_power_kw string, full_load_current_a string, ip_note string, colour string, row int")
    rows = {r["column"]: r for r in tabular.melt_wide_csv(df).collect()}
    assert set(rows) == {"rated_power_kw", "full_load_current_a", "colour"}
    assert (rows["rated_power_kw"]["attribute"], rows["rated_power_kw"]["unit"], rows["rated_power_kw"]["value"]) == ("rated_power", "kW", 1.1)
    assert rows["rated_power_kw"]["confidence"] == 0.85 and rows["colour"]["confidence"] == 0.60
    assert rows["colour"]["evidence_text"] == "manufacturer=W; rated_power_kw=1.1; full_load_current_a=7.22; colour=red"


def test_grid_rows_and_entity_match(spark):
    cells = spark.createDataFrame(
        [(5, 1, 1, 4, ["1,1", "1.5", "90S"]), (5, 1, 2, 4, ["kW"]), (5, 1, 3, None, ["5.5"]), (5, 1, 4, 4, ["2000"]), (5, 1, 5, 4, ["9.9"])],
        "page int, table_no int, row_no int, poles int, cells array<string>")
    manifest = spark.createDataFrame([("X-Y-4P-1.1", 0), ("X-Y-6P-5.52", 1), ("X-Y-4P-5.5", 2), ("zz", 3)], "product_id string, manifest_pos int")
    rows = tabular.grid_to_evidence(cells, manifest).orderBy("pos").collect()
    assert [(r["product_id"], r["attribute"], r["value"]) for r in rows] == [
        ("X-Y-4P-1.1", "rated_power", 1.1), ("X-Y-4P-1.1", "rated_power_hp", 1.5), ("X-Y-4P-1.1", "frame_size", 90.0),
        ("X-Y-6P-5.52", "rated_power", 5.5), ("PDF-P5-kW9.9", "rated_power", 9.9)]
    assert rows[0]["section"] == "p.5, 4-pole electrical data table"


def test_page_constants_need_every_gate_word(spark):
    df = spark.createDataFrame([(1, "a 400 V b 50Hz\nx"), (2, "50 Hz only"), (3, "1400 V")], "page int, text string")
    rows = tabular.page_constants(df).orderBy("pos").collect()
    assert [(r["page"], r["attribute"], r["raw_value"], r["evidence_text"]) for r in rows] == [
        (1, "rated_voltage", "400", "a 400 V b 50Hz x"), (1, "frequency", "50", "a 400 V b 50Hz x")]


def test_html_strategies(spark):
    text = html.html_strip(pages(spark)).filter("product_id = 'p1'").first()["text"]
    assert re.findall(r"[\d.]+ kW", text) == ["0.25 kW", "0.3 kW"] and "idle & 0.3 kW" in text
    tokens = html.html_tokens(pages(spark))
    # Cells without a unit give nothing, unless the header's unit is allowed.
    assert html.html_table_specs(tokens).filter("product_id = 'p1'").count() == 0
    with_units = html.html_table_specs(tokens, header_units=True).filter("product_id = 'p1'").orderBy("pos").collect()
    assert [(r["attribute"], r["value"], r["section"]) for r in with_units] == [("rated_power", 0.3, "Pond pump"), ("rated_speed", 2850.0, "Pond pump")]
    table = html.html_table_specs(tokens).filter("product_id = 'p2'").orderBy("pos").collect()
    assert [(r["attribute"], r["raw_value"], r["section"], r["evidence_text"]) for r in table] == [
        ("rated_power", "0.1", "Lampheads", "Load: 0.1 kW | Flow: 0.4 A"), ("rated_current", "0.4", "Lampheads", "Load: 0.1 kW | Flow: 0.4 A")]
    dl = html.html_dl_specs(tokens).orderBy("pos").collect()
    assert [(r["attribute"], r["raw_value"], r["section"], r["evidence_text"]) for r in dl] == [
        ("ip_rating", "IP68", "In the box", "Seal: IP68, tight"), ("rated_voltage", "230", "In the box", "Feed: 230 V")]
    every = html.html_specs(pages(spark)).filter("product_id = 'p1'").orderBy("pos").collect()
    assert [(r["method"], r["attribute"], r["raw_value"]) for r in every] == [
        ("html_dl", "ip_rating", "IP68"), ("html_dl", "rated_voltage", "230"), ("html_text", "rated_power", "0.25"), ("html_text", "rated_power", "0.3"),
        ("html_text", "rated_voltage", "230"), ("html_text", "ip_rating", "IP68"), ("html_text", "weight", "4.5")]
    assert len({r["pos"] for r in every}) == len(every)


class Tree(HTMLParser):
    """A page as nested lists [name, children], with the ends that HTML lets authors leave out."""

    ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

    def __init__(self, page):
        super().__init__()
        self.whole = True
        self.root = ["", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        while self.open[-1][0] in self.ENDS.get(name, ()):
            self.open.pop()
        node = [name, []]
        self.open[-1][1].append(node)
        if name != "br":
            self.open.append(node)

    def handle_endtag(self, name):
        if name in [n for n, _ in self.open]:
            while self.open.pop()[0] != name:
                pass

    def handle_data(self, data):
        inside = self.open[-1][1]
        if inside and isinstance(inside[-1], str) and self.whole:
            inside[-1] += data  # the parser hands out a text with a bare "<" in parts
        else:
            inside.append(data)
        self.whole = True

    def handle_comment(self, data):
        self.whole = False


def walk(node):
    """All elements and texts outside noise in page order."""
    for child in node[1]:
        if isinstance(child, str):
            yield child.strip()
        elif child[0] not in ("script", "style", "nav", "footer", "header"):
            yield child
            yield from walk(child)


def texts(node, sep=""):
    return sep.join(t for t in walk(node) if isinstance(t, str) and t)


def of(node, *names):
    return [n for n in walk(node) if isinstance(n, list) and n[0] in names]


def random_block(rng, depth=0):
    kind = rng.choice(["p", "table", "table", "dl", "nav", "div", "heading", "text"] if depth < 3 else ["p", "text"])
    inner = lambda: "".join(random_block(rng, depth + 1) for _ in range(rng.randrange(3)))
    word = rng.choice(["7 kW", "a &lt; b", "&#233;t&eacute;", "&nbsp;x&nbsp;", "50&nbsp;Hz", "5 < 6", "&unknown; &amp; y", "<!-- 3 kW > -->z", "&#x1F600;", "230 V"])
    if kind == "table":
        rows = ["".join(f"<{t}>{word if rng.random() < 0.5 else inner()}" + (f"</{t}>" if rng.random() < 0.6 else "")
                        for t in rng.choices(["td", "th"], k=rng.randrange(4))) for _ in range(rng.randrange(4))]
        rows = [f"<tr title='a > b'>{r}" + ("</tr>" if rng.random() < 0.6 else "") for r in rows]
        head = f"<thead>{rows.pop(0)}</thead>" if rows and rng.random() < 0.4 else ""
        return f"<table>{head}{''.join(rows)}</table>"
    if kind == "dl":
        return "<dl>" + "".join(f"<{t}>{word}{inner()}" + (f"</{t}>" if rng.random() < 0.5 else "") for t in rng.choices(["dt", "dd"], k=rng.randrange(5))) + "</dl>"
    if kind == "nav":
        return f"<{(n := rng.choice(['nav', 'header', 'footer']))}>{word}{inner()}</{n}>"
    if kind == "heading":
        return f"<h2>{rng.choice(['', word])}</h2>"
    return word if kind == "text" else f"<p class=\"x\">{word}</p>" if kind == "p" else f"<DIV>{inner()}{word}<br></DIV>"


def test_markup_against_a_tree(spark):
    rng = random.Random(41)
    made = []
    for i in range(120):
        body = "".join(random_block(rng) for _ in range(rng.randrange(12)))
        frame = rng.choice(["{}", "<body>{}</body>", "<head><title>t</title></head><body>x<main>{}</main>y</body>", "<body><nav>n</nav><article>{}<article>in</article></article><main>no</main></body>",
                            "<script>var t = '</p><main>';</script><body>{}</body>"])
        made.append((str(i), "u", frame.replace("{}", body)))
    made += [("none", "u", None), ("empty", "u", ""), ("main", "u", "<body>a<main></main>b</body>")]
    frame = spark.createDataFrame(made, "product_id string, url string, html string")
    got = {r["product_id"]: r["text"] for r in html.html_strip(frame).collect()}
    tokens = html.html_tokens(frame)
    tables = [(r["_page"]["product_id"], r["container"], r["row"], r["section"], r["headers"], r["cells"]) for r in markup.tables(tokens).collect()]
    lists = [(r["_page"]["product_id"], r["container"], r["i"], r["section"], r["term"], r["definition"]) for r in markup.definition_lists(tokens).collect()]
    for name, _, page in made:
        tree = Tree(page or "").root
        main = of(tree, "main", "article") or of(tree, "body")
        assert got[name] == texts(main[0] if main else tree, " "), page
        nodes = list(walk(tree))
        want_tables, want_lists = [], []
        for at, node in enumerate(nodes):
            if isinstance(node, list) and node[0] in ("table", "dl"):
                before = [texts(n) for n in nodes[:at] if isinstance(n, list) and n[0] == "h2" and texts(n)]
                section = before[-1][:100] if before else None
            if isinstance(node, list) and node[0] == "table" and len(rows := of(node, "tr")) >= 2:
                head = of(node, "thead")
                headers = [texts(c) for c in of(head[0] if head else rows[0], "td", "th")]
                want_tables += [(section, headers, cells) for r in (rows if head else rows[1:]) if (cells := [texts(c) for c in of(r, "td", "th")])]
            if isinstance(node, list) and node[0] == "dl":
                want_lists += [(section, texts(a), texts(b)) for a, b in zip(of(node, "dt"), of(node, "dd"))]
        assert [t[3:] for t in sorted(t for t in tables if t[0] == name)] == want_tables, page
        assert [t[3:] for t in sorted(t for t in lists if t[0] == name)] == want_lists, page
    assert len(tables) > 100 and len(lists) > 50


def test_character_references(evaluate):
    import html as standard

    text = "&#8211;&#x2014;&Eacute;&copy;&copy &AMP;&amp;&notit; &bogus; & &; &#; &#x; &#0;&#128;&#159;&#xD800;&#1114112;&#99999999999999999999;&#x0000000041;&ngE; a&b&lt"
    got = evaluate(lambda: markup.decoded(F.col("t")), "t string", text)
    assert got == standard.unescape(text).replace("¬it;", "&notit;")


def test_text_matches_agree_with_a_scan(spark):
    import re

    text = "1 kW 22kW, 3.5 kW;" + "x" * 100 + " 7 kW"
    df = spark.createDataFrame([("p", "u", text)], "product_id string, url string, text string")
    got = html.html_text_specs(df, [(r"(\d+(?:\.\d+)?)\s*kW", "rated_power", "kW")]).orderBy("pos").collect()
    want = [(m.group(1), text[max(0, m.start() - 60):m.end() + 60].strip()) for m in re.finditer(r"(\d+(?:\.\d+)?)\s*kW", text)]
    assert [(r["raw_value"], r["evidence_text"]) for r in got] == want


def test_stored_evidence(spark, tmp_path):
    fact = {"source_id": "s", "source_type": "pdf", "product_id": "P", "page": 3, "attribute": "weight", "raw_value": "2", "value": 2.0}
    files = {"a": {"source_id": "s", "source_type": "pdf", "product_id": "P", "status": "success", "evidence": [fact, {**fact, "raw_value": "3"}]},
             "b": {"source_id": "s", "source_type": "web", "product_id": "P", "status": "failed", "error": "403", "evidence": [fact]},
             "c": [{**fact, "source_type": "csv"}]}
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    rows = stored.read_evidence_json(spark, str(tmp_path)).orderBy("source_rank", "pos").collect()
    assert [(r["source_type"], r["raw_value"], r["source_rank"]) for r in rows] == [("pdf", "2", 0), ("pdf", "3", 0), ("csv", "2", 1)]
    log = {r["status"]: r["n_facts"] for r in stored.read_extraction_log(spark, str(tmp_path)).collect()}
    assert log == {"success": 2, "failed": 1}


def test_catalog_rows_are_numbered_in_file_order(spark, tmp_path):
    head = "Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf\n"
    (tmp_path / "a.csv").write_text(head + 'A1,"x ""q"" 36""\nsecond",-- Unbranded --,-,TREX,Freud Inc (2435)\nA2,d,,,,\n')
    (tmp_path / "b.csv").write_text(head + "B1," + "long " * 80 + ",N/A,-,,\nB2,d,,,,\n")
    rows = stored.read_catalog(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r["row_id"], r["mfg_part_num"]) for r in rows] == [(1, "A1"), (2, "A2"), (3, "B1"), (4, "B2")]
    assert rows[0]["part_desc"] == 'x "q" 36"\nsecond' and rows[0]["e1_brand"] is None and rows[0]["dib_brand"] == "TREX"


def test_large_csv_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    values = ["a", "", "x,y", 'say ""hi""', "line\nbreak", '\n\n", "', "36in", "long " * 30, "é€", '"', ",", "\r\n", "7"]
    want = []
    for name in ("b", "a", "c"):
        rows = [[rng.choice(values) for _ in range(3)] for _ in range(rng.choice((0, 40, 200)) if name != "a" else 200)]
        text = "k,l m,n\n" + "".join(",".join(v if rng.random() < 0.3 and not set(v) & set(',"\n\r') else '"' + v.replace('"', '""') + '"' for v in r) + rng.choice(("\n", "\n", "\n\n")) for r in rows)
        (tmp_path / f"{name}.csv").write_text(text, newline="")
        want.append((name, rows))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("37", "200", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            frame = records.read_csv(spark, str(tmp_path))
            assert frame.columns == ["k", "l m", "n", "row_id"]
            got = {r["row_id"]: [v or "" for v in r[:3]] for r in frame.collect()}
            expected = [r for _, rows in sorted(want) for r in rows]
            assert got == {i + 1: [v.replace("\r\n", "\n") for v in r] for i, r in enumerate(expected)}, size
            if size == "37":
                assert records.csv_records(spark, str(tmp_path)).count() == len(expected) and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bare_quotes_and_encodings(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes(b'a,b\r\n36" range,x\r\n5"x7" disc,"two\r\nlines"\r\n"q" tail,y\r\n')
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "q.csv")).select("row_id", "b").orderBy("row_id").collect()] == [(1, "x"), (2, "two\nlines"), (3, "y")]
    (tmp_path / "w.csv").write_bytes("\u00e9,b\n\u20ac5,\u00ae\n".encode("cp1252"))
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "w.csv"), "cp1252").collect()] == [("€5", "®", 1)]
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbfa,b\nok,\xff!\n")
    bad = records.read_csv(spark, str(tmp_path / "u.csv"))
    assert bad.columns == ["a", "b", "row_id"] and tuple(bad.first()) == ("ok", "\ufffd!", 1)


def test_gold(spark, tmp_path):
    (tmp_path / "g.csv").write_text(
        "Mfg_Part_Num,MANUFACTURER_PART_NUMBER,MANUFACTURER_NAME,BRAND_NAME,Product Name,Classpath,ATTRIBUTE_LABEL 1,ATTRIBUTE_VALUE 1,ATTRIBUTE_UOM 1,"
        "ATTRIBUTE_LABEL 2,ATTRIBUTE_VALUE 2,ATTRIBUTE_UOM 2\n,PX, Maker ,B,Name,A>B,Voltage,120,V,,,\n")
    wide = stored.read_gold(spark, str(tmp_path))
    row = stored.gold_rows(wide).first()
    assert (row["row_id"], row["mfg_part_num"], row["expected_brand"], row["expected_trade_name"]) == (1, "PX", "B", "")
    assert [tuple(r) for r in stored.gold_attributes(wide).collect()] == [(1, 1, "Voltage", "120", "V")]


def test_global_facts_reach_every_product(spark):
    from specledger.schema import conform

    own = conform(spark.createDataFrame([("pdf", "P1", "weight", "2", 0, 0)],
                                        "source_type string, product_id string, attribute string, raw_value string, source_rank int, pos int"))
    shared = conform(spark.createDataFrame([("pdf", "GLOBAL", "frequency", "50", 3, i) for i in range(4)],
                                           "source_type string, product_id string, attribute string, raw_value string, source_rank int, pos int"))
    products = spark.createDataFrame([("P1",), ("P2",)], "product_id string")
    rows = stored.collect_sources([own], products, shared).groupBy("product_id").agg(F.sum("n_copies").alias("n")).collect()
    assert {r["product_id"]: r["n"] for r in rows} == {"P1": 5, "P2": 4}


def test_tokens_are_shuffled_once(spark):
    """Tables and lists are read from tokens without a join: one shuffle brings the pages together, none follows."""
    tokens = html.html_tokens(pages(spark))
    for df in (html.html_table_specs(tokens), html.html_dl_specs(tokens)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
