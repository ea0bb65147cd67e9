from pyspark.sql import functions as F

from brickline.functions import numbers as num
from brickline.functions import text as txt
from brickline.operators import lines, reconcile, relational
from brickline.sources import read_catalogue_csv

c = F.col


def values(spark, kind, cells, *exprs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], f"i int, x {kind}").orderBy("i")
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*exprs).collect()]


def test_normalise_is_idempotent(spark):
    cells = [None, "  Straße ÄÖÜ ", "Abc", ""]
    once = values(spark, "string", cells, txt.normalise("x"))
    assert once == ["", "strasse aeoeue", "abc", ""]
    assert values(spark, "string", once, txt.normalise("x")) == once


def test_numbers(spark):
    cells = ["1.234,56", "1,234.56", "12,5", "1.234", "12,50 €", "x", None, "1.000.000,00 EUR"]
    assert values(spark, "string", cells, num.parse_number(c("x"))) == [1234.56, 1234.56, 12.5, 1.234, 12.5, None, None, 1e6]
    assert values(spark, "string", ["1.234", "1.234,5"], num.parse_german(c("x"))) == [1.234, 1234.5]
    assert values(spark, "string", ["für 12.50 EUR"], num.parse_price_text(c("x")), num.parse_price_text(c("x"), True)) == [(1250.0, 12.5)]
    assert values(spark, "string", ["3-5 Tage", "", None], num.digits_int(c("x"))) == [35, None, None]
    assert values(spark, "double", [1234567.5, 2.675], num.money_text(c("x")))[0] == "1.234.567,50"
    assert values(spark, "string", ["Lieferzeit ca. 3 Wochen", "sofort"], num.delivery_days(c("x"))) == [3, None]


def test_texts(spark):
    assert values(spark, "string", ["04.0010", "4.10.", "OZ 01.02", None], txt.item_number(c("x"))) == ["4.10", "4.10", "1.2", ""]
    assert values(spark, "string", ["a, b;c/ ", " ; ", None], txt.string_list(c("x"))) == [["a", "b", "c"], None, None]
    html = ["<p>a&amp;b</p>\n c&nbsp;", "Ma&szlig;e f&uuml;r 5 &#8364; &#x41;&#0;&unknown; & x", None, "&", "&lt;b&gt;"]
    assert values(spark, "string", html, txt.strip_html(c("x"))) == ["a&b\nc", "Maße für 5 € A&#0;&unknown; & x", "", "&", "<b>"]
    assert values(spark, "string", ["Rohr und Bögen DN-150 ab"], txt.tokens(c("x"))) == [["rohr", "bögen", "dn-150"]]
    assert values(spark, "string", ["a  b\r\n\r\n c "], txt.squeezed_lines(c("x"))) == ["a b\nc"]


def test_message_key_replay(spark):
    df = spark.createDataFrame([(" m1 ", "s", "f", "b"), (None, "s", "f", "b"), ("", "s", "f", "b")], "i string, s string, f string, b string")
    keys = [r[0] for r in df.select(txt.message_key(c("i"), c("s"), c("f"), c("b"))).collect()]
    assert keys[0].strip() == "m1" and keys[1] == keys[2] and keys[1].startswith("fallback-")


def test_carry_chain(spark):
    rows = [(1, 1, "a", False), (1, 2, None, True), (1, 3, None, True), (1, 4, "b", False), (1, 5, None, True), (2, 1, None, True)]
    df = spark.createDataFrame(rows, "k int, i int, v string, ref boolean")
    got = [r["carried_v"] for r in lines.carried(df, "k", ["i"], c("ref"), ["v"]).orderBy("k", "i").collect()]
    assert got == ["a", "a", "a", "b", "b", None]


def test_two_key_fallback_and_superseded(spark):
    df = spark.createDataFrame([(1, None, "offen"), (2, None, "fertig"), (3, 5, "offen")], "i int, k int, s string")
    got = relational.without_superseded(df, ["k"], c("s") == "offen", c("s") == "fertig").collect()
    assert sorted(r["i"] for r in got) == [2, 3]


def test_greedy_assignment(spark):
    line = [(1, "1.1", ["a", "b"]), (2, None, ["x", "y", "z"]), (3, None, ["q"]), (4, None, None)]
    request = [(10, "9", ["x", "y"]), (11, "1.1", []), (12, None, ["k"])]
    rows = [(7, s, *r) for s, side in (("line", line), ("request", request)) for r in side]
    rows += [(8, "line", 1, "5", ["p", "q"]), (8, "line", 2, "5", ["p", "q"]), (8, "request", 20, "5", ["z"]), (8, "request", 21, "5", []), (8, "request", 22, None, ["p", "q"])]
    rows += [(None, "line", 1, "", ["a"]), (None, "line", 1, "", ["a"]), (9, "request", 1, "1", [])]
    got = reconcile.greedy_assignment(spark.createDataFrame(rows, "mail_id long, side string, id long, number string, tokens array<string>"))
    by_mail = lambda m: [tuple(r)[1:] for r in got.collect() if r.mail_id == m]
    assert by_mail(7) == [(1, 11, "number"), (2, 10, "tokens"), (3, 12, "sole"), (4, None, None)]
    # of two requests with one number the last has it
    assert by_mail(8) == [(1, 21, "number"), (2, 22, "tokens")] and by_mail(None) == [(1, None, None)] * 2 and by_mail(9) == []


def test_insert_or_ignore(spark):
    import random

    rng = random.Random(6)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    rows = [(i, some(30), some(25), some(4)) for i in range(120)]
    schema = "i int, a int, b int, c int"
    seen, want = {("a", 5)}, []
    for i, a, b, k in rows:
        keys = {("a", a)} if a is not None else set()
        keys |= {("b", b, k)} if None not in (b, k) else set()
        if not keys & seen:
            seen |= keys
            want.append(i)
    existing = spark.createDataFrame([(0, 5, None, 1)], schema)
    got = relational.insert_or_ignore(existing, spark.createDataFrame(rows, schema), "i", [["a"], ["b", "c"]])
    assert sorted(r.i for r in got.collect()) == want
    none = spark.createDataFrame([], schema)
    assert relational.insert_or_ignore(none, none, "i", [["a"]]).count() == 0


def test_finalised_descriptions_go_on_from_chunk_to_chunk(spark, monkeypatch):
    from brickline.operators.extraction import descriptions

    fields = ", ".join(f"{n} {'int' if n in ('nominal_diameter_dn', 'secondary_nominal_diameter_dn', 'stiffness_class_sn') else 'string'}" for n in descriptions.FIELDS.values())
    line = lambda i, kind, text, dn=None: ("d", i, kind, text, None, None, None, dn, *[None] * (len(descriptions.FIELDS) - 1))
    rows = [line(0, "material", "", 100), line(1, "material", "Rohr, rund", 150), line(2, "material", "wie zuvor", 200), line(3, "dienstleistung", "Prüfen"), line(4, None, "", 300), *[line(i, "material", "wie zuvor", i) for i in range(5, 12)]]
    df = spark.createDataFrame(rows, f"doc string, n int, position_type string, description string, raw_text string, product_category string, product_subcategory string, {fields}")
    want = ["Position, DN 100", "Rohr, rund, DN 150", "Rohr, DN 200", "Prüfen", "Rohr, DN 300", *[f"Rohr, DN {i}" for i in range(5, 12)]]
    for run in (1000, 3):
        monkeypatch.setattr(descriptions, "RUN", run)
        assert [r.description for r in descriptions.finalised(df, "doc", "n").orderBy("n").collect()] == want
    assert descriptions.finalised(df.limit(0), "doc", "n").count() == 0


def test_catalogue_csv(spark, tmp_path):
    from pyspark.sql.types import StructType

    path = tmp_path / "k.csv"
    path.write_text("artikel_id;preis;stueck;unbekannt\nA1;1.234,50;3;x\nA2;;2,5;\n", encoding="utf-8")
    got = read_catalogue_csv(spark, str(path), StructType.fromDDL("artikel_id string, preis double, stueck int, fehlt string")).orderBy("artikel_id").collect()
    assert [tuple(r) for r in got] == [("A1", 1234.5, 3, None), ("A2", None, 2, None)]
