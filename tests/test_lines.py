"""The operators on lines, guesses and tallies with nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from brickline.operators import guesses, relational, tallies
from brickline.operators.extraction import corrections, descriptions, quantities
from brickline.operators.matching.ranking import frequent
from brickline.plans.guess_queries import ARTICLES
from brickline.plans.line_queries import LINES

c = F.col
part = pytest.fixture(lambda spark: spark.range(1, 40).withColumnRenamed("id", "p_partkey"))


def nulled(df):
    """The first rows as they are, and rows of nulls beside them."""
    empty = df.limit(2).select(*[F.lit(None).cast(kind).alias(name) if name != "p" else c(name) for name, kind in df.dtypes])
    return df.unionByName(empty)


def test_corrections_keep_every_row(part):
    rows = nulled(LINES.spark(part))
    for f in (corrections.corrected, corrections.post_processed):
        assert f(rows).count() == rows.count() and f(rows.limit(0)).count() == 0
        assert f(rows).columns == rows.columns


def test_guesses_keep_every_row(part):
    rows = nulled(ARTICLES.spark(part))
    got = guesses.enriched(rows)
    assert got.count() == rows.count() and guesses.enriched(rows.limit(0)).count() == 0
    text = guesses.combined(c("artikelname"), c("artikelbeschreibung"))
    none = rows.where("artikelname is null").select(guesses.material(text), guesses.connection_dns(text), guesses.highest_load_class(text), guesses.norms(text)["first"]).collect()
    assert len(none) == 2 and all(x is None for r in none for x in r)


def test_texts_without_anything(spark):
    rows = spark.createDataFrame([(None,), ("",), ("\n\n",)], "t string")
    got = rows.select(
        quantities.block_quantity(c("t"))["quantity"].alias("a"), quantities.text_quantity(c("t"))["unit"].alias("b"), F.size(descriptions.usable_lines(c("t"))).alias("n"),
        descriptions.display_title(c("t"), c("t"), c("t"), c("t")).alias("title"), quantities.is_noise(c("t")).alias("noise"),
    ).collect()
    assert all(tuple(r)[:4] == (None, None, 0, "Position") for r in got)


def test_paragraphs_and_measures(spark):
    text = "Rohr aus\nBeton liefern.\nTyp A\n\nca. 5 m, 4 x 3 m und 7,5 m\nEnde"
    [row] = spark.range(1).select(descriptions.paragraphs(F.lit(text)).alias("p"), quantities.text_quantity(F.lit(text)).alias("q")).collect()
    assert row["p"] == ["Rohr aus Beton liefern.", "Typ A", "ca. 5 m, 4 x 3 m und 7,5 m Ende"] and tuple(row["q"]) == (7.5, "m")


def test_reasons_by_frequency(spark):
    reasons = F.array(*[F.lit(x) for x in ["a", "b", "c", "b", "d", "e", "f", "g", "h", "h"]])
    assert spark.range(1).select(frequent(reasons)).first()[0] == ["b", "h", "a", "c", "d", "e", "f"]


def test_tallies_of_empty_tables(spark):
    pos = spark.createDataFrame([], "position_id string, position_type string, decision string, is_asked boolean, is_covered boolean")
    none = spark.createDataFrame([], "position_id string")
    rows = tallies.assignments(pos, none, none)
    assert tallies.tally(rows, [], tallies.position_tests()).first()["total"] == 0
    one = spark.createDataFrame([("p", None, None, None, None)], pos.schema)
    got = tallies.tally(tallies.assignments(one, none, none), [], tallies.position_tests() | {"covered": c("is_covered")})
    assert tallies.progress(got).first()["open"] == 1


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((c("id") * 7919 % 1000).alias("x"))
    got = relational.numbered_in_order(rows, [c("x")]).collect()
    assert all(r["nth"] == r["x"] + 1 for r in got) and relational.numbered_in_order(rows.limit(0), [c("x")]).count() == 0


def test_objects_of_any_depth_are_recovered(spark):
    from brickline.streaming.ingest import complete_objects

    texts = [
        '[{"a":{"b":{"c":1}}},{"d":1}', 'x [ {"a": "}]{"}, {"b": [1, {"c": "\\"}"}]},\n{"cut": {"e": 1}', "[]", None, "no array", '[{"a":1}] [{"b":2}]', '[1, {"a":1}, [2], "{", {"b"',
        '[{"t": "' + "x\\n" * 20_000 + '"}, {"u": "',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", complete_objects(F.col("t")).alias("got")).orderBy("i").collect()
    assert [r.got for r in rows] == [
        '[{"a":{"b":{"c":1}}},{"d":1}]', '[{"a": "}]{"},{"b": [1, {"c": "\\"}"}]}]', None, None, None, '[{"a":1}]', '[{"a":1}]', '[{"t": "' + "x\\n" * 20_000 + '"}]',
    ]


def test_a_description_names_its_details_once(spark):
    d = descriptions
    lit = lambda x, kind="string": F.lit(x).cast(kind)
    fields = {n: lit(None) for n in d.FIELDS} | {"dn": lit(150, "int"), "second_dn": lit(None, "int"), "sn": lit(4, "int"), "material": lit(" PP "), "system": lit("pp"), "reference": lit("Typ A")}
    shown = [d.display_description(lit(t), lit(raw), fields) for t, raw in (("Rohr", None), ("Rohr PP", ""), (None, None), ("Rohr", "Rohr\nMaterial: PVC\nMaterial: PVC"))]
    df = spark.range(1).select(*[x.alias(f"t{i}") for i, x in enumerate(shown)], d.derived_title(lit(None), lit("x")).alias("d"), d.derived_title(lit(""), lit(None)).alias("e"))
    assert list(df.first()) == ["Rohr, DN 150, PP, SN4, z. B. Typ A", "Rohr PP, DN 150, SN4, z. B. Typ A", None, "Rohr, Material: PVC, DN 150, PP, SN4, z. B. Typ A", "x", ""]
    columns = ["a int", "b int", "c int", *[f"{x} string" for x in "defghijk"]]
    some = spark.createDataFrame([], ", ".join(columns))
    names = dict(zip(d.FIELDS, ["a", "b", "d", "c", *"efghi"], strict=True))
    text = some.select(d.display_description(F.col("j"), F.col("k"), {n: F.col(x) for n, x in names.items()}).alias("x"))
    assert text._jdf.queryExecution().analyzed().expressions().toString().count("DN %d/%d") == 1
