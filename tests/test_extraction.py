from pyspark.sql import functions as F

from brickline.operators import inquiries
from brickline.operators.extraction.parameters import component_parts, parameters


def read(spark, *lines):
    df = spark.createDataFrame([(i, d, r) for i, (d, r) in enumerate(lines)], "i int, description string, raw_text string")
    return component_parts(parameters(df)).orderBy("i").collect()


def test_known_values_fill_what_the_text_leaves_open(spark):
    df = spark.createDataFrame(
        [(None, None, 300, "Beton", "Kanalrohre"), ("Rohr", "Rohr DN 150 PP", 300, "Beton", None)],
        "description string, raw_text string, nominal_diameter_dn int, material string, product_category string",
    )
    a, b = sorted(parameters(df).collect(), key=lambda r: r["nominal_diameter_dn"], reverse=True)
    assert (a["nominal_diameter_dn"], a["material"], a["product_subcategory"]) == (300, "Beton", "Betonrohre")
    assert (b["nominal_diameter_dn"], b["material"], b["product_category"]) == (150, "PP", "Kanalrohre")


def test_words_are_whole(spark):
    a, b, c = read(spark, ("Klappe", "Klappe für Schuppen"), ("Betonschachtring", "DN 1.000"), ("Höhenschacht x", "Übergangsstück DN 200 x 150"))
    assert a["material"] is None and a["product_category"] is None
    assert b["product_subcategory"] == "Schachtring" and b["nominal_diameter_dn"] == 1000
    assert c["product_subcategory"] == "Übergangsstück" and c["secondary_nominal_diameter_dn"] == 150


def test_connection_hides_pipe_families(spark):
    a, b = read(spark, ("Sattelstück", "Anschluss an KG-Rohr"), ("Bogen", "Bogen für KG-Rohr"))
    assert a["system_family"] is None and b["system_family"] == "KG PVC-U"


def test_parts_of_a_gully(spark):
    [row] = read(spark, ("Ablaufkombination", "bestehend aus Aufsatz 500x500 D400, Schaftkonus, Boden, Eimer verzinkt"))
    assert [(p["component_name"], p["load_class"], p["material"]) for p in row["components"]] == [
        ("Aufsatz", "D400", None), ("Schaftkonus", None, None), ("Boden", "D400", None), ("Eimer", None, "Stahl")
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], "description string, raw_text string")
    assert component_parts(parameters(df)).count() == 0


def test_candidates(spark):
    open_ = spark.createDataFrame([(1, 10, 5, "1.1"), (2, 10, 6, "1.2"), (3, 11, 5, "1.1"), (4, 11, None, None)], "inquiry_id long, supplier_id long, project_id long, number string")
    hints = spark.createDataFrame(
        [(1, [4], [10], [], []), (2, None, [10], [], []), (3, [], [10], [5], []), (4, [], [], [], ["1.1"]), (5, [], [], [], []), (6, None, [11], [5], ["1.2"])],
        "mail_id long, inquiry_ids array<long>, supplier_ids array<long>, project_ids array<long>, numbers array<string>",
    )
    got = sorted((r["mail_id"], r["inquiry_id"]) for r in inquiries.candidates(open_, hints).collect())
    assert got == [(1, 4), (2, 1), (2, 2), (3, 1), (4, 1), (4, 3)]


def test_choice_is_careful(spark):
    kind = "mail_id long, inquiry_id long, number string, score int, by_supplier boolean, by_project boolean"
    rows = [
        (1, 1, "1.1", 40, False, True), (1, 2, "1.1", 10, False, True),  # several, no supplier
        (2, 1, "1.1", 36, True, False), (2, 2, "1.1", 35, True, False),  # a supplier decides
        (3, 1, None, 20, True, False), (3, 2, None, 17, True, False),  # lead too small
        (4, 1, None, 20, True, False), (4, 2, None, 15, True, False),
        (5, 9, None, 0, False, False),  # the sole candidate
        (6, 1, "1.1", 4, False, False), (6, 2, "1.2", 5, False, False),
    ]
    got = sorted((r["mail_id"], r["inquiry_id"]) for r in inquiries.chosen(spark.createDataFrame(rows, kind)).collect())
    assert got == [(2, 1), (4, 1), (5, 9), (6, 2)]


def test_offer_sources(spark):
    rows = [(1, 7, "A", "x", 1, 3), (1, 7, "A", "y", 2, 3), (1, 8, "B", "x", 1, 9), (1, 9, "C", "z", 3, 1)]
    df = spark.createDataFrame(rows, "position_id long, inquiry_id long, supplier string, artikel_id string, rank int, score int")
    assert [tuple(r) for r in inquiries.offer_sources(df).collect()] == [(1, "x", "A")]


def test_addresses_and_tags(spark):
    df = spark.createDataFrame([(" A@b.de ", "Original-Empfänger: C@d.de, e@f.com"), ("", None), (None, "x@y.com und z@y.com")], "s string, t string")
    got = [sorted(r[0]) for r in df.select(inquiries.addresses(F.col("s"), F.col("t"))).collect()]
    assert got == [["a@b.de", "c@d.de"], [], ["x@y.com", "z@y.com"]]
