"""Queries whose work must grow with the input only, on odd rows and on copies."""

import duckdb
from pyspark.sql import functions as F

from brickline.llm import simhash
from brickline.operators import tallies
from brickline.operators.extraction import quantities
from brickline.operators.lines import numbered
from brickline.operators.matching.pairs import paired
from brickline.plans import catalogue_queries as cat
from brickline.plans.registry import QUERIES


def written(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def oracle(folder, sql, columns):
    con = duckdb.connect()
    for t in ("supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


def match_tables(spark, copies):
    """Products with unknown, equal and rising prices, unknown names, in copies; positions of which one stands twice."""
    p = spark.range(900 * copies).selectExpr(
        "id as p_partkey", "id % 900 as q").selectExpr(
        "p_partkey", "case when q % 13 = 0 then null else concat('n', q % 4) end as p_name", "concat('Brand#', 1 + q % 3) as p_brand",
        "element_at(array('ECONOMY', 'SMALL'), cast(1 + q % 2 as int)) as p_type", "cast(case when q % 31 = 0 then null else 1 + q % 9 end as int) as p_size",
        "cast(case when q % 7 = 0 then null else 900 - q % 60 end as double) as p_retailprice",
    )
    s = spark.range(40).selectExpr("id as s_suppkey", "cast(case when id % 9 = 0 then null else 840 + id * 2 end as double) as s_acctbal")
    return {"part": p, "supplier": s.unionByName(s.where("s_suppkey = 7"))}


def test_top_matches_on_odd_rows(spark, tmp_path):
    folder = written(spark, tmp_path, **match_tables(spark, 2))
    for name in ("scored_match_topk", "breakdown_arrays"):
        # the repeated position's own rows tie in the SQL's order
        df = cat.QUERIES[name](spark, folder).where("s_suppkey <> 7")
        got = sorted((tuple(r) for r in df.collect()), key=str)
        assert got == oracle(folder, f"SELECT * FROM ({cat.ORACLE[name]}) WHERE s_suppkey <> 7", df.columns)


def test_copies_do_not_multiply_what_positions_meet(spark):
    one, many = (
        cat.undominated(match_tables(spark, n)["part"], ["p_type", "p_size", "p_name", "p_brand"], [F.col("p_retailprice")]).count() for n in (1, 5)
    )
    assert one == many


def test_pairs_are_dealt_over_many_partitions(spark, tmp_path):
    folder = written(spark, tmp_path, **match_tables(spark, 1))
    assert cat.scored_pairs(cat.Tables(spark, folder)).rdd.getNumPartitions() == cat.PAIR_PARTS


def test_rows_of_one_file_are_dealt_over_the_cores(spark, tmp_path):
    folder = written(spark, tmp_path, part=match_tables(spark, 1)["part"])
    for name in ("text_parameters", "text_components", "match_product_features", "enriched_articles", "display_descriptions", "service_descriptions"):
        assert QUERIES[name](spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_blocks_of_whole_texts_are_those_of_lines(spark):
    texts = ["1.1 A\nx\n\n 01.02. B \n1.3\n1.4 C\r\ny", "vor\n2.1 A", "nichts", "", None, "3.1  \n3.2 \tX", "1.1 A\n1.1 A\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    by_line = quantities.heading_blocks(numbered(docs, "doc", "text"), "doc")
    by_text = quantities.text_blocks(docs, "doc", "text")
    assert by_text.columns == by_line.columns
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_line.collect()))
    assert "Window" not in by_text._jdf.queryExecution().toString() and "Exchange" not in by_text._jdf.queryExecution().toString()


def test_simhash_broadcasts_nothing_that_grows(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a b c d ', id % 50, ' e f g ', id % 50) as text")
    df = simhash.near_duplicates(docs)
    assert df.count() == 400
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_category_is_dealt_over_tasks(spark):
    pos = spark.createDataFrame([("kanalrohre", "", True, i) for i in range(5)], "f_category string, f_subcategory string, f_has_category boolean, s int")
    goods = spark.range(400).selectExpr("id", "'kanalrohre' as g_category", "'' as g_subcategory", "'rohr' as g_type")
    sizes = [r["count"] for r in paired(pos, goods).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1200


def test_suppliers_to_ask_on_odd_rows_without_moving_pairs(spark):
    kinds = {i: [["Rohre"], ["rohre", "ROHRE", "Rinnen"], ["Rinnen", None], [], None][i % 5] for i in range(400)}
    suppliers = [*kinds.items(), (3, ["Rohre"]), (None, ["Rohre"]), (7, ["rinnen"])]
    positions = [("p1", 1, "ROHRE"), ("p1", 1, "rohre"), ("p1", None, "rohre"), ("p2", None, "Rinnen"), (None, 1, "rinnen"), ("p3", 2, None), ("p4", 2, "neu")]
    asked = [(i, p, project, status) for i in [*range(0, 400, 3), 9999, None] for p, project, status in (
        ("p1", 1, "offen"), ("p2", None, "angefragt"), (None, 1, "offen"), ("p1", None, "abgelehnt"), ("p2", 5, "offen"), ("p3", 2, "offen"))] * 2
    got = tallies.suppliers_to_ask(
        spark.createDataFrame(positions, "position_id string, project_id long, category string"), spark.createDataFrame(suppliers, "supplier_id long, categories array<string>"),
        spark.createDataFrame(asked, "supplier_id long, position_id string, project_id long, status string"),
    )
    barred = {(p, project, i) for i, p, project, status in asked if status != "abgelehnt" and None not in (p, i)}
    want = [
        (p, i) for p, project, category in positions for i, ks in suppliers
        if category and category.lower() in {k.lower() for k in ks or [] if k} and (p, project, i) not in barred
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.index("Generate inline") < plan.index("Join ")


def test_pairs_with_confidence_do_not_sort_products(spark, tmp_path):
    folder = written(spark, tmp_path, **match_tables(spark, 2))
    df = cat.QUERIES["confidence_label"](spark, folder)
    assert sorted((tuple(r) for r in df.collect()), key=str) == oracle(folder, cat.ORACLE["confidence_label"], df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
