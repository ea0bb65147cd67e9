"""The offer export and the log of inquiries on small tables with nulls, repeats and no rows."""

import pytest

from brickline.operators import export, statuslog

POSITIONS = "project long, place int, position_id string, number string, description string, quantity double, unit string, position_type string, billable boolean, components array<string>"
SELECTIONS = "project long, place int, position_id string, articles array<string>, keys array<string>"
TERMS = "project long, assignment_key string, custom_price double, is_alternative boolean, supplier_open boolean"
INQUIRIES = "project long, position_id string, supplier_id long, number string, status string, product_description string, updated_at int"
PRODUCTS = "artikel_id string, name string, maker string, unit string, list_price double, price_10 double, price_50 double, price_100 double"
OFFERS = "offer_id long, article_number string, article_name string, unit string, unit_price double, supplier string"
EVENTS = "seq long, project long, kind string, inquiry_id long, position_id long, supplier_id long, number string, status string, notes string"


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    positions = make([
        (1, 1, "a", "1.1", "Rohr", 12.0, "", "material", True, None), (1, 2, "b", "1.2", "Deckel", None, None, None, True, None),
        (1, 3, "s", "1.3", "Bauleitung", 1.0, None, "dienstleistung", True, None), (2, 1, "a", "2.1", "Ring", 0.0, "m", "material", True, ["Ring", "Fuss"]),
        (3, 1, "c", "3.1", "nichts", 1.0, None, "material", False, None), (4, 1, "d", "4.1", "x", 1.0, None, "material", True, None),
    ], POSITIONS)
    selections = make([
        (1, 5, "a", ["P1", "SO-7", "SO-x"], ["k1"]), (1, 4, "b", ["P2", "P9"], None), (1, 6, "gone", ["P1"], None),
        (2, 1, "a", ["P1", "P1"], ["a::component::Ring", "x"]), (4, 1, "d", None, None),
    ], SELECTIONS)
    terms = make([(1, "k1", 1.0, True, None), (1, "b::0", 99.5, None, True)], TERMS)
    inquiries = make([
        (1, "a", 1, "1.1", "angebot_erhalten", "alter Text", 1), (1, "a", 1, "1.1", "angebot_erhalten", "neuer Text", 2), (1, "a", 2, None, "angebot_erhalten", None, 3),
        (1, "b", 1, None, "offen", None, 1), (1, "b", 1, None, "angebot_erhalten", "", 4), (4, None, 1, None, "offen", None, 1), (4, None, 2, None, "angefragt", None, 1),
    ], INQUIRIES)
    products = make([("P1", "Rohr", "M", "Stk", 10.0, 8.5, None, None), ("P2", "Deckel", None, "", None, None, None, None)], PRODUCTS)
    offers = make([(7, "", "Ware", "kg", None, None)], OFFERS)
    return positions, selections, terms, inquiries, products, offers


def test_offer_export(tables):
    positions, selections, terms, inquiries, products, offers = tables
    found = export.resolved(export.assignments(positions, selections, terms, inquiries), products, offers)
    lines = {(r.project, r.position_id, r.nth): r for r in export.export_lines(found).collect()}
    assert set(lines) == {(1, "a", 0), (1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "a", 1)}
    first, second, third = lines[1, "a", 0], lines[1, "a", 1], lines[1, "b", 0]
    assert (first.description, first.unit, float(first.price_net), float(first.total_net), first.is_alternative, first.is_additional) == ("neuer Text", "Stk", 8.5, 102.0, True, False)
    assert (second.artikel_id, second.maker, second.unit, float(second.price_net), second.is_additional) == ("SO-7", "Lieferant", "kg", 0.0, True)
    assert (third.unit, third.quantity, float(third.price_net), third.supplier_open) == ("Stk", 1.0, 99.5, True) and lines[2, "a", 0].quantity == 1.0
    said = export.export_warnings(positions, selections, found).orderBy("project", "side", "place", "nth", "at").collect()
    assert [(r.project, r.position_id, r.reason) for r in said] == [
        (1, "b", "Kein Preis verfügbar für P2, 0 EUR verwendet"), (1, "b", "Menge nicht erkannt, Standard 1 verwendet"), (1, "b", "Artikel P9 nicht in Datenbank gefunden"),
        (1, "a", "VK unter EK nicht erlaubt, EK verwendet"), (1, "a", "Lieferantenangebot SO-x nicht gefunden"), (3, "c", "Kein Artikel zugeordnet"), (4, "d", "Kein Artikel zugeordnet"),
    ]
    gate = {r.project: (r.code, r.detail) for r in export.gate(positions, selections, inquiries).collect()}
    assert gate == {
        1: (400, "Angebot gesperrt: Zuordnungsdaten für Position 1.1 sind unvollständig."), 2: (400, "Angebot gesperrt: Komponenten für Position 2.1 sind nicht vollständig zugeordnet."),
        4: (409, "Angebot gesperrt: 2 offene Lieferantenanfrage(n) vorhanden."),
    }
    out = {r.project: r for r in export.exported(positions, selections.where("position_id <> 'a' or project <> 1"), inquiries, found.where("project <> 1 or position_id <> 'a'")).collect()}
    assert out[3].detail == export.NOTHING and out[2].n_lines is None and out[1].code == 400


def test_export_joins_assignments_once_by_odd_ids(spark):
    make = spark.createDataFrame
    ids = ["SO-7", "SO-007", "SO-", "SO-x", "SO-99999999999999999999", "SO-9", None, "P1", "p1", ""]
    positions = make([(1, 1, "a", "1.1", "Rohr", 2.0, "m", "material", True, None)], POSITIONS)
    selections = make([(1, 1, "a", ids, None), (1, 2, None, ["P1"], None), (2, 1, "a", ["P1"], None)], SELECTIONS)
    products = make([("P1", "Rohr", "M", "Stk", 10.0, None, None, None), ("SO-9", "kein Angebot", "M", "Stk", 1.0, None, None, None), (None, "n", "M", None, 1.0, None, None, None)], PRODUCTS)
    offers = make([(7, "N7", "Ware", "kg", 3.0, "S"), (None, "N0", "nichts", "kg", 1.0, "S")], OFFERS)
    found = export.resolved(export.assignments(positions, selections, make([], TERMS), make([], INQUIRIES)), products, offers)
    got = {r.nth: (r.artikel_id, r.name, r.is_line, len(r.warnings)) for r in found.collect()}
    assert got == {
        0: ("N7", "Ware", True, 0), 1: ("N7", "Ware", True, 0), **{i: (ids[i], None, False, 1) for i in (2, 3, 4, 5, 8, 9)}, 7: ("P1", "Rohr", True, 0),
    }
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") == 4


def test_export_of_empty_tables(tables):
    none = [t.limit(0) for t in tables]
    found = export.resolved(export.assignments(*none[:4]), *none[4:])
    assert found.count() == 0 and export.exported(none[0], none[1], none[3], found).count() == 0 and export.gate(none[0], none[1], none[3]).count() == 0


def test_status_log(spark):
    log = spark.createDataFrame([
        (1, 1, "create", 10, 5, 1, None, "offen", None), (2, 1, "create", 11, 5, 1, None, "offen", None), (3, 1, "create", 12, 5, 2, None, "angefragt", None),
        (4, 1, "status", 10, None, None, None, "angefragt", "erste"), (5, 1, "status", 10, None, None, None, "falsch", "nie"), (6, 1, "content", 99, None, None, None, None, "x"),
        (7, 1, "offer", 10, None, None, None, None, None), (8, 1, "create", 13, 5, 1, None, None, None), (9, 1, "cleanup", None, 5, None, None, None, None),
        (10, 2, "create", 20, None, 1, None, "offen", None), (11, 2, "create", 21, None, 1, None, "offen", None), (12, 3, "open", None, None, None, None, None, None),
        (13, 3, "export", None, None, None, None, None, None), (14, None, "open", None, None, None, None, None, None), (15, 4, "offer", 77, None, None, None, None, None),
        (16, 1, "status", 13, None, None, None, "offen", None),
    ], EVENTS)
    state = statuslog.folded(log)
    assert sorted(tuple(r) for r in statuslog.refused(log, state).collect()) == [(2, 409), (5, 400), (6, 404), (16, 404)]
    assert sorted((r.inquiry_id, r.status, r.notes) for r in statuslog.inquiries(log, state).collect()) == [(10, "angebot_erhalten", "erste"), (12, "angefragt", None), (20, "offen", None), (21, "offen", None)]
    assert sorted(tuple(r) for r in statuslog.project_states(log, state).collect()) == [(1, 2, 1, "anfrage_offen"), (2, 2, 2, "anfrage_offen"), (3, 0, 0, "gerechnet"), (4, 0, 0, "neu")]
    assert statuslog.project_states(log.limit(0), statuslog.folded(log.limit(0))).count() == 0


def test_tender_refresh(spark):
    from brickline.operators import tenders

    stored = spark.createDataFrame([("a", "alt", "Bonn", 50.7, 7.1, 20, "ted"), ("b", "weit", "Ulm", 48.4, 10.0, 90, "ted"), ("c", "ohne Ort", None, None, None, 50, "nrw")],
                                   "external_id string, title string, city string, lat double, lng double, relevance int, source string")
    notices = spark.createDataFrame([
        (1, "a", "neu", "Bonn", 11, "ted"), (2, "d", "erste", " KÖLN ", 3, "nrw"), (3, "d", "zweite", "Köln", 40, "ted"), (4, "e", "schwach", "Bonn", 9, "ted"),
        (5, "f", "weit", "Ulm", 99, "nrw"), (6, "g", None, None, 99, "ted"), (7, "h", "Dorf", "Dorf", 50, "ted"), (8, "h", "Dorf 2", "Dorf", 60, "ted"),
    ], "n int, external_id string, title string, city string, relevance int, source string")
    places = spark.createDataFrame([("bonn", 50.73, 7.1)], "place string, lat double, lng double")
    gazetteer = spark.createDataFrame([("Bonn", 0.0, 0.0), ("Köln", 50.94, 6.96), ("Ulm", 48.4, 10.0), ("Nirgends", None, None)], "city string, lat double, lng double")
    ask = lambda t, n: tenders.refresh(t, n, places, gazetteer, "n", ("nrw", "ted"), (50.7, 7.1), 50.0, ("dorf",))
    got = ask(stored, notices)
    assert sorted(tuple(r) for r in got.tenders.select("external_id", "title", "relevance").collect()) == [("a", "alt", 11), ("d", "erste", 40), ("h", "Dorf", 60)]
    assert [tuple(r) for r in got.counts.collect()] == [("nrw", 1, 1, 3, 2), ("ted", 4, 1, 3, 2), (None, 5, 2, 3, 2)]
    assert {r.place for r in got.places.collect()} == {"bonn", "köln", "ulm"}
    none = ask(stored.limit(0), notices.limit(0))
    assert none.tenders.count() == 0 and none.counts.where("source is null").first().total == 0
