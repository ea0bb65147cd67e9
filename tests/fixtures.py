"""Small catalogue and positions; unnamed columns are null."""

from pyspark.sql import types as T

PRODUCT = """id long, artikel_id string, hersteller string, artikelname string, artikelbeschreibung string, kategorie string,
unterkategorie string, werkstoff string, nennweite_dn int, nennweite_od int, laenge_mm int, breite_mm int, hoehe_mm int,
belastungsklasse string, steifigkeitsklasse_sn string, norm_primaer string, system_familie string, verbindungstyp string,
dichtungstyp string, kompatible_dn_anschluss string, kompatible_systeme string, einsatzbereich string,
vk_listenpreis_netto double, staffelpreis_ab_10 double, staffelpreis_ab_50 double, staffelpreis_ab_100 double,
waehrung string, lager_gesamt int, lieferant_1_lieferzeit_tage int, status string"""
COMPONENT = """struct<component_name:string,description:string,product_category:string,product_subcategory:string,
nominal_diameter_dn:int,secondary_nominal_diameter_dn:int,quantity:double,material:string,system_family:string,
load_class:string,dimensions:string,connection_type:string,installation_area:string>"""
POSITION = f"""position_id string, ordnungszahl string, description string, raw_text string, quantity double, unit string,
billable boolean, position_type string, product_category string, product_subcategory string, material string,
nominal_diameter_dn int, secondary_nominal_diameter_dn int, load_class string, norm string, dimensions string,
reference_product string, installation_area string, stiffness_class_sn int, sortiment_relevant boolean,
pipe_length_mm int, angle_deg int, application_area string, system_family string, connection_type string,
seal_type string, compatible_systems array<string>, components array<{COMPONENT}>"""


def rows(spark, schema, dicts):
    kind = T.StructType.fromDDL(schema.replace("\n", " "))
    return spark.createDataFrame([tuple(d.get(f.name) for f in kind) for d in dicts], kind)


def pipe(id, name="KG-Rohr DN160 SN4", **more):
    return {
        "id": id, "artikel_id": f"A{id}", "hersteller": "M", "artikelname": name, "kategorie": "Kanalrohre", "unterkategorie": "KG-Rohre",
        "werkstoff": "PVC-U", "nennweite_dn": 160, "steifigkeitsklasse_sn": "SN4", "norm_primaer": "DIN EN 1401", "laenge_mm": 1000,
        "lager_gesamt": 50, "lieferant_1_lieferzeit_tage": 3, "vk_listenpreis_netto": 10.0, "staffelpreis_ab_10": 9.0, "status": "aktiv", **more,
    }


GOLDEN = {
    "position_id": "p1", "description": "KG-Rohr DN 150 SN4", "raw_text": "KG-Rohr DN 150 SN4 liefern", "quantity": 12.0, "position_type": "material",
    "product_category": "Kanalrohre", "product_subcategory": "KG-Rohre", "material": "PVC-U", "nominal_diameter_dn": 150,
    "stiffness_class_sn": 4, "norm": "DIN EN 1401",
}
