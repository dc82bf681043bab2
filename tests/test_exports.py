"""Numbers in exports, against C's formatting."""

from matforge.operators import analytics, registry

from .test_registry import AT


def test_confidence_is_rounded_from_the_number_itself(spark):
    """Halves in decimal that no double meets, exact halves, signs and a missing one."""
    values = [0.285, 0.615, 0.125, 0.375, 0.235, -0.001, 0.005, 1.005, 12.0, None]
    reg = spark.createDataFrame([(f"CNMC-{i:06d}", f"d{i}", v, "auto_linked", AT) for i, v in enumerate(values)], registry.REGISTRY)
    mapping = spark.createDataFrame([(i, f"CNMC-{i:06d}", "A", f"c{i}") for i in range(len(values))], registry.MAPPING)
    catalog = spark.createDataFrame([], "source_cpse string, item_id string, raw_description string, clean_description string, unit_of_measure string, category string, category_hint string, specs struct<category:string,size:string,pressure_rating:string,material_grade:string,material_family:string,facing:string,schedule:string,power_hp:string,speed_rpm:string>")
    got = [r["CONFIDENCE_SCORE"] for r in analytics.sap_export(reg, mapping, catalog).collect()]
    assert got == [None if v is None else "%.2f" % v for v in values]
