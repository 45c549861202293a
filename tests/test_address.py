import pytest
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions import licence as L
from plotline.functions import web as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("N. Main St.", "north main street"), ("  Oak-Hill  AVE ", "oak hill avenue"), (None, ""), ("", ""), ("é St", "street"), ("2nd Pl", "2nd place"), ("Mt Hope Xing", "mount hope crossing")],
)
def test_normal_streets(spark, given, wanted):
    assert one(spark, A.normalize_street(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Unit #5", "5"), ("# unit 5", "unit 5"), ("APT. 2B", "2b"), ("Suite  9", "9"), (None, ""), ("unit", "unit")])
def test_normal_units(spark, given, wanted):
    assert one(spark, A.normalize_unit(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("N 35TH AVE", "North 35th Avenue"), ("ST MARYS CT", "Saint Marys Court"), ("MAIN ST NW", "Main Street Northwest"), ("AVE", "Ave"), ("MCDONALD RD", "McDonald Road"), ("O'NEIL LN", "O'Neil Lane"), ("E", "E"), ("MT HOPE-WELL DR", "Mount Hope-Well Drive")],
)
def test_expanded_streets(spark, given, wanted):
    assert one(spark, A.expand_street(F.lit(given))) == wanted


def parts(spark, number, street, unit=None, place=None):
    exact = f"{number};{street};{unit}"
    return spark.createDataFrame([(number, street, unit, place, exact)], "number string, street string, unit string, place string, exact string")


@pytest.mark.parametrize(
    ("theirs", "wanted"),
    [
        (("10", "Oak Ave"), "IDENTICAL"), (("10", "oak ave"), "IDENTICAL"), (("10", "Oak Avenue"), "STREET_VARIANT"), (("10", None), "PARTIAL"), (("10", "Oak Ave", "2"), "UNIT_DIFF"),
        (("10", "Elm St"), "STREET_DIFF"), (("12", "Oak Ave"), None), (("10", "Elm St", "2"), None), (("10", None, None, "Village"), "STREET_VARIANT"),
    ],
)
def test_kinds_of_match(spark, theirs, wanted):
    a = A.with_normal(parts(spark, "10", "Oak Ave"))
    b = A.with_normal(parts(spark, *theirs))
    b = b.toDF(*[f"b_{c}" for c in b.columns])
    names = ("street", "place", "exact", "nn", "ns", "nu")
    kind = A.compare({c: F.col(c) for c in names}, {c: F.col(f"b_{c}") for c in names})
    assert a.crossJoin(b).select(kind.alias("k")).first()["k"] == wanted


def test_lists_and_sources(spark):
    assert one(spark, A.split_values(F.lit(" a ;b;; a;B  c"))) == ["a", "b", "B c"]
    assert one(spark, A.merge_sources(F.lit("Survey; county"), F.lit("COUNTY;GPS"))) == "Survey; county; GPS"
    assert one(spark, A.merge_sources(F.lit(None).cast("string"), F.lit("x"))) == "x"


@pytest.mark.parametrize(
    ("text", "credit", "alike", "wanted"),
    [("Public Domain", None, None, "COMPATIBLE"), ("CC BY-NC", None, None, "NOT_COMPATIBLE"), ("ODbL", None, True, "COMPATIBLE"), ("x", None, True, "NOT_COMPATIBLE"), ("", True, None, "NEEDS_WAIVER"), ("unknown", None, None, "UNKNOWN"),
     ("public domain; indemnify us", None, None, "CHECK_TERMS"), ("CC BY 4.0", None, None, "NEEDS_WAIVER"), ("terms", None, None, "CHECK_TERMS")],
)
def test_licences(spark, text, credit, alike, wanted):
    assert one(spark, L.licence_status(F.lit(text), F.lit(None).cast("string"), F.lit(credit).cast("boolean"), F.lit(alike).cast("boolean"))) == wanted


def test_service_answers(spark):
    assert one(spark, W.service_error(F.lit('{"error": {"code": 400, "message": "Bad   thing"}}'))) == "Bad thing"
    assert one(spark, W.service_error(F.lit("<html><title> Not found </title></html>"))) == "Not found"
    assert one(spark, W.service_error(F.lit('{"features": []}'))) is None
    assert one(spark, W.transfer_limited(F.lit('{"properties": {"exceededTransferLimit": true}}'))) is True
    box = tuple(F.lit(v) for v in (0.0, 0.0, 0.1, 0.3))
    assert one(spark, W.area_too_large(*box)) is True
