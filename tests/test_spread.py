import pytest
from pyspark.sql import functions as F

from plotline import session
from plotline.functions import address as A
from plotline.functions import names as N
from plotline.spread import join_spread, numbered


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(90)], "i long, k string")
    unique = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3)], "k string, v int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, rows.join(unique, "k", how).select("i", "v").collect()), key=str)
        assert sorted(map(tuple, join_spread(rows, unique, "k", how, hot_rows=10).select("i", "v").collect()), key=str) == want
    assert join_spread(rows.limit(0), unique, "k").count() == 0


def test_numbers_within_ranges(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "i long").repartition(7)
    for at_once in (1000, 5):
        assert sorted((r["i"], r["_n"]) for r in numbered(rows, "i", at_once=at_once).collect()) == [(i, i) for i in range(101)]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_scratch_tables_go(spark):
    from pathlib import Path

    with session.scratch(spark):
        gone = session.written(spark.range(3), "gone")
        kept = session.written(spark.range(3), "kept", keep=True)
    assert not Path(gone.written_path).exists() and kept.count() == 3
    session.forget(kept)
    assert not Path(kept.written_path).exists()


def test_controls_and_accents(spark):
    rows = [("\t10\n", "\x01Oak\tSt ", " A ; \tb\n;A")]
    r = spark.createDataFrame(rows, "n string, s string, v string").select(A.normalize_housenumber(F.col("n")).alias("n"), N.street_key(F.col("s")).alias("s"), A.split_values(F.col("v")).alias("v")).first()
    assert tuple(r) == ("10", "oak street", ["A", "b"])
    keys = [r[0] for r in spark.createDataFrame([("Peña Ave",), ("PEÑA avenue",), ("Улица",), ("УЛИЦА",), (None,)], "s string").select(N.street_key(F.col("s"))).collect()]
    assert keys[0] == keys[1] == "pena avenue" and keys[2] == keys[3] == "улица" and keys[4] is None
