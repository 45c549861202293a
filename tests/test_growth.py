"""Findings of round 3: work that must not grow faster than the tables."""

from pyspark.sql import functions as F

from plotline.sources import catalog as C


def test_datasets_pair_no_coverage_with_every_entry_of_its_map(spark):
    # one map: pairs of coverages and entries would be 4 * 10^10
    found = spark.range(200_000).select(F.lit(1).alias("view"), (F.col("id") + 5).alias("place"), F.lit(7).alias("map"))
    entries = spark.range(200_000).select(F.lit(7).alias("map"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("city").alias("level"), (200_000 - F.col("id")).alias("seq"))
    rows = C.datasets_for(found, entries)
    # both sides of the join are reduced before it
    assert rows._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].count("Aggregate") >= 2
    assert sorted((r["source"], r["seq"], r["place"]) for r in rows.collect()) == [("s0", 2, 1), ("s1", 1, 2)]


def test_large_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    from plotline.spread import BROADCAST_BYTES, joined_by_shuffle, stored

    # Spark guesses 10 bytes of file a row, and would broadcast an array of a hundred
    wide = stored(spark.range(200_000).withColumn("many", F.array_repeat(F.col("id"), 100)), "wide")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(spark.range(10**9).join(wide.withColumn("id", F.col("id") * 2), "id"))
    few = stored(spark.range(10), "few")
    assert joined_by_shuffle(few, few.written_path) is few and BROADCAST_BYTES > 1000
    assert "BroadcastHashJoin" in plan(spark.range(10**9).join(F.broadcast(wide), "id"))  # what is asked for holds


def test_each_overlap_is_computed_once(spark, tiny):
    from plotline.operators import match as M
    from plotline.plans.polygon_queries import TURNED, _turned_boxes
    from plotline.plans import town

    cells, buildings = _turned_boxes(town.cells(spark, tiny), "c"), _turned_boxes(town.buildings(spark, tiny, TURNED), "b")
    pairs = M.building_cells(buildings, cells, cells.select("cell_id"), TURNED)
    # the shapes are read by the join alone, not again for the home parcels
    assert "brings" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() > 0


def test_few_points_at_the_edge_are_not_compared_with_all_sites(spark, monkeypatch):
    from plotline.operators import spacing as P

    # a strip of sites: those at its ends find too few within the first radius
    sites = spark.range(3_000).select(F.col("id").alias("sid"), (F.col("id") * 10.0).alias("sx"), F.lit(0.0).alias("sy"))
    points = sites.select(F.col("sid").alias("pid"), F.col("sx").alias("px"), F.col("sy").alias("py"))
    monkeypatch.setattr(P, "FAR_PAIRS", 10_000)
    near = P.nearest_sites(points, sites, 10, 55.0)
    assert "BroadcastNestedLoop" not in near._jdf.queryExecution().executedPlan().toString()
    rows = near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).collect()
    assert len(rows) == 3_000 and all(r["n"] == 10 and r["d"] == max(50.0, 10.0 * (9 - min(r["pid"], 2_999 - r["pid"]))) for r in rows)


def test_nodes_of_buildings_are_not_broadcast(spark):
    from plotline.plans import polygon_queries

    nodes, ways, _, _ = polygon_queries._ways(spark, "/root/testdata/sf0.1")
    each = ways.select(F.explode("nodes").alias("node_id"))
    plan = each.join(nodes, "node_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_few_bytes_of_long_work_are_dealt_to_many_tasks(spark):
    from plotline.operators import chains as C
    from plotline.operators import spacing as P

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (9, 0), (9, 9))])
    cells = spark.range(100).select(F.col("id").alias("sid"), ring.alias("ring"))
    sites = spark.range(100).select(F.col("id").alias("sid"), F.lit(4.0).alias("sx"), F.lit(1.0).alias("sy"))
    roads = spark.createDataFrame([(-5.0, 2.0, 20.0, 2.0)], "ax double, ay double, bx double, by double")
    ways = spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("way"), F.array(F.col("id"), F.col("id") + 1).alias("nodes"), F.array(F.lit(0.0), F.lit(9.0)).alias("xs"), F.array(F.lit(0.0), F.lit(0.0)).alias("ys"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
    try:
        for out in (P.road_clipped(cells, sites, roads), C.road_chains(ways)):
            assert len({r["p"] for r in out.select(F.spark_partition_id().alias("p")).collect()}) >= tasks
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_task_holds_few_tiles_and_their_features_one_by_one(spark, tiny):
    from plotline.plans import reader_queries
    from plotline.sources import tiles as T

    data = reader_queries._tile([5, 6], [(1, 2), (3, 4)])
    (name, extent, found), = T.layers(data)
    assert next(found) == (1, {"id": "5"}, [9, 2, 4]) and next(found)[1] == {"id": "6"}
    # all tiles of the table came in one task; here most of the few tiles have a task, and so a file, of their own
    rows = reader_queries.vector_tiles(spark, tiny)
    assert len(rows.inputFiles()) > 1 and rows.count() == 150


def test_the_match_broadcasts_no_table_of_the_town(spark):
    from plotline.operators import match as M
    from plotline.plans import town
    from plotline.plans.match_queries import SETTINGS

    sf_dir = "/root/testdata/sf0.1"
    cells, buildings, existing = town.cells(spark, sf_dir), town.buildings(spark, sf_dir, SETTINGS), town.existing(spark, sf_dir)
    points = town.addresses(spark, sf_dir)
    for rows in (M.assign_cells(points, cells, SETTINGS), M.existing_in_cells(existing, cells), points.join(buildings, points["id"] == buildings["bid"])):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_no_document_of_an_extract_holds_most_of_a_table(spark):
    import os
    from urllib.parse import urlparse

    from plotline.plans import reader_queries

    sizes = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0"}
    was = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)  # many splits, as of a large file, but all rows lie in the one that holds the row group
        rows = reader_queries.map_extract(spark, "/root/testdata/sf0.1")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    bytes_each = [os.path.getsize(urlparse(f).path) for f in rows.inputFiles()]
    assert sum(bytes_each) > 1_000_000 and max(bytes_each) * 2 < sum(bytes_each)


def test_shapes_of_relations_are_put_together_once_and_many_at_once(spark, tiny):
    from plotline.operators import rings as R
    from plotline.plans import polygon_queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # Python was called for each relation, and in parcels_of_map twice
    assert "InPandas" not in plan(polygon_queries.parcels_of_map(spark, tiny)) + plan(polygon_queries.assembled_polygons(spark, tiny))
    nodes = spark.createDataFrame([(n, float(n % 7), float(n // 7)) for n in range(1, 30)], "node_id long, x double, y double")
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 9, 3]), (3, [4, 5, 6, 4]), (4, [7, 8, 99, 7]), (5, [10, 11, 12, 10]), (6, [20, 21]), (7, [])], "way_id long, nodes array<long>")
    roles = [
        (1, 2, 1, "outer"), (1, 1, 2, None), (1, 3, 3, "inner"), (1, 4, 5, "label"),  # in the order of seq, not of their numbers
        (2, 1, 3, "inner"),  # no outer ring
        (3, 1, 4, "outer"), (3, 2, 5, "outer"),  # a way without one of its nodes is not there
        (4, 1, 6, "outer"), (5, 1, 3, "outer"), (5, None, 5, ""),
    ]
    members = spark.createDataFrame(roles, "rel_id long, seq int, way_id long, role string")
    points = R.way_points(ways, nodes)
    assert sorted(r["way_id"] for r in points.collect()) == [1, 2, 3, 5, 6]
    found = {r["rel_id"]: [[int(p["x"] + 7 * p["y"]) for p in ring] for ring in r["rings"]] for r in R.multipolygons(members, points).collect()}
    assert found == {1: [[1, 9, 3, 2, 1], [4, 5, 6, 4]], 3: [[10, 11, 12, 10]], 5: [[4, 5, 6, 4], [10, 11, 12, 10]]}
