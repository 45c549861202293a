"""A town made from the integer keys of the test tables, as DataFrames and as SQL.

Lots of 20 m x 30 m in rows of 40, one address point per customer, rectangular
buildings from parts, existing addresses from suppliers, and one road per row. All
coordinates are integers or halves, so that both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.spread import joined_by_shuffle

BASES = ("Oak", "Maple", "Mt Hope", "Saint Paul", "N Hill", "2nd", "Mc-Kinley")
TYPES = (("Ave", "Avenue"), ("St", "Street"), ("Rd", "Road"), ("Ln", "Lane"), ("Blvd", "Boulevard"))
BUILDINGS = {"ECONOMY": "house", "LARGE": "detached", "MEDIUM": "apartments", "STANDARD": "yes", "SMALL": "garage", "PROMO": "roof"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few files, unless it is small, is dealt to all tasks by its first column."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    out = joined_by_shuffle(rows, path)
    if out is not rows and rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        out = joined_by_shuffle(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns[0]), path)
    return out


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _row(k: Column) -> Column:
    return F.floor(k / 40).cast("long")


def with_tags(df: DataFrame, t: Column, prefix: str = "", style: Column | None = None) -> DataFrame:
    """Address parts of the place numbered ``t``; its street's spelling varies by ``style``."""
    style = t % 5 if style is None else style
    base, short, long = _pick(BASES, _row(t) % 7), _pick(tuple(a for a, _ in TYPES), _row(t) % 5), _pick(tuple(b for _, b in TYPES), _row(t) % 5)
    with_short, with_long = F.concat(base, F.lit(" "), short), F.concat(base, F.lit(" "), long)
    street = F.when(style == 0, with_short).when(style == 1, with_long).when(style == 2, F.upper(with_short)).when(style == 3, F.lower(with_long)).otherwise(F.concat(with_short, F.lit(".")))
    unit = F.when(t % 11 == 0, F.concat(F.lit("Apt "), (t % 7).cast("string")))
    return df.withColumns({f"{prefix}number": (100 + 2 * (t % 40)).cast("string"), f"{prefix}street": street, f"{prefix}unit": unit, f"{prefix}place": F.lit(None).cast("string")})


def with_exact(df: DataFrame, prefix: str = "") -> DataFrame:
    parts = [F.coalesce(F.concat(F.lit(f"{p}="), F.col(prefix + p)), F.lit("")) for p in ("number", "street", "unit")]
    return df.withColumn(f"{prefix}exact", F.concat_ws(";", *parts))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cx, cy = (k % 40) * 20, _row(k) * 30
    return table(spark, sf_dir, "customer").where(k % 13 != 12).select(
        F.concat(F.lit("P"), k.cast("string")).alias("cell_id"),
        (cx - 10.0).alias("cxmin"), (cy - 15.0).alias("cymin"), (cx + 10.0).alias("cxmax"), (cy + 15.0).alias("cymax"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    rows = rows.withColumns({"x": ((k % 40) * 20 + (k * 7) % 23 - 11).cast("double"), "y": (_row(k) * 30 + (k * 13) % 37 - 18).cast("double")})
    t = F.when((k % 17 == 0) & (k > 0), k - 1).otherwise(k)
    return with_exact(with_tags(rows, t))


def buildings(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    j = F.col("p_partkey")
    lot = (j * 7) % F.col("n")
    cx, cy = (lot % 40) * 20 + j % 9 - 4, _row(lot) * 30 + j % 11 - 5
    hx, hy = 3 + F.col("p_size") % 7, 3 + F.col("p_size") % 9
    kind = F.create_map(*[F.lit(x) for pair in BUILDINGS.items() for x in pair])
    rows = table(spark, sf_dir, "part").where(j % 7 != 3).crossJoin(F.broadcast(n)).select(
        j.alias("bid"), lot.alias("lot"), F.element_at(kind, F.split("p_type", " ")[0]).alias("building"),
        (cx - hx).cast("double").alias("bxmin"), (cy - hy).cast("double").alias("bymin"), (cx + hx).cast("double").alias("bxmax"), (cy + hy).cast("double").alias("bymax"),
    )
    rows = with_exact(with_tags(rows.withColumn("factor", settings.building_weight(F.col("building"))), F.col("lot"), "b_"), "b_")
    has = F.col("bid") % 5 == 0
    return rows.withColumns({c: F.when(has, F.col(c)) for c in ("b_number", "b_street", "b_unit", "b_exact")}).drop("lot").transform(joined_by_shuffle, f"{sf_dir}/part.parquet")


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    s = F.col("eid")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("eid")).crossJoin(F.broadcast(n))
    rows = rows.withColumn("lot", (s * 37) % F.col("n")).drop("n")
    rows = rows.withColumns({"ex": ((F.col("lot") % 40) * 20 + s % 5 - 2).cast("double"), "ey": (_row(F.col("lot")) * 30 + 12).cast("double")})
    lot = F.col("lot")
    rows = with_tags(rows, lot, "e_", F.when(s % 6 == 1, 1).otherwise(lot % 5))
    rows = rows.withColumns({
        "e_unit": F.when(s % 6 == 2, F.lit("Apt 9")).otherwise(F.col("e_unit")),
        "e_street": F.when(s % 6 == 3, F.lit("Elsewhere Road")).when(s % 6 == 4, F.lit(None)).otherwise(F.col("e_street")),
        "e_number": F.when(s % 6 == 5, F.lit("7")).otherwise(F.col("e_number")),
    })
    return with_exact(rows, "e_").drop("lot").transform(joined_by_shuffle, f"{sf_dir}/supplier.parquet")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One horizontal road per row of lots, under it; every third is spelled in short."""
    r = F.col("row")
    rows = table(spark, sf_dir, "customer").select(_row(F.col("c_custkey")).alias("row")).distinct()
    base, short, long = _pick(BASES, r % 7), _pick(tuple(a for a, _ in TYPES), r % 5), _pick(tuple(b for _, b in TYPES), r % 5)
    return rows.select(
        r.alias("road_id"), F.concat(base, F.lit(" "), F.when(r % 3 == 0, short).otherwise(long)).alias("name"),
        F.lit(-10.0).alias("ax"), (r * 30 - 15.0).alias("ay"), F.lit(790.0).alias("bx"), (r * 30 - 15.0).alias("by"),
    )


# ---- the same town in SQL ----


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _tags_sql(t: str, style: str | None = None) -> str:
    """number, street and unit of the place numbered t, as three SQL expressions."""
    style = style or f"({t}) % 5"
    base = f"{_list(BASES)}[(({t}) // 40) % 7 + 1]"
    short, long = f"{_list(a for a, _ in TYPES)}[(({t}) // 40) % 5 + 1]", f"{_list(b for _, b in TYPES)}[(({t}) // 40) % 5 + 1]"
    street = (
        f"CASE {style} WHEN 0 THEN {base} || ' ' || {short} WHEN 1 THEN {base} || ' ' || {long} WHEN 2 THEN upper({base} || ' ' || {short}) "
        f"WHEN 3 THEN lower({base} || ' ' || {long}) ELSE {base} || ' ' || {short} || '.' END"
    )
    return f"CAST(100 + 2 * (({t}) % 40) AS VARCHAR)", street, f"CASE WHEN ({t}) % 11 = 0 THEN 'Apt ' || (({t}) % 7) END"


def _exact_sql(p: str = "") -> str:
    return " || ';' || ".join(f"coalesce('{c}=' || {p}{c}, '')" for c in ("number", "street", "unit"))


def town_sql() -> str:
    """CTEs n, cells, addresses, buildings, existing and roads."""
    t = "CASE WHEN c_custkey % 17 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END"
    a, b, e = _tags_sql(t), _tags_sql("lot"), _tags_sql("lot", "CASE WHEN s_suppkey % 6 = 1 THEN 1 ELSE lot % 5 END")
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUILDINGS.items())
    return f"""
n AS (SELECT count(*) AS n FROM customer),
cells AS (
  SELECT 'P' || c_custkey AS cell_id, (c_custkey % 40) * 20 - 10.0::DOUBLE AS cxmin, (c_custkey // 40) * 30 - 15.0::DOUBLE AS cymin,
    (c_custkey % 40) * 20 + 10.0::DOUBLE AS cxmax, (c_custkey // 40) * 30 + 15.0::DOUBLE AS cymax
  FROM customer WHERE c_custkey % 13 <> 12),
addresses0 AS (
  SELECT c_custkey AS id, CAST((c_custkey % 40) * 20 + (c_custkey * 7) % 23 - 11 AS DOUBLE) AS x,
    CAST((c_custkey // 40) * 30 + (c_custkey * 13) % 37 - 18 AS DOUBLE) AS y, {a[0]} AS number, {a[1]} AS street, {a[2]} AS unit
  FROM customer),
addresses AS (SELECT *, CAST(NULL AS VARCHAR) AS place, {_exact_sql()} AS exact FROM addresses0),
parts AS (
  SELECT p_partkey AS bid, (p_partkey * 7) % n AS lot, p_partkey % 9 - 4 AS ox, p_partkey % 11 - 5 AS oy, 3 + p_size % 7 AS hx, 3 + p_size % 9 AS hy,
    CASE string_split(p_type, ' ')[1] {kinds} END AS building
  FROM part, n WHERE p_partkey % 7 <> 3),
buildings0 AS (
  SELECT bid, building, CASE WHEN building = 'roof' THEN 0.02::DOUBLE WHEN building = 'garage' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS factor,
    CAST((lot % 40) * 20 + ox - hx AS DOUBLE) AS bxmin, CAST((lot // 40) * 30 + oy - hy AS DOUBLE) AS bymin,
    CAST((lot % 40) * 20 + ox + hx AS DOUBLE) AS bxmax, CAST((lot // 40) * 30 + oy + hy AS DOUBLE) AS bymax,
    CASE WHEN bid % 5 = 0 THEN {b[0]} END AS b_number, CASE WHEN bid % 5 = 0 THEN {b[1]} END AS b_street, CASE WHEN bid % 5 = 0 THEN {b[2]} END AS b_unit
  FROM parts),
buildings AS (SELECT *, CAST(NULL AS VARCHAR) AS b_place, CASE WHEN bid % 5 = 0 THEN {_exact_sql("b_").replace("'b_", "'")} END AS b_exact FROM buildings0),
sup AS (SELECT s_suppkey, (s_suppkey * 37) % n AS lot FROM supplier, n),
existing0 AS (
  SELECT s_suppkey AS eid, CAST((lot % 40) * 20 + s_suppkey % 5 - 2 AS DOUBLE) AS ex, CAST((lot // 40) * 30 + 12 AS DOUBLE) AS ey,
    CASE WHEN s_suppkey % 6 = 5 THEN '7' ELSE {e[0]} END AS e_number,
    CASE WHEN s_suppkey % 6 = 3 THEN 'Elsewhere Road' WHEN s_suppkey % 6 = 4 THEN NULL ELSE {e[1]} END AS e_street,
    CASE WHEN s_suppkey % 6 = 2 THEN 'Apt 9' ELSE {e[2]} END AS e_unit
  FROM sup),
existing AS (SELECT *, CAST(NULL AS VARCHAR) AS e_place, {_exact_sql("e_").replace("'e_", "'")} AS e_exact FROM existing0),
roads AS (
  SELECT r AS road_id, {_list(BASES)}[r % 7 + 1] || ' ' || CASE WHEN r % 3 = 0 THEN {_list(a for a, _ in TYPES)}[r % 5 + 1] ELSE {_list(b for _, b in TYPES)}[r % 5 + 1] END AS name,
    -10.0::DOUBLE AS ax, r * 30 - 15.0::DOUBLE AS ay, 790.0::DOUBLE AS bx, r * 30 - 15.0::DOUBLE AS b_y
  FROM (SELECT DISTINCT c_custkey // 40 AS r FROM customer))
"""
