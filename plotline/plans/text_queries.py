"""Queries over address text, licences, sources and lineage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions import licence as L
from plotline.functions.address import DIRECTIONALS, EXPANSIONS
from plotline.plans import sqltext as S
from plotline.plans import town
from plotline.plans.town import table, town_sql


def normalize_street(spark, sf_dir) -> DataFrame:
    return town.addresses(spark, sf_dir).select("id", A.normalize_street(F.col("street")).alias("street"))


def normalize_unit(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("Unit ", "APT ", "apt. ", "Suite ", "ste ", "#", "Unit #", "# unit ")])
    text = F.concat(F.element_at(words, (k % 8 + 1).cast("int")), (k % 100).cast("string"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), A.normalize_unit(text).alias("unit"))


def address_keys(spark, sf_dir) -> DataFrame:
    a = town.addresses(spark, sf_dir)
    return a.select("id", A.address_key(F.col("number"), F.col("street"), F.col("unit")).alias("key"), A.address_key(F.col("number"), F.col("street")).alias("without_unit"))


def _tags(df: DataFrame, p: str) -> DataFrame:
    """The address parts as a tag map, missing ones left out."""
    pairs = F.create_map(F.lit("addr:housenumber"), F.col(p + "number"), F.lit("addr:street"), F.col(p + "street"), F.lit("addr:unit"), F.col(p + "unit"), F.lit("building"), F.lit("yes"))
    return df.withColumn(p + "tags", F.map_filter(pairs, lambda k, v: v.isNotNull()))


def exact_keys(spark, sf_dir) -> DataFrame:
    return _tags(town.addresses(spark, sf_dir), "").select("id", F.replace(A.exact_key(F.col("tags")), F.lit("\u0001"), F.lit(";")).alias("key"))


def _lots(spark, sf_dir) -> DataFrame:
    """Existing addresses beside the address point whose number and street they were made from."""
    e = A.with_normal(town.existing(spark, sf_dir), "e_")
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    e = e.crossJoin(F.broadcast(n)).withColumn("lot", (F.col("eid") * 37) % F.col("n")).drop("n")
    return _tags(_tags(e, "e_").join(A.with_normal(town.addresses(spark, sf_dir)), F.col("lot") == F.col("id")), "")


def conflicting_keys(spark, sf_dir) -> DataFrame:
    return _lots(spark, sf_dir).select("eid", F.array_join(A.conflicting_keys(F.col("tags"), F.col("e_tags")), ",").alias("keys"))


def fill_missing_tags(spark, sf_dir) -> DataFrame:
    filled = A.fill_tags(F.col("tags"), F.col("e_tags"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(filled), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _lots(spark, sf_dir).select("eid", shown.alias("tags"))


def expand_street(spark, sf_dir) -> DataFrame:
    return town.addresses(spark, sf_dir).select("id", A.expand_street(F.upper("street")).alias("street"))


def title_case(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    return p.select(F.col("c_custkey").alias("id"), A.title_if_capitals(text).alias("title"))


def leading_number(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit("B"))).when(k % 4 == 1, F.lit("rear 5")).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("-9"))).otherwise(F.lit(None))
    return table(spark, sf_dir, "customer").select(k.alias("id"), A.leading_number(text).alias("number"))


def split_values(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "part")
    text = F.concat_ws("; ", "p_brand", F.replace("p_name", F.lit(" "), F.lit(" ;")), "p_brand", F.lit(""))
    return c.select(F.col("p_partkey").alias("id"), F.array_join(A.split_values(text), "|").alias("parts"))


def source_merge(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "part")
    return c.select(F.col("p_partkey").alias("id"), A.merge_sources(F.concat_ws(";", "p_type", F.lit("survey")), F.concat_ws("; ", F.lower("p_type"), F.lit("SURVEY"), "p_brand")).alias("merged"))


def lineage_sources(spark, sf_dir) -> DataFrame:
    """Labels of the sources that each building's edits came from, as one sorted list."""
    b = town.buildings(spark, sf_dir, town_settings())
    c = town.cells(spark, sf_dir)
    from plotline.operators.grid import grid_join

    hits = grid_join(b, c, "b", "c", 40.0)
    label = F.concat(F.lit("Parcels "), F.substr("cell_id", F.lit(1), F.lit(2)))
    return hits.groupBy("bid").agg(F.array_join(F.array_sort(F.collect_set(label)), "; ").alias("sources"))


def town_settings():
    from plotline.plans.match_queries import SETTINGS

    return SETTINGS


LICENCES = (
    "Public Domain", "CC BY 4.0", "CC BY-NC 4.0", "ODbL 1.0", "CC-BY-SA", "user must indemnify", "unknown", "",
    "public domain, user indemnifies", "https://creativecommons.org/publicdomain/zero/1.0/", "terms apply", "RLIS Open Database License",
)


def licence_ladder(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(t) for t in LICENCES]), (k % len(LICENCES) + 1).cast("int"))
    credit = F.when(k % 5 == 0, True).when(k % 5 == 1, False)
    alike = F.when(k % 7 == 0, True)
    url = F.when(k % 11 == 0, "https://opendatacommons.org/licenses/odbl/")
    return table(spark, sf_dir, "part").select(k.alias("id"), L.licence_status(text, url, credit, alike).alias("status"), L.licence_shown(text, url).alias("shown"))


def licence_precedence(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    permission, law = F.when(k % 4 == 0, "PERMISSION"), F.when(k % 3 == 0, "COMPATIBLE")
    declared = F.element_at(F.array(F.lit("UNKNOWN"), F.lit("NOT_COMPATIBLE"), F.lit(None)), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), L.assessed(permission, law, k % 2 == 0, declared).alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_street, normalize_unit, address_keys, exact_keys, conflicting_keys, fill_missing_tags, expand_street, title_case, leading_number,
        split_values, source_merge, lineage_sources, licence_ladder, licence_precedence,
    )
}

_LOTS = f"""WITH {town_sql()}, pairs AS (SELECT e.*, a.* FROM existing e JOIN n ON true JOIN addresses a ON a.id = (e.eid * 37) % n.n)"""
_CAP = "array_to_string(list_transform(str_split({w}, ''), lambda c, i: CASE WHEN i = 1 OR str_split({w}, '')[i - 1] IN ('-', '''', '.') THEN upper(c) ELSE c END), '')"


def _capitalize(w: str) -> str:
    risen = _CAP.format(w=w)
    return f"(CASE WHEN starts_with({risen}, 'Mc') AND length({risen}) > 2 THEN 'Mc' || upper(substr({risen}, 3, 1)) || substr({risen}, 4) ELSE {risen} END)"


def _expand_sql() -> str:
    lists = ", ".join(f"'{d}'" for d in DIRECTIONALS)
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in EXPANSIONS.items())
    return f"""
WITH {town_sql()}, longs(w, l) AS (VALUES {pairs}),
words AS (SELECT id, i, len(ws) AS n, ws[i] AS w, lower(ws[i]) AS lw, len(ws) > 1 AND list_contains([{lists}], lower(ws[len(ws)])) AS ld
  FROM (SELECT id, regexp_split_to_array(trim(upper(street)), '\\s+') AS ws FROM addresses), unnest(range(1, len(ws) + 1)) AS t(i)),
j AS (SELECT words.*, l, list_contains([{lists}], lw) AS d, CASE WHEN ld THEN n - 1 ELSE n END AS ti FROM words LEFT JOIN longs ON longs.w = lw),
o AS (SELECT id, i, CASE WHEN (i = 1 OR i = n) AND d AND n > 1 THEN {_capitalize("l")} WHEN i = 1 AND lw = 'st' AND n > 1 THEN 'Saint'
  WHEN i = 1 AND lw IN ('mt', 'ft') AND n > 1 THEN {_capitalize("l")} WHEN i = ti AND i > 1 AND l IS NOT NULL AND NOT d THEN {_capitalize("l")}
  WHEN regexp_full_match(lw, '\\d+(st|nd|rd|th)') THEN lw ELSE {_capitalize("lw")} END AS out FROM j)
SELECT id, string_agg(out, ' ' ORDER BY i) AS street FROM o GROUP BY id"""


_LIC = "[" + ", ".join(f"'{t}'" for t in LICENCES) + "]"
SQL = {
    "normalize_street": f"WITH {town_sql()} SELECT id, {S.street('street')} AS street FROM addresses",
    "normalize_unit": f"SELECT id, {S.unit('t')} AS unit FROM (SELECT c_custkey AS id, ['Unit ', 'APT ', 'apt. ', 'Suite ', 'ste ', '#', 'Unit #', '# unit '][c_custkey % 8 + 1] || (c_custkey % 100) AS t FROM customer)",
    "address_keys": f"WITH {town_sql()} SELECT id, {S.number('number')} || '|' || {S.street('street')} || '|' || {S.unit('unit')} AS key, {S.number('number')} || '|' || {S.street('street')} AS without_unit FROM addresses",
    "exact_keys": f"WITH {town_sql()} SELECT id, 'addr:housenumber=' || number || ';addr:street=' || street || coalesce(';addr:unit=' || unit, '') AS key FROM addresses",
    "conflicting_keys": _LOTS + """ SELECT eid, array_to_string(list_filter([CASE WHEN lower(trim(number)) <> lower(trim(e_number)) THEN 'addr:housenumber' END,
        CASE WHEN lower(trim(street)) <> lower(trim(e_street)) THEN 'addr:street' END, CASE WHEN lower(trim(unit)) <> lower(trim(e_unit)) THEN 'addr:unit' END], lambda x: x IS NOT NULL), ',') AS keys FROM pairs""",
    "fill_missing_tags": _LOTS + """ SELECT eid, array_to_string(list_filter([CASE WHEN e_number IS NULL THEN 'addr:housenumber=' || number END,
        CASE WHEN e_street IS NULL THEN 'addr:street=' || street END, CASE WHEN e_unit IS NULL THEN 'addr:unit=' || unit END], lambda x: x IS NOT NULL), ',') AS tags FROM pairs""",
    "expand_street": _expand_sql(),
    "title_case": f"""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS s FROM customer)
        SELECT id, CASE WHEN s = upper(s) AND lower(s) <> upper(s) THEN {_capitalize("lower(s)")} ELSE s END AS title FROM t""",
    "leading_number": """SELECT id, coalesce(try_cast(nullif(regexp_extract(t, '^\\s*(\\d{1,9})', 1), '') AS BIGINT), -1) AS number FROM (
        SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || 'B' WHEN 1 THEN 'rear 5' WHEN 2 THEN c_custkey || '-9' END AS t FROM customer)""",
    "split_values": """WITH t AS (SELECT p_partkey AS id, p_brand || '; ' || replace(p_name, ' ', ' ;') || '; ' || p_brand || '; ' AS s FROM part),
        w AS (SELECT id, i, regexp_replace(trim(str_split(s, ';')[i]), '\\s+', ' ', 'g') AS v FROM t, unnest(range(1, len(str_split(s, ';')) + 1)) AS u(i)),
        f AS (SELECT id, v, min(i) AS i FROM w WHERE v <> '' GROUP BY id, v) SELECT id, string_agg(v, '|' ORDER BY i) AS parts FROM f GROUP BY id""",
    "source_merge": """WITH t AS (SELECT p_partkey AS id, [p_type, 'survey', lower(p_type), 'SURVEY', p_brand] AS l FROM part),
        w AS (SELECT id, i, l[i] AS v FROM t, unnest(range(1, 6)) AS u(i)), f AS (SELECT id, min(i) AS i, arg_min(v, i) AS v FROM w GROUP BY id, lower(v))
        SELECT id, string_agg(v, '; ' ORDER BY i) AS merged FROM f GROUP BY id""",
    "lineage_sources": f"""WITH {town_sql()} SELECT bid, string_agg(s, '; ' ORDER BY s) AS sources FROM (SELECT DISTINCT bid, 'Parcels ' || substr(cell_id, 1, 2) AS s
        FROM buildings JOIN cells ON bxmin <= cxmax AND cxmin <= bxmax AND bymin <= cymax AND cymin <= bymax) GROUP BY bid""",
    "licence_ladder": f"""WITH t AS (SELECT p_partkey AS id, {_LIC}[p_partkey % {len(LICENCES)} + 1] AS text, CASE WHEN p_partkey % 11 = 0 THEN 'https://opendatacommons.org/licenses/odbl/' END AS url,
        CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS credit, CASE WHEN p_partkey % 7 = 0 THEN true END AS alike FROM part),
        s AS (SELECT *, trim(lower(text || ' ' || coalesce(url, ''))) AS t FROM t)
        SELECT id, CASE WHEN t IN ('', 'unknown') THEN CASE WHEN coalesce(credit, false) THEN 'NEEDS_WAIVER' ELSE 'UNKNOWN' END
          WHEN regexp_matches(t, '{L.NAMED_COMPATIBLE}') THEN 'COMPATIBLE' WHEN regexp_matches(t, '{L.NON_COMMERCIAL}') THEN 'NOT_COMPATIBLE'
          WHEN regexp_matches(t, '{L.SHARE_ALIKE}') OR (coalesce(alike, false) AND NOT regexp_matches(t, '{L.OPEN_DATABASE}')) THEN 'NOT_COMPATIBLE'
          WHEN regexp_matches(t, '{L.OPEN_DATABASE}') THEN 'COMPATIBLE' WHEN regexp_matches(t, '{L.PUBLIC_DOMAIN}') AND NOT regexp_matches(t, '{L.INDEMNITY}') THEN 'COMPATIBLE'
          WHEN regexp_matches(t, '{L.ATTRIBUTION}') THEN 'NEEDS_WAIVER' WHEN regexp_matches(t, '{L.INDEMNITY}') THEN 'CHECK_TERMS'
          WHEN coalesce(credit, false) THEN 'NEEDS_WAIVER' ELSE 'CHECK_TERMS' END AS status, CASE WHEN text <> '' THEN text ELSE url END AS shown FROM s""",
    "licence_precedence": """WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'PERMISSION' END AS p, CASE WHEN p_partkey % 3 = 0 THEN 'COMPATIBLE' END AS law,
        p_partkey % 2 = 0 AS o, ['UNKNOWN', 'NOT_COMPATIBLE', NULL][p_partkey % 3 + 1] AS d FROM part)
        SELECT id, coalesce(p, CASE WHEN o THEN law END, CASE WHEN coalesce(d, 'UNKNOWN') = 'UNKNOWN' AND law IS NOT NULL THEN law ELSE coalesce(d, 'UNKNOWN') END) AS status FROM t""",
}
