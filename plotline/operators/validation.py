"""All checks of a map's addresses in one list of findings, and the fixes of some.

Findings have code, severity, message, detail, element and related, the other elements
they are about. Only what was visited is reported, but all rows are context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import quality as Q
from plotline.operators import sequence as S
from plotline.operators.chains import RADIUS
from plotline.operators.elements import leaves_bounds
from plotline.operators.grid import with_box

# The codes and texts of findings.
OUTBUILDING, NO_ROAD, NEAR_MATCH, NO_ROAD_AT_EDGE, SEQUENCE, PARITY, NEIGHBOURS, DIFFERS = range(47100, 47108)
MESSAGES = {
    OUTBUILDING: "Address on outbuilding",
    NO_ROAD: "Street name not found nearby",
    NEAR_MATCH: "addr:street differs from the nearby road name",
    NO_ROAD_AT_EDGE: "Street name not found nearby (at edge of downloaded area)",
    SEQUENCE: "House number out of sequence along the street",
    PARITY: "House number parity differs from its side of the street",
    NEIGHBOURS: "addr:street differs from the neighbouring addresses",
    DIFFERS: "Address node differs from the address of its building",
}
AT_EDGE = " (at edge of downloaded area)"
WARNING = "WARNING"


def _element(letter: str, key: Column) -> Column:
    return F.concat(F.lit(letter), key.cast("string"))


def _finding(rows: DataFrame, code: int, detail: Column, element: Column, related: Column | None = None, severity: Column | None = None, edge: Column | None = None) -> DataFrame:
    message = F.lit(MESSAGES[code])
    if edge is not None:
        message = F.when(edge, MESSAGES[code] + AT_EDGE).otherwise(MESSAGES[code])
    others = F.array_sort(related) if related is not None else F.array().cast("array<string>")
    return rows.select(
        F.lit(code).alias("code"), (severity if severity is not None else F.lit(WARNING)).alias("severity"), message.alias("message"), detail.alias("detail"),
        element.alias("element"), others.alias("related"),
    )


def _shown(addresses: DataFrame, id_as: str) -> DataFrame:
    """What findings say of an address: number and street as they are."""
    return addresses.select(F.col("id").alias(id_as), F.coalesce("number", F.lit("")).alias(f"{id_as}_number"), F.coalesce(A.trimmed(F.col("street")), F.lit("")).alias(f"{id_as}_street"))


def outbuildings(buildings: DataFrame) -> DataFrame:
    """Buildings (bid, building, factor) with an address that are outbuildings by their tags."""
    rows = buildings.where("b_exact IS NOT NULL AND factor < 1")
    detail = F.concat(F.lit("building="), "building", F.lit(" carries an address but no amenity, shop or office tag"))
    return _finding(rows, OUTBUILDING, detail, _element("b", F.col("bid")))


def unknown_streets(addresses: DataFrame, roads: DataFrame, **more) -> DataFrame:
    """Findings of ``quality.street_names``."""
    found = Q.street_names(addresses, roads, with_road=True, **more)
    detail, element = F.concat(F.lit("addr:street="), "street"), _element("n", F.col("id"))
    near = _finding(found.where("problem = 'NEAR_MATCH'"), NEAR_MATCH, F.concat(detail, F.lit(", road name="), "road"), element, F.array(_element("w", F.col("road_id"))))
    out = near
    for code, problem in ((NO_ROAD, "NO_ROAD"), (NO_ROAD_AT_EDGE, "NO_ROAD_AT_EDGE")):
        out = out.unionByName(_finding(found.where(F.col("problem") == problem), code, detail, element))
    return out


def _at_edge(rows: DataFrame, addresses: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """``rows`` with ``leaves``: whether the surroundings of their address are not wholly loaded."""
    if bounds is None:
        return rows.withColumn("leaves", F.lit(False))
    places = addresses.select(F.col("id").alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return leaves_bounds("s", bounds, with_box(rows.join(places, F.col("id") == F.col("_p")), "s", "_x", "_y", RADIUS))


def house_numbers(placed: DataFrame, addresses: DataFrame, bounds: DataFrame | None = None, parity: bool = True) -> DataFrame:
    """Findings about numbers along streets, of addresses ``placed`` on chains."""
    own, low, high = (_shown(addresses, c) for c in ("_own", "_low", "_high"))
    rows = S.out_of_sequence(placed)
    up = F.col("before") <= F.col("after")
    rows = rows.withColumns({"_l": F.when(up, F.col("before_id")).otherwise(F.col("after_id")), "_h": F.when(up, F.col("after_id")).otherwise(F.col("before_id"))})
    rows = _at_edge(rows, addresses, bounds).join(own, F.col("id") == F.col("_own")).join(low, F.col("_l") == F.col("_low")).join(high, F.col("_h") == F.col("_high"))
    detail = F.concat("_own_number", F.lit(" between "), "_low_number", F.lit(" and "), "_high_number", F.lit(" on "), "_own_street")
    out = _finding(rows, SEQUENCE, detail, _element("n", F.col("id")), F.array(_element("n", F.col("_l")), _element("n", F.col("_h"))), edge=F.col("leaves"))
    if not parity:
        return out
    odd = _at_edge(S.wrong_parity(placed), addresses, bounds).join(own, F.col("id") == F.col("_own"))
    side = F.when(F.col("house") % 2 == 0, "odd").otherwise("even")  # that of the others
    detail = F.concat("_own_number", F.lit(" on the "), side, F.lit(" side of "), "_own_street")
    return out.unionByName(_finding(odd, PARITY, detail, _element("n", F.col("id")), edge=F.col("leaves")))


def commonest_spellings(found: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per row of ``found`` (id, near): the single street that most of the near addresses
    have, that of the nearest of equals (spelling), how many have it, and how many have one."""
    values = addresses.select(F.col("id").alias("_n"), A.split_values(F.col("street")).alias("_v")).where(F.size("_v") == 1)
    each = found.select("id", F.posexplode("near").alias("_pos", "_near")).join(values, F.col("_near") == F.col("_n"))
    per = each.groupBy("id", F.col("_v")[0].alias("spelling")).agg(F.count(F.lit(1)).alias("_many"), F.min("_pos").alias("_first"))
    best = F.max_by(F.struct("spelling", F.col("_many").alias("having")), F.struct("_many", -F.col("_first")))
    return per.groupBy(F.col("id").alias("_i")).agg(best.alias("_b"), F.sum("_many").alias("of")).select("_i", "_b.spelling", "_b.having", "of")


def unlike_neighbours(addresses: DataFrame, roads: DataFrame) -> DataFrame:
    """Findings of ``quality.agreeing_neighbours``."""
    found = Q.agreeing_neighbours(addresses, roads).select("id", "near")
    rows = found.join(commonest_spellings(found, addresses), F.col("id") == F.col("_i")).join(_shown(addresses, "_own"), F.col("id") == F.col("_own"))
    detail = F.concat(F.lit("addr:street="), "_own_street", F.lit(", neighbours use "), "spelling")
    return _finding(rows, NEIGHBOURS, detail, _element("n", F.col("id")), F.transform("near", lambda n: _element("n", n)))


def street_fixes(addresses: DataFrame, roads: DataFrame) -> DataFrame:
    """Streets (id, was, street) to set where neighbours disagree: the spelling that nearly
    all of the agreeing neighbours use, where it is not the address's own."""
    found = Q.agreeing_neighbours(addresses, roads).select("id", "near")
    rows = found.join(commonest_spellings(found, addresses), F.col("id") == F.col("_i")).where(F.col("having") >= Q.AGREEMENT * F.col("of"))
    rows = rows.join(addresses.select(F.col("id").alias("_a"), F.col("street").alias("was")), F.col("id") == F.col("_a"))
    return rows.where(~F.col("was").eqNullSafe(F.col("spelling"))).select("id", "was", F.col("spelling").alias("street"))


def unlike_buildings(addresses: DataFrame, buildings: DataFrame) -> DataFrame:
    """Findings of ``quality.nodes_in_buildings``."""
    rows = Q.nodes_in_buildings(addresses, buildings).join(_shown(addresses, "_own"), F.col("id") == F.col("_own"))
    theirs = buildings.select(F.col("bid").alias("_b"), F.coalesce("b_number", F.lit("")).alias("_bn"), F.coalesce("b_street", F.lit("")).alias("_bs"))
    rows = rows.join(theirs, F.col("bid") == F.col("_b"))
    detail = F.concat(F.lit("node "), "_own_number", F.lit(" "), "_own_street", F.lit(", building "), "_bn", F.lit(" "), "_bs")
    return _finding(rows, DIFFERS, detail, _element("n", F.col("id")), F.array(_element("b", F.col("bid"))), F.col("severity"))


def findings(
    addresses: DataFrame, roads: DataFrame, buildings: DataFrame, placed: DataFrame, bounds: DataFrame | None = None,
    names: DataFrame | None = None, exempt: DataFrame | None = None, visited: DataFrame | None = None, parity: bool = True,
) -> DataFrame:
    """All findings about addresses (id, x, y, number, street, nn, ns), roads (road_id, name,
    key, ax, ay, bx, by) and buildings (bid, shape b and their address b_), with addresses
    ``placed`` on chains. ``visited`` (element) are the elements to report on."""
    out = outbuildings(buildings)
    for part in (
        unknown_streets(addresses, roads, names=names, exempt=exempt, bounds=bounds), house_numbers(placed, addresses, bounds, parity),
        unlike_neighbours(addresses, roads), unlike_buildings(addresses, buildings),
    ):
        out = out.unionByName(part)
    return out if visited is None else out.join(visited.select("element").distinct(), "element", "left_semi")


def first_of_each(found: DataFrame) -> DataFrame:
    """One finding of each code for an element, the first by detail, and how many there are."""
    order = Window.partitionBy("code", "element").orderBy("detail")
    rows = found.withColumns({"_k": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("code", "element"))})
    return rows.where("_k = 1").drop("_k")
