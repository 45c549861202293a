"""Tunables of the match, and the fixed key and value lists it depends on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
OUTBUILDINGS = (
    "garage", "garages", "shed", "carport", "roof", "canopy", "outbuilding", "greenhouse", "barn",
    "hut", "cabin", "shelter", "kiosk", "storage_tank", "silo", "service",
)
ROOFS = ("roof", "canopy")
GENERIC_BUILDINGS = ("yes", "true", "1")
FEATURE_KEYS = ("amenity", "shop", "office", "craft", "leisure", "tourism", "healthcare", "emergency", "public_transport")
NO_ADDRESS_FEATURES = (
    "amenity=parking", "amenity=parking_space", "amenity=parking_entrance", "amenity=bicycle_parking",
    "amenity=shelter", "amenity=bench", "amenity=waste_basket", "amenity=waste_disposal", "amenity=recycling",
    "amenity=fountain", "amenity=grave_yard", "amenity=loading_dock", "leisure=picnic_table", "leisure=pitch",
    "leisure=swimming_pool", "leisure=playground", "public_transport=platform",
)
NODE_META_KEYS = ("source", "note", "fixme", "FIXME", "check_date", "created_by", "survey:date", "import_uuid")
CARRIER_FEATURE_KEYS = ("amenity", "shop", "office", "craft", "tourism", "leisure", "healthcare", "emergency", "name")
POI_KEYS = ("amenity", "shop", "office", "craft", "tourism", "leisure", "healthcare", "emergency", "entrance", "name")
ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link",
    "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential",
    "living_street", "service", "pedestrian", "track", "busway", "road",
)
DIVIDING_ROADS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential",
    "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
)
NAME_KEYS = ("name", "alt_name", "official_name", "short_name", "loc_name", "old_name", "name_1", "name_2")
NAME_METADATA = ("etymology", "pronunciation", "wikidata", "wikipedia")
#: In the order in which results are shown; the first three may be applied in bulk.
BUCKETS = (
    "CLEAN", "FILL_EXISTING", "MULTI_ADDRESS_BUILDING", "REVIEW", "NO_BUILDING",
    "AMBIGUOUS_BUILDING", "EXISTING_ADDRESS", "DUPLICATE", "OUTSIDE_CELLS",
)
BULK_BUCKETS = BUCKETS[:3]
KIND_CONFIDENCE = {"IDENTICAL": 0.95, "PARTIAL": 0.85, "STREET_VARIANT": 0.7, "UNIT_DIFF": 0.5, "STREET_DIFF": 0.3}
OTHER_KIND_CONFIDENCE = 0.2


@dataclass(frozen=True)
class MatchSettings:
    match_distance: float = 30.0
    reach_factor: float = 2.0
    min_reach: float = 15.0
    ambiguity_ratio: float = 0.75
    outbuilding_factor: float = 0.1
    roof_factor: float = 0.02
    multi_ambiguity_ratio: float = 0.25
    hint_over_outbuilding: float = 3.0
    generic_beside_explicit: float = 0.3
    far_match: float = 100.0
    contains_factor: float = 4.0
    other_address_factor: float = 0.2
    min_share: float = 0.10
    min_area: float = 20.0
    split_tolerance: float = 0.2
    delete_sources: bool = True
    outbuildings: tuple[str, ...] = field(default=OUTBUILDINGS)

    def building_weight(self, building: Column) -> Column:
        """Weight of a building value; roofs weigh least whether or not they are listed."""
        listed = [v.strip() for v in self.outbuildings if v.strip() not in ROOFS]
        return F.when(building.isin(*ROOFS), self.roof_factor).when(building.isin(*listed) if listed else F.lit(False), self.outbuilding_factor).otherwise(1.0)

    def tag_weight(self, tags: Column) -> Column:
        """Weight of a building by all its tags: one that is a feature by itself weighs 1."""
        feature = F.lit(False)
        for key in FEATURE_KEYS:
            value = F.try_element_at(tags, F.lit(key))
            feature = feature | (value.isNotNull() & ~F.concat(F.lit(key + "="), value).isin(*NO_ADDRESS_FEATURES))
        return F.when(F.coalesce(feature, F.lit(False)), 1.0).otherwise(self.building_weight(F.try_element_at(tags, F.lit("building"))))


def plain_address_node(tags: Column) -> Column:
    """Whether a node is nothing but an address: addr tags and bookkeeping."""
    meta = "|".join(k.replace(".", r"\.") for k in NODE_META_KEYS)
    return F.forall(F.map_keys(tags), lambda k: F.startswith(k, F.lit("addr:")) | k.rlike(f"^({meta})(:|$)"))


def name_key(key: Column) -> Column:
    """Whether a tag key holds a name of a road."""
    described = F.lit(False)
    for part in NAME_METADATA:
        described = described | F.contains(key, F.lit(part))
    return key.isin(*NAME_KEYS) | (F.startswith(key, F.lit("name:")) & ~described)


def address_carrier(tags: Column, settings: MatchSettings) -> Column:
    """Whether a feature's place tells where its address is along the street."""
    building = F.try_element_at(tags, F.lit("building"))
    bare = ~F.exists(F.map_keys(tags), lambda k: k.isin(*CARRIER_FEATURE_KEYS))
    return F.when(building.isNotNull() & (building != "no"), settings.tag_weight(tags) >= 1.0).otherwise(bare)


def bucket_rank(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket).cast("int") - 1
