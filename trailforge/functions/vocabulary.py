"""A local vocabulary for tag values: a bijection for each column, applied token by token.

The names here are English ones for people; VALUES can be replaced by any other
mapping of the same shape. Unknown tokens pass through either way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from trailforge.functions.tags import translate

#: By column, tag value to local name.
VALUES: dict[str, dict[str, str]] = {
    "highway": {
        "cycleway": "cycle_track", "footway": "footpath", "path": "trail", "service": "service_road", "residential": "home_street", "living_street": "play_street",
        "pedestrian": "walking_street", "steps": "stairs", "track": "farm_track", "primary": "main_road", "secondary": "second_road", "tertiary": "local_road",
        "trunk": "fast_road", "motorway": "freeway", "unclassified": "minor_road", "road": "unknown_road", "bridleway": "riding_path",
    },
    "surface": {
        "asphalt": "tarmac", "paved": "hard_surface", "unpaved": "no_hard_surface", "concrete": "beton", "paving_stones": "pavers", "sett": "cut_stone",
        "cobblestone": "cobbles", "compacted": "pressed_mix", "fine_gravel": "grit", "gravel": "loose_stones", "ground": "soil", "dirt": "bare_soil", "sand": "loose_sand",
        "grass": "lawn", "mud": "mire", "wood": "timber", "metal": "steel",
    },
    "smoothness": {"excellent": "perfect", "very_good": "very_even", "good": "even", "intermediate": "middling", "bad": "uneven", "very_bad": "very_uneven", "horrible": "broken", "very_horrible": "very_broken", "impassable": "no_way"},
    "cycleway": {"yes": "present", "no": "absent", "none": "lacking", "lane": "bike_lane", "track": "parted_track", "separate": "drawn_apart", "share_busway": "with_buses", "shared_lane": "with_cars", "crossing": "bike_crossing"},
    "bicycle": {"yes": "allowed", "no": "forbidden", "designated": "meant_for_bikes", "destination": "to_a_goal_only", "permissive": "by_the_owner", "dismount": "get_off", "use_sidepath": "use_the_side"},
    "lit": {"yes": "lamps", "no": "dark", "24/7": "always", "automatic": "by_sensor", "limited": "at_times"},
    "service": {"driveway": "house_drive", "parking_aisle": "car_park", "alley": "narrow_way", "drive-through": "drive_in", "emergency_access": "for_rescue"},
    "access": {"yes": "open", "no": "closed", "private": "own", "permissive": "by_leave", "destination": "for_visits", "customers": "for_customers", "delivery": "for_goods", "permit": "by_permit"},
}


def inverse(values: Mapping[str, Mapping[str, str]] = VALUES) -> dict[str, dict[str, str]]:
    """Local name to tag value; ValueError if two values have one name."""
    out = {}
    for column, names in values.items():
        out[column] = {name: value for value, name in names.items()}
        if len(out[column]) < len(names):
            raise ValueError(f"names of {column} repeat")
    return out


def _apply(df: DataFrame, values: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return df.withColumns({c: translate(c, names) for c, names in values.items() if c in df.columns})


def to_osm(df: DataFrame, values: Mapping[str, Mapping[str, str]] = VALUES) -> DataFrame:
    """Columns with tag values; those that are so already stay."""
    return _apply(df, inverse(values))


def to_local(df: DataFrame, values: Mapping[str, Mapping[str, str]] = VALUES) -> DataFrame:
    """Columns with local names; those that are so already stay."""
    return _apply(to_osm(df, values), values)
