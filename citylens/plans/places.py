"""Names of community boards and neighbourhood groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.functions.rules import first_match
from citylens.session import parameter_table

# Borough codes, names and number of community boards.
BOROUGHS = [("1", "Manhattan", 12), ("2", "Bronx", 12), ("3", "Brooklyn", 18), ("4", "Queens", 14), ("5", "Staten Island", 3)]
# Boards that are parks or an airport.
OPEN_SPACES = [
    ("cb_164", "Central Park"),
    ("cb_226", "Van Cortlandt Park"),
    ("cb_355", "Prospect Park"),
    ("cb_481", "Flushing Meadows-Corona Park"),
    ("cb_483", "JFK Airport"),
]
# Boards left out before the nearest one is sought; bike trips may end in cb_226.
NOT_NEAREST = ["cb_164", "cb_226", "cb_355", "cb_481", "cb_483"]
NOT_NEAREST_BIKE = ["cb_164", "cb_355", "cb_481", "cb_483"]
# Boards of the central business district.
CBD_BOARDS = ["cb_101", "cb_102", "cb_103", "cb_104", "cb_105", "cb_106"]
# Neighbourhoods of the congestion relief zone.
CRZ_NEIGHBOURHOODS = [
    "Financial District-Battery Park City",
    "Tribeca-Civic Center",
    "The Battery-Governors Island-Ellis Island-Liberty Island",
    "SoHo-Little Italy-Hudson Square",
    "Greenwich Village",
    "West Village",
    "Chinatown-Two Bridges",
    "Lower East Side",
    "East Village",
    "Chelsea-Hudson Yards",
    "Hell's Kitchen",
    "Midtown South-Flatiron-Union Square",
    "Midtown-Times Square",
    "Stuyvesant Town-Peter Cooper Village",
    "Gramercy",
    "Murray Hill-Kips Bay",
    "East Midtown-Turtle Bay",
    "United Nations",
]
# Areas reported on their own in the injury summary.
CRZ = "Congestion Relief Zone"
REPORTED_AREAS = [
    CRZ, "Upper West Side", "Upper East Side", "Williamsburg", "Downtown Brooklyn", "Astoria", "Greater Harlem",
    "Inwood/Washington Heights", "Long Island City-Hunters Point", "Morningside Heights",
]
# End of fixed values.


def board_names() -> list[tuple[str, str]]:
    """``(code, label)`` of every community board, and of the open spaces."""
    boards = [(f"cb_{code}{n:02d}", f"{name} Community Board {n}") for code, name, count in BOROUGHS for n in range(1, count + 1)]
    return boards + OPEN_SPACES


def board_labels(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, "code string, label string", board_names())


def area_groups(neighbourhoods: DataFrame) -> DataFrame:
    """Neighbourhood to area: ``(region, area)``; the rest keep their own name.

    ``neighbourhoods`` has ``region`` (its name), ``district`` (code and name) and ``borough``.
    The areas are disjoint, so the order of the rules does not matter.
    """
    name, district, borough = F.col("region"), F.col("district"), F.col("borough")
    harlem = district.rlike("MN09|MN10|MN11") & ~name.contains("Morningside")
    area = first_match(
        [
            (name.isin(CRZ_NEIGHBOURHOODS), CRZ),
            (district.contains("MN07"), "Upper West Side"),
            (district.contains("MN08"), "Upper East Side"),
            (name.contains("Williamsburg"), "Williamsburg"),
            (district.contains("BK02"), "Downtown Brooklyn"),
            (district.contains("QN01") & borough.contains("Queens"), "Astoria"),
            (harlem, "Greater Harlem"),
            (district.contains("MN12"), "Inwood/Washington Heights"),
        ]
    )
    return neighbourhoods.select("region", area.alias("area")).where(F.col("area").isNotNull())


def neighbourhood_zones(neighbourhoods: DataFrame) -> DataFrame:
    """``(name, cbd, other_manhattan, outside_cbd)`` flags per neighbourhood.

    Everything outside the business district follows from the borough, so no list of outer
    neighbourhoods is needed.
    """
    cbd = F.col("region").isin(CRZ_NEIGHBOURHOODS)
    return neighbourhoods.select(
        F.col("region").alias("name"), cbd.alias("cbd"),
        ((F.col("borough") == "Manhattan") & ~cbd).alias("other_manhattan"), (~cbd).alias("outside_cbd"),
    )
