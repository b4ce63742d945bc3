"""How the test tables stand in for the city feeds.

Each binding is written twice: as a DataFrame and as the SQL text the oracle queries select from.
Coordinates are multiples of 1/8 and rectangle sides 4 or 8, so distances are exact in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.catalog.registry import table
from citylens.session import parameter_table

# --- rectangles as regions -------------------------------------------------------------------

RECTANGLES = [("r1", 0, 0, 4, 4), ("r2", 4, 0, 8, 4), ("r3", 0, 8, 4, 12), ("r4", 8, 8, 12, 12)]
CELL = 1.0
RECTANGLES_SQL = "(VALUES " + ", ".join(
    f"('{n}', {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {d}.0::DOUBLE)" for n, a, b, c, d in RECTANGLES
) + ") AS r(region, x0, y0, x1, y1)"
GAP_SQL = "sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2)"


def rectangle_wkt(x0, y0, x1, y1) -> str:
    return f"MULTIPOLYGON ((({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0})))"


def rectangles(spark: SparkSession) -> DataFrame:
    return parameter_table(spark, "region string, wkt string", [(n, rectangle_wkt(*box)) for n, *box in RECTANGLES])


# --- trips from events -----------------------------------------------------------------------

TRIPS_SQL = """(SELECT event_id, user_id, event_type, value, ts,
    CAST(user_id * 37 % 104 AS DOUBLE) / 8 AS ox, CAST(user_id * 53 % 104 AS DOUBLE) / 8 AS oy,
    CAST(event_id * 37 % 104 AS DOUBLE) / 8 AS dx, CAST(event_id * 53 % 104 AS DOUBLE) / 8 AS dy,
    format('{:,.2f}', value * 1000) AS weight_text FROM events)"""


def trips(spark: SparkSession, folder: str) -> DataFrame:
    def eighth(column: str, factor: int):
        return (F.col(column) * factor % 104).cast("double") / 8

    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", "ts",
        eighth("user_id", 37).alias("ox"), eighth("user_id", 53).alias("oy"),
        eighth("event_id", 37).alias("dx"), eighth("event_id", 53).alias("dy"),
        F.format_number(F.col("value") * 1000, 2).alias("weight_text"),
    )


NEAREST_SQL = """(SELECT x, y, region FROM
    (SELECT x, y, region, {gap} AS gap FROM (SELECT DISTINCT {x} AS x, {y} AS y FROM {trips} t), {rects})
    QUALIFY gap = min(gap) OVER (PARTITION BY x, y))"""


def nearest_sql(x: str, y: str, trips_sql: str = TRIPS_SQL) -> str:
    return NEAREST_SQL.format(gap=GAP_SQL, x=x, y=y, trips=trips_sql, rects=RECTANGLES_SQL)


# --- crashes from orders and customers ---------------------------------------------------------

PERSONS_SQL = """(SELECT o_orderkey AS person_id, o_custkey AS "COLLISION_ID",
    CASE o_orderstatus WHEN 'F' THEN 'Injured' WHEN 'O' THEN ' injured ' ELSE
        CASE WHEN o_orderkey % 4 = 0 THEN 'Killed' ELSE 'Unspecified' END END AS "PERSON_INJURY",
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Unconscious' WHEN '2-HIGH' THEN ' conscious'
        WHEN '3-MEDIUM' THEN 'Shock ' WHEN '5-LOW' THEN 'Does Not Apply' END AS "EMOTIONAL_STATUS",
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Internal' WHEN 'AUTOMOBILE' THEN 'minor burn'
        WHEN 'MACHINERY' THEN 'None Visible' WHEN 'FURNITURE' THEN 'Whiplash' END AS "COMPLAINT",
    CASE o_custkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Eye' END AS "BODILY_INJURY",
    CASE WHEN o_orderkey % 50 = 0 THEN 'not a date' ELSE
        month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS "CRASH_DATE",
    'n' || c_nationkey AS area, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def persons(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as persons in crashes, with padding, mixed case, gaps and bad dates."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    status, priority, segment = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("c_mktsegment")
    return joined.select(
        F.col("o_orderkey").alias("person_id"), F.col("o_custkey").alias("COLLISION_ID"),
        F.when(status == "F", "Injured").when(status == "O", " injured ")
        .when(F.col("o_orderkey") % 4 == 0, "Killed").otherwise("Unspecified").alias("PERSON_INJURY"),
        F.when(priority == "1-URGENT", "Unconscious").when(priority == "2-HIGH", " conscious")
        .when(priority == "3-MEDIUM", "Shock ").when(priority == "5-LOW", "Does Not Apply").alias("EMOTIONAL_STATUS"),
        F.when(segment == "BUILDING", "Internal").when(segment == "AUTOMOBILE", "minor burn")
        .when(segment == "MACHINERY", "None Visible").when(segment == "FURNITURE", "Whiplash").alias("COMPLAINT"),
        F.when(F.col("o_custkey") % 3 == 0, "Unknown").when(F.col("o_custkey") % 3 == 1, "Eye").alias("BODILY_INJURY"),
        F.when(F.col("o_orderkey") % 50 == 0, "not a date")
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("CRASH_DATE"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("area"), "c_nationkey",
    )


SEVERITY_SQL = """CASE
    WHEN upper(trim("PERSON_INJURY")) = 'KILLED' THEN 'K'
    WHEN upper(trim("PERSON_INJURY")) IS DISTINCT FROM 'INJURED' THEN 'U'
    WHEN upper(trim("EMOTIONAL_STATUS")) = 'UNCONSCIOUS' THEN 'A'
    WHEN "EMOTIONAL_STATUS" IS NULL THEN 'U'
    WHEN upper("COMPLAINT") = 'INTERNAL' THEN 'A'
    WHEN upper("COMPLAINT") = 'MINOR BURN' THEN 'B'
    WHEN upper(trim("EMOTIONAL_STATUS")) = 'CONSCIOUS' AND upper("COMPLAINT") = 'NONE VISIBLE' AND "BODILY_INJURY" = 'Unknown' THEN 'U'
    WHEN upper("COMPLAINT") IN ('NONE VISIBLE', 'WHIPLASH') THEN 'C'
    ELSE 'U' END"""

# --- incidents from line items and orders --------------------------------------------------------

INCIDENTS_SQL = """(SELECT o_orderdate AS incident_at, l_returnflag || l_linestatus AS dispatch_area,
    CAST(l_linenumber AS VARCHAR) AS severity_code, o_orderdate AS assigned_at, l_shipdate AS activated_at,
    CASE WHEN l_quantity < 5 THEN 0 ELSE CAST(l_quantity * 100 AS INTEGER) END AS travel_s,
    CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(l_quantity * 130 AS INTEGER) END AS response_s,
    CASE WHEN l_tax < 0.02 THEN 0 ELSE CAST(round(l_tax * 1000) AS INTEGER) END AS dispatch_s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Line items read as emergency calls, their seconds as comma-grouped text."""
    lineitem, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lineitem.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))

    def seconds(empty, amount):
        return F.format_number(F.when(empty, F.lit(0.0)).otherwise(amount), 0)

    return joined.select(
        F.col("o_orderdate").alias("incident_at"), F.concat("l_returnflag", "l_linestatus").alias("dispatch_area"),
        F.col("l_linenumber").cast("string").alias("severity_code"),
        F.col("o_orderdate").alias("assigned_at"), F.col("l_shipdate").alias("activated_at"),
        seconds(F.col("l_quantity") < 5, F.col("l_quantity") * 100).alias("travel_text"),
        seconds(F.col("l_quantity") < 3, F.col("l_quantity") * 130).alias("response_text"),
        seconds(F.col("l_tax") < 0.02, F.round(F.col("l_tax") * 1000)).alias("dispatch_text"),
    )


AREAS = {"cbd": ["AO"], "bronx": ["AF", "NF"], "queens": ["NO", "RO"]}
LIFE_THREAT = ["1", "2", "3"]

# --- traffic counts from line items ---------------------------------------------------------------

COUNTS_SQL = """(SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS direction,
    lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':00:00' AS hour,
    CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE l_quantity END AS count FROM lineitem)"""


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("direction"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":00:00")).alias("hour"),
        F.when(F.col("l_orderkey") % 997 != 0, F.col("l_quantity")).alias("count"),
    )


TEST_HOLIDAYS = [f"{y}-{md}" for y in range(1995, 2002) for md in ("01-01", "07-04", "11-11", "12-25")]
DAY_TYPE_SQL = (
    "CASE WHEN strftime({d}, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25') THEN 'holiday' "
    "WHEN isodow({d}) >= 6 THEN 'weekend' ELSE 'non-holiday weekday' END"
)

# --- hourly and daily readings ---------------------------------------------------------------------

SITES = [f"s{i:02d}" for i in range(26)] + ["s99"]
HOURLY_SQL = """(SELECT 's' || lpad(CAST(user_id % 26 AS VARCHAR), 2, '0') AS site, ts, value, event_type,
    CAST(ts AS DATE) AS file FROM events)"""
DAILY_SQL = """(SELECT 's' || lpad(CAST(o_custkey % 26 AS VARCHAR), 2, '0') AS site, CAST(o_orderdate AS DATE) AS date,
    o_orderpriority AS method, o_orderstatus AS source, floor(o_totalprice) AS value,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    strftime(o_orderdate, '%Y-%m') AS year_month FROM orders)"""


def _site(column: str):
    return F.concat(F.lit("s"), F.lpad((F.col(column) % 26).cast("string"), 2, "0"))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        _site("user_id").alias("site"), "ts", "value", "event_type", F.to_date("ts").alias("file")
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        _site("o_custkey").alias("site"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("method"),
        F.col("o_orderstatus").alias("source"), F.floor("o_totalprice").cast("double").alias("value"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
    )
