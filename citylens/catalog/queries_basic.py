"""Sources, sinks, column work, filters, scalar functions and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylens.catalog import bindings as b
from citylens.catalog.registry import query, table
from citylens.functions import dates, rules, text
from citylens.operators import geo, joins, ordering, project, reshape
from citylens.plans import air, places, traffic, trips
from citylens.session import scratch_path
from citylens.sinks import writers
from citylens.sources import markup, regions, schemas, tabular

# --- sources -----------------------------------------------------------------------------------

ORDER_COLUMNS = ["order_id", "price", "priority"]
ORDERS_TEXT_SQL = """SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_id, o_totalprice AS price,
    nullif(o_orderpriority, '5-LOW') AS priority FROM orders"""


def _orders_text(spark, sf):
    return table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("order_id"), F.col("o_totalprice").alias("price"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )


def _csv(spark, df, name, header=True):
    path = scratch_path(spark, name)
    df.write.option("header", header).csv(path)
    return path


@query("src_csv_infer", "SELECT o_orderkey AS order_id, o_totalprice AS price, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def src_csv_infer(spark, sf):
    read = tabular.read_csv_typed(spark, _csv(spark, _orders_text(spark, sf), "csv_infer"))
    return read.select(F.col("order_id").cast("bigint").alias("order_id"), "price", "priority")


@query("src_csv_override", ORDERS_TEXT_SQL)
def src_csv_override(spark, sf):
    schema = schemas.schema("order_id string, price double, priority string")
    return tabular.read_csv_override(spark, _csv(spark, _orders_text(spark, sf), "csv_override"), ["order_id"], schema)


MISSING_TEXT = ["NaN", "NA", "N/A", "null", ""]


@query("src_csv_missing", """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 >= 5 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders""")
def src_csv_missing(spark, sf):
    tokens = F.array(*[F.lit(t) for t in MISSING_TEXT])
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("order_id"), F.when(key % 7 >= 5, F.col("o_totalprice").cast("string")).otherwise(F.get(tokens, (key % 7).cast("int"))).alias("price"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).otherwise(F.get(tokens, (key % 4).cast("int"))).alias("priority"),
    )
    return tabular.read_csv_missing(spark, _csv(spark, rows, "csv_missing"), "order_id bigint, price double, priority string")


@query("src_csv_text", "SELECT order_id, CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR) AS price, priority FROM (" + ORDERS_TEXT_SQL + ")")
def src_csv_text(spark, sf):
    rows = _orders_text(spark, sf).withColumn("price", F.col("price").cast("decimal(18,2)"))
    return tabular.read_csv_text(spark, _csv(spark, rows, "csv_text"))


@query("src_headerless", ORDERS_TEXT_SQL)
def src_headerless(spark, sf):
    path = _csv(spark, _orders_text(spark, sf), "csv_headerless", header=False)
    schema = schemas.schema("column00 string, column01 double, column02 string")
    return tabular.read_csv_headerless(spark, path, ORDER_COLUMNS, schema)


@query("src_multi_file", """SELECT CAST(year(o_orderdate) AS INTEGER) AS file_year, count(*) AS n, round(sum(o_totalprice), 2) AS price
    FROM orders GROUP BY ALL""")
def src_multi_file(spark, sf):
    path = scratch_path(spark, "yearly")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("folder"))
    orders.write.partitionBy("folder").option("header", True).csv(path)
    read = tabular.read_yearly_csv(spark, [f"{path}/folder=*/*.csv"], schemas.schema("o_orderkey bigint, o_totalprice double"))
    return read.groupBy("file_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("src_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src_parquet(spark, sf):
    return tabular.read_parquet(spark, f"{sf}/lineitem.parquet").where("l_quantity >= 45").select("l_orderkey", "l_quantity")


def _parcels(spark, sf):
    """One square per customer, as region code and WKT."""
    x, y = F.col("c_custkey") % 100 * 8, F.floor(F.col("c_custkey") / 100) * 8
    corner = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(" "), (y + dy).cast("string"))
    ring = F.concat_ws(", ", corner(0, 0), corner(4, 0), corner(4, 4), corner(0, 4), corner(0, 0))
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("code"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt")
    )


PARCEL_SQL = """(SELECT c_custkey, 'cb_' || c_custkey AS region, c_custkey % 100 * 8 AS x, c_custkey // 100 * 8 AS y FROM customer)"""
PARCEL_WKT_SQL = """'POLYGON ((' || x || ' ' || y || ', ' || (x + 4) || ' ' || y || ', ' || (x + 4) || ' ' || (y + 4) || ', '
    || x || ' ' || (y + 4) || ', ' || x || ' ' || y || '))'"""


@query("src_json_regions", f"SELECT region, {PARCEL_WKT_SQL} AS wkt FROM {PARCEL_SQL}")
def src_json_regions(spark, sf):
    path = scratch_path(spark, "regions")
    blank = [F.lit(None).cast("string")]
    row = F.array(*blank * 8, F.col("code"), *blank * 2, F.col("wkt"))
    documents = _parcels(spark, sf).groupBy(F.floor(F.col("c_custkey") / 200).alias("page")).agg(
        F.collect_list(row).alias("data")  # at most 200 rows per document
    )
    documents.select("data").write.option("ignoreNullFields", False).json(path)
    return regions.read_region_json(spark, path, one_document=False)


@query("src_ddl_schema", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS mode,
    CAST(o_orderkey AS DOUBLE) AS count FROM orders""")
def src_ddl_schema(spark, sf):
    feed = schemas.FEEDS["mta_overall_ridership_traffic"].schema
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("count"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("mode")
    )
    return project.align_to_schema(rows, feed).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("src_pandas_view", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS weight FROM nation WHERE n_nationkey >= 0")
def src_pandas_view(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("citylens_nation_view")
    view = spark.sql("SELECT n_name AS name, n_nationkey AS id FROM citylens_nation_view WHERE n_nationkey >= 0")
    schema = schemas.schema("id int, name string, weight double")
    return ordering.stack({0: spark.createDataFrame([], schema), 1: project.align_to_schema(view, schema)})


STRIP_SQL = "nullif(trim(" + "replace(" * 6 + r"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')" + "".join(
    f", '{e}', '{s}')" for e, s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
) + "), '')"
LIST_SQL = r"""(WITH lists AS (SELECT page_id, unnest(l) AS body, unnest(range(len(l))) AS i FROM
        (SELECT page_id, regexp_extract_all(html, '(?is)<(?:ul|ol)(?:\s[^>]*)?>(.*?)</(?:ul|ol)>', 1) AS l FROM pages)),
    items AS (SELECT page_id, i, regexp_extract_all(body, '(?is)<(?:li)(?:\s[^>]*)?>(.*?)</(?:li)>', 1) AS li FROM lists),
    best AS (SELECT page_id, li FROM items QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(li) DESC, i) = 1)
    SELECT page_id, unnest(range(len(li))) AS pos, unnest(li) AS raw FROM best)"""


def _list_rows(spark, sf):
    return markup.table_rows(table(spark, sf, "pages").select("page_id", "html"), table="ul|ol", row="li", cell="")


@query("src_html_table", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, {STRIP_SQL.format(c='raw')} AS item FROM {LIST_SQL}")
def src_html_table(spark, sf):
    return _list_rows(spark, sf).select("page_id", "pos", F.get("cells", F.lit(0)).alias("item"))


@query("src_html_nested", """SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY k) - 1 AS INTEGER) AS pos, cell0, cell1, cell2
    FROM (SELECT n_nationkey, -1 AS k, 'nation' AS cell0, 'supplier' AS cell1, 'supplier' AS cell2 FROM nation
    UNION ALL SELECT n_nationkey, s_suppkey, n_name, s_name, printf('%d', s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey)""")
def src_html_nested(spark, sf):
    """One page per nation: a layout table around a table without end tags, with a heading over two columns and a name over all rows."""
    suppliers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))  # the rows of one page
    named = table(spark, sf, "nation").select("n_nationkey", "n_name").join(suppliers, "n_nationkey", "left")
    row = lambda r: F.concat(F.lit("<td>"), r.s_name, F.lit("<td align='right'><i>"), r.s_suppkey.cast("string"), F.lit("</i>"))
    rows = F.array_join(F.transform("s", row), "<tr>")
    body = F.when(F.size("s") > 0, F.concat(F.lit("<tr><td rowspan="), F.size("s").cast("string"), F.lit(">"), F.col("n_name"), rows)).otherwise("")
    page = F.concat(
        F.lit("<html><table class='a>b'><tr><td>menu<td>text <table><!-- <tr><td>no --><thead><tr><th>nation<th colspan=2>supplier<tbody>"),
        body, F.lit("</table> more</td></tr></table>"),
    )
    found = markup.table_rows(named.select("n_nationkey", page.alias("html")))
    return found.select("n_nationkey", "pos", *[F.get("cells", F.lit(i)).alias(f"cell{i}") for i in range(3)])


# --- sinks -------------------------------------------------------------------------------------

SEGMENT_SQL = "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL"


def _segments(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("sink_parquet", SEGMENT_SQL)
def sink_parquet(spark, sf):
    path = scratch_path(spark, "sink")
    writers.write_parquet(_segments(spark, sf), path)
    return spark.read.parquet(path)


@query("sink_parquet_overwrite", SEGMENT_SQL)
def sink_parquet_overwrite(spark, sf):
    path = scratch_path(spark, "sink_over")
    writers.write_parquet(_segments(spark, sf).where(F.col("n") < 0), path)
    writers.write_parquet(_segments(spark, sf), path, overwrite=True)
    return spark.read.parquet(path)


@query("sink_csv", SEGMENT_SQL)
def sink_csv(spark, sf):
    path = scratch_path(spark, "sink_csv")
    writers.write_csv(_segments(spark, sf), path)
    return tabular.read_csv_typed(spark, path, "segment string, n bigint, balance double")


@query("sink_report", SEGMENT_SQL)
def sink_report(spark, sf):
    paths = writers.write_report({"segments": _segments(spark, sf)}, scratch_path(spark, "sink_report"))
    return spark.read.parquet(paths["segments"])


@query("materialize_once", SEGMENT_SQL)
def materialize_once(spark, sf):
    path = scratch_path(spark, "stage")
    writers.materialize_once(spark, path, lambda: _segments(spark, sf))
    return writers.materialize_once(spark, path, lambda: _segments(spark, sf).where(F.col("n") < 0))


@query("ctas", SEGMENT_SQL)
def ctas(spark, sf):
    path = scratch_path(spark, "ctas")
    return writers.create_table(_segments(spark, sf), "citylens_" + path[-32:], path=path)


# --- columns -----------------------------------------------------------------------------------

@query("project_cols", "SELECT event_id, event_type FROM events")
def project_cols(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type")


@query("project_exclude", "SELECT event_id, round(value * 1000, 2) AS weight FROM events")
def project_exclude(spark, sf):
    rows = b.trips(spark, sf).select(F.col("weight_text").alias("weight"), "event_id")
    return project.replace_last(rows, "weight", F.round(text.cast_commas("weight"), 2))


@query("project_align", "SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(NULL AS DOUBLE) AS transfers FROM events")
def project_align(spark, sf):
    return project.align_to_schema(table(spark, sf, "events"), schemas.schema("event_id bigint, user_id int, transfers double"))


@query("rename_col", "SELECT event_id AS id, event_type AS hour FROM events")
def rename_col(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return rows.withColumnRenamed("event_id", "id").withColumnRenamed("event_type", "hour")


@query("drop_cols_regex", "SELECT event_id AS id, user_id AS \"2024-01-01\" FROM events")
def drop_cols_regex(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("2024-01-01"), F.col("value").alias("Count"),
        F.col("value").alias("7 Day"), F.col("value").alias("Workday Mean"),
    )
    return project.drop_matching(rows, traffic.SUMMARY_COLUMNS)


@query("update_expr", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def update_expr(spark, sf):
    return table(spark, sf, "orders").withColumn("doubled", F.col("o_totalprice") * 2).select("o_orderkey", "doubled")


@query("flag_case", """SELECT CASE WHEN dispatch_area IN ('AO') THEN 'cbd' WHEN dispatch_area IN ('AF', 'NF') THEN 'bronx'
    WHEN dispatch_area IN ('NO', 'RO') THEN 'queens' END AS area_type,
    CASE WHEN severity_code IN ('1', '2', '3') THEN 'life_threat' ELSE 'non_life_threat' END AS init_severity,
    count(*) AS n FROM """ + b.INCIDENTS_SQL + " GROUP BY ALL")
def flag_case(spark, sf):
    return b.incidents(spark, sf).groupBy(
        rules.label_by_sets(F.col("dispatch_area"), b.AREAS).alias("area_type"),
        rules.label_by_sets(F.col("severity_code"), {"life_threat": b.LIFE_THREAT}, "non_life_threat").alias("init_severity"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("rules_first_match", f"SELECT person_id, {b.SEVERITY_SQL} AS severity FROM {b.PERSONS_SQL}")
def rules_first_match(spark, sf):
    letter = rules.severity("PERSON_INJURY", "EMOTIONAL_STATUS", "COMPLAINT", "BODILY_INJURY")
    return b.persons(spark, sf).select("person_id", letter.alias("severity"))


KEPT_AREAS = ["n1", "n2", "n3"]


@query("where_else", """SELECT CASE WHEN a IN ('n1', 'n2', 'n3') THEN a ELSE 'Other' END AS grouped, count(*) AS n
    FROM (SELECT nullif(area, 'n4') AS a FROM """ + b.PERSONS_SQL + ") GROUP BY ALL")
def where_else(spark, sf):
    area = F.nullif("area", F.lit("n4"))
    return b.persons(spark, sf).groupBy(project.keep_or(area, KEPT_AREAS, "Other").alias("grouped")).agg(F.count(F.lit(1)).alias("n"))


VALID_SQL = "(SELECT site, month FROM " + b.DAILY_SQL + " GROUP BY ALL HAVING count(*) >= 50)"


def _valid_site_months(spark, sf):
    return b.daily(spark, sf).groupBy("site", "month").agg(F.count(F.lit(1)).alias("n")).where("n >= 50").select("site", "month")


@query("null_out", f"""SELECT d.site, d.date, d.method, CASE WHEN v.site IS NOT NULL THEN value END AS value
    FROM {b.DAILY_SQL} d LEFT JOIN {VALID_SQL} v ON d.site = v.site AND d.month = v.month""")
def null_out(spark, sf):
    rows = project.blank_unless(b.daily(spark, sf), "value", _valid_site_months(spark, sf), ["site", "month"])
    return rows.select("site", "date", "method", "value")


# --- filters -----------------------------------------------------------------------------------

@query("filter_isin", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IN ('O', 'P')")
def filter_isin(spark, sf):
    return table(spark, sf, "orders").where(F.nullif("o_orderstatus", F.lit("P")).isin("O", "P")).select("o_orderkey")


@query("filter_not_in", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') NOT IN ('O')")
def filter_not_in(spark, sf):
    return table(spark, sf, "orders").where(~F.nullif("o_orderstatus", F.lit("P")).isin("O")).select("o_orderkey")


@query("filter_any_list", """SELECT event_type, CAST(sum(CASE WHEN name = ANY(['NATION_1', 'NATION_3']) THEN 1 ELSE 0 END) AS BIGINT) AS n
    FROM (SELECT event_type, CASE WHEN user_id % 7 <> 0 THEN 'NATION_' || (user_id % 25) END AS name FROM events) GROUP BY ALL""")
def filter_any_list(spark, sf):
    name = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(F.coalesce(name.isin("NATION_1", "NATION_3"), F.lit(False))).alias("n")
    )


VEHICLES_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS v1, o_orderstatus AS v2,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Taxi' END AS v3, c_mktsegment AS v4, CASE WHEN c_nationkey = 7 THEN 'Taxi' END AS v5,
    CASE WHEN o_orderkey % 2 = 0 THEN '1.6' ELSE '0' END AS injured,
    CASE WHEN o_orderkey % 11 = 0 THEN '1' WHEN o_orderkey % 4 = 0 THEN NULL ELSE '0.4' END AS killed,
    month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS crash_date, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _vehicles(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key, F.when(key % 3 == 0, F.col("o_orderpriority")).alias("VEHICLE_1"), F.col("o_orderstatus").alias("VEHICLE_2"),
        F.when(key % 5 == 0, "Taxi").alias("VEHICLE_3"), F.col("c_mktsegment").alias("VEHICLE_4"),
        F.when(F.col("c_nationkey") == 7, "Taxi").alias("VEHICLE_5"),
        F.when(key % 2 == 0, "1.6").otherwise("0").alias("INJURED"),
        F.when(key % 11 == 0, "1").when(key % 4 == 0, None).otherwise("0.4").alias("KILLED"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("CRASH_DATE"), "c_nationkey",
    )


@query("filter_any_of_cols", f"SELECT o_orderkey FROM {VEHICLES_SQL} WHERE v1 = 'Taxi' OR v2 = 'Taxi' OR v3 = 'Taxi' OR v4 = 'Taxi' OR v5 = 'Taxi'")
def filter_any_of_cols(spark, sf):
    return _vehicles(spark, sf).where(project.any_equal([f"VEHICLE_{i}" for i in range(1, 6)], "Taxi")).select("o_orderkey")


@query("filter_numeric_or", f"SELECT o_orderkey FROM {VEHICLES_SQL} WHERE CAST(injured AS INTEGER) > 0 OR CAST(killed AS INTEGER) > 0")
def filter_numeric_or(spark, sf):
    hurt = (text.text_to_int("INJURED") > 0) | (text.text_to_int("KILLED") > 0)
    return _vehicles(spark, sf).where(hurt).select("o_orderkey")


@query("filter_contains", """SELECT p_partkey, p_type FROM part WHERE (contains(p_brand, '#1') OR contains(p_brand, '#2'))
    AND NOT contains(p_type, 'BRASS')""")
def filter_contains(spark, sf):
    chosen = F.col("p_brand").rlike("#1|#2") & ~F.col("p_type").contains("BRASS")
    return table(spark, sf, "part").where(chosen).select("p_partkey", "p_type")


@query("filter_prefix_suffix", "SELECT site, year_month, count(*) AS n FROM " + b.DAILY_SQL + " WHERE year_month LIKE '1996%' AND site LIKE '%3' GROUP BY ALL")
def filter_prefix_suffix(spark, sf):
    chosen = F.col("year_month").startswith("1996") & F.col("site").endswith("3")
    return b.daily(spark, sf).where(chosen).groupBy("site", "year_month").agg(F.count(F.lit(1)).alias("n"))


@query("filter_regex", r"""SELECT event_id, mark FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL
    WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M:%S') ELSE event_type END AS mark FROM events)
    WHERE regexp_matches(mark, '^\d{2}:\d{2}:\d{2}')""")
def filter_regex(spark, sf):
    mark = F.when(F.col("event_id") % 3 == 1, dates.time_of_day("ts")).when(F.col("event_id") % 3 == 2, F.col("event_type"))
    return table(spark, sf, "events").select("event_id", mark.alias("mark")).where(F.col("mark").rlike(r"^\d{2}:\d{2}:\d{2}"))


@query("filter_between", "SELECT site, date, method FROM " + b.DAILY_SQL + " WHERE month BETWEEN 3 AND 5")
def filter_between(spark, sf):
    return b.daily(spark, sf).where(F.col("month").between(3, 5)).select("site", "date", "method")


@query("filter_month_range", "SELECT site, date, method FROM " + b.DAILY_SQL + " WHERE month >= 11 OR month <= 2")
def filter_month_range(spark, sf):
    return b.daily(spark, sf).where(dates.in_month_range(F.month("date"), 11, 2)).select("site", "date", "method")


@query("filter_combo", "SELECT site, date, method, source FROM " + b.DAILY_SQL + " WHERE method IN ('1-URGENT', '2-HIGH') OR source = 'P'")
def filter_combo(spark, sf):
    chosen = F.col("method").isin("1-URGENT", "2-HIGH") | (F.col("source") == "P")
    return b.daily(spark, sf).where(chosen).select("site", "date", "method", "source")


@query("head_rows", f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < 2 THEN 'All' WHEN pos < 4 THEN 'Northbound'
    ELSE 'Southbound' END AS direction FROM {LIST_SQL} WHERE pos < 6""")
def head_rows(spark, sf):
    blocks = _list_rows(spark, sf).select("page_id", "pos", traffic.block_label("pos", size=2).alias("direction"))
    return blocks.where("direction IS NOT NULL")


# --- lookups and labels ----------------------------------------------------------------------------

BOARD_SQL = """CASE WHEN n BETWEEN 101 AND 112 THEN 'Manhattan Community Board ' || (n - 100)
    WHEN n = 164 THEN 'Central Park' ELSE 'cb_' || n END"""
CODED_SQL = "(SELECT event_id, value, 100 + user_id % 70 AS n, 100 + event_id % 16 AS m FROM events)"


def _coded(spark, sf):
    code = lambda c, k: F.concat(F.lit("cb_"), (F.col(c) % k + 100).cast("string"))
    return table(spark, sf, "events").select(
        "event_id", "value", code("user_id", 70).alias("origin_region"), code("event_id", 16).alias("destination_region")
    )


@query("join_lookup_default", f"SELECT event_id, {BOARD_SQL} AS origin FROM {CODED_SQL}")
def join_lookup_default(spark, sf):
    rows = joins.lookup_default(_coded(spark, sf), "origin_region", places.board_labels(spark), "origin")
    return rows.select("event_id", "origin")


def _flow(spark, sf):
    return _coded(spark, sf).groupBy("origin_region", "destination_region").agg(F.sum("value").alias("trips"))


@query("filter_od_labels", f"""SELECT origin, destination, origin || ' to ' || destination || ': '
        || format('{{:,}}', CAST(trunc(sum(value)) AS BIGINT)) || ' trips' AS line FROM (SELECT value, {BOARD_SQL} AS origin,
    CASE WHEN m BETWEEN 101 AND 112 THEN 'Manhattan Community Board ' || (m - 100) ELSE 'cb_' || m END AS destination FROM {CODED_SQL})
    WHERE origin = 'Manhattan Community Board 7' AND contains(destination, 'Manhattan') GROUP BY origin, destination""")
def filter_od_labels(spark, sf):
    named = trips.named_flow(_flow(spark, sf), places.board_labels(spark))
    return trips.flow_lines(named, "Manhattan Community Board 7", "Manhattan", "trips")


SITES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(air.HOURLY_SITES)) + ") AS s(i, code, label)"


@query("join_replace_codes", f"""SELECT event_id, coalesce(label, 'x' || user_id % 30) AS site FROM events
    LEFT JOIN {SITES_SQL} ON i = user_id % 30""")
def join_replace_codes(spark, sf):
    codes = F.array(*[F.lit(c) for c, _ in air.HOURLY_SITES])
    slot = (F.col("user_id") % 30).cast("int")
    rows = table(spark, sf, "events").select(
        "event_id", F.coalesce(F.get(codes, slot), F.concat(F.lit("x"), slot.cast("string"))).alias("code")
    )
    names = b.parameter_table(spark, "code string, label string", air.HOURLY_SITES)
    return joins.lookup_default(rows, "code", names, "site").select("event_id", "site")


@query("join_valid_months", f"SELECT d.site, d.date, d.method FROM {b.DAILY_SQL} d SEMI JOIN {VALID_SQL} v ON d.site = v.site AND d.month = v.month")
def join_valid_months(spark, sf):
    return joins.keep_listed(b.daily(spark, sf), _valid_site_months(spark, sf), ["site", "month"]).select("site", "date", "method")


@query("join_inner_equi", """SELECT o_orderpriority AS priority, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def join_inner_equi(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    joined = table(spark, sf, "lineitem").join(orders, "l_orderkey", "inner")
    return joined.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


ZONE_OF = "n_regionkey"


def _zones(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), (F.col(ZONE_OF) == 0).alias("cbd"), (F.col(ZONE_OF) == 1).alias("other_manhattan"),
        (F.col(ZONE_OF) != 0).alias("outside_cbd"),
    )


def named_trips(spark, sf):
    name = lambda c: F.concat(F.lit("NATION_"), (F.col(c) % 25).cast("string"))
    return table(spark, sf, "events").select(
        "event_type", "ts", F.when(F.col("event_id") % 9 != 0, name("user_id")).alias("start_name"), name("event_id").alias("end_name")
    )


NAMED_SQL = """(SELECT event_type, ts, s.n_regionkey AS s, e.n_regionkey AS e FROM events
    LEFT JOIN nation s ON s.n_nationkey = user_id % 25 AND event_id % 9 <> 0 LEFT JOIN nation e ON e.n_nationkey = event_id % 25)"""


@query("join_zone_dim", f"SELECT event_type, coalesce(s = 0, false) AS s_cbd, coalesce(e <> 0, false) AS e_out, count(*) AS n FROM {NAMED_SQL} GROUP BY ALL")
def join_zone_dim(spark, sf):
    zones = _zones(spark, sf)
    rows = joins.zone_flags(named_trips(spark, sf), "start_name", zones, {"cbd": "s_cbd"})
    rows = joins.zone_flags(rows, "end_name", zones, {"outside_cbd": "e_out"})
    return rows.groupBy("event_type", "s_cbd", "e_out").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions --------------------------------------------------------------------------------

@query("fn_try_cast_commas", """SELECT event_id, TRY_CAST(replace(t, ',', '') AS INTEGER) AS seconds FROM
    (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE weight_text END AS t FROM """ + b.TRIPS_SQL + ")")
def fn_try_cast_commas(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, "n/a").when(F.col("event_id") % 4 > 1, F.col("weight_text"))
    return b.trips(spark, sf).select("event_id", text.try_int_commas(raw).alias("seconds"))


@query("fn_cast_commas", "SELECT event_id, CAST(replace(weight_text, ',', '') AS DOUBLE) AS weight FROM " + b.TRIPS_SQL)
def fn_cast_commas(spark, sf):
    return b.trips(spark, sf).select("event_id", text.cast_commas("weight_text").alias("weight"))


@query("fn_clean_text", "SELECT person_id, upper(trim(\"EMOTIONAL_STATUS\")) AS status FROM " + b.PERSONS_SQL)
def fn_clean_text(spark, sf):
    return b.persons(spark, sf).select("person_id", text.clean_text("EMOTIONAL_STATUS").alias("status"))


@query("fn_split_index", """SELECT o_orderkey, split_part(m, '-', 2) AS month,
    CASE WHEN len(string_split(m, '-')) >= 4 THEN '' END AS missing FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS m FROM orders)""")
def fn_split_index(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.split_index(day, "-", 2).alias("month"), text.split_index(day, "-", 4).alias("missing")
    )


@query("fn_substr", "SELECT event_id, substr(strftime(ts, '%Y-%m-%d %H:%M'), 1, 7) AS year_month FROM events")
def fn_substr(spark, sf):
    return table(spark, sf, "events").select("event_id", F.substring(F.col("ts").cast("string"), 1, 7).alias("year_month"))


@query("fn_pad", "SELECT event_id, CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS padded FROM (SELECT event_id, user_id % 120 AS n FROM events)")
def fn_pad(spark, sf):
    return table(spark, sf, "events").select("event_id", text.pad2(F.col("user_id") % 120).alias("padded"))


@query("fn_concat_label", "SELECT site, CAST(month AS VARCHAR) || '/' || year AS label, count(*) AS n FROM " + b.DAILY_SQL + " GROUP BY ALL")
def fn_concat_label(spark, sf):
    label = F.concat(F.col("month").cast("string"), F.lit("/"), F.col("year").cast("string"))
    return b.daily(spark, sf).groupBy("site", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_thousands", "SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)) AS price FROM orders")
def fn_thousands(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.thousands("o_totalprice").alias("price"))


@query("fn_regex_groups", f"""SELECT event_id, CASE WHEN n BETWEEN 101 AND 112 THEN 'Manhattan' ELSE {BOARD_SQL} END AS area,
    CAST(CASE WHEN n BETWEEN 101 AND 112 THEN n - 100 ELSE 0 END AS INTEGER) AS number FROM {CODED_SQL}""")
def fn_regex_groups(spark, sf):
    rows = joins.lookup_default(_coded(spark, sf), "origin_region", places.board_labels(spark), "origin")
    return rows.select("event_id", text.natural_name("origin").alias("area"), text.natural_number("origin").alias("number"))


@query("fn_extract", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
    CAST(day(o_orderdate) AS INTEGER) AS d FROM orders""")
def fn_extract(spark, sf):
    when = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.year(when).alias("y"), F.month(when).alias("m"), F.dayofmonth(when).alias("d"))


@query("fn_parse_strict", f"SELECT o_orderkey, CAST(strptime(crash_date, '%m/%d/%Y') AS DATE) AS day FROM {VEHICLES_SQL}")
def fn_parse_strict(spark, sf):
    return _vehicles(spark, sf).select("o_orderkey", F.to_date(dates.parse_strict("CRASH_DATE")).alias("day"))


@query("fn_parse_coerce", f"SELECT person_id, CAST(try_strptime(\"CRASH_DATE\", '%m/%d/%Y') AS DATE) AS day FROM {b.PERSONS_SQL}")
def fn_parse_coerce(spark, sf):
    return b.persons(spark, sf).select("person_id", F.to_date(dates.parse_coerce("CRASH_DATE")).alias("day"))


# New York is five hours behind UTC in January, the only month of the events table
LOCAL_SQL = "(ts - INTERVAL 5 HOUR)"


@query("fn_tz_convert", f"SELECT event_id, strftime({LOCAL_SQL}, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def fn_tz_convert(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(dates.utc_to_local("ts"), "yyyy-MM-dd HH:mm:ss").alias("local"))


# The rule of the years of the orders table: daylight time from the first Sunday of April to the last of October, both at two o'clock.
CHANGES_SQL = """(SELECT o_orderkey, utc, utc - CASE WHEN utc >= spring + INTERVAL 7 HOUR AND utc < autumn + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS local
    FROM (SELECT o_orderkey, utc, make_date(year(utc), 4, 1 + (7 - isodow(make_date(year(utc), 4, 1))) % 7)::TIMESTAMP AS spring,
    make_date(year(utc), 10, CAST(31 - isodow(make_date(year(utc), 10, 31)) % 7 AS BIGINT))::TIMESTAMP AS autumn
    FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_minutes(CAST(o_orderkey * 7 % 1440 AS BIGINT)) AS utc FROM orders)))"""


@query("fn_tz_changes", f"""SELECT o_orderkey, strftime(local, '%Y-%m-%d %H:%M:%S') AS local, CAST(local AS DATE) AS day, strftime(local, '%H:%M:%S') AS time
    FROM {CHANGES_SQL}""")
def fn_tz_changes(spark, sf):
    """Seven years of local times, across every change of the clock."""
    utc = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o_orderkey * 7 % 1440 AS INT), 0)")
    local = dates.utc_to_local(utc)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"), F.to_date(local).alias("day"), dates.time_of_day(local).alias("time")
    )


@query("fn_date_time_split", f"SELECT event_id, CAST({LOCAL_SQL} AS DATE) AS day, strftime({LOCAL_SQL}, '%H:%M:%S') AS time FROM events")
def fn_date_time_split(spark, sf):
    local = dates.utc_to_local("ts")
    return table(spark, sf, "events").select("event_id", F.to_date(local).alias("day"), dates.time_of_day(local).alias("time"))


@query("fn_fractional_hour", "SELECT event_id, round(hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600, 6) AS hour FROM events")
def fn_fractional_hour(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(dates.fractional_hour("ts"), 6).alias("hour"))


@query("fn_year_month", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def fn_year_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.month_start(F.year("o_orderdate"), F.month("o_orderdate")).alias("month"))


@query("fn_format_date", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, month(ts) || '/' || year(ts) AS label FROM events")
def fn_format_date(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.date_format("ts", "M/yyyy").alias("label")
    )


@query("fn_epoch_diff", "SELECT event_id, round(epoch(ts - TIMESTAMP '2024-01-01 00:00:00'), 6) AS seconds FROM events")
def fn_epoch_diff(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", F.round(dates.seconds_between(start, "ts"), 6).alias("seconds"))


@query("fn_day_type", f"SELECT o_orderkey, {b.DAY_TYPE_SQL.format(d='o_orderdate')} AS day_type FROM orders")
def fn_day_type(spark, sf):
    holidays = traffic.holiday_table(spark, b.TEST_HOLIDAYS)
    return dates.with_day_type(table(spark, sf, "orders"), "o_orderdate", holidays).select("o_orderkey", "day_type")


@query("fn_round", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS part FROM orders")
def fn_round(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / 7, 2).alias("part"))


@query("fn_nullif_zero", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def fn_nullif_zero(spark, sf):
    ratio = F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(ratio, 6).alias("ratio"))


@query("fn_coalesce", "SELECT person_id, coalesce(\"EMOTIONAL_STATUS\", 'Unknown') AS status FROM " + b.PERSONS_SQL)
def fn_coalesce(spark, sf):
    return b.persons(spark, sf).select("person_id", F.coalesce("EMOTIONAL_STATUS", F.lit("Unknown")).alias("status"))


# --- sorting and sets ----------------------------------------------------------------------------------

@query("sort_multi", """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
    ORDER BY priority NULLS LAST, o_orderkey""")
def sort_multi(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return ordering.sort_nulls_last(rows, "priority", "o_orderkey")


@query("sort_natural", f"SELECT origin, count(*) AS n FROM (SELECT {BOARD_SQL} AS origin FROM {CODED_SQL}) GROUP BY ALL")
def sort_natural(spark, sf):
    rows = joins.lookup_default(_coded(spark, sf), "origin_region", places.board_labels(spark), "origin")
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).orderBy(*text.natural_order("origin"))


@query("limit_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 30")
def limit_n(spark, sf):
    return table(spark, sf, "orders").orderBy("o_custkey", "o_orderkey").limit(30).select("o_orderkey", "o_custkey")


@query("topk_latest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 3")
def topk_latest(spark, sf):
    return ordering.latest(table(spark, sf, "events"), "ts", 3, "event_id").select("event_id", "event_type")


@query("union_all", """SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS kind, NULL AS size FROM customer
    UNION ALL SELECT p_partkey, NULL, 'part', p_size FROM part""")
def union_all(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return ordering.stack({"customer": customers, "part": parts}, "kind")


@query("dedupe_keys", """SELECT o_custkey, o_orderdate AS first_date, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def dedupe_keys(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("first_date"), "o_orderkey")
    return ordering.first_per_key(rows, ["o_custkey"], ["first_date"])


@query("geo_point_wkt", "SELECT event_id, ox AS x, oy AS y FROM " + b.TRIPS_SQL)
def geo_point_wkt(spark, sf):
    wkt = F.concat(F.lit("POINT ("), F.col("ox").cast("string"), F.lit(" "), F.col("oy").cast("string"), F.lit(")"))
    return b.trips(spark, sf).select("event_id", geo.point_from_wkt(wkt).alias("p")).select("event_id", "p.x", "p.y")


@query("geo_latlon_text", "SELECT event_id, ox AS x, oy AS y FROM " + b.TRIPS_SQL)
def geo_latlon_text(spark, sf):
    pair = F.concat(F.lit("("), F.col("oy").cast("string"), F.lit(", "), F.col("ox").cast("string"), F.lit(")"))
    return b.trips(spark, sf).select("event_id", geo.point_from_latlon(pair).alias("p")).select("event_id", "p.x", "p.y")


@query("geo_point", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ox END AS x, CASE WHEN event_id % 5 <> 0 THEN oy END AS y
    FROM """ + b.TRIPS_SQL)
def geo_point(spark, sf):
    rows = b.trips(spark, sf).withColumn("lat", F.when(F.col("event_id") % 5 != 0, F.col("oy")))
    return geo.with_point(rows, "ox", "lat").select("event_id", "x", "y")


@query("geo_geojson_point", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'POINT (' || ox || ' ' || oy || ')' END AS georeference
    FROM """ + b.TRIPS_SQL)
def geo_geojson_point(spark, sf):
    feature = F.struct(F.lit("Point").alias("type"), F.array("ox", "oy").alias("coordinates"))
    rows = b.trips(spark, sf).withColumn("geometry", F.when(F.col("event_id") % 3 != 0, feature))
    return rows.select("event_id", geo.geojson_point_wkt("geometry").alias("georeference"))


@query("geo_polygon_wkt", f"""SELECT region, CAST(x + a AS DOUBLE) AS x1, CAST(y + b AS DOUBLE) AS y1, CAST(x + c AS DOUBLE) AS x2,
    CAST(y + d AS DOUBLE) AS y2 FROM {PARCEL_SQL}, (VALUES (0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)) AS e(a, b, c, d)""")
def geo_polygon_wkt(spark, sf):
    parcels = _parcels(spark, sf).select(F.concat(F.lit("cb_"), "code").alias("region"), "wkt")
    return geo.polygon_edges(parcels).drop("ring")


@query("unpivot_long", """SELECT hour, date, n FROM (SELECT CAST(hour(ts) AS INTEGER) AS hour, """ + ", ".join(
    f"CAST(sum(CASE WHEN day(ts) = {d} THEN 1 END) AS BIGINT) AS \"2024-01-{d:02d}\"" for d in range(1, 31)
) + " FROM events GROUP BY ALL) UNPIVOT INCLUDE NULLS (n FOR date IN (" + ", ".join(f'"2024-01-{d:02d}"' for d in range(1, 31)) + "))")
def unpivot_long(spark, sf):
    days = [f"2024-01-{d:02d}" for d in range(1, 31)]
    events = table(spark, sf, "events").select(F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    wide = events.groupBy("hour").pivot("date", days).count()
    return reshape.unpivot_long(wide, ["hour"], None, "date", "n")
