"""Queries over the catalogue: search, summaries, places, duplicates, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo, text
from lodestrata.operators import neighbours, rollups, search
from lodestrata.sources import tables as t

ITEMS = """items AS (
  SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, ts,
    CASE WHEN event_id % 7 <> 0 THEN CAST((user_id * 37) % 1800 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) + CAST(0.05 AS DOUBLE) END AS lat,
    CASE WHEN event_id % 7 <> 0 THEN CAST((user_id * 53) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) + CAST(0.05 AS DOUBLE) END AS lon,
    'evt_' || event_id AS name, CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS size, sha256(CAST(event_id AS VARCHAR)) AS content_hash, user_id
  FROM events)"""
CELL = "CAST(CAST(floor(lat * CAST(10 AS DOUBLE)) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon * CAST(10 AS DOUBLE)) AS BIGINT) AS VARCHAR)"
KM = lambda a, b: f"CAST(12742 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lon - {b}) / 2), 2))))"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {ITEMS} SELECT id, kind, day, name FROM items WHERE kind = 'click' AND day BETWEEN '2024-01-05' AND '2024-01-20' AND contains(lower(name), 'evt') AND contains(lower(name), '1') ORDER BY day DESC NULLS LAST, name DESC, id LIMIT 80 OFFSET 20")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    spec = search.Search(q="EVT 1", kind="click", year="2024", after="2024-01-05", before="2024-01-20", offset=20, limit=80)
    return search.page(t.items(spark, d), spec).select("id", "kind", "day", "name")


@query(f"WITH {ITEMS} SELECT id, round({KM(-60, -137)}, 6) AS km FROM items WHERE lat IS NOT NULL AND {KM(-60, -137)} <= 2000")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(t.items(spark, d), search.Search(near=(-60.0, -137.0, 2000.0)))
    return found.select("id", F.round(geo.haversine_km(F.lit(-60.0), F.lit(-137.0), F.col("lat"), F.col("lon")), 6).alias("km"))


@query(f"WITH {ITEMS} SELECT id, day FROM items WHERE lat IS NULL")
def kind_unknown(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.items(spark, d), search.Search(kind="unknown")).select("id", "day")


@query(f"WITH {ITEMS} SELECT id, name FROM items WHERE day IS NULL")
def kind_undated(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.items(spark, d), search.Search(kind="undated")).select("id", "name")


@query(f"WITH {ITEMS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM items WHERE lat IS NOT NULL")
def kind_located(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.items(spark, d), search.Search(kind="located")).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {ITEMS} SELECT id FROM items WHERE starts_with(day, '2024') AND {CELL} IN ('-197:-793', '-36:-1584')")
def place_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.search(t.items(spark, d), search.Search(year="2024", place="-197:-793,-36:-1584")).select("id")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def text_terms_all(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").where(text.all_terms(F.col("text"), "The TION")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_filter(spark: SparkSession, d: str) -> DataFrame:
    c = rollups.size_candidates(t.contents(spark, d))
    repeated = c.groupBy(F.col("content_hash").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")
    return c.join(repeated, F.col("content_hash") == F.col("h"), "left_semi").select("doc_id")


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, CAST(sum(n_chars) * (count(*) - 1) // count(*) AS BIGINT) AS extra_bytes FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return rollups.duplicate_groups(rollups.size_candidates(t.contents(spark, d)))


@query("""WITH g AS (SELECT text, count(*) AS c, sum(n_chars) AS b FROM documents GROUP BY text)
SELECT count(*) AS contents, count(*) FILTER (c > 1) AS dup_groups, CAST(coalesce(sum(c - 1) FILTER (c > 1), 0) AS BIGINT) AS extra_files,
  CAST(coalesce(sum(b * (c - 1) // c) FILTER (c > 1), 0) AS BIGINT) AS extra_bytes FROM g""")
def dup_summary(spark: SparkSession, d: str) -> DataFrame:
    g = t.contents(spark, d).groupBy("content_hash").agg(F.count("*").alias("c"), F.sum("size").alias("b"))
    more = F.col("c") > 1
    total = lambda x: F.coalesce(F.sum(F.when(more, x)), F.lit(0))
    return g.agg(F.count("*").alias("contents"), F.count_if(more).alias("dup_groups"), total(F.col("c") - 1).alias("extra_files"), total(F.expr("b * (c - 1) div c")).alias("extra_bytes"))


@query(f"""WITH {ITEMS} SELECT count(*) AS items, count(*) FILTER (day IS NULL) AS undated, count(*) FILTER (lat IS NOT NULL) AS located, count(*) FILTER (kind = 'click') AS clicks,
  count(DISTINCT kind) AS kinds, min(day) AS first, max(day) AS last, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM items""")
def library_summary(spark: SparkSession, d: str) -> DataFrame:
    return rollups.library_summary(t.items(spark, d))


@query(f"""WITH {ITEMS}, o AS (SELECT substr(day, 1, 4) AS year, substr(day, 6, 2) AS month, row_number() OVER (ORDER BY day DESC NULLS LAST, name DESC, id) - 1 AS o FROM items)
SELECT year, month, count(*) AS n, min(o) AS "offset" FROM o GROUP BY year, month""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return rollups.timeline(t.items(spark, d))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders)
SELECT year, month, count(*) AS n, CAST(grouping(year, month) AS INTEGER) AS level FROM o GROUP BY ROLLUP (year, month)""")
def timeline_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.timeline_rollup(t.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))


@query(f"""WITH {ITEMS} SELECT {CELL} AS cell, count(*) AS n, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, min(day) AS first, max(day) AS last,
  first(id ORDER BY day DESC NULLS LAST, name DESC, id) AS cover FROM items WHERE lat IS NOT NULL GROUP BY 1""")
def places_grid(spark: SparkSession, d: str) -> DataFrame:
    return rollups.places(t.items(spark, d)).withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


def _nations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    return t.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_id"), (k * 7.1 - 85.0).alias("s_lat"), (k * 14.2 - 175.0).alias("s_lon"), "n_regionkey")


_NEAREST = f"""WITH {ITEMS}, p AS (SELECT DISTINCT {CELL} AS cell, lat, lon FROM items WHERE lat IS NOT NULL),
s AS (SELECT n_nationkey AS s_id, CAST(n_nationkey AS DOUBLE) * CAST(7.1 AS DOUBLE) - CAST(85 AS DOUBLE) AS s_lat, CAST(n_nationkey AS DOUBLE) * CAST(14.2 AS DOUBLE) - CAST(175 AS DOUBLE) AS s_lon, n_regionkey FROM nation),
m AS (SELECT cell, s_id, n_regionkey, cos(radians(lat)) * cos(radians(lon)) * cos(radians(s_lat)) * cos(radians(s_lon)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(s_lat)) * sin(radians(s_lon)) + sin(radians(lat)) * sin(radians(s_lat)) AS dot FROM p, s),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(dot, 12) DESC, s_id) = 1)"""


@query(_NEAREST + " SELECT cell, s_id, round(CAST(6371 AS DOUBLE) * acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), dot))), 3) AS km FROM best")
def nearest_settlement(spark: SparkSession, d: str) -> DataFrame:
    i = t.items(spark, d).where("lat is not null")
    cells = i.groupBy(geo.cell_key(F.col("lat"), F.col("lon")).alias("cell")).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    return neighbours.nearest_place(cells, _nations(spark, d)).withColumn("km", F.round("km", 3))


@query(_NEAREST + f""", c AS (SELECT {CELL} AS cell, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM items WHERE lat IS NOT NULL GROUP BY 1)
SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n, round(sum(lat * n) / sum(n), 6) AS lat, round(sum(lon * n) / sum(n), 6) AS lon, count(*) AS cells FROM c JOIN best USING (cell) GROUP BY n_regionkey""")
def weighted_place_merge(spark: SparkSession, d: str) -> DataFrame:
    cells = rollups.places(t.items(spark, d)).select("cell", "n", "lat", "lon")
    near = neighbours.nearest_place(cells, _nations(spark, d)).select(F.col("cell").alias("c2"), "s_id")
    met = cells.join(near, F.col("cell") == F.col("c2")).join(F.broadcast(_nations(spark, d).select(F.col("s_id").alias("s2"), "n_regionkey")), F.col("s_id") == F.col("s2"))
    return rollups.merged_places(met, ["n_regionkey"]).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def people_summary(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    met = t.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def untagged(spark: SparkSession, d: str) -> DataFrame:
    """Rows that carry none of the tags asked for: customers without an urgent order."""
    urgent = t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return t.table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, arg_min(l_partkey, row(l_linenumber, l_partkey)) AS first_part, arg_max(l_partkey, row(l_linenumber, l_partkey)) AS last_part
FROM lineitem GROUP BY l_orderkey""")
def album_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = t.table(spark, d, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("last_part"))


@query("""WITH k AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY h) AS INTEGER) AS rank FROM k QUALIFY rank <= 8""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select("doc_id", "lang", "source")
    return rollups.stratified_sample(docs, ["lang", "source"], F.col("doc_id"), 8)


@query(f"""WITH {ITEMS}, o AS (SELECT id, day, row_number() OVER (ORDER BY day, id) - 1 AS "at", count(*) OVER () AS n FROM items WHERE day IS NOT NULL),
k AS (SELECT DISTINCT CAST(round_even(CAST(i AS DOUBLE) * CAST(n - 1 AS DOUBLE) / CAST(23 AS DOUBLE), 0) AS BIGINT) AS "at" FROM range(24) r(i), (SELECT max(n) AS n FROM o))
SELECT id, day, "at" FROM o WHERE "at" IN (SELECT "at" FROM k)""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    return rollups.highlights(t.items(spark, d), 24).select("id", "day", F.col("at").cast("long").alias("at"))


_ENTRIES = "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation"


def _entries(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    columns = {"customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name"), "nation": ("n_nationkey", "n_name")}
    return {k: t.table(spark, d, k).select(F.col(i).cast("long").alias("id"), F.col(n).alias("name")) for k, (i, n) in columns.items()}


@query(f"WITH e AS ({_ENTRIES}) SELECT kind, id, name FROM e WHERE contains(lower(name), '1') ORDER BY CASE WHEN starts_with(lower(name), '1') THEN 0 ELSE 1 END, lower(name), kind, id LIMIT 20")
def suggest_prefix(spark: SparkSession, d: str) -> DataFrame:
    frames = [f.select(F.lit(k).alias("kind"), "id", "name") for k, f in _entries(spark, d).items()]
    return search.suggest(frames[0].unionByName(frames[1]).unionByName(frames[2]), "1")


@query(f"""WITH e AS ({_ENTRIES}), f AS (SELECT kind, CAST(id AS VARCHAR) AS id, name, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY lower(name), CAST(id AS VARCHAR)) AS r FROM e WHERE contains(lower(name), 'a') AND contains(lower(name), 'n'))
SELECT kind, id, name, total FROM f WHERE r <= 10""")
def everything_search(spark: SparkSession, d: str) -> DataFrame:
    return search.everything(_entries(spark, d), "a N")


@query("SELECT conv_id AS content, turn AS start FROM conversations WHERE contains(lower(text), 'tion') AND contains(lower(text), 'an') AND role = 'assistant'")
def moments_search(spark: SparkSession, d: str) -> DataFrame:
    return t.segments(spark, d).where(F.col("role") == "assistant").where(text.all_terms(F.col("text"), "tion an")).select("content", "start")


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS BIGINT) AS chunk FROM orders")
def chunk_by_value(spark: SparkSession, d: str) -> DataFrame:
    return rollups.chunked(t.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 5)


@query(f"WITH {ITEMS} SELECT id, day FROM items ORDER BY day ASC NULLS LAST, id LIMIT 500")
def slideshow(spark: SparkSession, d: str) -> DataFrame:
    return search.slideshow(t.items(spark, d), search.Search()).select("id", "day")


@query("""SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars = 0) AS empty,
  CAST(count(*) - count(DISTINCT text) AS BIGINT) AS repeats FROM documents GROUP BY lang""")
def export_audit(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "documents").select("lang", "source", "n_chars", F.sha2("text", 256).alias("h"))
    return c.groupBy("lang").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") == 0).alias("empty"), (F.count("*") - F.count_distinct("h")).alias("repeats"))


@query("""WITH n AS (SELECT conv_id, list(turn) AS have, max(turn) AS last FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id)
SELECT conv_id, CAST(x AS BIGINT) AS missing FROM (SELECT conv_id, unnest(list_filter(range(0, last + 1), lambda i: NOT list_contains(have, i))) AS x FROM n)""")
def part_number_gaps(spark: SparkSession, d: str) -> DataFrame:
    parts = t.table(spark, d, "conversations").where("turn % 3 <> 1").groupBy("conv_id").agg(F.collect_set("turn").alias("have"), F.max("turn").alias("last"))
    return parts.select("conv_id", F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), "last"), "have")).alias("missing"))


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS place FROM part GROUP BY p_brand")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = t.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    return tags.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")))  # over brands, not rows
