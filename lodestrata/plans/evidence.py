"""Queries over facts, dates, trips and state: evidence, gaps, overlays, incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo, times, vectors
from lodestrata.operators import evidence, journeys, overlay
from lodestrata.plans.catalogue import CELL, ITEMS
from lodestrata.sources import tables as t
from lodestrata.storage import materialise, workspace

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT o_orderkey, attribute, value FROM (
  SELECT o_orderkey, 'status' AS attribute, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders)""")
def eav_unpivot(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.unpivot("o_orderkey", ["status", "priority", "day"], "attribute", "value")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang,
  len(html) - len(replace(html, '<p', 'p')) AS paragraphs FROM pages""")
def pages_meta_extract(spark: SparkSession, d: str) -> DataFrame:
    took = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.table(spark, d, "pages").select("page_id", took("<title>([^<]*)</title>").alias("title"), took('<html[^>]*lang="([^"]*)"').alias("lang"), (F.length("html") - F.length(F.replace("html", F.lit("<p"), F.lit("p")))).cast("long").alias("paragraphs"))


_CLAIMS = """claims AS (
  SELECT o_orderkey % 3000 AS c, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00+02:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT08:00:00Z') WHEN 2 THEN '2024-13-40T10:00:00'
    ELSE strftime(o_orderdate, '%Y-%m-%dT10:00:00') END AS value, o_custkey % 2 AS src FROM orders WHERE o_orderkey % 7 <> 2 OR o_orderkey % 5 = 0),
stated AS (SELECT DISTINCT c, value, src, CASE WHEN try_strptime(value[:19], '%Y-%m-%dT%H:%M:%S') IS NOT NULL THEN value END AS s FROM claims),
per AS (SELECT c, value, s, CASE WHEN length(s) > 19 THEN CAST(s AS TIMESTAMPTZ) END AS i, CASE WHEN length(s) = 19 THEN s END AS n FROM stated),
counts AS (SELECT c, count(*) AS choices, count(s) AS sound, count(DISTINCT i) AS aware, count(DISTINCT n) AS naive FROM per GROUP BY c)"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(k == 0, F.concat(day, F.lit("T10:00:00+02:00"))).when(k == 1, F.concat(day, F.lit("T08:00:00Z"))).when(k == 2, "2024-13-40T10:00:00").otherwise(F.concat(day, F.lit("T10:00:00")))
    o = t.table(spark, d, "orders").where("o_orderkey % 7 <> 2 or o_orderkey % 5 = 0")
    return o.select((F.col("o_orderkey") % 3000).alias("c"), value.alias("value"), (F.col("o_custkey") % 2).alias("src"))


@query(f"""WITH {_CLAIMS} SELECT s.c AS c, CASE WHEN choices IS NULL THEN 'missing' WHEN sound < choices THEN 'invalid' WHEN aware > 1 THEN 'conflict' WHEN naive > 0 AND (aware > 0 OR naive > 1) THEN 'timezone_unknown'
  WHEN choices > 1 THEN 'equivalent' ELSE 'single' END AS status FROM range(3000) s(c) LEFT JOIN counts ON s.c = counts.c""")
def date_status(spark: SparkSession, d: str) -> DataFrame:
    return evidence.date_status(_claims(spark, d), "c", identity=("src",), subjects=spark.range(3000).withColumnRenamed("id", "c"))


_NAMES = """names AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_101530.jpg' WHEN 1 THEN 'scan-' || strftime(o_orderdate, '%Y-%m-%d') || '.png'
  WHEN 2 THEN 'x' || strftime(o_orderdate, '%Y%m%d') || '.heic' WHEN 3 THEN 'p' || (1400000000 + o_orderkey) || '.jpg' WHEN 4 THEN (1400000000 + o_orderkey) || '123_n.jpg'
  ELSE '20231341_000000-' || strftime(o_orderdate, '%Y-%m-%d') || '.jpg' END AS name, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


@query(f"""WITH {_NAMES} SELECT o_orderkey, name, CASE o_orderkey % 6 WHEN 0 THEN day || 'T10:15:30' WHEN 3 THEN strftime(make_timestamp((1400000000 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN 4 THEN strftime(make_timestamp((1400000000 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE day || 'T12:00:00' END AS value,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 5 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM names""")
def filename_date_infer(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 6, lambda p: F.date_format("o_orderdate", p)
    epoch = (F.col("o_orderkey") + 1400000000).cast("string")
    name = F.when(k == 0, F.concat(F.lit("IMG_"), day("yyyyMMdd"), F.lit("_101530.jpg"))).when(k == 1, F.concat(F.lit("scan-"), day("yyyy-MM-dd"), F.lit(".png"))).when(k == 2, F.concat(F.lit("x"), day("yyyyMMdd"), F.lit(".heic")))
    name = name.when(k == 3, F.concat(F.lit("p"), epoch, F.lit(".jpg"))).when(k == 4, F.concat(epoch, F.lit("123_n.jpg"))).otherwise(F.concat(F.lit("20231341_000000-"), day("yyyy-MM-dd"), F.lit(".jpg")))
    told = t.table(spark, d, "orders").select("o_orderkey", name.alias("name")).withColumn("t", times.name_time(F.col("name"), 2030))
    return told.select("o_orderkey", "name", "t.value", "t.confidence")


@query("""WITH f AS (SELECT doc_id AS s, 'quality' AS attribute, CAST(quality AS VARCHAR) AS value, 2 AS p, doc_id AS o FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), 2, doc_id FROM labels
  UNION ALL SELECT doc_id, 'quality', lang, 3, n_chars FROM documents UNION ALL SELECT doc_id, 'lang', lang, 1, n_chars FROM documents)
SELECT s, attribute, arg_min(value, row(p, o)) AS value FROM f WHERE value IS NOT NULL GROUP BY s, attribute""")
def fact_precedence(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = t.table(spark, d, "labels"), t.table(spark, d, "documents")
    fact = lambda f, a, v, p, o: f.select(F.col("doc_id").alias("s"), F.lit(a).alias("attribute"), F.col(v).cast("string").alias("value"), F.lit(p).alias("p"), F.col(o).alias("o"))
    facts = fact(labels, "quality", "quality", 2, "doc_id").unionByName(fact(labels, "toxic", "toxic", 2, "doc_id")).unionByName(fact(docs, "quality", "lang", 3, "n_chars")).unionByName(fact(docs, "lang", "lang", 1, "n_chars"))
    return evidence.by_precedence(facts, "s", "attribute", "value", F.col("p"), "o")


@query("""WITH k AS (SELECT n_chars, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM documents GROUP BY n_chars)
SELECT page_id, CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n = 1 THEN 'attached' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM pages LEFT JOIN k ON n_chars = page_id + 100""")
def unique_match_join(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages").select("page_id", (F.col("page_id") + 100).alias("size"))
    return evidence.unique_matches(pages, t.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size")), "size", "page_id", "doc_id")


@query("SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0")
def tier_gate(spark: SparkSession, d: str) -> DataFrame:
    marked = t.table(spark, d, "documents").select("doc_id", "lang").join(t.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "sealed").alias("mark")), "doc_id", "left")
    return evidence.visible(marked.withColumn("tier", F.coalesce("mark", F.lit("open")))).select("doc_id", "lang")


@query("""WITH o AS (SELECT doc_id, n_chars AS size, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN n.doc_id IS NULL OR n.size = o.size THEN o.lang END AS lang,
  CAST(n.doc_id IS NOT NULL AS INTEGER) AS present FROM n FULL JOIN o ON n.doc_id = o.doc_id""")
def inventory_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), "lang")
    new = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return evidence.merged_inventory(docs.where("doc_id % 3 <> 0"), new, "doc_id", ["size"], ["lang"])


@query("SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')")
def stale_facts(spark: SparkSession, d: str) -> DataFrame:
    present = t.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("p"))
    return t.table(spark, d, "labels").join(present, F.col("doc_id") == F.col("p"), "left_anti").select("doc_id", "quality")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars < 100")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents")
    return evidence.remaining_work(docs.select("doc_id"), t.table(spark, d, "labels"), docs.where("n_chars < 100"), key="doc_id")


@query("""WITH a AS (SELECT text, list_sort(list(doc_id)) AS m FROM documents WHERE doc_id % 9 <> 0 GROUP BY text HAVING count(*) > 1), b AS (SELECT text, list_sort(list(doc_id)) AS m FROM documents GROUP BY text HAVING count(*) > 1)
SELECT sha256(coalesce(a.text, b.text)) AS content_hash, CASE WHEN a.m IS NULL THEN 'added' WHEN b.m IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.text = b.text WHERE a.m IS DISTINCT FROM b.m""")
def changed_groups(spark: SparkSession, d: str) -> DataFrame:
    c = t.contents(spark, d).select("doc_id", "content_hash")
    grouped = lambda f: f.groupBy("content_hash").agg(F.sort_array(F.collect_list("doc_id")).alias("members")).where(F.size("members") > 1)
    return evidence.changed_members(grouped(c.where("doc_id % 9 <> 0")), grouped(c), "content_hash", "members")


@query(f"""WITH RECURSIVE {ITEMS}, days AS (SELECT {CELL} AS cell, CAST(day AS DATE) AS day, count(*) AS n FROM items WHERE lat IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS r FROM days),
f AS (SELECT cell, day, n, r, day AS a FROM o WHERE r = 1 UNION ALL
  SELECT o.cell, o.day, o.n, o.r, CASE WHEN o.day - f.day > 2 OR o.day - f.a > 14 THEN o.day ELSE f.a END FROM f JOIN o ON o.cell = f.cell AND o.r = f.r + 1)
SELECT cell, strftime(a, '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY cell, a HAVING sum(n) >= 3""")
def trips_sessionize(spark: SparkSession, d: str) -> DataFrame:
    i = t.items(spark, d).select(geo.cell_key(F.col("lat"), F.col("lon")).alias("cell"), "day")
    return journeys.trips(i)


@query(f"""WITH {ITEMS}, e AS (SELECT user_id, CAST(day AS TIMESTAMP) AS day FROM items WHERE day IS NOT NULL),
m AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS s FROM e),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 3""")
def trips_gap_only(spark: SparkSession, d: str) -> DataFrame:
    days = t.items(spark, d).where("day is not null").select("user_id", F.to_timestamp("day", "yyyy-MM-dd").alias("day"))
    runs = journeys.runs_by_gap(days, "user_id")
    return runs.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("""SELECT o_orderkey, event_id FROM orders JOIN (SELECT event_id, DATE '1992-01-01' + CAST(event_id % 2400 AS INTEGER) AS a, DATE '1992-01-01' + CAST(event_id % 2400 + 3 AS INTEGER) AS b FROM events)
  ON CAST(o_orderdate AS DATE) BETWEEN a AND b""")
def trip_range_join(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("event_id") % 2400).cast("int"))
    ranges = t.table(spark, d, "events").select("event_id", start.alias("after"), F.date_add(start, 3).alias("before"))
    orders = t.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return journeys.in_ranges(orders, ranges, "day", "after", "before").select("o_orderkey", "event_id")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
  ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""")
def asof_legs(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("p_ts")).agg(F.max("event_id").alias("last_purchase"))
    return journeys.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_purchase", "p_ts").select("event_id", "last_purchase")


@query("SELECT count(*) AS total, count(*) FILTER (abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) = 0) AS same_day, count(*) FILTER (abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 7) AS within_week FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_calibration(spark: SparkSession, d: str) -> DataFrame:
    met = t.table(spark, d, "lineitem").join(t.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return journeys.calibration(met.select(F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b")), "a", "b")


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def mass_copy_days(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).where("n >= 10")


_LOG = """log AS (SELECT ts, event_id, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'set' ELSE 'add' END AS op, user_id AS entity, event_id % 5 AS member,
  CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS value FROM events)"""


@query(f"WITH {_LOG}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) = 1) SELECT entity, value FROM l WHERE op <> 'reset'")
def overlay_last_write(spark: SparkSession, d: str) -> DataFrame:
    return overlay.last_written(t.log(spark, d), "entity", "value")


@query(f"WITH {_LOG}, l AS (SELECT * FROM log WHERE op IN ('add', 'remove') QUALIFY row_number() OVER (PARTITION BY entity, member ORDER BY ts DESC, event_id DESC) = 1) SELECT entity, member FROM l WHERE op = 'add'")
def overlay_sets(spark: SparkSession, d: str) -> DataFrame:
    return overlay.members(t.log(spark, d), "entity", "member")


@query(f"""WITH {_LOG}, r AS (SELECT entity, member, max(row(ts, event_id)) AS r FROM log WHERE op = 'remove' GROUP BY ALL),
a AS (SELECT log.entity, log.member, min(row(ts, event_id)) AS first FROM log LEFT JOIN r ON log.entity = r.entity AND log.member = r.member WHERE op = 'add' AND (r IS NULL OR row(ts, event_id) > r.r) GROUP BY ALL)
SELECT entity, string_agg(CAST(member AS VARCHAR), ',' ORDER BY first) AS members FROM a GROUP BY entity""")
def overlay_buckets(spark: SparkSession, d: str) -> DataFrame:
    return overlay.ordered_members(t.log(spark, d), "entity", "member", "members").withColumn("members", F.array_join("members", ","))


@query("SELECT event_type AS stage, arg_max(event_id % 3, row(ts, event_id)) AS status, count(*) AS n FROM events GROUP BY event_type")
def stage_status(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 3).alias("status"), F.struct("ts", "event_id").alias("seq"))
    return overlay.stage_status(e, "stage")


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS block, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS seq, event_type AS op, event_id % 7 AS person, event_id % 11 AS member, event_id % 5 AS source FROM events),
w AS (SELECT block, seq AS id, member, person, seq AS t FROM e WHERE op NOT IN ('signup', 'error')
  UNION ALL SELECT block, id, member, n.person, n.seq FROM (SELECT w.block, w.id, w.member, arg_min({'op': e.op, 'person': e.person, 'seq': e.seq}, e.seq) AS n FROM w JOIN e ON e.block = w.block AND e.seq > w.t
    AND ((e.op = 'signup' AND e.source = w.person AND e.source <> e.person) OR (e.op = 'error' AND e.person = w.person AND e.member = w.member)) GROUP BY w.block, w.id, w.member) WHERE n.op = 'signup')
SELECT DISTINCT block, person, member FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.block = w.block AND e.seq > w.t AND ((e.op = 'signup' AND e.source = w.person AND e.source <> e.person) OR (e.op = 'error' AND e.person = w.person AND e.member = w.member)))""")
def overlay_merges(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent merges of people, by library."""
    e = t.table(spark, d, "events").select((F.col("user_id") % 50).alias("block"), F.row_number().over(Window.partitionBy(F.col("user_id") % 50).orderBy("ts", "event_id")).alias("seq"), F.when(F.col("event_type") == "signup", "merge_person").when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), (F.col("event_id") % 7).alias("person"), (F.col("event_id") % 11).alias("member"), (F.col("event_id") % 5).alias("source"))
    return overlay.merged_people(e, "block")


@query("SELECT event_id, event_type, value FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events taken in by a stream, merged by key into a versioned table."""
    from lodestrata.streaming import ingest

    e = t.table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    with workspace(spark, "stream") as folder:
        e.write.parquet(f"{folder}/in")
        return materialise(ingest.ingest(spark, f"{folder}/in", e.schema.simpleString()[7:-1].replace(":", " "), folder, "event_id", "ts").select("event_id", "event_type", "value"), "ingested")


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by event time in a stream with a watermark."""
    from lodestrata.streaming import ingest

    e = t.table(spark, d, "events").select("event_type", "value", "ts")
    with workspace(spark, "stream") as folder:
        e.write.parquet(f"{folder}/in")
        out = materialise(ingest.windowed_counts(spark, f"{folder}/in", "event_type string, value double, ts timestamp_ntz", folder), "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT vec_id, CAST(len(list_filter(range(0, 63), lambda i: embedding[i + 1] < embedding[i + 2])) AS INTEGER) AS ones FROM embeddings")
def difference_bits(spark: SparkSession, d: str) -> DataFrame:
    bits = vectors.difference_hash(F.col("embedding"), width=64)
    return t.table(spark, d, "embeddings").select("vec_id", F.length(F.replace(bits, F.lit("0"), F.lit(""))).alias("ones"))


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
f AS (SELECT user_id, t, r, t AS k FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.t, o.r, CASE WHEN o.t >= f.k + 86400 THEN o.t ELSE f.k END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, CAST(least(count(DISTINCT k), 60) AS INTEGER) AS kept FROM f GROUP BY user_id""")
def keyframe_thinning(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return journeys.thinned(e, "user_id", "t", F.lit(86400.0)).select("user_id", F.size("kept").alias("kept"))
