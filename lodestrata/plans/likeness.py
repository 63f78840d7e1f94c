"""Queries over vectors and hashes: nearest vectors, near-duplicates, bursts, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors
from lodestrata.operators import journeys, neighbours
from lodestrata.sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT x AS y FROM v WHERE vec_id = 0)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return t.vectors(spark, d).where("vec_id = 0").first()["vector"]


@query(f"WITH {_V} SELECT vec_id, round(list_dot_product(x, y), 6) AS score FROM v, q WHERE label <> 3 ORDER BY list_dot_product(x, y) DESC, vec_id LIMIT 50")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    allowed = t.vectors(spark, d).where("label <> 3")
    return neighbours.top_k(allowed, _query_vector(spark, d), 50).withColumn("score", F.round("score", 6))


@query(f"WITH {_V} SELECT label, vec_id, round(list_dot_product(x, y), 6) AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY list_dot_product(x, y) DESC, vec_id) AS INTEGER) AS rank FROM v, q QUALIFY rank <= 5")
def vector_topk_by_group(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vector(spark, d)
    scored = t.vectors(spark, d).select("label", "vec_id", vectors.dot(F.col("vector"), F.array(*[F.lit(x) for x in q])).alias("score"))
    return neighbours.top_k_by_group(scored, "label", "vec_id", 5).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS o, list_dot_product(a.x, b.x) AS s FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, o) AS r FROM s)
SELECT vec_id, max(o) FILTER (r = 1) AS best, round(max(s) FILTER (r = 1) - max(s) FILTER (r = 2), 6) AS margin FROM r WHERE r <= 2 GROUP BY vec_id""")
def knn_margin(spark: SparkSession, d: str) -> DataFrame:
    """The most like of all vectors for each asked one, and its lead over the second."""
    v = t.vectors(spark, d).select("vec_id", "vector")
    top = neighbours.best_matches(v.where("vec_id % 50 = 0"), v).groupBy("vec_id")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    return top.agg(at("o", 1).alias("best"), F.round(at("score", 1) - at("score", 2), 6).alias("margin"))


SKETCH = """w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
b AS (SELECT doc_id, (31 * (CASE WHEN word = '' THEN 0 ELSE unicode(word) END) + 7 * length(word) + (CASE WHEN word = '' THEN 0 ELSE unicode(word[-1:]) END)) % 65 AS b FROM w),
c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY doc_id, b),
g AS (SELECT d.doc_id, r.i, coalesce(c.n, 0) AS n FROM documents d CROSS JOIN range(65) r(i) LEFT JOIN c ON c.doc_id = d.doc_id AND c.b = r.i),
l AS (SELECT doc_id, i, n < lead(n) OVER (PARTITION BY doc_id ORDER BY i) AS bit FROM g),
h AS (SELECT doc_id, CAST(sum(CASE WHEN bit AND i >= 32 AND i < 64 THEN 1::BIGINT << (i - 32) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN bit AND i < 32 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS lo FROM l GROUP BY doc_id)"""


@query(f"WITH {SKETCH} SELECT doc_id, hi, lo FROM h")
def document_sketches(spark: SparkSession, d: str) -> DataFrame:
    return t.sketches(spark, d)


@query(f"""WITH {SKETCH}, k AS (SELECT hi, lo, min(doc_id) AS rep FROM h GROUP BY hi, lo)
SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM k a, k b WHERE a.rep < b.rep AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6
UNION ALL SELECT rep, doc_id, 0 FROM h JOIN k USING (hi, lo) WHERE doc_id <> rep""")
def neardup_bands(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.banded_pairs(t.sketches(spark, d), 6, "doc_id")


@query(f"""WITH RECURSIVE {SKETCH}, k AS (SELECT hi, lo, min(doc_id) AS rep FROM h GROUP BY hi, lo),
p AS (SELECT a.rep AS a, b.rep AS b FROM k a, k b WHERE a.rep <> b.rep AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6 UNION ALL SELECT rep, doc_id FROM h JOIN k USING (hi, lo) WHERE doc_id <> rep UNION ALL SELECT doc_id, rep FROM h JOIN k USING (hi, lo) WHERE doc_id <> rep),
r AS (SELECT DISTINCT a AS member, a AS g FROM p UNION SELECT p.b, r.g FROM r JOIN p ON p.a = r.member)
SELECT member, min(g) AS "group" FROM r GROUP BY member""")
def components_groups(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.groups_of(neighbours.banded_links(t.sketches(spark, d), 6, "doc_id"))


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
n AS (SELECT day, floor(t / 90) AS k, t, event_id FROM e)
SELECT a.event_id AS a, b.event_id AS b, b.t - a.t AS gap FROM n a JOIN (SELECT *, unnest([k - 1, k]) AS j FROM n) b ON a.day = b.day AND a.k = b.j AND row(a.t, a.event_id) < row(b.t, b.event_id) WHERE b.t - a.t <= 90""")
def burst_pairs(spark: SparkSession, d: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    e = t.table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), at.alias("at"))
    return neighbours.burst_pairs(e, 90, "event_id")


_DAYS = "i AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events)"


@query(f"""WITH {_DAYS}, m AS (SELECT a.id, b.id AS p_id, abs(a.t - b.t) AS gap FROM i a JOIN i b ON a.day = b.day AND a.event_type = 'error' AND b.event_type = 'purchase')
SELECT id, arg_min(p_id, row(gap, p_id)) AS p_id, min(gap) AS gap FROM m WHERE gap <= 10800 GROUP BY id""")
def gap_same_day_location(spark: SparkSession, d: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    e = t.table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), at.alias("at"), "event_type")
    rows = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "day", "at")
    peers = e.where("event_type = 'purchase'").select(F.col("event_id").alias("p_id"), F.col("day").alias("p_day"), F.col("at").alias("p_at"))
    return neighbours.nearest_in_day(rows, peers, 10800)


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return t.vectors(spark, d).select(F.col("vec_id").alias("face_id"), "vector", (F.col("vec_id") % 97).alias("content"), F.col("label").alias("block"))


@query()
def face_groups(spark: SparkSession, d: str) -> DataFrame:
    """Complete-link groups by block; the threshold is low as these vectors are far apart."""
    return neighbours.anchored_groups(_faces(spark, d), "block", anchor=0.30, every=0.25)


@query()
def live_clusters(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.centroid_groups(_faces(spark, d), "block", threshold=0.30)


@query()
def line_simplify(spark: SparkSession, d: str) -> DataFrame:
    lines = t.vectors(spark, d).select(F.col("vec_id").alias("id"), F.transform("vector", lambda y, i: F.array(i.cast("double"), y)).alias("points"))
    return neighbours.simplified(lines, 0.1)


@query("""SELECT l.doc_id, quality, toxic, CAST(row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END, n_chars DESC, l.doc_id) AS BIGINT) AS place FROM labels l JOIN documents d ON l.doc_id = d.doc_id ORDER BY place LIMIT 200""")
def reviewed_order(spark: SparkSession, d: str) -> DataFrame:
    """The first page of reviewed rows: matches, then open ones, then mismatches, each by prior order."""
    verdict = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    met = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), F.col("doc_id") == F.col("id"))
    page = met.withColumn("verdict", verdict).orderBy("verdict", F.desc("n_chars"), "doc_id").limit(200)
    return page.select("doc_id", "quality", "toxic", F.row_number().over(Window.orderBy("verdict", F.desc("n_chars"), "doc_id")).cast("long").alias("place"))


@query("""WITH d AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT event_id, user_id, event_type FROM d WHERE event_type IS DISTINCT FROM was""")
def consecutive_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return journeys.without_repeats(e, "user_id", "seq", "event_type").select("event_id", "user_id", "event_type")
