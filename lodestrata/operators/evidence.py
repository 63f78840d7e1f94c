"""Facts with provenance: precedence, competing dates, tiers, attachment, change-aware merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import times

#: The columns that every fact carries, and the tiers.
PROVENANCE = ("source_path", "source_span", "extractor", "extractor_version", "confidence", "derived_at", "tier")
TIERS = ("open", "personal", "sealed")


def validated(facts: DataFrame) -> DataFrame:
    """The facts; reading one without whole provenance is an error that names the column."""
    missing = set(PROVENANCE) - set(facts.columns)
    if missing:
        raise ValueError(f"facts lack {sorted(missing)}")
    out = facts
    for c in PROVENANCE:
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a fact without {c}")).cast(facts.schema[c].dataType)).otherwise(F.col(c)))
    sure = F.col("confidence").between(0.0, 1.0)
    out = out.withColumn("confidence", F.when(sure, F.col("confidence")).otherwise(F.raise_error(F.lit("a confidence outside 0 to 1")).cast(facts.schema["confidence"].dataType)))
    return out.withColumn("tier", F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(F.raise_error(F.lit("an unknown tier")).cast("string")))


def visible(facts: DataFrame, escalated: bool = False) -> DataFrame:
    """Facts that a reader may see: sealed ones only when escalated."""
    return facts if escalated else facts.where(F.col("tier") != "sealed")


def date_status(claims: DataFrame, by: str = "content_hash", value: str = "value", identity: tuple[str, ...] = (), subjects: DataFrame | None = None) -> DataFrame:
    """How the dates that a content's claims state agree: invalid, conflict, timezone_unknown, equivalent, single or missing.

    Claims of one value that also share the columns of ``identity`` (their source) are one. Any that isn't a whole ISO
    time makes the content invalid. Instants are compared in UTC; two times without offset, or one beside an instant,
    can't be compared. Contents of ``subjects`` without a claim are missing.
    """
    stated = times.iso_time(F.col(value))
    aware = times.is_aware(stated)
    per = claims.select(by, value, *identity).distinct().withColumns({"__s": stated, "__i": F.when(aware, times.instant(stated)), "__n": F.when(~aware, stated.try_cast("timestamp_ntz"))})
    counts = per.groupBy(by).agg(F.count("*").alias("choices"), F.count("__s").alias("sound"), F.count_distinct("__i").alias("aware"), F.count_distinct("__n").alias("naive"))
    status = (
        F.when(F.col("sound") < F.col("choices"), "invalid")
        .when(F.col("aware") > 1, "conflict")
        .when((F.col("naive") > 0) & (F.col("aware") + F.col("naive") > 1), "timezone_unknown")
        .when(F.col("choices") > 1, "equivalent")
        .when(F.col("choices") == 1, "single")
        .otherwise("missing")
    )
    found = counts.select(by, status.alias("status"))
    if subjects is None:
        return found
    every = subjects.select(F.col(by).alias("__by")).distinct()
    return every.join(found, F.col("__by").eqNullSafe(F.col(by)), "left").select(F.col("__by").alias(by), F.coalesce("status", F.lit("missing")).alias("status"))


def by_precedence(facts: DataFrame, by: str, attribute: str, value: str, priority: Column, order: str) -> DataFrame:
    """One value for each subject and attribute: the best priority, then the first in order."""
    return facts.where(F.col(value).isNotNull()).groupBy(by, attribute).agg(F.min_by(value, F.struct(priority, F.col(order))).alias(value))


def latest(facts: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """The last value of each subject."""
    return facts.groupBy(*by).agg(F.max_by(value, order).alias("value"))


def unique_matches(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, status) for each left row: attached where exactly one right row fits, else ambiguous or unmatched."""
    fits = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count_distinct(right_id).alias("n"), F.min(right_id).alias(right_id))
    met = left.join(fits, F.col(key) == F.col("__key"), "left")
    n = F.coalesce("n", F.lit(0))
    return met.select(left_id, F.when(n == 1, F.col(right_id)).alias(right_id), F.when(n == 1, "attached").when(n > 1, "ambiguous").otherwise("unmatched").alias("status"))


def merged_inventory(old: DataFrame, new: DataFrame, key: str, unchanged: list[str], carried: list[str], dated: dict[str, str] | None = None) -> DataFrame:
    """Inventory after a scan: rows of both, with what was derived kept only where nothing changed; unseen rows stay, marked absent.

    ``dated``: of each derived column the one that tells when; a value without its time is not carried.
    """
    a, b = old.select(*[F.col(c).alias(f"__{c}") for c in old.columns]), new
    met = b.join(a, F.col(key) == F.col(f"__{key}"), "full_outer")
    same = F.lit(True)
    for c in unchanged:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    seen = F.col(key).isNotNull()
    own = [F.when(seen, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in (key, *unchanged)]
    told = lambda c: F.col(f"__{(dated or {}).get(c, c)}").isNotNull()
    return met.select(*own, *[F.when((same | ~seen) & told(c), F.col(f"__{c}")).alias(c) for c in carried], seen.cast("int").alias("present"))


def changed_members(stored: DataFrame, current: DataFrame, by: str, members: str) -> DataFrame:
    """Groups whose members differ between two states, and how: added, removed or changed."""
    a = stored.select(F.col(by).alias("__by"), F.col(members).alias("__members"))
    met = current.join(a, F.col(by) == F.col("__by"), "full_outer").where(~F.col(members).eqNullSafe(F.col("__members")))
    return met.select(F.coalesce(by, "__by").alias(by), F.when(F.col("__members").isNull(), "added").when(F.col(members).isNull(), "removed").otherwise("changed").alias("change"))


def remaining_work(candidates: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Candidates that are in none of the ledgers; a null key is always work."""
    out = candidates
    for ledger in done:
        out = out.join(ledger.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")
    return out


def unchanged(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ("derived_at",)) -> bool:
    """Whether two tables hold the same rows, as often, apart from some columns."""
    columns = sorted(set(a.columns) - set(ignore))
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def first_occurrence(rows: DataFrame, digest: str, order: list[Column]) -> DataFrame:
    """One row for each content, the first in (ascending) order; rows without a digest are all kept. Copies are combined before the shuffle."""
    first = rows.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("r"))
    named = first.select("r.*")
    return named.unionByName(rows.where(F.col(digest).isNull()))
