"""Times as people and cameras write them. No time zone is ever invented."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def stated_time(raw: Column, offset: Column | None = None) -> Column:
    """ISO text of a camera's ``YYYY:MM:DD HH:MM:SS`` (with a separate offset) or an ISO time; null if impossible."""
    text = F.trim(raw)
    camera = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", r"$1-$2-$3T$4")
    own = F.regexp_replace(F.replace(camera, F.lit(" "), F.lit("T")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    if offset is not None:
        usable = F.regexp_like(offset, F.lit(r"^[+-](0\d|1[0-3]):[0-5]\d$|^[+-]14:00$"))
        own = F.when(usable & ~F.regexp_like(own, F.lit(_OFFSET)), F.concat(own, offset)).otherwise(own)
    sound = F.regexp_like(own, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"))
    return F.when(sound & F.try_to_timestamp(F.substring(own, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), own)


def is_aware(text: Column) -> Column:
    """Whether an ISO time states its offset."""
    return F.regexp_like(text, F.lit(_OFFSET))


def instant(text: Column) -> Column:
    """The instant of an aware ISO time, else null."""
    return F.when(is_aware(text), text.try_cast("timestamp"))


def day_of(text: Column) -> Column:
    """The local day, as stated: the first ten characters."""
    return F.substring(text, 1, 10)


def second_of_day(text: Column) -> Column:
    """By the wall clock; null for a bare day."""
    parts = [F.substring(text, a, 2).try_cast("int") for a in (12, 15, 18)]
    return F.when(F.length(text) >= 19, parts[0] * 3600 + parts[1] * 60 + parts[2])


def modified_day(nanoseconds: Column) -> Column:
    return F.to_date(F.timestamp_micros((nanoseconds / 1000).cast("long")))


#: Kind, pattern and confidence of the times that file names tell, in the order they are tried.
NAME_PATTERNS = (
    ("timestamp", r"(?<!\d)((?:19|20)\d{2})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})(?!\d)", 0.8),
    ("date", r"(?<!\d)((?:19|20)\d{2})-(\d{2})-(\d{2})(?!\d)", 0.7),
    ("compact", r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", 0.6),
    ("epoch", r"(?<!\d)(1[3-8]\d{8})(\d{3})?(?!\d)", 0.6),
)
FIRST_YEAR = 1990


def name_time(name: Column, latest_year: int) -> Column:
    """struct(value, confidence, kind) of the time that a file name tells, or null: the first kind whose match is a real date
    from FIRST_YEAR to ``latest_year``. Days stand at noon; an epoch, in seconds or milliseconds, is in UTC."""
    found = []
    for kind, pattern, confidence in NAME_PATTERNS:
        match = F.regexp_extract(name, pattern, 0)  # fields have fixed widths, so one match is enough
        if kind == "epoch":
            seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.substring(match, 1, 10).try_cast("decimal(18,6)"))
            value = F.date_format(F.lit("1970-01-01T00:00:00").cast("timestamp_ntz") + seconds, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")  # whatever the session's zone
        else:
            digits = F.regexp_replace(match, r"\D", "")
            part = lambda a, n=2: F.substring(digits, a, n)  # noqa: B023, E731
            clock = F.concat_ws(":", part(9), part(11), part(13)) if kind == "timestamp" else F.lit("12:00:00")
            text = F.concat(F.concat_ws("-", part(1, 4), part(5), part(7)), F.lit("T"), clock)
            value = F.when(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), text)
        sound = (match != "") & value.isNotNull() & F.substring(value, 1, 4).between(str(FIRST_YEAR), str(latest_year))
        found.append(F.when(sound, F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"))))
    return F.coalesce(*found)


def name_times(names: Column, latest_year: int) -> Column:
    """All times that a content's names tell, one for each value (the first name's in code point order), the surest first, then by value."""
    told = F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(name_time(n, latest_year).alias("t"), n.alias("name")))
    flat = F.transform(F.filter(told, lambda x: x["t"].isNotNull()), lambda x: F.struct((-x["t"]["confidence"]).alias("rank"), x["t"]["value"].alias("value"), x["t"]["confidence"].alias("confidence"), x["t"]["kind"].alias("kind"), x["name"].alias("name")))
    first = F.aggregate(flat, F.slice(flat, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: k["value"] == x["value"]), kept).otherwise(F.concat(kept, F.array(x))))
    return F.transform(F.array_sort(first), lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), F.concat(F.lit("file name ("), x["kind"], F.lit(")")).alias("field"), x["name"].alias("name")))


def iso_time(raw: Column) -> Column:
    """An ISO date and time of at least nineteen characters, with or without offset, as it is written; null if it can't be."""
    text = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("T")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    sound = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$"))
    return F.when(sound & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), text)


def tag_time(raw: Column) -> Column:
    """The time of an XMP or IPTC tag as ISO text: ISO, or eight digits with optional ``HHMMSS`` and offset; partial dates are null."""
    compact = r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})([+-]\d{2}:?\d{2}|Z)?)?$"
    part = lambda i: F.regexp_extract(raw, compact, i)
    clock = F.when(part(4) != "", F.concat_ws(":", part(4), part(5), part(6))).otherwise("00:00:00")
    made = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit("T"), clock, part(7))
    return F.coalesce(stated_time(F.when(F.regexp_like(raw, F.lit(compact)), made)), stated_time(raw))


#: The months' short names in RFC 1123 dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def rfc_1123_time(raw: Column) -> Column:
    """``Sat, 04 Jul 2026 10:20:30 GMT`` (or an offset) as ISO text; null if it can't be."""
    pattern = r"(?i)^\s*(?:[a-z]{3},\s*)?(\d{1,2}) ([a-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2})(?: (GMT|UTC|[+-]\d{4}))?\s*$"
    part = lambda i: F.regexp_extract(raw, pattern, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
    zone = F.when(F.upper(part(5)).isin("GMT", "UTC"), "+00:00").otherwise(F.regexp_replace(part(5), r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    made = F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), zone)
    return F.when(F.regexp_like(raw, F.lit(pattern)) & (month > 0), stated_time(made))


def humanised(seconds: Column) -> Column:
    """Minutes under two hours, else hours."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 120, F.concat(minutes.cast("string"), F.lit(" minutes"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hours")))


def sampling_interval(duration: Column) -> Column:
    """Seconds between sampled frames: a sixtieth of the duration, five at least; null for durations that can't be."""
    return F.when((duration > 0) & (duration <= 21600), F.greatest(F.lit(5.0), duration / 60.0))


def even_places(n: Column, k: int) -> Column:
    """k places spread evenly over 0..n-1, rounded half to even; all of them if there are no more than k."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1).cast("double") / F.lit(float(max(1, k - 1))), 0).cast("long")))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(spread)
