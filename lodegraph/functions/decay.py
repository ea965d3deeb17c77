"""Half-life decay, archiving horizons and dates named in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the decay model.
EDGE_HALF_LIFE = 90.0
EDGE_LEAST = 0.05
ARCHIVE_BELOW = 0.10
GAIN = 4.0
FLOOR = 0.15
IMMORTAL_FROM = 0.4
DEMOTED_DAYS = 60.0
DELETE_AFTER_DAYS = 7.0
DAY = 86400.0
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Patterns of a date or a range of days, and of a promise with a date.
NAMED_DATE = r"\b([A-Za-z]{3,9})\.? (\d{1,2})(?:\s*[-–]\s*(\d{1,2}))?(?:st|nd|rd|th)?(?:,? ((?:19|20)\d\d))?\b"
PROMISED = r"(?i)\b(?:will|is going to|is scheduled to|is expected to)\b[^.;]{0,80}?\bon ([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?(?:,? (\d{4}))?"

INF = float("inf")


def _month(word: Column) -> Column:
    """1 to 12 of a month's name, its first three letters or `sept`; else null."""
    w = F.lower(word)
    full = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), w)
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), w)
    return F.when(full > 0, full).when(short > 0, short).when(w == "sept", 9)


def upcoming(content: Column, as_of: float) -> Column:
    """A date named in the text is not before the day of `as_of` (UTC); a range counts its end, a missing year is this one."""
    text = F.coalesce(content, F.lit(""))
    got = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(NAMED_DATE), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)])
    today = F.to_date(F.timestamp_seconds(F.lit(as_of)))

    def ahead(x: Column) -> Column:
        day = F.when(x["g3"] != "", x["g3"]).otherwise(x["g2"])
        year = F.when(x["g4"] != "", x["g4"]).otherwise(F.year(today).cast("string"))
        return F.coalesce(F.try_to_date(F.concat_ws("-", year, _month(x["g1"]).cast("string"), day), "yyyy-M-d") >= today, F.lit(False)) & _month(x["g1"]).isNotNull()

    return F.exists(got, ahead)


def half_life(base: Column, kind: Column, importance: Column, content: Column, as_of: float) -> Column:
    """The half-life that decay uses: unimportant immortals are demoted, events wait for their date."""
    inf = F.lit(INF)
    return F.when((base == inf) & (kind != "category") & (F.coalesce(importance, F.lit(0.0)) < IMMORTAL_FROM), F.lit(DEMOTED_DAYS)).when((kind == "event") & upcoming(content, as_of), inf).otherwise(base)


def weight_at(weight: Column, since: Column, life: Column, importance: Column, as_of: float) -> Column:
    """weight * 0.5 ** (days / stretched half-life), not below the floor of the importance; immortals keep theirs."""
    imp = F.coalesce(importance, F.lit(0.0))
    days = (F.lit(as_of) - since) / DAY
    return F.when(life == F.lit(INF), weight).otherwise(F.greatest(weight * F.pow(F.lit(0.5), days / (life * (1 + GAIN * imp))), FLOOR * imp))


def days_left(weight: Column, life: Column, importance: Column, threshold: float = ARCHIVE_BELOW) -> Column:
    imp = F.coalesce(importance, F.lit(0.0))
    never = (life == F.lit(INF)) | (imp * FLOOR >= threshold)
    return F.when(never, F.lit(INF)).when(weight <= threshold, F.lit(0.0)).otherwise(life * (1 + GAIN * imp) * F.log2(weight / threshold))


def edge_half_life(count: Column) -> Column:
    return EDGE_HALF_LIFE * F.log1p(count)


def passed_date(content: Column, as_of: float) -> Column:
    """The first future-tense phrase with a date, if that date is before the day of `as_of`; else null."""
    text = F.coalesce(content, F.lit(""))
    today = F.to_date(F.timestamp_seconds(F.lit(as_of)))
    m, d, y = (F.regexp_extract(text, PROMISED, g) for g in (1, 2, 3))
    when = F.try_to_date(F.concat_ws("-", F.when(y != "", y).otherwise(F.year(today).cast("string")), _month(m).cast("string"), d), "yyyy-M-d")
    return F.when(_month(m).isNotNull() & (when < today), F.concat(F.trim(F.regexp_extract(text, PROMISED, 0)), F.lit(" (passed)")))
