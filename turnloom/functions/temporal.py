"""Column functions on time phrases: finding, parsing, resolving against an observation, ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English months and weekdays.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
DAY = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
# Fixed value: phrases that name a time, first alternative holds.
PHRASE = (
    r"(?i)\b(?:\d{1,2}:\d{2}\s*(?:am|pm)?\s+(?:on\s+)?\d{1,2}\s+[A-Z][a-z]+,?\s+\d{4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}(?:\s*\([^)]*\))?(?:\s+\d{1,2}:\d{2})?"
    rf"|(?:{MONTH})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|(?:about\s+|around\s+)?(?:a|an|one|\d+)\s+(?:day|week|month|year)s?\s+ago"
    r"|(?:for\s+)?(?:(?:just\s+under|almost|nearly|about|around)\s+)?(?:a|an|one|\d+)\s+(?:day|week|month|year)s?(?:\s+now)?|today|yesterday|tomorrow"
    rf"|last\s+(?:week|month|year|{DAY})|next\s+(?:week|month|year|{DAY})|{DAY})\b"
)
# Forms of absolute times as (shape, pattern, precision), first match holds.
FORMS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "second"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "second"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", "%Y-%m-%d", "day"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm", "%Y/%m/%d %H:%M", "minute"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", "%Y/%m/%d", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "%m/%d/%Y", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", "%d/%m/%Y", "day"),
    (rf"^\d{{1,2}}:\d{{2}} (am|pm) \d{{1,2}} ({MONTH}) \d{{4}}$", "h:mm a d MMMM yyyy", "%I:%M %p %d %B %Y", "minute"),
    (rf"^\d{{1,2}} ({MONTH}) \d{{4}} \d{{1,2}}:\d{{2}}$", "d MMMM yyyy H:mm", "%d %B %Y %H:%M", "minute"),
    (rf"^\d{{1,2}} ({MONTH}) \d{{4}}$", "d MMMM yyyy", "%d %B %Y", "day"),
    (rf"^({MONTH}) \d{{1,2}} \d{{4}} \d{{1,2}}:\d{{2}}$", "MMMM d yyyy H:mm", "%B %d %Y %H:%M", "minute"),
    (rf"^({MONTH}) \d{{1,2}} \d{{4}}$", "MMMM d yyyy", "%B %d %Y", "day"),
    (rf"^({MONTH}) \d{{4}}$", "MMMM yyyy", "%B %Y", "month"),
    (r"^\d{4}$", "yyyy", "%Y", "year"),
]
# Most units a count may name before it means nothing.
CAPS = {"day": 36500, "week": 5200, "month": 1200, "year": 100}
PRECISIONS = ["second", "minute", "day", "week", "month", "year"]
# Counts of units back from a day, and spans that last up to it.
AGO = r"^(?:about\s+|around\s+)?(?:a|an|one|(\d+))\s+(day|week|month|year)s?\s+ago$"
LASTED = r"^(?:for\s+)?(?:(just\s+under|almost|nearly|about|around)\s+)?(?:a|an|one|(\d+))\s+(day|week|month|year)s?(?:\s+now)?$"


def first_phrase(text: Column) -> Column:
    """First time phrase of a text with single blanks, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, PHRASE, 0), r"\s+", " "), F.lit(""))


def all_phrases(text: Column) -> Column:
    """Distinct time phrases in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", " ")))


def clean(value: Column) -> Column:
    """Without brackets, ordinal endings, ``on``, ``at`` and commas."""
    v = F.regexp_replace(value, r"\([^)]*\)", " ")
    v = F.regexp_replace(v, r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    v = F.regexp_replace(v, r"(?i)\b(on|at)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, ",", " "), r"\s+", " "))


def _cleaned_parse(v: Column) -> Column:
    pattern = precision = None
    for shape, form, _, unit in FORMS:
        fits = v.rlike("(?i)" + shape)
        pattern = F.when(fits, form) if pattern is None else pattern.when(fits, form)
        precision = F.when(fits, unit) if precision is None else precision.when(fits, unit)
    # Numbers first read as month and day may be day and month.
    second = F.try_to_timestamp(F.when(v.rlike(FORMS[6][0]), v), F.lit(FORMS[6][1]))
    start = F.coalesce(F.try_to_timestamp(v, pattern), second).cast("timestamp_ntz")
    return F.struct(start.alias("start"), precision.alias("precision"))


def parsed(value: Column) -> Column:
    """struct(start TIMESTAMP_NTZ, precision) of an absolute time; null if it has none of the forms or is impossible."""
    v = clean(value)
    v = F.regexp_replace(F.regexp_replace(v, "(?i) am ", " AM "), "(?i) pm ", " PM ")
    # A lambda binds the cleaned text once, so the plan does not repeat it for every form.
    got = F.filter(F.transform(F.array(v), _cleaned_parse), lambda x: x["start"].isNotNull())
    return F.get(got, F.lit(0))


def end_of(start: Column, precision: Column) -> Column:
    """Last microsecond of the span that starts at ``start``."""
    micro = F.expr("INTERVAL '0.000001' SECOND")
    step = lambda text: start + F.expr(f"INTERVAL {text}") - micro
    return (
        F.when(precision == "year", step("'1' YEAR")).when(precision == "month", step("'1' MONTH")).when(precision == "week", step("'7' DAY"))
        .when(precision == "day", step("'1' DAY")).when(precision == "minute", step("'1' MINUTE")).otherwise(start)
    )


def relative(phrase: Column, anchor: Column) -> Column:
    """struct(start DATE, precision) of a phrase seen from the day ``anchor``; null if it is not relative or names too much."""
    # A lambda binds both once, so the plan does not repeat them for every form.
    return F.get(F.transform(F.array(F.struct(phrase.alias("p"), anchor.alias("a"))), lambda x: _relative(x["p"], x["a"])), F.lit(0))


def _relative(phrase: Column, anchor: Column) -> Column:
    p = F.regexp_replace(F.lower(F.trim(phrase)), r"\s+", " ")
    a = anchor.cast("date")
    wd = F.weekday(a)
    month, year, monday = F.trunc(a, "MM"), F.trunc(a, "YEAR"), F.date_sub(a, wd)
    names = [d.lower() for d in DAY.split("|")]
    index = lambda word: F.array_position(F.array(*[F.lit(d) for d in names]), word).cast("int") - 1
    day = lambda d, precision="day": F.struct(d.cast("date").alias("start"), F.lit(precision).alias("precision"))
    bare, last, nxt = index(p), index(F.regexp_extract(p, "^last ([a-z]+)$", 1)), index(F.regexp_extract(p, "^next ([a-z]+)$", 1))
    whole = lambda k: F.when(k == 0, 7).otherwise(k)

    def counted(pattern: str, n_group: int, unit_group: int, lasted: bool) -> Column:
        fits = p.rlike(pattern)
        n = F.coalesce(F.nullif(F.regexp_extract(p, pattern, n_group), F.lit("")).cast("decimal(38,0)"), F.lit(1))
        unit = F.regexp_extract(p, pattern, unit_group)
        small = F.lit(False)
        for u, cap in CAPS.items():
            small = small | ((unit == u) & (n <= cap))
        n = F.when(small, n).otherwise(0).cast("int")
        short = F.regexp_extract(p, pattern, 1).rlike("under|almost|nearly").cast("int") if lasted else F.lit(0)
        years = day(F.add_months(month, -F.greatest(F.lit(1), 12 * n - short)), "month") if lasted else day(F.add_months(year, -12 * n), "year")
        return F.when(
            fits & small,
            F.when(unit == "day", day(F.date_sub(a, n))).when(unit == "week", day(F.date_sub(a, 7 * n), "week")).when(unit == "month", day(F.add_months(month, -n), "month")).otherwise(years),
        )

    return (
        F.when(p == "today", day(a)).when(p == "yesterday", day(F.date_sub(a, 1))).when(p == "tomorrow", day(F.date_add(a, 1)))
        .when(bare >= 0, day(F.date_add(a, F.pmod(bare - wd, F.lit(7)))))
        .when(last >= 0, day(F.date_sub(a, whole(F.pmod(wd - last, F.lit(7))))))
        .when(nxt >= 0, day(F.date_add(a, whole(F.pmod(nxt - wd, F.lit(7))))))
        .when(p == "last week", day(F.date_sub(monday, 7), "week")).when(p == "next week", day(F.date_add(monday, 7), "week"))
        .when(p == "last month", day(F.add_months(month, -1), "month")).when(p == "next month", day(F.add_months(month, 1), "month"))
        .when(p == "last year", day(F.add_months(year, -12), "year")).when(p == "next year", day(F.add_months(year, 12), "year"))
        .otherwise(F.coalesce(counted(AGO, 1, 2, False), counted(LASTED, 2, 3, True)))
    )


def precision_rank(precision: Column) -> Column:
    """0 for a second up to 5 for a year; 6 for anything else."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRECISIONS]), precision)
    return F.when(place > 0, place - 1).otherwise(6).cast("int")


def sort_key(start: Column, end: Column, precision: Column) -> list[Column]:
    """Order of spans: resolved first, by start, end and precision."""
    return [F.when(start.isNull(), 1).otherwise(0).asc(), start.asc(), end.asc(), precision_rank(precision).asc()]


def overlaps(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Whether two resolved closed spans meet; a missing end is the start."""
    return (start <= F.coalesce(end2, start2)) & (start2 <= F.coalesce(end, start))


def epoch_days(value: Column) -> Column:
    """Days since 1970 of an ISO date, in the middle of a month or year that is all that is given."""
    whole = F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-07-01"))).when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-15"))).otherwise(F.substring(value, 1, 10))
    return F.datediff(F.try_to_date(whole, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))


def closeness(gap_days: Column) -> Column:
    """exp(-gap / 90)."""
    return F.exp(-gap_days / 90.0)
