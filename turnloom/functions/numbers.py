"""Column functions on numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers with their unit; a count and a price per piece, either way round.
NUMBER = r"(?i)(?<![\w])(?:[$£€]\s*)?-?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:%|hours?|hrs?|days?|weeks?|months?|years?|minutes?|mins?|dollars?|usd|miles?|km|kilometers?))?"
COUNT_RATE = r"(?i)\b(\d+(?:\.\d+)?)\s+[A-Za-z][^.!?]{0,64}?(?:at|for)\s+([$£€]\s*\d+(?:\.\d+)?)\s*(?:each|apiece|per\s+[A-Za-z]+)"
RATE_COUNT = r"(?i)([$£€]\s*\d+(?:\.\d+)?)\s*(?:each|apiece|per\s+[A-Za-z]+)[^.!?]{0,64}?\b(\d+(?:\.\d+)?)\b"


def number_list(text: Column) -> Column:
    """Distinct numbers with their units in order, four-digit years left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    return F.array_distinct(F.filter(found, lambda n: ~n.rlike(r"^(19|20)\d{2}$")))


def rate_pair(text: Column) -> Column:
    """struct(count, rate) of a quantity and its unit price in one sentence, or null."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    first = F.struct(F.regexp_extract(text, COUNT_RATE, 1).alias("count"), squeeze(F.regexp_extract(text, COUNT_RATE, 2)).alias("rate"))
    second = F.struct(F.regexp_extract(text, RATE_COUNT, 2).alias("count"), squeeze(F.regexp_extract(text, RATE_COUNT, 1)).alias("rate"))
    return F.when(text.rlike(COUNT_RATE), first).when(text.rlike(RATE_COUNT), second)


def fact_cap(units: Column, entities: Column, times: Column, floor: int = 4, ceiling: int = 32, weights: tuple[float, float, float] = (0.6, 0.4, 0.2)) -> Column:
    """Facts a scene may yield: weighted counts rounded up, between ``floor`` and ``ceiling``."""
    a, b, c = weights
    return F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.ceil(a * units + b * entities + c * times))).cast("int")
