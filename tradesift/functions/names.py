"""Company and person names as token sets, and the matches between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradesift.config import AMBIGUOUS_KEYWORDS, CLUSTER_STOPWORDS, DEFAULT, INSTITUTION_KEYWORDS, NORMALISE_STOPWORDS, PERSON_TITLES, TRAIL_MARKERS, Config


def normalise_company(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\b(?:" + "|".join(NORMALISE_STOPWORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " "))


def strip_name(name: Column) -> Column:
    """Without parentheses, without what follows a comma or a descriptive marker."""
    bare = F.split_part(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "), F.lit(","), F.lit(1))
    return F.regexp_replace(bare, r"(?is)\b(?:" + "|".join(TRAIL_MARKERS) + r")\b.*$", "")


def _tokens(text: Column, stop: tuple[str, ...]) -> Column:
    split = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +")
    kept = F.filter(split, lambda w: F.length(w) > 1)
    return F.array_sort(F.array_except(F.array_distinct(kept), F.array(*map(F.lit, stop))))


def company_tokens(name: Column) -> Column:
    return _tokens(strip_name(name), CLUSTER_STOPWORDS)


def person_tokens(name: Column) -> Column:
    return _tokens(F.coalesce(name, F.lit("")), PERSON_TITLES)


def deal_key(name: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(company_tokens(name), " "), F.lit("")), normalise_company(name))


def person_key(name: Column) -> Column:
    return F.array_join(person_tokens(name), " ")


def subset_match(a: Column, b: Column) -> Column:
    """Both non-empty, and one contains the other."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def amount_match(a: Column, b: Column, tolerance: float = DEFAULT.amount_tolerance) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= tolerance * F.greatest(a, b)), F.lit(False))


def age_hours(ts: Column, as_of: Column) -> Column:
    """Hours from ``ts`` to ``as_of``; infinite if unknown."""
    return F.coalesce((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9, F.lit(float("inf")))


def names_match(tokens_a: Column, tokens_b: Column, amount_a: Column, amount_b: Column, age: Column, config: Config = DEFAULT) -> Column:
    by_name = (age <= config.name_window_hours) & subset_match(tokens_a, tokens_b)
    by_amount = (age <= config.amount_window_hours) & amount_match(amount_a, amount_b, config.amount_tolerance) & F.arrays_overlap(tokens_a, tokens_b)
    return by_name | by_amount


def seller_class(name: Column) -> Column:
    """institution, ambiguous or individual, by keywords anywhere in the name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike("|".join(INSTITUTION_KEYWORDS)), "institution").when(low.rlike("|".join(AMBIGUOUS_KEYWORDS)), "ambiguous").otherwise("individual")
