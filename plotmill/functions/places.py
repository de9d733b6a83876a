"""Localities: the most specific field of a place text, and whether two places agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that name a town and hence no neighbourhood.
CITIES = "potsdam berlin brandenburg werder teltow kleinmachnow stahnsdorf nuthetal michendorf falkensee nauen caputh ketzin beelitz schwielowsee".split()
#: Words that tell neighbourhoods of one name apart.
DISCRIMINATOR = "^(i{1,3}|iv|v|nord|n[öo]rdliche|süd|sued|s[üu]dliche|ost|[öo]stliche|west|westliche|mitte)\\z"


def neighbourhood(place: Column, cities: list[str] | None = None) -> Column:
    """Last comma field that isn't a town, lower case, without postcodes and signs; empty if unknown."""
    town = F.array(*[F.lit(c) for c in (cities or CITIES)])
    fields = F.transform(F.split(F.lower(F.coalesce(place, F.lit(""))), ","), lambda f: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(f, "(?<![0-9a-z_])[0-9]{4,5}(?![0-9a-z_])", " "), "[^a-zäöüß ]+", " "), " +", " ")))
    named = F.filter(fields, lambda f: (f != "") & ~F.array_contains(town, f))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))


def neighbourhoods_agree(a: Column, b: Column) -> Column:
    """True, false or null (unknown) for two neighbourhoods: equal names agree, names without a common word differ, so do
    names told apart by a number or a point of the compass; a name that only adds words to the other agrees with it."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    more_a, more_b = F.array_except(ta, tb), F.array_except(tb, ta)
    told = F.exists(F.concat(more_a, more_b), lambda t: t.rlike(DISCRIMINATOR))
    return (
        F.when((a == "") | (b == ""), F.lit(None).cast("boolean"))
        .when(a == b, True)
        .when(~F.arrays_overlap(ta, tb) | told, False)
        .when((F.size(more_a) == 0) | (F.size(more_b) == 0), True)
    )


def postcodes(text: Column) -> Column:
    """Five-digit codes that aren't part of a longer number."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![0-9])[0-9]{5}(?![0-9])"), F.lit(0))


def outside_region(text: Column, prefixes: list[str]) -> Column:
    """True only if the text prints postcodes and none begins with a prefix; no prefixes and no codes are inside."""
    codes = postcodes(text)
    inside = F.exists(codes, lambda c: F.lit(False) if not prefixes else c.rlike("^(" + "|".join(prefixes) + ")"))
    return F.lit(bool(prefixes)) & (F.size(codes) > 0) & ~inside
