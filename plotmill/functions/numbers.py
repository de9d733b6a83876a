"""Number dialects. Different writers need different readers, with different answers for ``1.158``, ``72.5`` or ``1,250``;
each reader is one Column expression, and none of them is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leading(text: Column) -> Column:
    """The number a text starts with, in dot notation, else null."""
    return F.regexp_extract(text, "^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))", 1).try_cast("double")


def _comma_to_dot(text: Column) -> Column:
    return F.regexp_replace(text, "^([^,]*),", "$1.")


def _drop_group_dots(text: Column) -> Column:
    return F.regexp_replace(text, "\\.(?=[0-9]{3}([^0-9]|\\z))", "")


def linkage_number(text: Column) -> Column:
    """For comparing records: other characters are dropped, dots before three digits group, unknown is 0."""
    return F.coalesce(_leading(_comma_to_dot(_drop_group_dots(F.regexp_replace(text, "[^0-9.,]", "")))), F.lit(0.0))


def queue_number(text: Column) -> Column:
    """As ``linkage_number`` but on the raw text: anything before the number makes it 0."""
    return F.coalesce(_leading(_comma_to_dot(_drop_group_dots(text))), F.lit(0.0))


def report_number(text: Column) -> Column:
    """For reports: German groups, comma decimals of one or two digits, ``1,250`` as a group; the sign is kept."""
    t = F.regexp_replace(text, "[^0-9.,-]", "")
    german = t.rlike("^[0-9]{1,3}(\\.[0-9]{3})+(,[0-9]+)?\\z") | t.rlike(",[0-9]{1,2}\\z")
    return _leading(F.when(german, _comma_to_dot(F.replace(t, F.lit("."), F.lit("")))).when(t.rlike("^[0-9]+,[0-9]{3}\\z"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t))


def reconcile_number(text: Column) -> Column:
    """For reconciling: of two kinds of separators the last is the decimal; a single kind groups before three digits."""
    tok = F.regexp_extract(text, "[0-9][0-9.,]*[0-9]|[0-9]", 0)
    dot, comma = F.contains(tok, F.lit(".")), F.contains(tok, F.lit(","))
    tail = F.length(F.regexp_extract(tok, "[^.,]*\\z", 0))
    dot_last = F.length(F.substring_index(tok, ".", -1)) < F.length(F.substring_index(tok, ",", -1))
    no_dots, no_commas = F.replace(tok, F.lit("."), F.lit("")), F.replace(tok, F.lit(","), F.lit(""))
    plain = (
        F.when(dot & comma, F.when(dot_last, no_commas).otherwise(_comma_to_dot(no_dots)))
        .when(dot, F.when(tail == 3, no_dots).otherwise(tok))
        .when(comma, F.when(tail == 3, no_commas).otherwise(_comma_to_dot(tok)))
        .otherwise(tok)
    )
    return _leading(plain)


def page_number(text: Column) -> Column:
    """For page texts: every dot groups, the first comma is the decimal (``72.5`` is 725)."""
    return _leading(F.regexp_replace(_comma_to_dot(F.replace(text, F.lit("."), F.lit(""))), "[^0-9.]", ""))


def card_number(text: Column) -> Column:
    """For cards: the first run of digits and dots with an optional comma part; dots group."""
    return _leading(_comma_to_dot(F.replace(F.regexp_extract(text, "[0-9.]+(?:,[0-9]+)?", 0), F.lit("."), F.lit(""))))


def room_number(text: Column) -> Column:
    """For room counts: comma or dot is the decimal, nothing groups."""
    return _leading(_comma_to_dot(F.regexp_extract(text, "[0-9]+(?:[.,][0-9]+)?", 0)))


def score_number(text: Column) -> Column:
    """For scores: the whole text, the first comma as decimal; null if it isn't a finite number."""
    v = F.trim(_comma_to_dot(text)).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def prefix_number(text: Column) -> Column:
    """The leading number in dot notation, whatever follows."""
    return _leading(text)


def upper_of_range(text: Column) -> Column:
    """The largest number of a range such as ``498–552`` or ``498 - 552``."""
    parts = F.split(text, "[–—]|(?<=[0-9])\\s*-\\s*(?=[0-9])")
    return F.array_max(F.transform(parts, reconcile_number))


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, computed on doubles, unlike the built-in decimal rounding."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


DIALECTS = {
    "linkage": linkage_number, "queue": queue_number, "report": report_number, "reconcile": reconcile_number, "page": page_number,
    "card": card_number, "room": room_number, "score": score_number, "prefix": prefix_number, "upper": upper_of_range,
}
