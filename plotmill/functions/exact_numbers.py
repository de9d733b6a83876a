"""Numbers written in several notations, as canonical text: two numbers are equal exactly if their texts are.

The canonical text has a sign only for negative numbers, no leading or closing zeros and no exponent. It has no bound on
digits, so no number is rounded or lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with group and decimal separators; blanks, thin blanks and apostrophes only group.
_BODY = "[0-9]+(?:[.,'’ \\u00a0\\u2009\\u202f][0-9]+)*"


def _canonical(plain: Column) -> Column:
    """From an optional sign, digits and an optional point with digits; null for anything else, and if all digits are 0.
    Each step uses the one before once, so that generated code stays small."""
    short = F.regexp_replace(plain, "^(-?)0*([0-9]+?)(?:\\.0*|(\\.[0-9]*[1-9])0*)?\\z", "$1$2$3")
    return F.get(F.regexp_extract_all(short, F.lit("\\A-?[0-9.]*[1-9][0-9.]*\\z"), F.lit(0)), F.lit(0))


def exact_from_text(text: Column) -> Column:
    """The number a text denotes, or null for null, 0, empty text and text without a digit (all of them "unknown").

    A separator before exactly three digits groups thousands, the last one before another count of digits is the decimal
    sign; ``½ ¼ ¾`` after a digit are decimals. Units and words around the number don't count; of several numbers the
    first is taken. A minus sign right before the first digit counts.
    """
    halves = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?<=[0-9]) ?½", ",5"), "(?<=[0-9]) ?¼", ",25"), "(?<=[0-9]) ?¾", ",75")
    plain = F.when(text.rlike("[½¼¾]"), halves).otherwise(text)
    body = F.regexp_extract(plain, f"[-−]?{_BODY}", 0)
    pointed = F.regexp_replace(body, "[.,](?=(?:[0-9]{1,2}|[0-9]{4,})\\z)", "p")
    return _canonical(F.translate(F.regexp_replace(pointed, "[^-−0-9p]", ""), "−p", "-."))


def exact_from_double(number: Column) -> Column:
    """The number of a double's shortest notation; null for null, NaN, infinity and 0 ("unknown")."""

    def unfolded(text: Column) -> Column:
        """Without the exponent, which Java's shortest notation has below 0.001 and from 10,000,000 on."""
        sign, whole, fraction = (F.regexp_extract(text, "^(-?)([0-9]+)\\.?([0-9]*)", k) for k in (1, 2, 3))
        digits, point = F.concat(whole, fraction), F.length(whole) + F.regexp_extract(text, "E(-?[0-9]+)\\z", 1).cast("int")
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        return F.concat(sign, F.when(point <= 0, small).otherwise(F.concat(F.rpad(F.left(digits, point), point, "0"), F.lit("."), F.substring(digits, point + 1, F.length(digits)))))

    text = number.cast("string")
    unknown = F.isnan(number) | (number == 0) | (F.abs(number) == float("inf"))
    # bound in a lambda, as it is used many times; hardly any row comes here
    far = _canonical(F.get(F.transform(F.array(text), unfolded), F.lit(0)))
    # without an exponent the notation has no other zeros to drop than those of a whole number
    return F.when(unknown, None).when(F.contains(text, F.lit("E")), far).when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)
