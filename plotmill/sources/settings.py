"""Settings files: a list of searches and groups that name them, in the subset of YAML that such files use."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PAIR = re.compile(r"^([\w-]+):(?:\s+(.*))?$")
SEARCH = "pos int, name string, portal string, url string, enabled boolean, risk string"


def _value(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text.endswith(text[0]) and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    text = re.split(r"\s#", text)[0].strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def parse_settings(text: str) -> dict[str, object]:
    """Top-level names with a value or a list of flat maps. Comments, quoted texts, flow lists, numbers, booleans and null
    are read; deeper nesting, anchors and block texts raise an error. Settings are small and read on the driver."""
    out: dict[str, object] = {}
    name, item = None, None
    for number, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        line = raw.rstrip()
        body = line.lstrip()
        depth = len(line) - len(body)
        if depth == 0 and not body.startswith("- "):
            m = _PAIR.match(body)
            if not m:
                raise ValueError(f"line {number} of the settings can't be read")
            name, item = m[1], None
            out[name] = _value(_uncommented(m[2])) if m[2] else []
            continue
        if body.startswith("- "):
            item = {}
            if not isinstance(out.get(name), list):
                raise ValueError(f"line {number} of the settings has an entry outside a list")
            out[name].append(item)
            body = body[2:]
        m = _PAIR.match(body)
        if item is None or not m or not m[2]:
            raise ValueError(f"line {number} of the settings can't be read")
        item[m[1]] = _value(_uncommented(m[2]))
    return out


def _uncommented(text: str) -> str:
    """Without a comment behind a quoted text."""
    m = re.match(r"^((?:\"[^\"]*\"|'[^']*'|\[[^\]]*\]))\s*(?:#.*)?$", text)
    return m[1] if m else text


def searches(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    """The searches in their order; enabled unless they say otherwise."""
    rows = [(k, s.get("name"), s.get("portal"), s.get("url"), s.get("enabled") is not False, s.get("risk")) for k, s in enumerate(settings.get("searches") or [])]
    return spark.createDataFrame(rows, SEARCH)


def groups(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(g.get("label"), g.get("search")) for g in settings.get("groups") or []], "label string, search string")


def ordered(searches: DataFrame) -> DataFrame:
    """``rank``: those of high risk last, otherwise in their order. Settings are few rows."""
    return searches.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(F.col("risk") == "high", F.lit(False)), "pos")))


def search_for(rows: DataFrame, searches: DataFrame, portal: str, name: str) -> DataFrame:
    """``rows`` with ``search`` and ``url`` of the enabled search of their portal that has their name, else of the portal's
    first enabled one, else null."""
    on = searches.where("enabled")
    exact = on.groupBy(F.col("portal").alias("__p"), F.col("name").alias("__n")).agg(F.min(F.struct("pos", "name", "url")).alias("__exact"))
    first = on.groupBy(F.col("portal").alias("__q")).agg(F.min(F.struct("pos", "name", "url")).alias("__first"))
    found = rows.join(F.broadcast(exact), (F.col(portal) == F.col("__p")) & (F.col(name) == F.col("__n")), "left").join(F.broadcast(first), F.col(portal) == F.col("__q"), "left")
    best = F.coalesce("__exact", "__first")
    return found.withColumn("search", best["name"]).withColumn("url", best["url"]).drop("__p", "__n", "__q", "__exact", "__first")


def in_areas(place: Column, areas: list[str]) -> Column:
    """Whether the place contains one of the areas, whatever the case; null places are in none."""
    return F.coalesce(F.exists(F.array(*[F.lit(a.lower()) for a in areas]).cast("array<string>"), lambda a: F.contains(F.lower(place), a)), F.lit(False))
