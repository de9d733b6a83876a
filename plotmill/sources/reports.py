"""Evaluation reports: typed records and lists out of Markdown prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmill.functions.numbers import reconcile_number, report_number, upper_of_range
from plotmill.functions.text import report_header, section, strip_markdown

#: What precedes a title and isn't part of it.
_BEFORE_TITLE = "(?i)^(?:#[0-9]+\\s*[—-]\\s*|🔄\\s*SWAP\\s*[—:-]?\\s*|Evaluation:\\s*|(?:TAUSCHWOHNUNG|Wohnungstausch|Wohnungsswap)\\s*[:—-]?\\s*|[„\"“]\\s*)+"
_AMOUNT = "[0-9]{1,3}(?:\\.[0-9]{3})+(?:,[0-9]{1,2})?|[0-9]{3,4}(?:,[0-9]{1,2})?"
_ESTIMATE = "(?i)(?<![a-z])(?:est\\.?|estimat\\w*|geschätzt|ca\\.|approx\\w*|rekonstru\\w*|selbst berechnet|derived)|~|≈"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, ended at a word and marked."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.left(text, F.lit(limit)), "\\s+\\S*\\z", ""), F.lit("…"))).otherwise(text)


def report_records(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``url, date, score, status, rent, m2, rooms`` of texts with a URL header.

    A score that isn't a number is a status. Numbers out of the plausible range (rent 100 to 10,000, size 15 to 250, rooms
    1 to 12) count as misread and are null. Texts without a URL, null and empty ones give no row.
    """
    t = F.col(text)
    score = _first(t, "(?m)^\\*\\*Score:\\*\\*[ \\t]*(.+)$")
    rent = _first(t, "(?i)-\\s*Kaltmiete:\\s*([^\\n(]+)")
    between = lambda v, low, high: F.when(v.between(low, high), v)
    return texts.select(
        *keep,
        _first(t, "(?m)^\\*\\*URL:\\*\\*\\s*(\\S+)").alias("url"),
        _first(t, "(?m)^\\*\\*Date:\\*\\*\\s*(\\S+)").try_cast("date").alias("date"),
        F.when(score.rlike("^[0-9]"), reconcile_number(score)).alias("score"),
        F.when(~score.rlike("^[0-9]"), F.upper(score)).alias("status"),
        between(F.when(rent.rlike("[–—-]"), upper_of_range(rent)).otherwise(reconcile_number(rent)), 100, 10_000).alias("rent"),
        between(reconcile_number(_first(t, "(?i)-\\s*(?:Living area|Wohnfläche|Wohnflaeche|Größe):\\s*([^\\n(]+)")), 15, 250).alias("m2"),
        between(reconcile_number(_first(t, "(?i)-\\s*(?:Rooms|Zimmer|Räume):\\s*([^\\n(]+)")), 1, 12).alias("rooms"),
    ).where("url is not null")


def report_title(text: Column, limit: int = 80) -> Column:
    """The first heading without leading marks, cut at a word; empty if there is none."""
    t = F.regexp_replace(strip_markdown(F.regexp_extract(text, "(?m)^#\\s+(.+)$", 1)), _BEFORE_TITLE, "")
    return _cut(F.trim(F.regexp_replace(F.regexp_replace(t, "[“\"]\\s*(?=—|\\z)", " "), "\\s+", " ")), limit)


def report_address(text: Column) -> Column:
    """Address header as text and precision (exact, street or area; empty if not stated); null without the header."""
    v = report_header(text, "Address")
    kind = F.lower(F.regexp_extract(v, "(?i)\\(\\s*(exact|street|area)(?![a-z])[^)]*\\)\\s*\\z", 1))
    plain = F.when(kind != "", F.regexp_replace(v, "\\s*\\([^)]*\\)\\s*\\z", "")).otherwise(v)
    return F.when(v != "", F.struct(strip_markdown(plain).alias("text"), kind.alias("precision")))


def warm_rent(text: Column) -> Column:
    """Warm rent as value, upper bound of a range and whether it is an estimate; null if there is none.

    The labelled line counts before any other mention, and its bold amount before its plain ones. Amounts outside 250 to
    10,000 are others; a mention of something included in the warm rent is none.
    """
    lines = F.split(text, "\n")
    amounts = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(_AMOUNT), F.lit(0)), lambda a: report_number(a)), lambda v: v.between(250, 10_000))

    def of(part: Column, around: Column, ranged: bool) -> Column:
        v = amounts(part)
        span = F.lit(ranged) & (F.size(v) > 1) & part.rlike("[–-]")
        return F.when(F.size(v) > 0, F.struct(F.get(v, F.lit(0)).alias("value"), F.when(span, F.get(v, F.lit(1))).alias("high"), (span | around.rlike(_ESTIMATE)).alias("estimated")))

    def labelled(line: Column) -> Column:
        bold = F.regexp_extract_all(line, F.lit("\\*\\*([^*]+)\\*\\*"), F.lit(1))
        sums = F.filter(bold, lambda b: F.size(amounts(b)) > 0)
        best = F.get(sums, F.lit(0))
        before = F.right(F.split_part(line, best, F.lit(1)), F.lit(27))
        return F.coalesce(F.when(best.isNotNull(), of(best, F.concat(before, best), True)), of(line, line, False))

    own = F.filter(lines, lambda x: x.rlike("(?i)^\\s*(?:[-*|]\\s*)?\\**\\s*Warmmiete(?![a-zäöüß])"))
    other = F.filter(lines, lambda x: x.rlike("(?i)warmmiete") & ~x.rlike("(?i)in\\s+(?:der\\s+)?warmmiete\\s+enthalten"))
    rest = F.transform(other, lambda x: F.regexp_extract(x, "(?i)warmmiete.*\\z", 0))
    found = lambda xs, f: F.get(F.filter(F.transform(xs, f), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(found(own, labelled), found(rest, lambda x: of(x, x, False)))


def summary_items(text: Column) -> Column:
    """``pros``, ``cons`` and ``prose`` of the summary: items marked ✓ or ✗ (also several in one line), bullets under a
    marked heading, and the rest. Wrapped lines are joined first."""
    body = section(text, "Summary")
    joined = F.regexp_replace(body, "\\n(?!\\s*(?:(?:[-*]|[0-9]+\\.)\\s|[✓✗✘]|\\n|\\z))[ \\t]*", " ")
    lines = F.filter(F.split(joined, "\n"), lambda s: F.trim(s) != "")

    def segments(line: Column) -> Column:
        bullet = line.rlike("^\\s*(?:[-*]|[0-9]+\\.)\\s+")
        bare = F.regexp_replace(line, "^\\s*(?:[-*]|[0-9]+\\.)\\s+", "")
        return F.transform(F.split(bare, "(?=[✓✗✘])"), lambda s: F.struct(bullet.alias("bullet"), F.trim(s).alias("s")))

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("pros"), empty.alias("cons"), empty.alias("prose"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        mark = F.when(x["s"].startswith("✓"), "pros").when(x["s"].rlike("^[✗✘]"), "cons").otherwise("")
        item = F.trim(F.regexp_replace(strip_markdown(F.regexp_replace(x["s"], "^[✓✗✘]\\s*", "")), "\\s*[·;,]\\s*\\z", ""))
        heading = (mark != "") & item.rlike("(?i)^(?:pros?|cons?|vorteile|nachteile)\\s*:?\\z")
        to = F.when((item == "") | heading, "").when(mark != "", mark).when(x["bullet"] & (a["open"] != ""), a["open"]).otherwise("prose")
        put = lambda name: F.when(to == name, F.concat(a[name], F.array(item))).otherwise(a[name])
        after = F.when(mark != "", mark).when(to == "prose", "").otherwise(a["open"])
        return F.struct(put("pros").alias("pros"), put("cons").alias("cons"), put("prose").alias("prose"), after.alias("open"))

    return F.aggregate(F.flatten(F.transform(lines, segments)), start, step, lambda a: F.struct(a["pros"].alias("pros"), a["cons"].alias("cons"), F.array_join(a["prose"], " ").alias("prose")))


def next_action(text: Column) -> Column:
    """First open item of the next steps, else the first bullet, with its indented continuation; empty if there is none."""
    body = F.concat(section(text, "Next Steps"), F.lit("\n"))
    more = "((?:\\n[ \\t]+\\S[^\\n]*)*)"
    open_item = "(?m)^\\s*-\\s*\\[ \\][ \\t]*(\\S[^\\n]*)" + more
    bullet = "(?m)^\\s*(?:-|[0-9]+\\.)[ \\t]+(\\S[^\\n]*)" + more
    pick = lambda p: F.concat(F.regexp_extract(body, p, 1), F.regexp_replace(F.regexp_extract(body, p, 2), "\\n[ \\t]*(?:(?:[-*]|[0-9]+\\.)[ \\t]+)?", " "))
    return strip_markdown(F.when(body.rlike(open_item), pick(open_item)).otherwise(pick(bullet)))


def reason_of(notes: Column, limit: int = 140) -> Column:
    """Why a row was set aside: by priority of the clauses, not by their position; else the whole note."""
    n = strip_markdown(notes)
    clauses = [F.nullif(F.regexp_extract(n, f"(?i){p}[^|]*", 0), F.lit("")) for p in ("swap-mismatch", "HARD BLOCKER", "DISCARDED", "EXPIRED")]
    return _cut(F.trim(F.coalesce(*clauses, n)), limit)


def with_group(staged: Column, pending: Column) -> Column:
    """A staged line with the group of its pending line put after its portal, unless it has it already."""
    group = F.trim(F.coalesce(F.get(F.split(pending, "\\|"), F.lit(2)), F.lit("")))
    parts = F.split(staged, " \\| ")
    has = F.exists(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), lambda p: F.trim(p) == group)
    put = F.array_join(F.concat(F.slice(parts, 1, 3), F.array(group), F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))), " | ")
    return F.when((group == "") | ~staged.rlike("^- \\[x\\] #[0-9]+") | (F.size(parts) < 3) | has, staged).otherwise(put)
