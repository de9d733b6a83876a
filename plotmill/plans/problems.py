"""Queries p2, p5 and p6: table differences, lines that fail to parse, references without a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions.exact_numbers import exact_from_double, exact_from_text
from plotmill.operators import references as refs
from plotmill.operators.table_diff import table_diff
from plotmill.runtime import materialize, read_table
from plotmill.sources.delimited import line_errors, parse_tracker_lines, tracker_rows

NUMBERS = ["price", "m2", "rooms"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    history = read_table(spark, sf, "scan_history").select("entry_id", *[exact_from_double(F.col(c)).alias(c) for c in NUMBERS])
    mirror = read_table(spark, sf, "scan_mirror").select("entry_id", *[exact_from_text(F.col(c)).alias(c) for c in NUMBERS])
    return table_diff(history, mirror, "entry_id", NUMBERS, left_name="history", right_name="mirror")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return line_errors(parse_tracker_lines(read_table(spark, sf, "tracker_lines"))).select("line_id", "reason")


def p5_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that can't be loaded, with the offset at which the reason shows."""
    return line_errors(parse_tracker_lines(read_table(spark, sf, "tracker_lines")))


def p5_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The valid lines as typed rows."""
    return tracker_rows(parse_tracker_lines(read_table(spark, sf, "tracker_lines")))


def _p6(spark: SparkSession, sf: str) -> tuple[DataFrame, list[DataFrame]]:
    """The references, and the change deltas of each table with the date of each change."""
    additions, reports, history = (read_table(spark, sf, t) for t in ("tracker_additions", "reports", "scan_history"))
    path = F.nullif(F.regexp_extract("report", "reports/.*?\\.md", 0), F.lit(""))
    url = F.when(~F.col("url").rlike("^\\s*\\z"), F.col("url"))
    rows = additions.select(F.lit("tracker_additions").alias("ref_table"), F.col("addition_id").alias("ref_id"), path.alias("key"), F.col("add_date").alias("ref_on")).unionByName(
        reports.select(F.lit("reports").alias("ref_table"), F.col("report_id").alias("ref_id"), url.alias("key"), F.col("created_on").alias("ref_on"))
    )
    changes = [
        (additions, "add_date", lambda t, keep=(): refs.reference_deltas(t, "tracker_additions", path, F.col("add_date"), keep=keep)),
        (reports, "created_on", lambda t, keep=(): refs.existence_deltas(t, "tracker_additions", F.col("path"), F.col("created_on"), keep=keep)),
        (reports.where("deleted_on is not null"), "deleted_on", lambda t, keep=(): refs.deletion_deltas(t, "tracker_additions", F.col("path"), F.col("created_on"), keep=keep)),
        (reports, "created_on", lambda t, keep=(): refs.reference_deltas(t, "reports", url, F.col("created_on"), keep=keep)),
        (history, "first_seen", lambda t, keep=(): refs.existence_deltas(t, "reports", F.col("url"), F.col("first_seen"), keep=keep)),
    ]
    return rows, changes


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references of a ledger that takes the changes of the targets first and then those of the references."""
    rows, changes = _p6(spark, sf)
    ledger = refs.ReferenceLedger(spark)
    for part in ([changes[1], changes[2], changes[4]], [changes[0], changes[3]]):
        ledger.apply(reduce(DataFrame.unionByName, [deltas(t) for t, _, deltas in part]))
    return refs.orphan_rows(rows, ledger.current())


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return refs.orphan_report(p6_found(spark, sf))


def p6_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan keys of a ledger to which the changes were applied month by month, in the order in which they happened;
    changes without a date come first. Records and references come and records go, each in its own month."""
    _, changes = _p6(spark, sf)
    month = lambda on: F.coalesce(F.date_format(on, "yyyy-MM"), F.lit("0000-00"))
    log = materialize(reduce(DataFrame.unionByName, [deltas(t.withColumn("month", month(on)), ("month",)) for t, on, deltas in changes]), "changes", "month")
    ledger = refs.ReferenceLedger(spark)
    for m in sorted(r.month for r in log.select("month").distinct().collect()):
        ledger.apply(log.where(F.col("month") == m).drop("month"))
    return refs.orphan_keys(ledger.current()).select("ref_table", "key", "refs", "ever", F.date_format("ref_since", "yyyy-MM-dd").alias("ref_since"))


def _number_sql(col: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({col}, '([0-9]) ?½', '\\1,5', 'g'), '([0-9]) ?¼', '\\1,25', 'g'), '([0-9]) ?¾', '\\1,75', 'g')"
    body = f"regexp_extract({t}, '[-−]?[0-9]+(?:[.,''’ \\x{{00a0}}\\x{{2009}}\\x{{202f}}][0-9]+)*')"
    frac = f"regexp_extract({body}, '[.,]([0-9]{{1,2}}|[0-9]{{4,}})$', 1)"
    return f"nullif(try_cast(regexp_replace(left({body}, length({body}) - length({frac})), '[^0-9]', '', 'g') || '.' || {frac} || '0' AS decimal(18,4)), 0)"


P2_SQL = f"""
WITH h AS (SELECT entry_id, {", ".join(f"nullif(try_cast({c} AS decimal(18,4)), 0) AS {c}" for c in NUMBERS)} FROM scan_history),
m AS (SELECT DISTINCT entry_id, {", ".join(f"{_number_sql(c)} AS {c}" for c in NUMBERS)} FROM scan_mirror)
SELECT entry_id, 'missing_in_mirror' AS issue FROM h WHERE entry_id NOT IN (SELECT entry_id FROM m)
UNION ALL SELECT DISTINCT entry_id, 'missing_in_history' AS issue FROM m WHERE entry_id NOT IN (SELECT entry_id FROM h)
{" ".join(f"UNION ALL SELECT entry_id, '{c}' AS issue FROM h JOIN m USING (entry_id) WHERE h.{c} IS DISTINCT FROM m.{c}" for c in NUMBERS)}
"""

_CELL = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_P5_CTE = f"""
WITH kept AS (SELECT line_id, line FROM tracker_lines WHERE line IS NOT NULL AND NOT regexp_full_match(line, ' *') AND NOT starts_with(line, 'num' || chr(9))),
tok AS (SELECT line_id, line, regexp_full_match(line, '(?s){_CELL}(?:\\t{_CELL})*') AS quoted_well,
  list_transform(regexp_extract_all(chr(9) || line, '(?s)\\t("(?:[^"]|"")*"|[^\\t]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS cells FROM kept),
judged AS (SELECT *, trim(cells[1], ' ') AS num, CASE WHEN NOT quoted_well THEN 'quotes' WHEN len(cells) NOT IN (11, 12) THEN 'columns'
  WHEN NOT regexp_full_match(trim(cells[1], ' '), '[0-9]{{1,9}}') OR regexp_full_match(trim(cells[1], ' '), '0+') THEN 'num'
  WHEN regexp_matches(coalesce(cells[12], ''), '[\\x00-\\x08\\x0A-\\x1F\\x7F\\x{{FFFD}}]') THEN 'notes' END AS reason FROM tok)
"""
P5_SQL = _P5_CTE + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
P5_ROWS_SQL = (
    _P5_CTE
    + f"""SELECT line_id, try_cast(num AS integer) AS num, try_cast(trim(cells[2], ' ') AS date) AS add_date, nullif(cells[3], '') AS portal, nullif(cells[4], '') AS offer_type, nullif(cells[5], '') AS location,
{", ".join(f"CAST({_number_sql(f'cells[{k}]')} AS double) AS {c}" for k, c in ((6, "price"), (7, "m2"), (8, "rooms")))}, try_cast(replace(trim(cells[9], ' '), ',', '.') AS double) AS score, nullif(cells[10], '') AS status, nullif(cells[11], '') AS report, nullif(cells[12], '') AS notes
FROM judged WHERE reason IS NULL"""
)

_P6_CTE = """
WITH r1 AS (SELECT addition_id AS ref_id, nullif(regexp_extract(report, 'reports/.*?\\.md'), '') AS key, add_date AS ref_on FROM tracker_additions),
e1 AS (SELECT path AS key, count(*) FILTER (WHERE deleted_on IS NULL) AS live, min(created_on) AS since FROM reports GROUP BY 1),
r2 AS (SELECT report_id AS ref_id, CASE WHEN NOT regexp_full_match(url, '\\s*') THEN url END AS key, created_on AS ref_on FROM reports),
e2 AS (SELECT url AS key, count(*) AS live, min(first_seen) AS since FROM scan_history GROUP BY 1),
found AS (
SELECT 'tracker_additions' AS ref_table, ref_id, CASE WHEN e1.live IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN ref_on < since THEN 'late' END AS reason, strftime(ref_on, '%Y-%m') AS ref_month
FROM r1 LEFT JOIN e1 USING (key) WHERE key IS NOT NULL
UNION ALL
SELECT 'reports', ref_id, CASE WHEN e2.live IS NULL THEN 'missing' WHEN ref_on < since THEN 'late' END, strftime(ref_on, '%Y-%m') FROM r2 LEFT JOIN e2 USING (key) WHERE key IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_errors": p5_errors, "p5_rows": p5_rows, "p6_found": p6_found, "p6_report": p6_report, "p6_monthly": p6_monthly}
ORACLES = {
    "p2_found": P2_SQL,
    "p5_found": P5_SQL,
    "p5_rows": P5_ROWS_SQL,
    "p6_found": _P6_CTE + "SELECT ref_table, ref_id, reason, ref_month FROM found WHERE reason IS NOT NULL",
    "p6_report": _P6_CTE + "SELECT ref_table, ref_month, reason, count(*) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_monthly": _P6_CTE
    + """, keys AS (
SELECT 'tracker_additions' AS ref_table, key, count(*) AS refs, coalesce(max(n), 0) AS ever, coalesce(max(live), 0) AS live, min(ref_on) AS ref_since
FROM r1 LEFT JOIN (SELECT path AS key, count(*) AS n, count(*) FILTER (WHERE deleted_on IS NULL) AS live FROM reports GROUP BY 1) USING (key) WHERE key IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'reports', key, count(*), coalesce(max(live), 0), coalesce(max(live), 0), min(ref_on) FROM r2 LEFT JOIN e2 USING (key) WHERE key IS NOT NULL GROUP BY 2)
SELECT ref_table, key, refs, ever, strftime(ref_since, '%Y-%m-%d') AS ref_since FROM keys WHERE live = 0""",
}
