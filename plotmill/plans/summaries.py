"""Queries of aggregations, windows, ordered limits, set operations and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotmill.functions.text import canonical_url
from plotmill.operators import summaries
from plotmill.operators.incremental import first_by_key
from plotmill.runtime import read_table

TODAY = "2026-11-30"
_KIND = "lower(coalesce(offer_type, ''))"


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: rows, unknown prices, late rows and distinct canonical addresses."""
    return read_table(spark, sf, "scan_inbox").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.coalesce("price", F.lit(0.0)) == 0).alias("no_price"), F.count_if(F.datediff("loaded_at", "first_seen") > 1).alias("late"), F.count_distinct(canonical_url(F.col("url"))).alias("urls")
    )


STATS_SQL = "SELECT batch_no, count(*) AS found, count(*) FILTER (WHERE coalesce(price, 0) = 0) AS no_price, count(*) FILTER (WHERE date_diff('day', first_seen, CAST(loaded_at AS date)) > 1) AS late, count(DISTINCT split_part(split_part(url, '#', 1), '?', 1)) AS urls FROM scan_inbox GROUP BY 1"


def seen_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch, how many canonical addresses the history has, and whether four fifths are reached."""
    seen = read_table(spark, sf, "scan_history").select(canonical_url(F.col("url")).alias("c")).where("c is not null").distinct().withColumn("seen", F.lit(1))
    rows = read_table(spark, sf, "scan_inbox").select("batch_no", canonical_url(F.col("url")).alias("c")).join(seen, "c", "left")
    return rows.groupBy("batch_no").agg(F.count("seen").alias("n_seen"), F.count(F.lit(1)).alias("n")).select("batch_no", "n_seen", "n", (F.col("n_seen") >= 0.8 * F.col("n")).alias("stop"))


RATIO_SQL = "SELECT batch_no, count(*) FILTER (WHERE s) AS n_seen, count(*) AS n, count(*) FILTER (WHERE s) >= 0.8 * count(*) AS stop FROM (SELECT batch_no, split_part(split_part(url, '#', 1), '?', 1) IN (SELECT split_part(split_part(url, '#', 1), '?', 1) FROM scan_history WHERE url IS NOT NULL) AS s FROM scan_inbox) GROUP BY 1"


def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """History rows per portal and kind of skipping, zero-filled."""
    kinds = ["added", "skipped_dup", "skipped_title", "archived"]
    return read_table(spark, sf, "scan_history").groupBy("portal").pivot("status", kinds).count().na.fill(0, kinds)


PIVOT_SQL = "SELECT portal, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in ("added", "skipped_dup", "skipped_title", "archived")) + " FROM scan_history GROUP BY 1"


def label_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per short portal label, in order of first appearance."""
    return summaries.breakdown(read_table(spark, sf, "scan_history"), F.left("portal", F.lit(4)), "entry_id")


BREAKDOWN_SQL = "SELECT label, n, row_number() OVER (ORDER BY first, label) AS rank FROM (SELECT left(portal, 4) AS label, count(*) AS n, min(entry_id) AS first FROM scan_history GROUP BY 1)"


def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per address the latest report, the first path among equals, and how many there are."""
    return summaries.latest_by(read_table(spark, sf, "reports").where("url <> '' and created_on is not null"), "url", "created_on", "path", ["path", "created_on"])


LATEST_SQL = "SELECT url, path, created_on, n FROM (SELECT *, count(*) OVER (PARTITION BY url) AS n FROM reports WHERE url <> '' AND created_on IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY url ORDER BY created_on DESC, path) = 1"


def archive_months(spark: SparkSession, sf: str) -> DataFrame:
    """History rows per month and status, with running totals per status."""
    m = read_table(spark, sf, "scan_history").groupBy(F.date_format("first_seen", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("status").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("running", F.sum("n").over(w)).withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("status").orderBy("month")))


MONTHS_SQL = "SELECT month, status, n, CAST(sum(n) OVER (PARTITION BY status ORDER BY month) AS bigint) AS running, n - lag(n) OVER (PARTITION BY status ORDER BY month) AS change FROM (SELECT strftime(first_seen, '%Y-%m') AS month, status, count(*) AS n FROM scan_history GROUP BY 1, 2)"


def _tracker(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "tracker_additions").withColumn("kind", F.lower(F.coalesce("offer_type", F.lit(""))))


_AGGS = lambda: (F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker statistics, rolled up from kind and status to all."""
    return _tracker(spark, sf).rollup("kind", "status").agg(F.grouping_id().alias("level"), *_AGGS())


def status_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker statistics over all combinations of kind, portal and status."""
    return _tracker(spark, sf).cube("kind", "portal", "status").agg(F.grouping_id().alias("level"), *_AGGS())


def status_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker statistics by portal, by status and in all, in one pass."""
    return _tracker(spark, sf).groupingSets([["portal"], ["status"], []], "portal", "status").agg(F.grouping_id().alias("level"), *_AGGS())


def _grouping_sql(by: str, cols: str) -> str:
    return f"SELECT {cols}, CAST(grouping_id({cols}) AS bigint) AS level, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT *, {_KIND} AS kind FROM tracker_additions) GROUP BY {by}"


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows per half point of the score, with their share."""
    h = read_table(spark, sf, "tracker_additions").where("score is not null").groupBy((F.floor(F.col("score") * 2) / 2).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("low", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


HISTOGRAM_SQL = "SELECT floor(score * 2) / 2 AS low, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tracker_additions WHERE score IS NOT NULL GROUP BY 1"


def market_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Price per m² by rooms: mean, exact tenth, fiftieth and ninetieth percentile, and mean against the overall one."""
    h = read_table(spark, sf, "scan_history").where("price > 0 and price < 10000 and m2 > 0 and rooms > 0").select("rooms", (F.col("price") / F.col("m2")).alias("rate"))
    g = h.groupBy("rooms").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("mean"), F.percentile("rate", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    overall = F.sum(F.col("mean") * F.col("n")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return g.select("rooms", "n", F.round("mean", 5).alias("mean"), *[F.round(F.col("p")[k], 5).alias(f"p{q}") for k, q in enumerate((10, 50, 90))], F.round(F.col("mean") / overall, 5).alias("against_all"))


MARKET_SQL = """SELECT rooms, count(*) AS n, round(avg(rate), 5) AS mean, round(quantile_cont(rate, 0.1), 5) AS p10, round(quantile_cont(rate, 0.5), 5) AS p50, round(quantile_cont(rate, 0.9), 5) AS p90, round(avg(rate) / (sum(avg(rate) * count(*)) OVER () / sum(count(*)) OVER ()), 5) AS against_all
FROM (SELECT rooms, price / m2 AS rate FROM scan_history WHERE price > 0 AND price < 10000 AND m2 > 0 AND rooms > 0) GROUP BY 1"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """History rows per hood of the gazetteer, zero included."""
    h = read_table(spark, sf, "scan_history").groupBy(F.col("location").alias("hood")).agg(F.count(F.lit(1)).alias("k"))
    return read_table(spark, sf, "gazetteer").join(h, "hood", "left").select("plz", "hood", F.coalesce("k", F.lit(0)).alias("n"))


COVERAGE_SQL = "SELECT plz, hood, coalesce(k, 0) AS n FROM gazetteer LEFT JOIN (SELECT location AS hood, count(*) AS k FROM scan_history GROUP BY 1) USING (hood)"


def orphan_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that nothing refers to although their number is referred to."""
    used = read_table(spark, sf, "tracker_additions").select(F.nullif(F.regexp_extract("report", "reports/.*?\\.md", 0), F.lit("")).alias("path")).where("path is not null").distinct()
    number = F.regexp_extract("path", "^reports/([0-9]+)-", 1)
    r = read_table(spark, sf, "reports").select("report_id", "path").join(used, "path", "left_anti").withColumn("num", number)
    return r.join(used.select(number.alias("num")).where("num <> ''").distinct(), "num", "left_semi").select("report_id", "path")


ORPHAN_SQL = "WITH u AS (SELECT DISTINCT nullif(regexp_extract(report, 'reports/.*?\\.md'), '') AS path FROM tracker_additions) SELECT report_id, path FROM reports WHERE path NOT IN (SELECT path FROM u WHERE path IS NOT NULL) AND regexp_extract(path, '^reports/([0-9]+)-', 1) IN (SELECT regexp_extract(path, '^reports/([0-9]+)-', 1) FROM u WHERE regexp_extract(path, '^reports/([0-9]+)-', 1) <> '')"


def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The five best tracker rows: a top-k report."""
    return read_table(spark, sf, "tracker_additions").where("score is not null").orderBy(F.desc("score"), "addition_id").limit(5).select("addition_id", "score")


TOP_SQL = "SELECT addition_id, score FROM tracker_additions WHERE score IS NOT NULL ORDER BY score DESC, addition_id LIMIT 5"


def stale_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The ten rows that wait longest, better scores first: a top-k report over two sort keys."""
    a = read_table(spark, sf, "tracker_additions").withColumn("days", F.datediff(F.lit(TODAY), "add_date")).where("days > 14")
    return a.orderBy(F.desc("days"), F.desc(F.coalesce("score", F.lit(0.0))), "addition_id").limit(10).select("addition_id", "days")


STALE_SQL = f"SELECT addition_id, CAST(date_diff('day', add_date, DATE '{TODAY}') AS integer) AS days FROM tracker_additions WHERE date_diff('day', add_date, DATE '{TODAY}') > 14 ORDER BY days DESC, coalesce(score, 0) DESC, addition_id LIMIT 10"


def best_per_portal(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, dense rank and quartile of each tracker row by score within its portal and month."""
    w = Window.partitionBy("portal", F.date_format("add_date", "yyyy-MM")).orderBy(F.desc("score"), "addition_id")
    tied = Window.partitionBy("portal", F.date_format("add_date", "yyyy-MM")).orderBy(F.desc("score"))
    a = read_table(spark, sf, "tracker_additions").where("score is not null")
    return a.select("addition_id", F.row_number().over(w).alias("k"), F.rank().over(tied).alias("rank"), F.dense_rank().over(tied).alias("dense"), F.ntile(4).over(w).alias("quartile"))


RANK_SQL = "SELECT addition_id, row_number() OVER w AS k, rank() OVER t AS rank, dense_rank() OVER t AS dense, ntile(4) OVER w AS quartile FROM tracker_additions WHERE score IS NOT NULL WINDOW w AS (PARTITION BY portal, strftime(add_date, '%Y-%m') ORDER BY score DESC, addition_id), t AS (PARTITION BY portal, strftime(add_date, '%Y-%m') ORDER BY score DESC)"


def source_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most a hundred rows per portal in order of arrival: the cap is the operator."""
    return summaries.capped(read_table(spark, sf, "scan_inbox").where("portal is not null"), "portal", ["batch_no", "entry_id"], 100).select("entry_id", "portal")


CAP_SQL = "SELECT entry_id, portal FROM scan_inbox WHERE portal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY portal ORDER BY batch_no, entry_id) <= 100"


def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Batches read per portal until the first one of which a quarter was skipped by title."""
    pages = read_table(spark, sf, "scan_inbox").where("portal is not null").groupBy("portal", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "skipped_title").alias("skipped"))
    return summaries.until_stop(pages, "portal", "batch_no", F.col("skipped") >= 0.25 * F.col("n"))


STOP_SQL = "SELECT portal, batch_no, n, skipped FROM (SELECT *, min(CASE WHEN skipped >= 0.25 * n THEN batch_no END) OVER (PARTITION BY portal) AS halt FROM (SELECT portal, batch_no, count(*) AS n, count(*) FILTER (WHERE status = 'skipped_title') AS skipped FROM scan_inbox WHERE portal IS NOT NULL GROUP BY 1, 2)) WHERE halt IS NULL OR batch_no <= halt"


def dimension_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Per portal the cheapest, the largest and the best scored tracker row."""
    a = read_table(spark, sf, "tracker_additions").where("portal is not null").withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("price", "m2", "score")})
    return summaries.winners(a, "portal", "addition_id", {"price": False, "m2": True, "score": True})


WINNERS_SQL = " UNION ALL ".join(f"(SELECT portal, '{c}' AS dimension, addition_id, {c} AS value FROM tracker_additions WHERE portal IS NOT NULL AND {c} > 0 QUALIFY row_number() OVER (PARTITION BY portal ORDER BY {c} {o}, addition_id) = 1)" for c, o in (("price", "ASC"), ("m2", "DESC"), ("score", "DESC")))


def file_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Staged lines that aren't blank, each with the number of the row last opened in its file."""
    lines = read_table(spark, sf, "tracker_lines").where("line_no is not null")
    marker = F.nullif(F.regexp_extract("line", "^([0-9]{1,9})\\t", 1), F.lit(""))
    return summaries.carried_sections(lines, "file_name", "line_no", marker).where("trim(line) <> ''").select("line_id", "section")


SECTION_SQL = "SELECT line_id, section FROM (SELECT *, last_value(nullif(regexp_extract(line, '^([0-9]{1,9})\\t', 1), '') IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no) AS section FROM tracker_lines WHERE line_no IS NOT NULL) WHERE trim(line, ' ') <> ''"


def next_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """New tracker rows numbered on from the largest number so far, without a sort in one task."""
    a = read_table(spark, sf, "tracker_additions")
    top = a.where("add_date < '2026-07-01'").agg(F.coalesce(F.max(F.col("num").try_cast("bigint")), F.lit(0)).alias("top"))
    new = a.where("add_date >= '2026-07-01'").select("addition_id", "add_date")
    days = new.groupBy("add_date").agg(F.count(F.lit(1)).alias("n")).select("add_date", F.coalesce(F.sum("n").over(Window.orderBy("add_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("add_date").orderBy("addition_id"))
    return new.withColumn("k", k).join(days, "add_date").join(F.broadcast(top)).select("addition_id", (F.col("top") + F.col("before") + F.col("k")).alias("num"))


NEXT_SQL = "SELECT addition_id, (SELECT coalesce(max(try_cast(num AS bigint)), 0) FROM tracker_additions WHERE add_date < '2026-07-01') + row_number() OVER (ORDER BY add_date, addition_id) AS num FROM tracker_additions WHERE add_date >= '2026-07-01'"


def url_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of union, intersection and differences of the history's and the reports' addresses."""
    h, r = (read_table(spark, sf, t).select("url").where("url <> ''").distinct() for t in ("scan_history", "reports"))
    parts = {"union": h.union(r).distinct(), "both": h.intersect(r), "history_only": h.exceptAll(r), "reports_only": r.subtract(h)}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


SETS_SQL = "WITH h AS (SELECT DISTINCT url FROM scan_history WHERE url <> ''), r AS (SELECT DISTINCT url FROM reports WHERE url <> '') SELECT 'union' AS part, count(*) AS n FROM (FROM h UNION FROM r) UNION ALL SELECT 'both', count(*) FROM (FROM h INTERSECT FROM r) UNION ALL SELECT 'history_only', count(*) FROM (FROM h EXCEPT FROM r) UNION ALL SELECT 'reports_only', count(*) FROM (FROM r EXCEPT FROM h)"


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """History rows per month and fate: kept, compacted after ninety days, archived after thirty."""
    age = F.datediff(F.lit(TODAY), "first_seen")
    fate = F.when((F.col("status") == "skipped_criteria") & (age > 90), "compacted").when((F.col("status") != "added") & (age > 30), "archived").otherwise("kept")
    return read_table(spark, sf, "scan_history").groupBy(F.date_format("first_seen", "yyyy-MM").alias("month"), fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


_AGE = f"date_diff('day', first_seen, DATE '{TODAY}')"
RETENTION_SQL = f"SELECT strftime(first_seen, '%Y-%m') AS month, CASE WHEN status = 'skipped_criteria' AND {_AGE} > 90 THEN 'compacted' WHEN status <> 'added' AND {_AGE} > 30 THEN 'archived' ELSE 'kept' END AS fate, count(*) AS n FROM scan_history GROUP BY 1, 2"


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Per canonical address of both tables the row loaded last, its status as it is now."""
    cols = ["entry_id", "url", "status", "loaded_at"]
    rows = read_table(spark, sf, "scan_history").select(*cols).unionByName(read_table(spark, sf, "scan_inbox").select(*cols)).where("url is not null and loaded_at is not null")
    late = rows.withColumns({"c": canonical_url(F.col("url")), "back": -F.col("entry_id")})
    return late.groupBy("c").agg(F.max_by(F.struct("entry_id", "status"), F.struct("loaded_at", "back")).alias("r")).select(F.col("c").alias("url"), "r.*")


UPSERT_SQL = "SELECT c AS url, entry_id, status FROM (SELECT *, split_part(split_part(url, '#', 1), '?', 1) AS c FROM (SELECT entry_id, url, status, loaded_at FROM scan_history UNION ALL SELECT entry_id, url, status, loaded_at FROM scan_inbox) WHERE url IS NOT NULL AND loaded_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY c ORDER BY loaded_at DESC, entry_id) = 1"


def integrity(spark: SparkSession, sf: str) -> DataFrame:
    """One row per check: how many rows break it, and whether that is an error or a warning."""
    h, a, r = (read_table(spark, sf, t) for t in ("scan_history", "tracker_additions", "reports"))

    def check(name: str, level: str, df: DataFrame, broken) -> DataFrame:
        return df.agg(F.count_if(broken).alias("n")).select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n")

    known = ["added", "skipped_criteria", "skipped_dup", "skipped_title", "skipped_expired", "archived"]
    double = a.groupBy("num").agg(F.count(F.lit(1)).alias("k"))
    parts = [
        check("status", "error", h, ~F.col("status").isin(known) | F.col("status").isNull()),
        check("url", "error", h, ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))),
        check("late", "warning", h, F.datediff("loaded_at", "first_seen") > 1),
        check("score", "error", a, ~F.col("score").between(0, 5)),
        check("num", "warning", double, F.col("k") > 1),
        check("path", "error", r, ~F.coalesce(F.col("path").rlike("^reports/.*\\.md\\z"), F.lit(False))),
        check("deleted", "error", r, F.col("deleted_on") < F.col("created_on")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _check_sql(name: str, level: str, table: str, broken: str) -> str:
    return f"SELECT '{name}' AS \"check\", '{level}' AS level, count(*) FILTER (WHERE {broken}) AS n FROM {table}"


INTEGRITY_SQL = " UNION ALL ".join(
    [
        _check_sql("status", "error", "scan_history", "status IS NULL OR status NOT IN ('added', 'skipped_criteria', 'skipped_dup', 'skipped_title', 'skipped_expired', 'archived')"),
        _check_sql("url", "error", "scan_history", "NOT coalesce(regexp_matches(url, '^https?://'), false)"),
        _check_sql("late", "warning", "scan_history", "date_diff('day', first_seen, CAST(loaded_at AS date)) > 1"),
        _check_sql("score", "error", "tracker_additions", "NOT score BETWEEN 0 AND 5"),
        _check_sql("num", "warning", "(SELECT num, count(*) AS k FROM tracker_additions GROUP BY 1)", "k > 1"),
        _check_sql("path", "error", "reports", "NOT coalesce(regexp_full_match(path, 'reports/.*\\.md'), false)"),
        _check_sql("deleted", "error", "reports", "deleted_on < created_on"),
    ]
)


def first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """First row of each canonical address in the history, by entry."""
    return first_by_key(read_table(spark, sf, "scan_history").select("entry_id", "url").where("url is not null"), canonical_url(F.col("url")), ["entry_id"])


FIRST_SQL = "SELECT entry_id, url FROM scan_history WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split_part(split_part(url, '#', 1), '?', 1) ORDER BY entry_id) = 1"

QUERIES = {
    f.__name__: f
    for f in (
        ingest_stats, seen_ratio, status_pivot, label_breakdown, latest_report, archive_months, status_rollup, status_cube, status_sets, score_histogram, market_percentiles, coverage, orphan_prefix, top_scores,
        stale_queue, best_per_portal, source_cap, early_stop, dimension_winners, file_sections, next_numbers, url_sets, retention, upsert_latest, integrity, first_arrivals,
    )
}
ORACLES = dict(
    zip(
        QUERIES,
        (
            STATS_SQL, RATIO_SQL, PIVOT_SQL, BREAKDOWN_SQL, LATEST_SQL, MONTHS_SQL, _grouping_sql("ROLLUP (kind, status)", "kind, status"), _grouping_sql("CUBE (kind, portal, status)", "kind, portal, status"),
            _grouping_sql("GROUPING SETS ((portal), (status), ())", "portal, status"), HISTOGRAM_SQL, MARKET_SQL, COVERAGE_SQL, ORPHAN_SQL, TOP_SQL, STALE_SQL, RANK_SQL, CAP_SQL, STOP_SQL, WINNERS_SQL, SECTION_SQL, NEXT_SQL, SETS_SQL,
            RETENTION_SQL, UPSERT_SQL, INTEGRITY_SQL, FIRST_SQL,
        ),
        strict=True,
    )
)
