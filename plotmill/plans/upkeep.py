"""Queries of maintenance operators and of report extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.functions.numbers import reconcile_number
from plotmill.functions.places import neighbourhood
from plotmill.operators import linkage, maintenance
from plotmill.plans.linkage import CROSS_SQL, town_names
from plotmill.runtime import read_table
from plotmill.sources import reports


def duplicates_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows that go, of the confirmed cross-portal pairs of their batch."""
    rows = read_table(spark, sf, "scan_inbox").withColumn("hood", neighbourhood(F.col("location"), town_names(spark, sf)))
    pairs = linkage.cross_source_pairs(rows.select("entry_id", "batch_no", "url", "portal", "price", "m2", "rooms", "hood"), "entry_id", ["batch_no"])
    rank = F.when(F.col("portal") == "Wohnkompass", 3).when(F.col("portal") == "Mietradar", 2).when(F.col("portal") == "Kiezmarkt", 1)
    return maintenance.resolve_duplicates(pairs, rows, "entry_id", rank).select(F.col("loser").alias("entry_id"))


_RANK = "CASE portal WHEN 'Wohnkompass' THEN 3 WHEN 'Mietradar' THEN 2 WHEN 'Kiezmarkt' THEN 1 ELSE 0 END"
RESOLVED_SQL = CROSS_SQL.split("SELECT entry_id, count(*)")[0] + f", k AS (SELECT entry_id, {_RANK} AS rank FROM scan_inbox) SELECT DISTINCT CASE WHEN b.rank > a.rank THEN ia ELSE ib END AS entry_id FROM p JOIN k a ON a.entry_id = ia JOIN k b ON b.entry_id = ib WHERE kind = 'confirmed'"


def corrections_applied(spark: SparkSession, sf: str) -> DataFrame:
    """History rows that the mirror corrects: price beyond 5 and 3 %, size beyond 1; the title follows if both change."""
    h = read_table(spark, sf, "scan_history").select("entry_id", "price", "m2", "title")
    m = read_table(spark, sf, "scan_mirror").groupBy("entry_id").agg(F.max(reconcile_number(F.col("price"))).alias("price"), F.max(reconcile_number(F.col("m2"))).alias("m2"), F.max("title").alias("title"))
    fixed = maintenance.apply_corrections(h, m, "entry_id", {"price": F.greatest(F.lit(5.0), F.col("__price") * 0.03), "m2": F.lit(1.0)}, {"title": ["price", "m2"]})
    return fixed.where("changed <> ''")


def _corrections_sql() -> str:
    from plotmill.plans.scalars import NUM_SQL

    expr = NUM_SQL.split("AS n_report,\n")[1].split(" AS n_reconcile")[0]
    return f"""WITH m AS (SELECT entry_id, max({expr}) AS p, max({expr.replace("price", "m2")}) AS s, max(title) AS t FROM scan_mirror GROUP BY 1),
j AS (SELECT h.*, p, s, t, coalesce(price <> 0 AND p <> 0 AND abs(price - p) > greatest(5.0, p * 0.03), false) AS cp, coalesce(m2 <> 0 AND s <> 0 AND abs(m2 - s) > 1, false) AS cs FROM scan_history h JOIN m USING (entry_id))
SELECT entry_id, CASE WHEN cp THEN p ELSE price END AS price, CASE WHEN cs THEN s ELSE m2 END AS m2, CASE WHEN cp AND cs AND t IS NOT NULL THEN t ELSE title END AS title,
concat_ws(',', CASE WHEN cp THEN 'price' END, CASE WHEN cs THEN 'm2' END, CASE WHEN cp AND cs AND t IS NOT NULL THEN 'title' END) AS changed FROM j WHERE cp OR cs"""


def statuses_advanced(spark: SparkSession, sf: str) -> DataFrame:
    """Tracker rows per status after one guarded step: viewings before November are viewed."""
    a = read_table(spark, sf, "tracker_additions").select("addition_id", "status", "add_date")
    u = a.where("add_date < '2026-11-01'").select("addition_id", F.lit("Viewing").alias("expected"), F.lit("Viewed").alias("status"))
    return maintenance.advance_status(a, u, "addition_id", {"Viewing": "Viewed"}).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


ADVANCED_SQL = "SELECT CASE WHEN status = 'Viewing' AND add_date < '2026-11-01' THEN 'Viewed' ELSE status END AS status, count(*) AS n FROM tracker_additions GROUP BY 1"


def report_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Title, pros, cons and next action of every report text."""
    d = read_table(spark, sf, "documents").where(F.lower(F.trim("source")) == "report")
    t = F.col("text")
    return d.select("doc_id", reports.report_title(t).alias("title"), reports.summary_items(t).alias("s"), reports.next_action(t).alias("action")).select("doc_id", "title", F.size("s.pros").alias("pros"), F.size("s.cons").alias("cons"), F.length("s.prose").alias("prose_chars"), "action")


QUERIES = {f.__name__: f for f in (duplicates_resolved, corrections_applied, statuses_advanced, report_lists)}
ORACLES = {"duplicates_resolved": RESOLVED_SQL, "corrections_applied": _corrections_sql(), "statuses_advanced": ADVANCED_SQL}
