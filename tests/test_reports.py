"""Report extraction on small texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from plotmill.sources import reports


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()[0]


def test_records(spark):
    t = "# Evaluation: A — B\n**URL:** https://a.example/1\n**Date:** 2026-05-01\n**Score:** 4,1/5\n- Kaltmiete: 1.150–1.200 EUR (x)\n- Wohnfläche: 80,5 m²\n- Rooms: 30\n"
    df = spark.createDataFrame([(1, t), (2, "**URL:** u\n**Score:** discarded\n"), (3, "no url"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r for r in reports.report_records(df, ["id"]).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r.url, r.date, r.score, r.status, r.rent, r.m2, r.rooms) == ("https://a.example/1", datetime.date(2026, 5, 1), 4.1, None, 1200.0, 80.5, None)
    assert got[2].status == "DISCARDED" and got[2].score is None


@pytest.mark.parametrize(("text", "want"), [("# Evaluation: #12 — **Flat** in X\ny", "Flat in X"), ("# 🔄 SWAP — TAUSCHWOHNUNG: „Nice“ — X", "Nice — X"), ("none", ""), ("# " + "word " * 30, "word " * 15 + "word…")])
def test_title(spark, text, want):
    assert one(spark, text, reports.report_title) == want


def test_address(spark):
    assert one(spark, "**Address:** Weg 1, X (exact, from ad)\n", reports.report_address) == ("Weg 1, X", "exact")
    assert one(spark, "**Address:** X\n", reports.report_address) == ("X", "")
    assert one(spark, "x", reports.report_address) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("- Warmmiete: **1.975,00 EUR** (1.500 + x)", (1975.0, None, False)), ("- Warmmiete: ca. **1.500–1.600 EUR**", (1500.0, 1600.0, True)), ("| Warmmiete | 980 EUR |", (980.0, None, False)),
        ("Heizung in Warmmiete enthalten 500\nDie Warmmiete liegt bei geschätzt 1.200 EUR", (1200.0, None, True)), ("- Warmmiete: 12 EUR", None), ("Kaltmiete 900", None), (None, None), ("", None),
    ],
)
def test_warm_rent(spark, text, want):
    got = one(spark, text, reports.warm_rent)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("✓ bright\n✗ loud", (["bright"], ["loud"], "")), ("✓ Pros:\n- bright\n- quiet\n✗ Cons:\n- far", (["bright", "quiet"], ["far"], "")), ("✓ a · ✓ b. ✗ c", (["a", "b."], ["c"], "")),
        ("✓ **Pro:** a long\nwrapped item", (["Pro: a long wrapped item"], [], "")), ("Just prose.\n\nMore.", ([], [], "Just prose. More.")), ("", ([], [], "")),
    ],
)
def test_summary(spark, body, want):
    got = one(spark, f"# T\n## Summary\n\n{body}\n## Next Steps\nx", reports.summary_items)
    assert (list(got.pros), list(got.cons), got.prose) == want


def test_action_reason_group(spark):
    t = "## Next Steps\n- [x] done\n- [ ] In one message **ask**:\n  - rent\n  - date\n- [ ] later\n## Z\n"
    assert one(spark, t, reports.next_action) == "In one message ask: rent date"
    assert one(spark, "## Next Steps\n1. call\n", reports.next_action) == "call"
    assert one(spark, "x", reports.next_action) == ""
    assert one(spark, "DISCARDED swap-mismatch: too small | more", reports.reason_of) == "swap-mismatch: too small"
    assert one(spark, "plain", reports.reason_of) == "plain"
    df = spark.createDataFrame([("- [x] #7 | u | p | d | 4", "- [ ] u | p | g | t"), ("- [x] #7 | u | p | g | d", "- [ ] u | p | g | t"), ("- [ ] u", "- [ ] u | p | g")], "s string, p string")
    assert [r[0] for r in df.select(reports.with_group(F.col("s"), F.col("p"))).collect()] == ["- [x] #7 | u | p | g | d | 4", "- [x] #7 | u | p | g | d", "- [ ] u"]
