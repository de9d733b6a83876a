"""Tolerance joins, linkage, incremental operators, places, numbers, text and sources on small fixtures."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotmill.functions import numbers, places, text
from plotmill.operators import incremental, linkage
from plotmill.operators.bands import Band, band_join
from plotmill.runtime import materialize, shared_dir
from plotmill.sources import captures, mail, markdown

D = datetime.date


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("value", "answers"),
    [
        ("1.158", {"linkage": 1158, "queue": 1158, "report": 1158, "reconcile": 1158, "page": 1158, "card": 1158, "room": 1.158, "score": 1.158, "prefix": 1.158}),
        ("72.5", {"linkage": 72.5, "report": 72.5, "reconcile": 72.5, "page": 725, "card": 725, "room": 72.5, "prefix": 72.5}),
        ("1,250", {"linkage": 1.25, "report": 1250, "reconcile": 1250, "page": 1.25, "card": 1.25, "room": 1.25, "score": 1.25, "prefix": 1}),
        ("1.975,00 €", {"linkage": 1975, "report": 1975, "reconcile": 1975, "page": 1975, "card": 1975, "score": None, "prefix": 1.975}),
        ("12abc", {"linkage": 12, "queue": 12, "report": 12, "reconcile": 12, "page": 12, "card": 12, "room": 12, "score": None, "prefix": 12}),
        ("x 12", {"linkage": 12, "queue": 0, "report": 12, "reconcile": 12, "page": 12, "prefix": None}),
        (None, {"linkage": 0, "queue": 0, "report": None, "reconcile": None, "page": None, "card": None, "room": None, "score": None, "prefix": None}),
        ("", {"linkage": 0, "queue": 0, "report": None, "reconcile": None, "page": None, "prefix": None}),
    ],
)
def test_number_dialects(spark, value, answers):
    df = spark.createDataFrame([(value,)], "v string").select(*[numbers.DIALECTS[k](F.col("v")).alias(k) for k in answers])
    assert df.first().asDict() == answers


def test_rounding_goes_up(spark):
    assert one(spark, 3.4499999999999997, lambda c: numbers.round_half_up(c, 1), "double") == 3.5
    assert one(spark, "498–552 €", numbers.upper_of_range) == 552


AGREEMENT = [
    ("waldstadt i, x", "waldstadt ii, x", False), ("babelsberg, x", "babelsberg nord, x", False), ("golm, x", "golm (14476), x", True), ("am stern, x", "stern, x", True),
    ("nauener vorstadt, x", "babelsberg nord, x", False), ("x", "golm, x", None), (None, "golm, x", None), ("alt golm, x", "neu golm, x", None),
]


@pytest.mark.parametrize(("a", "b", "want"), AGREEMENT)
def test_places_agree(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    hood = lambda c: places.neighbourhood(F.col(c), ["x"])
    assert df.select(places.neighbourhoods_agree(hood("a"), hood("b"))).first()[0] is want
    assert df.select(places.neighbourhoods_agree(hood("b"), hood("a"))).first()[0] is want


def test_postcode_gate(spark):
    gate = lambda v: one(spark, v, lambda c: places.outside_region(c, ["144", "145"]))
    assert [gate("14467 A"), gate("10115 B"), gate("A"), gate("10115 or 14467"), gate("id 101150"), gate(None)] == [False, True, False, False, False, False]


def test_text_functions(spark):
    assert one(spark, "https://a.example/x?y=1#z", text.canonical_url) == "https://a.example/x"
    assert one(spark, None, text.canonical_url) is None
    assert one(spark, "see https://a.example/x) and http://b.example|", text.urls_in) == ["https://a.example/x", "http://b.example"]
    assert one(spark, "H4-00-02 and H4-00-02 xH4-00-03", text.unit_codes) == ["H4-00-02"]
    assert one(spark, "Schöne helle Wohnung", text.title_key) == ""
    assert one(spark, "Dachgeschoss am Griebnitzsee mit Kamin", text.title_key) == "dachgeschoss am griebnitzsee mit kamin"
    assert one(spark, "# Evaluation: A — B — Golm\nx", text.heading_parts) == ("A — B", "Golm")
    assert one(spark, "## Summary\n\nGood.\n## Next\nx", lambda c: text.section(c, "Summary")) == "Good."
    assert one(spark, "**Score:** 4.1/5\n", lambda c: text.report_header(c, "Score")) == "4.1/5"
    assert one(spark, 1975.4, text.german_integer, "double") == "1.975"
    assert one(spark, 77.97, text.german_decimal, "double") == "77,97"
    assert one(spark, None, text.german_decimal, "double") == ""


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([0.0, -5.0, float("nan")]), st.floats(90, 110)), st.one_of(st.none(), st.floats(1, 20)), st.integers(0, 1)), max_size=25))
def test_band_join_is_the_theta_join(spark, data):
    rows = [(k, *r) for k, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, price double, m2 double, g int")
    got = sorted((r.i, r.j) for r in band_join(df, df, [Band("price", share=0.05), Band("m2", span=3.0)], ["g"]).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect())
    ok = [r for r in rows if r[1] is not None and r[1] > 0 and r[2] is not None and r[2] > 0]
    want = sorted((a[0], b[0]) for a in ok for b in ok if a[3] == b[3] and abs(a[1] - b[1]) / max(a[1], b[1]) < 0.05 and abs(a[2] - b[2]) <= 3)
    assert got == want


S = "id bigint, url string, portal string, price double, m2 double, rooms double, hood string"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "confirmed"), ({"portal": "p"}, None), ({"url": "u1"}, None), ({"hood": "golm"}, None), ({"hood": "", "price": 1210.0, "m2": 82.0}, "numeric"), ({"hood": "", "rooms": 2.0}, None),
        ({"hood": "", "rooms": 0.0}, None), ({"price": 1275.0}, None), ({"m2": 84.5}, None), ({"price": 0.0}, None), ({"m2": None}, None), ({"price": 1140.0}, None),
    ],
)
def test_cross_source_pairs(spark, change, want):
    base = {"id": 1, "url": "u1", "portal": "p", "price": 1200.0, "m2": 80.0, "rooms": 3.0, "hood": "kirchsteigfeld"}
    other = base | {"id": 2, "url": "u2", "portal": "q", "price": 1199.0, "m2": 79.5} | change
    df = spark.createDataFrame([tuple(base.values()), tuple(other.values())], S)
    assert [r.kind for r in linkage.cross_source_pairs(df, "id", []).collect()] == ([want] if want else [])


def test_best_match_takes_the_closest_of_all(spark):
    c = spark.createDataFrame([(1, 1000.0, 80.0, 3.0, "golm"), (2, 1000.0, 80.0, 3.0, "golm"), (3, None, 80.0, 3.0, "golm")], "c bigint, price double, m2 double, rooms double, hood string")
    pool = spark.createDataFrame([(10, 1020.0, 80.0, 3.0, "golm"), (11, 1000.0, 80.0, 3.0, ""), (12, 1001.0, 80.1, 3.0, "golm"), (13, 1001.0, 80.1, 3.0, "golm")], "t bigint, price double, m2 double, rooms double, hood string")
    assert sorted((r.candidate, r.match, r.kind) for r in linkage.best_match(c, "c", pool, "t").collect()) == [(1, 12, "confirmed"), (2, 12, "confirmed")]
    assert linkage.best_match(c.limit(0), "c", pool, "t").count() == 0


def test_known_match_ranks_and_vetoes(spark):
    s = "price double, m2 double, rooms double, hood string, codes array<string>, tokens array<string>"
    t, k = ["brauhausberg"], "wohnen am brauhausberg"
    wanted = [
        (1, 1000.0, 80.0, 3.0, "golm", ["H4-00-02"], [], ""),  # unit 8 % off before the numbers of another unit
        (2, None, 60.0, 2.0, "", [], t, k),  # known title, unknown price
        (3, 500.0, 40.0, 1.0, "", [], ["seeblick"], ""),  # numeric, but the titles conflict
        (4, 700.0, 50.0, 2.0, "kiez", ["H5-00-01"], [], ""),  # only another unit is near
        (5, 600.0, 60.0, 3.0, "", [], t, k),  # the title's rooms differ
    ]
    pool = [
        (10, 1080.0, 80.0, 3.0, "golm", ["H4-00-02"], [], []), (11, 1000.0, 80.0, 3.0, "golm", ["H4-01-03"], [], []), (12, 1000.0, 80.0, 3.0, "golm", [], [], []),
        (13, 900.0, 61.0, 2.5, "west", [], t, [k]), (14, 500.0, 40.0, 1.0, "", [], ["garten"], []), (15, 700.0, 50.0, 2.0, "kiez", ["H5-00-02"], [], []),
    ]
    c, e = spark.createDataFrame(wanted, f"c bigint, {s}, key string"), spark.createDataFrame(pool, f"t bigint, {s}, keys array<string>")
    assert sorted((r.candidate, r.match, r.kind) for r in linkage.known_match(c, "c", e, "t").collect()) == [(1, 10, "unit"), (2, 13, "title")]


def test_known_match_against_brute_force(spark):
    """Unknown and odd values, several codes and titles, many rows of one code and of one title."""
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    some = lambda values, most: rng.sample(values, rng.randint(0, most))
    codes, words, keys = ["H4-00-02", "H4-01-03", "H5-00-01"], ["garten", "seeblick", "altbau"], ["k1", "k2", "k3"]

    def row(k):
        price, m2 = pick(None, 0.0, -5.0, 0.4, *[round(1000 * 1.011 ** rng.randint(0, 14), 2) for _ in range(9)]), pick(None, 0.0, *[50.0 + rng.randint(0, 18) / 2 for _ in range(6)])
        return (k, price, m2, pick(None, 0.0, 2.0, 2.5, 3.0), pick("", "", "golm", "golm nord", "kiez"), some(codes, pick(0, 0, 0, 0, 2)), some(words, pick(0, 1, 2)))

    wanted, pool = [(*row(k), pick("", "", "", "k1", "k1", "k2")) for k in range(120)], [(*row(k), some(keys, pick(0, 0, 2))) for k in range(160)]
    on = lambda v: v is not None and v > 0
    words_of = lambda a, b: (set(a.split()), set(b.split()))

    def agree(a, b):
        if not a or not b:
            return None
        x, y = words_of(a, b)
        return True if a == b else False if not x & y or "nord" in x ^ y else True

    def pair(c, e):
        known = lambda k: on(c[k]) and on(e[k])
        far = lambda k, most: known(k) and abs(c[k] - e[k]) > most
        share = abs(c[1] - e[1]) / max(c[1], e[1]) if known(1) else 0
        coded = c[5] and e[5]
        if coded and not set(c[5]) & set(e[5]):
            return None
        kind = "unit" if coded else "title" if c[7] and c[7] in e[7] and not far(2, 3) and not far(3, 0.5) else None
        if kind:
            kind = kind if share <= 0.10 else None
        elif known(1) and known(2) and share < 0.05 and abs(c[2] - e[2]) <= 3:
            place = agree(e[4], c[4])
            conflict = c[6] and e[6] and not set(c[6]) & set(e[6])
            kind = "confirmed" if place else "numeric" if place is None and on(c[3]) and c[3] == e[3] and not conflict else None
        v = [[x if on(x) else 0.0 for x in r[1:3]] for r in (c, e)]
        gap = abs(v[0][0] - v[1][0]) / max(v[0][0], v[1][0], 1.0) / 0.05 + abs(v[0][1] - v[1][1]) / 3
        return kind and (["unit", "title", "confirmed", "numeric"].index(kind), gap, e[0], kind)

    want = {(c[0], *best[2:]) for c in wanted if (best := min(filter(None, (pair(c, e) for e in pool)), default=None))}
    s = "price double, m2 double, rooms double, hood string, codes array<string>, tokens array<string>"
    c, e = spark.createDataFrame(wanted, f"c bigint, {s}, key string"), spark.createDataFrame(pool, f"t bigint, {s}, keys array<string>")
    got = [(r.candidate, r.match, r.kind) for r in linkage.known_match(c, "c", e, "t").collect()]
    assert set(got) == want and len(got) == len(want) and {k for *_, k in want} == {"unit", "title", "confirmed", "numeric"}


def most_rows(plan):
    """The largest number of rows that a step of a plan gave."""
    inner = [getattr(plan, k)() for k, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if plan.getClass().getSimpleName().endswith(kind)]
    below = inner or [plan.children().apply(k) for k in range(plan.children().size())]
    n = plan.metrics().get("numOutputRows")
    return max([n.get().value() if n.isDefined() else 0, *map(most_rows, below)])


def test_best_match_known_with_a_common_address(spark, tmp_path, monkeypatch):
    """A third of the history and of the reports at one address: its titles don't meet its reports one by one."""
    from plotmill.plans.linkage import best_match_known

    title, n = "Wohnen am Brauhausberg mit Seeblick", 600
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("gazetteer", [("14476", "Golm", "Potsdam")], "plz string, hood string, town string")
    write("scan_inbox", [(50, title, None, None, 60.0, 2.0), (100, "Ganz anderer Altbau am Kanal", "Golm", 900.0, 61.0, 2.0), (101, title, None, None, 60.0, 2.0)], "entry_id bigint, title string, location string, price double, m2 double, rooms double")
    write("scan_history", [(k, "u1", title if k % 2 else "Heller Garten im Quartier") for k in range(1, n)] + [(n, "u2", "Seltene Villa am Heiligen See"), (n + 1, "", title), (n + 2, None, title)], "entry_id bigint, url string, title string")
    write("reports", [(f"reports/{k}.md", "u1") for k in range(n)] + [("reports/x.md", "u2"), ("reports/x.md", "u1"), ("reports/y.md", "")], "path string, url string")
    rows = [(k, f"[{k}](reports/{k}.md)", None, 1000.0, 60.0 + k % 3, 2.0, None) for k in range(1, n)] + [(n, "reports/x.md", "Golm", 900.0, 60.0, 2.0, None), (n + 1, "reports/y.md", "Golm", 901.0, 61.5, 2.0, None), (n + 2, None, "Golm", 900.0, 61.0, 2.0, None)]
    write("tracker_additions", rows, "addition_id bigint, report string, location string, price double, m2 double, rooms double, notes string")
    ran = []
    keep = linkage.materialize
    monkeypatch.setattr(linkage, "materialize", lambda df, what: (df.collect(), ran.append(most_rows(df._jdf.queryExecution().executedPlan())), keep(df, what))[-1])
    found = best_match_known(spark, str(tmp_path))
    got = sorted((r.entry_id, r.addition_id, r.kind) for r in found.collect())
    assert got == [(50, 3, "title"), (100, n + 2, "confirmed")]
    assert 0 < max(ran) < 10 * n


def test_near_counts_take_all_rows(spark, tmp_path):
    from plotmill.plans.linkage import near_prices

    rng = random.Random(5)
    row = lambda k: (k, rng.choice(["p", "q", None]), rng.choice([1000.0, 1020.0, 1049.0, 1060.0, None]), rng.choice([50.0, 53.0, 53.5, 0.0]), rng.choice([2.0, 3.0, None]))
    left, right = [row(k) for k in range(150)], [row(k) for k in range(1, 120)]
    for name, key, rows in (("tracker_additions", "addition_id", left), ("scan_inbox", "entry_id", right)):
        spark.createDataFrame(rows, f"{key} bigint, portal string, price double, m2 double, rooms double").write.parquet(f"{tmp_path}/{name}.parquet")
    want = {}
    for _, p, x, m, r in left:
        for _, q, y, n, t in right:
            if x and y and m and n and r is not None and r == t and abs(x - y) / max(x, y) < 0.05 and abs(m - n) <= 3:
                want[p, q] = want.get((p, q), 0) + 1
    assert {(r.portal_a, r.portal_b): r.n for r in near_prices(spark, str(tmp_path)).collect()} == want


def test_unseen_and_first(spark):
    rows = spark.createDataFrame([(1, "a?x"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "c#1")], "id bigint, url string")
    seen = spark.createDataFrame([("b?z",), (None,)], "url string")
    key = text.canonical_url(F.col("url"))
    assert sorted(r.id for r in incremental.unseen(rows, key, seen, key, ["id"]).collect()) == [1, 4, 5, 6]
    assert sorted(r.id for r in incremental.first_by_key(rows, key, ["id"]).collect()) == [1, 3, 4, 5, 6]


def test_merge_refuses_by_number_first(spark):
    s = "id bigint, num string, report string"
    old = spark.createDataFrame([(1, "001", "r1")], s)
    new = spark.createDataFrame([(2, "001", "r2"), (3, "002", "r2"), (4, "003", "r1"), (5, "002", "r5"), (6, "004", None), (7, "005", None), (8, None, "r9")], s)
    merge = lambda staged, tracked: sorted(r.id for r in incremental.merge_staged(staged, tracked, "num", F.col("report"), F.col("report"), "id").collect())
    assert merge(new, old) == [3, 6, 7]
    assert merge(new, old.unionByName(new)) == []


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: D(2026, 1, 1) + datetime.timedelta(days=rng.randint(0, 200))
    left = [(k, rng.choice(["hot", "hot", "a", "b", None]), day() if k % 17 else None) for k in range(200)]
    right = [(rng.choice(["hot", "a", "c", None]), day() if k % 19 else None, float(k) if k % 11 else None) for k in range(150)]
    got = {r.id: r.as_of for r in incremental.as_of(spark.createDataFrame(left, "id bigint, key string, on date"), spark.createDataFrame(right, "key string, day date, v double"), "key", "on", "day", "v").collect()}
    for k, key, on in left:
        hits = [(d, v) for r, d, v in right if key is not None and r == key and d and on and d <= on and v is not None]
        assert got[k] == (max(hits)[1] if hits else None)


def test_markdown_rows(spark):
    lines = ["| # | Date | x |", "|---|---|---|", "| 007 | 2026-01-01 | a |", "| 8 |  | - |", "| 9 | x |", "text", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, line string")
    assert [(r.num, r.date, r.x) for r in markdown.table_rows(df, ["k"], ("num", "date", "x")).collect()] == [("007", "2026-01-01", "a"), ("8", "", None)]


def test_queue_rows(spark):
    lines = ["- [ ] https://a.example/1 | p | g | Flat | 1.200 EUR | 72,5 m² | 2,5 Zi | Golm, X", "- [ ] https://a.example/2 | p | g | 3-Zimmer-Flat | Golm | 80 m²", "- [x] https://a.example/3 | p | g | t", "", None]
    got = markdown.queue_rows(spark.createDataFrame([(v,) for v in lines], "line string"), []).collect()
    assert [(r.url[-1], r.price, r.m2, r.rooms, r.location) for r in got] == [("1", 1200.0, 72.5, 2.5, "golm, x"), ("2", 0.0, 80.0, 3.0, "golm")]


def test_queue_lines_of_all_rows(spark, tmp_path):
    from plotmill.plans import captures

    rows = [
        (1, "3 Zi. mit Balkon", None), (2, "2,5-Zimmer-Wohnung", 0.0), (3, "4 Räume", 3.5), (4, None, None), (5, "", 2.0), (6, "Loft", None), (7, "1-Raum | hell", None), (8, "1.250 Zimmer", None), (9, "4 RÄUME", None),
    ]
    df = spark.createDataFrame([(k, f"https://p.example/{k}", "p", t, 900.0, 50.5, r, "Golm") for k, t, r in rows], "entry_id bigint, url string, portal string, title string, price double, m2 double, rooms double, location string")
    df.write.parquet(f"{tmp_path}/scan_history.parquet")
    got = {r.entry_id: (r.title, r.rooms, r.m2, r.location) for r in captures.queue_lines(spark, str(tmp_path)).collect()}
    rooms = {1: 3.0, 2: 2.5, 3: 3.5, 4: 0.0, 5: 2.0, 6: 0.0, 7: 1.0, 8: 1250.0, 9: 0.0}
    assert got == {k: ((t or "").replace("|", "/"), rooms[k], 50.5, "golm") for k, t, _ in rows}


def test_correspondence(spark):
    log = "# Log\n## 2026-07-01 10:15 · email · → sent\nhi\n**Next:** wait\n**Next:** second\n## Notes\n**Next:** no\n## 2026-07-03 · phone · ← received\nbye"
    got = markdown.correspondence(spark.createDataFrame([(1, log), (2, None), (3, "")], "id bigint, text string"), "id").orderBy("block").collect()
    assert [(r.day, r.time, r.channel, r.direction, r.next) for r in got] == [("2026-07-01", "10:15", "email", "sent", "wait"), ("2026-07-03", None, "phone", "received", None)]


def test_captures(spark):
    pages = ['{"c":2,"n":true,"p":"https://x.example/","L":[["7","1200","80","3","t","l"],["https://y.example/8","","0","","",""]]}', '{"count":1,"listings":[{"url":"u","price":5.0,"m2":0.0}]}', '[{"url":"v"}]', '[["9"]]', "broken", "", None, '{"c":0,"empty":true}']
    df = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(pages)], "k int, body string, url string")
    got = sorted((r.k, r.url, r.price, r.m2) for r in captures.listings(df.drop("url"), ["k"]).collect())
    assert got == [(0, "https://x.example/7", 1200.0, 80.0), (0, "https://y.example/8", None, None), (1, "u", 5.0, None), (2, "v", None, None), (3, "9", None, None)]
    states = {r.k: r.state for r in captures.page_state(df.withColumn("no", F.lit(1)), ["k"], "no").collect()}
    assert (states[0], states[4], states[6], states[7]) == ("ok", "unreadable", "unreadable", "empty")


def test_mail(spark):
    import base64
    from email.message import EmailMessage

    every = bytes(range(256))
    m = EmailMessage()
    m.set_content("hi")
    m.add_attachment(every, maintype="application", subtype="octet-stream", filename="a.bin")
    url_safe = base64.urlsafe_b64encode(m.as_bytes()).decode()
    bodies = ['{"x":[{"raw":"' + url_safe + '"}]}', url_safe.rstrip("="), m.as_string(), "", None, "{not json", "{}"]
    got = mail.attachments(spark.createDataFrame(list(enumerate(bodies)), "id bigint, body string"), "id").collect()
    assert [(r.row_id, r.name, bytes(r.content) == every) for r in sorted(got, key=lambda r: r.row_id)] == [(k, "a.bin", True) for k in range(3)]


def test_runtime(spark):
    df = spark.range(5)
    assert materialize(df, "t").count() == 5
    assert shared_dir(spark)
