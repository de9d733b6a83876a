"""Operators for training data: brute force, round trips, edge cases and hot groups."""

import datetime
import os
import random
import re
import unicodedata
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import plotmill.llm.queries as q
from plotmill.llm import addresses, leaks, mojibake, token_index, vantage
from plotmill.llm.addresses import Gazetteer, buildings, osa, parse, same_building_pairs
from plotmill.llm.leaks import leaked_items
from plotmill.llm.mixing import count_tokens, mix
from plotmill.llm.mojibake import garbled_documents, restored_documents
from plotmill.llm.token_index import TokenIndex, advert_tokens, known_rows

SF = "/root/testdata/sf0.001"
D = datetime.date
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


# p1 ---------------------------------------------------------------------------------------------------------------


def tokens(spark, urls):
    df = advert_tokens(spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "id int, url string, tokens string"), ["id"])
    return [r.tokens for r in df.orderBy("id").collect()]


def test_same_advert_however_written(spark):
    forms = [
        "https://www.wohnkompass.example/expose/05159939871", "HTTP://M.Wohnkompass.Example:443//de/expose/05159939871/?a=1#x", "<https://wohnkompass.example/expose/05159939871;jsessionid=6434CF733A7A>", " https://wohnkompass.example/%65xpose/05159939871/amp ",
    ]
    assert len({tuple(t) for t in tokens(spark, forms)}) == 1
    a, b, c = tokens(spark, ["https://x.mietradar.example/angebot/kleine-1-zi-00A7C41E903", "https://mietradar.example/angebot/expose%2D00a7c41e903?ref=1", "https://mietradar.example/angebot/expose-00a7c41e904"])
    assert a == b != c
    a, b, c, d = tokens(spark, ["https://nestfinder.example/objekt?print=1&id=00975129462", "https://nestfinder.example/objekt;jsessionid=A1?id=00975129462#top", "https://havelquartier.example/wohnungen?u=1#WE-00975129462", "https://immobilien.sparhaus.example/angebote/x/FIO-00975129462.html"])
    assert a == b and len({tuple(x) for x in (a, c, d)}) == 3
    assert tokens(spark, [None, "", "  "]) == [None, None, None]
    assert all(tokens(spark, ["nonsense", "https://other.example/a%zz"]))


def test_known_rows_against_brute_force(spark):
    rng = random.Random(1)
    url = lambda: f"https://{rng.choice(['wohnkompass', 'stadtbau'])}.example/{rng.choice(['expose', 'mieten/x'])}/{rng.choice([7, 7, 7, *range(60)]):011d}"
    history = [(url(), D(2026, 1, 1)) for _ in range(40)] + [(None, D(2026, 1, 1))]
    inbox = [(k, rng.choice([1, 2, 3, None]), url() if k % 13 else None, D(2026, 2, 1)) for k in range(150)]
    h = advert_tokens(spark.createDataFrame(history, "url string, since date"), ["since"])
    i = advert_tokens(spark.createDataFrame(inbox, "entry_id bigint, batch_no int, url string, since date"), ["entry_id", "batch_no", "since"])
    seen, want = {u for u, _ in history if u}, set()
    for e, b, u, _ in sorted(inbox, key=lambda r: (r[1] or 99, r[0])):
        if u in seen:
            want.add(e)
        elif u:
            seen.add(u)
    assert {r.entry_id for r in known_rows(h, i).collect()} == want
    assert known_rows(h.limit(0), i.limit(0)).count() == 0


def test_index_finds_similar_sets(spark):
    """Thresholds below one: prefixes, lengths and overlap against brute force, over two batches."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    sets = [sorted(rng.sample(words[: 10 + k % 30], rng.randint(3, 9))) for k in range(120)]
    base, batch1, batch2 = sets[:60], sets[60:90], sets[90:]
    frame = lambda rows, at: spark.createDataFrame([(at + k, t, None) for k, t in enumerate(rows)], "entry_id bigint, tokens array<string>, since date")
    index = TokenIndex.build(frame(base, 0), threshold=0.6)
    known = [set(t) for t in base]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.6 - 1e-12
    both = frame(batch1, 1000).withColumn("batch_no", F.lit(1000)).unionByName(frame(batch2, 2000).withColumn("batch_no", F.lit(2000)))
    index.accept(index.stage(both))
    for at, batch in ((1000, batch1), (2000, batch2)):
        got = {r.entry_id for r in index.accepted().collect() if at <= r.entry_id < at + 1000}
        first = {}
        for k, t in enumerate(batch):
            first.setdefault(tuple(t), at + k)
        want = {e for t, e in first.items() if not any(alike(set(t), b) for b in known) and not any(alike(set(t), set(o)) and f < e for o, f in first.items())}
        assert got == want
        known += [set(t) for t, e in first.items() if e in want]


def test_kept_index_is_opened_again(spark, tmp_path, monkeypatch):
    """Batches of later runs probe what earlier runs accepted, before and after compaction, with and without naming the
    tokens to the scan; no table stays in the catalogue."""
    monkeypatch.setattr(token_index, "COMPACT_AFTER", 2)
    path, before = f"file://{tmp_path}/index", {t.name for t in spark.catalog.listTables()}
    rows = lambda codes, at: spark.createDataFrame([(at + k, at, ["site:x", f"code:{c}"], None) for k, c in enumerate(codes)], "entry_id bigint, batch_no int, tokens array<string>, since date")
    known = set(range(0, 200, 2))
    token_index.TokenIndex.build(rows(sorted(known), 0), path=path).close()
    for run, codes in enumerate([range(0, 150), [1, 2, 3, 300, 301, 300], range(290, 305), [7, 500], [500, 501]]):
        index = token_index.TokenIndex.open(spark, path)
        got = {r.entry_id for r in token_index.new_rows_left_out(index, rows(codes, 1000 * (run + 1))).collect()}
        want = set()
        for k, c in enumerate(codes):
            if c in known:
                want.add(1000 * (run + 1) + k)
            known.add(c)
        assert got == want
    assert {t.name for t in spark.catalog.listTables()} == before


# p3, p4 -----------------------------------------------------------------------------------------------------------

PLACES = [("62137", "Waldau I", "Kalmbrück an der Selde"), ("62149", "Waldau II", "Kalmbrück an der Selde"), ("43281", "Moorgrund", "Altenried am Moor"), ("62240", "Töpferhof", "Altenried an der Selde"), ("43820", "Hagenmitte", "Oderhagen")]


def test_edit_distance():
    assert [osa("ab", "ba", 2), osa("kasterhof", "kasetrhof", 1), osa("abc", "abd", 1), osa("abc", "xyz", 2), osa("", "ab", 2), osa("same", "same", 1)] == [1, 1, 1, 3, 2, 0]


@pytest.mark.parametrize(
    ("location", "want"),
    [
        ("43820 Hagenmitte, Kasterhofufer 20", ("|kasterhof|ufer", "20", ("oderhagen",))),
        ("KASTERHOF-UFER NR. 20 A, ODERHAGEN", ("|kasterhof|ufer", "20a", ("oderhagen",))),
        ("Hagenmitte | Neue Kasterhofstr. 020a | Oderhagen, 2. OG links", ("neü|kasterhof|strasse", "20a", ("oderhagen",))),
        ("A. d. Kasterhof 7 in Altenried/Selde", ("ander|kasterhof|", "7", ("altenried an der selde",))),
        ("D-62149 Kalmbrück - Waldau II, Zum Kasterhof Hausnr. 7, VH", ("zum|kasterhof|", "7", ("kalmbrück an der selde",))),
        ("Zum Kasterhof 7, 62240, Whg. 14", ("zum|kasterhof|", "7", ("altenried an der selde",))),
        ("Am Kasterhof 9, Altenried", ("am|kasterhof|", "9", ("altenried am moor", "altenried an der selde"))),
        ("Am Kasterhof 9, Odrhagen", ("am|kasterhof|", "9", ("oderhagen",))),
        ("43820 Oderhagen", None), ("Kasterhofufer, Oderhagen, Whg. 3", None), ("Oderhagen", None), ("", None), (None, None), ("?!", None), ("x" * 100_000, None),
    ],
)
def test_parse(location, want):
    got = parse(location, Gazetteer(PLACES))
    assert (got and (got[0], got[1], tuple(got[2]))) == want


def test_buildings(spark):
    g = spark.createDataFrame(PLACES, "plz string, hood string, town string")
    rows = [
        (1, "Kasterhofufer 20, Oderhagen"), (2, "43820 Hagenmitte, Kastrehofufer 20"), (3, "Kasterhofufer 20, Oderhagen"), (4, "Kasterhofufer 20a, Oderhagen"), (5, "Kasterhofring 20, Oderhagen"), (6, "Oderhagen"), (7, None),
        (8, "Kasterhofufer 20, Altenried"), (9, "Kasterhofufer 20, 62240 Altenried"), (10, "KASTERHOF-UFER 20, HAGENMITTE, EG"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "addition_id bigint, location string, building string")
    got = {tuple(r) for r in same_building_pairs(df, g).collect()}
    one = [1, 2, 3, 10]
    assert got == {(a, b) for a in one for b in one if a < b} | {(8, 9)}
    assert buildings(df.limit(0), g).count() == 0
    assert buildings(df, g.limit(0)).count() == 8


def test_large_blocks_lose_no_link(spark, monkeypatch):
    """Far more spellings than a window, in segments: the classes are those of all pairs."""
    monkeypatch.setattr(addresses, "SEGMENT", 32)
    rng = random.Random(9)
    names = {"".join(rng.choice("abdeghiklmnorstu") for _ in range(7)) for _ in range(40)}
    for name in list(names):
        for _ in range(15):
            k = rng.randrange(7)
            names.add(rng.choice([name[:k] + rng.choice("xyzäü") + name[k + 1 :], name[:k] + name[k + 1 :], name[:k] + "x" + name[k:], name[:k] + name[k : k + 2][::-1] + name[k + 2 :]]))
    streets = sorted(f"|{n}|weg" for n in names)
    parsed, brute = [addresses.Street(s) for s in streets], addresses.Classes()
    for k, a in enumerate(parsed):
        for b in parsed[:k]:
            if a.same(b):
                brute.join(a.text, b.text)
    entries = spark.createDataFrame([("town", "7", s, 1, 1) for s in streets], "town string, number string, street string, sure bigint, g bigint")
    found = addresses.Classes()
    for r in addresses.street_links(entries, 4, window=4).collect():
        found.join(r.a, r.b)
    by = lambda c: {frozenset(s for s in streets if c.root(s) == r) for r in {c.root(s) for s in streets}}
    assert len(streets) > 400 and by(found) == by(brute)
    named = {r.street: r.name for r in addresses.named_streets(entries, 4, window=4).collect()}
    assert all((named[a] == named[b]) == (brute.root(a) == brute.root(b)) for a in streets[:50] for b in streets)


@pytest.mark.parametrize("window", [4, 10**6])
def test_two_edits_link_in_blocks_of_any_size(spark, monkeypatch, window):
    """Long names two edits apart, with forms, kinds and umlauts: large blocks, over several tiles, link as small ones."""
    monkeypatch.setattr(addresses, "SEGMENT", 64)
    rng = random.Random(10)
    names = {"".join(rng.choice("abdeghiklmnorstuü") for _ in range(10)) for _ in range(120)}
    for name in sorted(names):
        for _ in range(2):
            x, y = rng.sample(range(10), 2)
            w = list(name)
            w[x], w[y] = rng.choice(["", "y", "ö", w[x] + "q"]), rng.choice(["", "z", "x", w[y] + "j"])
            names.add("".join(w))
    streets = sorted({f"{rng.choice(['', '', '', '', 'am'])}|{n}|{rng.choice(['weg', 'weg', 'weg', 'weg', 'wegg', ''])}" for n in sorted(names)})
    streets = [s if not s.endswith("|wegg") else s.replace("|wegg", "wegg|") for s in streets]
    parsed, brute = [addresses.Street(s) for s in streets], addresses.Classes()
    for k, a in enumerate(parsed):
        for b in parsed[:k]:
            if a.same(b):
                brute.join(a.text, b.text)
    entries = spark.createDataFrame([("town", "7", s) for s in streets], "town string, number string, street string")
    found = addresses.Classes()
    for r in addresses.street_links(entries, 4, window=window).collect():
        found.join(r.a, r.b)
    by = lambda c: {frozenset(s for s in streets if c.root(s) == r) for r in {c.root(s) for s in streets}}
    assert by(found) == by(brute) and 100 < len(by(brute)) < 300 < len(streets)


def test_two_edits_depend_on_the_names_alone():
    same = lambda a, b: addresses.Street(a).same(addresses.Street(b))
    assert same("|hadenkletaler|chaussee", "|hadeenkeltaler|chaussee")
    assert not same("|drosdenberg|strasse", "|drosdenberger|strasse")
    assert not same("|ulmen|weg", "|ulxxn|weg") and same("|ulmen|weg", "|ulemn|weg")
    assert not same("am|ulmenhof|", "zum|ulmenhof|")


def test_tree_finds_all_pairs():
    rng = random.Random(3)
    for n in (0, 1, 2, 13, 60, 400):
        points = [(rng.randint(0, 40), rng.randint(0, 12)) for _ in range(n)]
        codes = [(1 << x) - 1 | (1 << y) - 1 << vantage.BITS for x, y in points]
        got = list(vantage.near_pairs(codes))
        want = {(i, j) for i in range(n) for j in range(i) if abs(points[i][0] - points[j][0]) + abs(points[i][1] - points[j][1]) <= vantage.RADIUS}
        assert {tuple(sorted(p, reverse=True)) for p in got} == want and len(got) == len(want)
    same = [7] * 50
    assert len(list(vantage.near_pairs(same))) == 50 * 49 // 2


def test_similar_records_against_brute_force(spark):
    """One group holds a third of the rows, shared over several shards; unknown fields of every kind."""
    rng = random.Random(4)
    maybe = lambda v: rng.choice([v, v, v, v, None, 0.0])
    rows = [(k, "hot" if k % 3 == 0 else rng.choice(["a", "b", None]), maybe(round(300 * 1.02 ** rng.randint(0, 120), 2)), maybe(20.0 + 1.5 * rng.randint(0, 60)), maybe(rng.randint(2, 12) / 2)) for k in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, grp string, price double, m2 double, rooms double, combo string")
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] is None or a[1] != b[1]:
                continue
            tests = []
            if a[2] and b[2]:
                tests.append(abs(a[2] - b[2]) * 20 < max(a[2], b[2]))
            if a[3] and b[3]:
                tests.append(abs(a[3] - b[3]) <= 3)
            if a[4] and b[4]:
                tests.append(abs(a[4] - b[4]) <= 0.5)
            if len(tests) >= 2 and all(tests):
                want.add((a[0], b[0]))
    got = [tuple(r) for r in vantage.similar_records(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    links = {r.row_id: r.n_links for r in vantage.record_links(df).collect()}
    assert links == {r[0]: sum(r[0] in p for p in want) for r in rows if r[1] is not None}
    assert vantage.similar_records(df.limit(0)).count() == vantage.record_links(df.limit(0)).count() == 0


def test_price_bound_is_exact(spark):
    df = spark.createDataFrame([(1, "g", 1100.0, 50.0, 2.0), (2, "g", 1045.0, 50.0, 2.0), (3, "g", 1045.5, 53.0, 2.5), (4, "h", 1100.0, 50.0, 2.0)], "row_id bigint, grp string, price double, m2 double, rooms double")
    assert {tuple(r) for r in vantage.similar_records(df).collect()} == {(1, 3), (2, 3)}


# p7 ---------------------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).lower())


def brute_leaks(docs, items, n=12):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t) if t else []
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs if t for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "der", "Straße", "größer", "naïve", "12", "x1", "zimmer", "ÜBER", "й"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(8, 40))) for k in range(30)] + [(90, None), (91, ""), (92, "a b c d e f g h i j k l"), (93, "a " * 11)]
    docs = []
    for k in range(150):
        _, t = rng.choice(items[:30])
        w = t.split(" ")
        n = rng.choice([5, 11, 12, 13, 30])
        at = rng.randint(0, max(0, len(w) - n))
        cut = rng.choice([", ", "\n> ", " - ", "  "]).join(w[at : at + n])
        docs.append((k, text(rng.randint(0, 20)) + rng.choice([" ", ". "]) + (cut.upper() if k % 3 else unicodedata.normalize("NFD", cut)) + " " + text(rng.randint(0, 20))))
    docs += [(900, None), (901, ""), (902, "A, b; c d e_f g h i j k L!"), (903, "xa b c d e f g h i j k l"), (904, docs[1][1]), (905, "z " * 300_000 + docs[2][1])]
    d, i = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaked_items(d, i).collect()]
    assert set(got) == brute_leaks(docs, items) and len(got) == len(set(got)) > 30
    assert leaked_items(d.limit(0), i).count() == leaked_items(d, i.limit(0)).count() == 0


def fewest_edits(pattern, text):
    """Of the pattern in any part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        before, row = row, [0]
        for k, p in enumerate(pattern):
            row.append(min(before[k] + (p != c), before[k + 1] + 1, row[k] + 1))
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edited_leaks_against_brute_force(spark, edits, monkeypatch):
    """Changed, lost and added letters inside the passage; more of them than allowed in some documents. With the items'
    q-grams sent to the executors and without."""
    monkeypatch.setattr(leaks, "BROADCAST_GRAMS", 10**6 if edits == 1 else 0)
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(["wort", "haus", "tür", "ab", "zimmer", "licht"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([12, 14, 20])))) for k in range(8)]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split(" ")
        at = rng.randint(0, len(w) - 12)
        passage = list(" ".join(w[at : at + 12]))
        for _ in range(rng.randint(0, edits + 1)):
            x = rng.randrange(len(passage))
            passage[x : x + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
        docs.append((k, f"vor {k} " + "".join(passage) + " nach"))
    want = {(d, i) for d, t in docs for i, s in items if any(fewest_edits(n[a:b], leaks.normal(t)) <= edits for n in [leaks.normal(s)] for a, b in leaks.windows(n, 12))}
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaked_items(d, i, edits=edits).collect()]
    assert set(got) == want and len(got) == len(want) and 20 < len(want)
    assert len(want) > len(leaked_items(d, i).collect())


def test_too_many_edits_are_refused(spark):
    d, i = spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    with pytest.raises(ValueError, match="too many"):
        leaked_items(d, i, edits=9)


# p8 ---------------------------------------------------------------------------------------------------------------


def mixture(spark, documents, targets, **more):
    d = spark.createDataFrame(documents, "doc_id bigint, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mix(d, t, **more)
    return {r.doc_id: r for r in m.documents.collect()}, {r.source: r for r in m.shares.collect()}


def test_mix_meets_its_shares(spark):
    rng = random.Random(7)
    docs = [(k, rng.choice(["Big ", "BIG", "big"]) if k % 3 else "small", "wort " * rng.randint(1, 30)) for k in range(900)]
    docs += [(1000, None, "x"), (1001, "other", "x y z"), (1002, "small", None), (1003, "small", "")]
    targets = [("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)]
    drawn, shares = mixture(spark, docs, targets)
    assert all(r.repeats <= (2 if r.source == "small" else 1) for r in drawn.values())
    total = sum(s.tokens for s in shares.values())
    assert shares["absent"].tokens == 0 and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    assert abs(shares["big"].tokens / shares["small"].tokens - 0.5 / 0.4) < 0.02
    assert total == sum(r.tokens * r.repeats for r in drawn.values())
    again, _ = mixture(spark, docs, targets)
    assert {k: r.repeats for k, r in drawn.items()} == {k: r.repeats for k, r in again.items()}


def test_mix_is_nested_and_capped(spark):
    docs = [(k, "a", "wort " * 5) for k in range(400)] + [(k, "b", "wort " * 5) for k in range(400, 440)]
    targets = [("a", 0.5, 1), ("b", 0.5, 3)]
    small, _ = mixture(spark, docs, targets, total_tokens=1000)
    large, shares = mixture(spark, docs, targets, total_tokens=2000)
    assert set(small) <= set(large) and all(small[k].repeats <= large[k].repeats for k in small)
    _, full = mixture(spark, docs, targets, total_tokens=10**6)
    assert full["b"].documents == 40 and full["a"].documents == 400 and full["b"].tokens == 3 * 40 * small[next(iter(small))].tokens


def test_mix_edges(spark):
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == {}
    assert mixture(spark, [(1, "a", "x")], [])[0] == {}
    drawn, _ = mixture(spark, [(1, "a", "x y"), (1, "a", "x y")], [("a", 1.0, 1)])
    assert set(drawn) == {1}


def test_tokens_of_whole_texts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, "<|endoftext|>"), (3, None), (4, ""), (5, "wort " * 50_000)], "id int, text string")
    n = {r.id: r.tokens for r in count_tokens(d, ["id"]).collect()}
    assert n[1] == 2 and n[2] > 1 and n[3] == n[4] == 0 and n[5] >= 50_000


def test_long_texts_count_as_the_tokenizer_does(spark):
    """Beyond any piece length, and for stretches on which the tokenizer's splitting gives up."""
    import base64

    import public_tokenizers
    import tiktoken

    from plotmill.llm.mixing import TOKENIZER

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(TOKENIZER).read_bytes().splitlines())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice(["wohnung ", "größe", "  ", "\n", "1234567", "!?", "Zimmerküche"]) for _ in range(60_000)) for _ in range(3)]
    d = spark.createDataFrame([*enumerate(texts), (9, " " * 2_000_000 + "x")], "id int, text string")
    n = {r.id: r.tokens for r in count_tokens(d, ["id"]).collect()}
    assert all(len(t) > 250_000 and n[k] == len(enc.encode_ordinary(t)) for k, t in enumerate(texts)) and n[9] > 1


# p9 ---------------------------------------------------------------------------------------------------------------

CLEAN = [
    "Die Küche ist größer, die Straße ruhig – für 1.200 € und 80 m² Fläche · schön.", "Le loyer s'élève à 900 €, près du château, dépôt de garantie, DÉJÀ RÉNOVÉ.", "Dostępne od 5. dnia miesiąca, łazienka z oknem, piętro wyższe.",
    "├── Töpferhof: 10 €/m² ── Oderhagen √ geprüft ✓ ✗ → ←", "Partner: ÎLE-ÂPRE, MAÇÃ DO SUL, São Ravelo, Ÿvraine, Žilovec, Ørnevik, Ålsund.", "plain ascii only",
]
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("utf-8", "iso8859_2"), ("cp1252", "cp437"), ("cp1252", "cp850")]


def sloppy(raw, charset):
    return "".join(bytes([b]).decode(charset, "ignore") or chr(b) for b in raw)


def test_garbled_text_is_found_and_restored(spark):
    docs = [(k, CLEAN[k % len(CLEAN)]) for k in range(240)]
    bad, n = {}, 1000
    for written, read in WAYS:
        for t in CLEAN[:1] if written != "utf-8" else CLEAN[:3]:
            bad[n] = (t, t[:20] + sloppy(t[20:].encode(written), read))
            n += 1
    bad[n] = (CLEAN[0], sloppy(sloppy(CLEAN[0].encode(), "cp1252").encode("cp1252", "ignore"), "cp1252"))
    lost = {n + 1: "Die K�che"}
    edges = [(5000, None), (5001, ""), (5002, "ü" * 3000), (5003, "Ж" * 5000)]
    df = spark.createDataFrame(docs + [(k, g) for k, (_, g) in bad.items()] + list(lost.items()) + edges, "doc_id bigint, text string")
    df = df.withColumn("run", F.lit("clash"))
    assert {r.doc_id for r in garbled_documents(df).collect()} == set(bad) | set(lost)
    fixed = {r.doc_id: r for r in restored_documents(df).collect()}
    exact = [k for k, (t, g) in bad.items() if fixed[k].restored == t]
    assert len(exact) >= 0.9 * len(bad)
    assert not fixed[n + 1].complete
    assert garbled_documents(df.limit(0)).count() == 0


def test_rare_contexts_count_in_large_corpora(spark, monkeypatch):
    docs = [(1, "ü " * 600_000), (2, "Im Ørt")] + [(10 + k, "Im Ïrt") for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert garbled_documents(df).collect() == []
    monkeypatch.setattr(mojibake, "MAX_CONTEXTS", 2)
    with pytest.raises(ValueError, match="contexts"):
        garbled_documents(df)


def restored(spark, cases, clean=CLEAN * 40):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(clean)] + [(10_000 + k, t) for k, t in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in restored_documents(df).collect()}
    assert min(got, default=10_000) >= 10_000
    return [got.get(10_000 + k) for k in range(len(cases))]


def test_long_runs_and_repeated_garbling(spark):
    """No bound on the length of a run or on the number of times it was garbled changes what comes back."""
    again = "Die Küche ist größer"
    for _ in range(8):
        again = sloppy(again.encode(), "cp1252")
    dashes = "Im Plan " + "─" * 70 + " Ende"
    a, b, c = restored(spark, [again, sloppy(dashes.encode(), "cp1252"), sloppy(("─" * 5000).encode(), "cp437")])
    assert a.restored == "Die Küche ist größer" and a.complete
    assert b.restored == dashes and b.complete
    assert c.restored == "─" * 5000 and c.complete


def test_complete_means_complete(spark):
    """Letters that the corpus has never seen, garbled beside others."""
    text = "Die Küche: Ж Жилой дом на улице"
    (r,) = restored(spark, [sloppy(text.encode(), "cp1252")])
    assert r.restored == text or not r.complete
    (r,) = restored(spark, [sloppy(("Küche " + "Ж" * 20).encode(), "cp1252")])
    assert r.restored == "Küche " + "Ж" * 20 or not r.complete


def test_escapes_take_part(spark):
    cases = ["die K&Atilde;&frac14;che", "die K%C3%BCche", "die K&amp;Atilde;&amp;#188;che", "die KÃ&frac14;che", "siehe https://x.example/K%C3%BCche/a%20b", "die K&uuml;che &amp; 100%25 &nbsp;"]
    got = restored(spark, cases)
    assert [r and r.restored for r in got[:4]] == ["die Küche"] * 4
    assert got[4] is None and got[5] is None


def test_functions_travel_by_value(spark):
    """Workers that can't import the package run them all the same."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = mojibake.Plausibility(mojibake.np.array([ord("K") << 42 | ord("ü") << 21 | ord("c")]), mojibake.np.array([9]))
    blob = cloudpickle.dumps((model, mojibake.find_runs, parse, leaks.within, vantage._search))
    code = "import importlib.util, pickle, sys; assert importlib.util.find_spec('plotmill') is None; m, find, parse, within, search = pickle.load(sys.stdin.buffer); assert m.restore('K', 'Ã¼', 'c')[0] == 'ü'; assert [k for _, k in find('Küche')] == [('K', 'ü', 'c')]; assert within(b' a b ', b' a ', [(0, 3)], 0, 0, 0)"
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, input=blob, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_mend():
    assert mojibake.mend("fÃ¼r Ã© ü", "cp1252") == "für é ü"
    assert mojibake.mend("├── MAÇÃ", "cp437") == "├── MAÇÃ"


# whole tables -----------------------------------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", q.QUERIES)
def test_queries_run(spark, name):
    rows = q.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(set(map(str, rows))) > 0


@needs_data
def test_p1_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("scan_history", "scan_inbox"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert {r.entry_id for r in q.p1_found(spark, SF).collect()} == {r[0] for r in con.execute(q.ORACLES["p1_found"]).fetchall()}


@needs_data
def test_p7_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/eval_items.parquet").collect()]
    assert {tuple(r) for r in q.p7_found(spark, SF).collect()} == brute_leaks(docs, items)
