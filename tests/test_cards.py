"""Card rules on small pages, one per source, and the HTML tree."""

import pytest

from plotmill.sources.cards import GENERAL, PAGES, SNIPPETS, card_listings, extract, rule_for
from plotmill.sources.html_tree import parse_html

BASE = "https://site.example/list"


def test_selectors():
    t = parse_html('<div class="a b" id="x"><p>one<br>two</p><a href="/q?x=1">go <b>on</b></a><ul><li>1<li>2</ul><script>no</script></div><div class="c"><p>three</p></div>')
    assert [n.text() for n in t.all("div p")] == ["one two", "three"]
    assert t.first(".a a[href*=\"?x\"]").text() == "go on"
    assert t.first("#x").closest("div").attrs["class"] == "a b"
    assert t.all("div.c p, li") and t.first("[href^='/q']") and t.first("[href$='=1']") and not t.first("p.a")
    assert "no" not in t.text()
    assert parse_html("").text() == "" and parse_html("<p").all("p") == []


PAGE_CASES = [
    ("ImmoScout24", '<ul><li data-id="1"><a href="/expose/5?x#y"></a><b data-testid="title">T</b><i data-testid="price">1.200,50 €</i><i data-testid="area">80,5 m²</i><i data-testid="rooms">3</i><i data-testid="address">Ort</i></li></ul>', ("https://site.example/expose/5", "T", 1200.5, 80.5, 3.0, "Ort")),
    ("ImmoScout24", '<div class="listing-card"><a href="/expose/6#g">x</a> 900 € 50 m² 2 Zi.</div>', ("https://site.example/expose/6", "x 900 € 50 m² 2 Zi.", 900.0, 50.0, 2.0, "")),
    ("Immowelt", '<div data-testid="classified-card-mfe-1"><a href="/expose/a1?q"></a><b data-testid="cardmfe-price-testid">1.150 €</b><div data-testid="cardmfe-description-box-text-test-id"><p>1.150 €</p><p>Wohnung zur Miete</p><p>2,5 Zimmer · 61,3 m²</p></div><i data-testid="cardmfe-description-box-address">Ort</i></div>', ("https://site.example/expose/a1", "Wohnung zur Miete", 1150.0, 61.3, 2.5, "Ort")),
    ("Kleinanzeigen", '<article data-adid="7" data-href="/s-anzeige/x/7"><script type="application/ld+json">{"title":"LD"}</script><h2>H</h2>14469 Ort 700 € 45 m² 2,5 Zi.</article>', ("https://site.example/s-anzeige/x/7", "LD", 700.0, 45.0, 3.0, "14469 Ort")),
    ("ohne-makler", '<a data-om-id="1" href="/o/1"><img alt="Bild"><p class="text-primary-500">1.000 €</p><p class="text-slate-800">Ort</p>70 m²</a>', ("https://site.example/o/1", "Bild", 1000.0, 70.0, None, "Ort")),
    ("IVD24", '<a class="rr-list-results" data-id="1" href="/i/1"><h2>T</h2><h5>Ort</h5><div class="result-bar"><p class="float-right">250.000 € 72.5 m²</p></div></a>', ("https://site.example/i/1", "T", 250000.0, 72.5, None, "Ort")),
    ("Zwangsversteigerung", '<div class="d_tab_objekte"><a href="/detail/1"><p class="left">Weg 1, Ort</p><p class="middle">Haus 120 m²</p><p class="right">90.000 €</p></a></div>', ("https://site.example/detail/1", "Haus 120 m² — Weg 1, Ort", 90000.0, 120.0, None, "Weg 1, Ort")),
    ("Engel", '<div class="x-StyledContent"><a href="/exposes/1"></a><b data-testid="a_result-card_headline">T</b><b data-testid="result-card_price">300.000 €</b><i data-testid="result-card_attribute_1">3 Zi</i><i data-testid="result-card_attribute_2">90 m²</i><i data-testid="result-card_location">Ort</i></div>', ("https://site.example/exposes/1", "T", 300000.0, 90.0, None, "Ort")),
    ("DGA", '<div class="auktion-details"><p class="addr-list"><a href="/d/1">Haus 95 m²<br>Weg 2<br>Ort</a></p><i class="auktionLimitAmoutForSorting">5000</i></div>', ("https://site.example/d/1", "Haus 95 m²", 5000.0, 95.0, None, "Weg 2, Ort")),
    ("BVBI", '<div class="flex flex-col"><p><a href="/immobilien/details/1">Titel</a></p><a href="/immobilien/details/2">Jetzt ansehen</a> 10.000 € 50 m²</div>', ("https://site.example/immobilien/details/1", "Titel", 10000.0, 50.0, None, "")),
    ("BVVG", '<div class="immomakler-listitem"><a href="/objekte/acker">Ackerland</a><a href="/objekte/?s">Alle Objekte</a> 2,5 ha</div>', ("https://site.example/objekte/acker", "Ackerland", None, 25000.0, None, "")),
    ("BLB", '<article><h2>Haus in Ort</h2><a href="/pressemitteilung/1">w</a> Kaufpreisvorstellung: 50.000 EUR 300 m²</article>', ("https://site.example/pressemitteilung/1", "Haus in Ort", 50000.0, 300.0, None, "Ort")),
    ("BBG", '<div><a href="/properties/1"><h4>Laden – Altstadt</h4></a> 40 m2 9.000 EUR</div>', ("https://site.example/properties/1", "Laden – Altstadt", 9000.0, 40.0, None, "Altstadt")),
    ("Stadt Potsdam", '<article><h3>T</h3><a href="/s/1">w</a> 33 m²</article>', ("https://site.example/s/1", "T", None, 33.0, None, "Potsdam")),
    ("ProPotsdam", '<li class="row"><a href="/verkaufsobjektdetails/1"></a><h3>Haus in der Mitte Neu</h3><i class="main-facts__text">100 m²</i><i class="main-facts__text">7.000 €</i></li>', ("https://site.example/verkaufsobjektdetails/1", "Haus in der Mitte", 7000.0, 100.0, None, "Potsdam, Mitte")),
    ("DIBAG", '<section><div><div><div><div><h2 class="elementor-heading-title">Haus A | WE 12</h2></div></div> 3 Zimmer 81,5 m² In der Feldmark 4 2. OG</div></div></section>', (BASE + "#WE12", "Haus A WE 12 — 3 Zi, 81,5 m², 2. OG", None, 81.5, 3.0, "In der Feldmark 4, 14476 Potsdam-Golm")),
    ("Semmelhaack", '<div class="objekt-single-data"><h3>Titel hier</h3><a class="zur-objektbeschreibung" href="/o/1"></a><div class="row"><i class="label">Kaltmiete:</i><i class="value">800,10 €</i></div><div class="row"><i class="label">Wohnfläche:</i><i class="value">60,5 m²</i></div><div class="row"><i class="label">Zimmer:</i><i class="value">2</i></div><div class="row"><i class="label">Standort:</i><i class="value">Ort</i></div></div>', ("https://site.example/o/1", "Titel hier", 800.1, 60.5, 2.0, "Ort")),
    ("WG Karl Marx", '<div class="immo-object card" data-type="Wohnung"><a class="card-link" href="/w/1"></a><h3 class="card-title">2-Raum-Wohnung</h3><p class="space"><i class="number">50,5 m²</i></p><p class="price"><i class="number">400 €</i></p></div><div class="immo-object card" data-type="Garage"><a class="card-link" href="/w/2"></a></div>', ("https://site.example/w/1", "2-Raum-Wohnung", 400.0, 50.5, 2.0, "Potsdam")),
    ("Süddeutsche", '<div class="card item-wrap"><a href="/immobilien/1"></a><p>1.234,00 €</p><p>70 m²</p><p>2,5 Zi.</p><p>14467 Ort</p></div><div class="card item-wrap"><a href="/immobilien/2">ohne alles</a></div>', ("https://site.example/immobilien/1", "Wohnung (Premium-Anzeige)", 1234.0, 70.0, 2.5, "14467 Ort")),
    ("Schoba", '<table><tr><th>Wohnung<br>14467 Ort<br>Schöne Lage</th></tr><tr><td>Zimmer: 3 Wohnfläche: ca. 75,5 m² Kaltmiete: 900,00 EUR <a href="vm-1.og-2.htm">w</a></td></tr></table>', ("https://site.example/vm-1.og-2.htm", "Schöne Lage", 900.0, 75.5, 3.0, "14467 Ort")),
    ("Ab ins Zuhause", '<div data-entries-list-target="entryCardWrapper"><a href="/angebot/1?x"></a><p class="text-truncate">T</p><small>Neu</small><small>Ort</small><small>2,5 Zi. · 60,5 m²</small><p class="fw-bold">750 €</p></div>', ("https://site.example/angebot/1", "T", 750.0, 60.5, 2.5, "Ort")),
    ("immobilien.de", '<body><div><div><a href="/expose/11">Titel 99 €</a><p>500 € Kaltmiete 10 € / m² 14467 Ort Fläche 50,5 m² Zimmer 2,5</p></div><div><a href="/expose/12">B</a></div></div></body>', ("https://site.example/expose/11", "Titel 99 €", 500.0, 50.5, 2.5, "14467 Ort")),
    ("unknown", '<div class="my-listing"><h3>T</h3><a href="/g/1">x</a> 1.200 € 80 m² 3 Zi</div>', ("https://site.example/g/1", "T", 1200.0, 80.0, 3.0, "")),
    ("unknown", '<p><a href="/g/2">Wohnung 900 € warm, 60 m², 2 Zi</a><a href="/g/3">nur 5 €</a></p>', ("https://site.example/g/2", "Wohnung 900 € warm, 60 m², 2 Zi", 900.0, 60.0, 2.0, "")),
]

SNIPPET_CASES = [
    ("ImmoScout24", '<h1>2 Mietwohnungen</h1><div class="listing-card"><a href="/expose/1"></a><i data-testid="g-9-slide-0"></i><b data-testid="headline">T</b><i data-testid="attributes">1.200 € 80,5 m² 3 Zi.</i><i data-testid="hybridViewAddress">Ort</i></div><h3>Weitere Treffer</h3><div class="listing-card"><a href="/expose/2"></a></div>', ("https://site.example/expose/9", "T", 1200.0, 80.5, 3.0, "Ort")),
    ("Immowelt", PAGE_CASES[2][1], PAGE_CASES[2][2]),
    ("Kleinanzeigen", PAGE_CASES[3][1], (*PAGE_CASES[3][2][:4], 2.5, "14469 Ort")),
    ("eBay", '<div class="s-card"><a href="/itm/123456"></a></div><div class="s-card"><a href="/itm/55?x"></a><p class="s-item__title">Grundstück 500 m² Privat</p><p class="s-item__price">EUR 1.999,50</p></div><div class="s-card"><a href="/itm/56"></a><p class="s-item__title">Ohne Preis</p></div>', ("https://site.example/itm/55", "Grundstück 500 m²", 2000.0, 500.0, None, "")),
    ("Regionalimmobilien24", '<article class="list-immoitem" id="oid-1"><i class="shariff" data-url="https://r.example/1"></i><h2>T</h2><p class="listentry-details">700,00 € 50,5 m² 2.5 Zimmer</p><p class="listentry-adress">Adresse Ort</p></article>', ("https://r.example/1", "T", 700.0, 50.5, 2.5, "Ort")),
    ("Sparkasse", '<div data-testid="estate-link"><a href="/expose/F1.html#x"></a><b data-testid="estate-card-title">T</b><i data-testid="estate-card-subtitle">Ort</i><i data-testid="cost-section">99.999,50 €</i><i data-testid="mainfacts-section">120 m² Wohnfläche 700 m² Grundstücksfläche 4,5 Zi</i></div>', ("https://site.example/expose/F1.html", "T", 100000.0, 700.0, 4.5, "Ort")),
    ("Semmelhaack", PAGE_CASES[16][1], PAGE_CASES[16][2]),
    ("Vonovia", '{"results":[{"wrk_id":1,"slug":"a","titel":"T","preis":"500,5","groesse":0,"anzahl_zimmer":"2,5","plz":"14467","ort":"Ort"},{"wrk_id":1,"slug":"b"}]}', ("/zuhause-finden/immobilien/a", "T", 500.5, None, 2.5, "14467 Ort")),
    ("Engel", '<article><a href="/exposes/aaaabbbb-1"></a><b data-testid="search-components_result-card_headline">T</b><b data-testid="search-components_result-card_price">1.000,50 €</b><i data-testid="x_result-card_attribute_ffff-livingSurface">1 m²</i><i data-testid="x_result-card_attribute_aaaabbbb-1-livingSurface">90 m²</i><p>Ort, Deutschland</p></article>', ("https://site.example/exposes/aaaabbbb-1", "T", 1001.0, 90.0, None, "Ort")),
    ("BBG", '<div class="property_listing"><a href="/properties/ein-haus#g">+</a> 5.000,50 EUR 33 m²</div>', ("https://site.example/properties/ein-haus", "ein haus", 5001.0, 33.0, None, "")),
    ("BLB", '<article><a href="/x/1">Haus Weiterlesen ...</a><h3>Haus Weiterlesen ...</h3> Kaufpreis: 10.000,50 EUR 300 m²</article><article>Text</article>', ("https://site.example/x/1", "Haus", 10001.0, 300.0, None, "")),
    ("WBG Daheim", '<main><article><h3>T</h3><a href="/w/1">w</a> 60,5 m² 2,5 Zimmer 500 €</article></main>', ("https://site.example/w/1", "T", 500.0, 60.5, 3.0, "Potsdam")),
]


def rows(html, source, snippets=False):
    return [tuple(r[c] for c in ("url", "title", "price", "m2", "rooms", "location")) for r in extract(html, source, BASE, snippets)[0]]


@pytest.mark.parametrize(("source", "html", "want"), PAGE_CASES)
def test_page(source, html, want):
    assert rows(html, source)[0] == want
    assert len(rows(html, source)) == (2 if source == "immobilien.de" else 1)
    assert rows(html + html, source)[: len(rows(html, source))] == rows(html, source)


@pytest.mark.parametrize(("source", "html", "want"), SNIPPET_CASES)
def test_snippet(source, html, want):
    assert rows(html, source, True) == [want]


def test_every_source_has_a_case():
    for rule in PAGES:
        assert any(rule_for(s) is rule for s, _, _ in PAGE_CASES)
    for rule in SNIPPETS:
        assert any(rule_for(s, True) is rule for s, _, _ in SNIPPET_CASES)
    assert rule_for("elsewhere") is GENERAL and rule_for(None) is GENERAL


def test_empty_pages():
    assert extract("", "x") == extract(None, "x") == ([], False)
    assert extract("<p>Keine passenden Objekte gefunden</p>", "immobilien.de") == ([], True)
    assert extract('<div class="immo-object card" data-type="Garage"></div>', "wg karl marx") == ([], True)
    assert extract("<h1>0 Mietwohnungen</h1>", "immoscout", snippets=True) == ([], True)
    assert extract("<main>leider keine</main>", "WBG Daheim", snippets=True) == ([], True)


def test_frame(spark):
    pages = [(k, s, BASE, h, "clash") for k, (s, h, _) in enumerate(PAGE_CASES)] + [(900, "x", None, None, ""), (901, None, None, "<p>nothing", ""), (902, "x", "", "", "")]
    df = spark.createDataFrame(pages, "page_id bigint, source string, url string, html string, title string")
    got = {r.page_id: (r.url, r.title, r.price, r.m2, r.rooms, r.location) for r in card_listings(df, "page_id", "source", "url", "html").where("pos = 0").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(PAGE_CASES)}
    assert card_listings(df.limit(0), "page_id", "source", "url", "html").count() == 0
