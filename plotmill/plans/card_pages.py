"""Result pages of each source, rendered from inbox rows in the markup of that source and read by its own rule.

A template has ``{i}`` for the row's id, ``{p}`` for a price, ``{m}`` for whole square metres and ``{r}`` for rooms. Beside
it stands what a reader of the page expects, in SQL over the same four values: address, title, price, size, rooms, place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.runtime import read_table
from plotmill.sources.cards import card_listings

_SITE = "https://site.example"
_AT = f"'{_SITE}%s' || i"

#: source, template, (url, title, price, m2, rooms, location)
PAGES = [
    ("ImmoScout24", '<ul><li data-id="{i}"><a href="/expose/{i}?x#y"></a><b data-testid="title">Nr {i}</b><i data-testid="price">{p},50 €</i><i data-testid="area">{m},5 m²</i><i data-testid="rooms">{r}</i><i data-testid="address">Ort</i></li></ul>', (_AT % "/expose/", "'Nr ' || i", "p + 0.5", "m + 0.5", "r", "'Ort'")),
    ("Immowelt", '<div data-testid="classified-card-mfe-1"><a href="/expose/{i}?q"></a><b data-testid="cardmfe-price-testid">{p} €</b><div data-testid="cardmfe-description-box-text-test-id"><p>{p} €</p><p>Wohnung zur Miete</p><p>{r},5 Zimmer · {m},3 m²</p></div><i data-testid="cardmfe-description-box-address">Ort</i></div>', (_AT % "/expose/", "'Wohnung zur Miete'", "p", "m + 0.3", "r + 0.5", "'Ort'")),
    ("ohne-makler", '<a data-om-id="{i}" href="/o/{i}"><img alt="Bild {i}"><p class="text-primary-500">{p} €</p><p class="text-slate-800">Ort</p>{m} m²</a>', (_AT % "/o/", "'Bild ' || i", "p", "m", "NULL", "'Ort'")),
    ("IVD24", '<a class="rr-list-results" data-id="{i}" href="/i/{i}"><h2>T {i}</h2><h5>Ort</h5><div class="result-bar"><p class="float-right">{p} € {m}.5 m²</p></div></a>', (_AT % "/i/", "'T ' || i", "p", "m + 0.5", "NULL", "'Ort'")),
    ("Zwangsversteigerung", '<div class="d_tab_objekte"><a href="/detail/{i}"><p class="left">Weg 1, Ort</p><p class="middle">Haus {m} m²</p><p class="right">{p} €</p></a></div>', (_AT % "/detail/", "'Haus ' || m || ' m² — Weg 1, Ort'", "p", "m", "NULL", "'Weg 1, Ort'")),
    ("Engel", '<div class="x-StyledContent"><a href="/exposes/{i}"></a><b data-testid="a_result-card_headline">T {i}</b><b data-testid="result-card_price">{p} €</b><i data-testid="result-card_attribute_1">3 Zi</i><i data-testid="result-card_attribute_2">{m} m²</i><i data-testid="result-card_location">Ort</i></div>', (_AT % "/exposes/", "'T ' || i", "p", "m", "NULL", "'Ort'")),
    ("DGA", '<div class="auktion-details"><p class="addr-list"><a href="/d/{i}">Haus {m} m²<br>Weg 2<br>Ort</a></p><i class="auktionLimitAmoutForSorting">{p}</i></div>', (_AT % "/d/", "'Haus ' || m || ' m²'", "p", "m", "NULL", "'Weg 2, Ort'")),
    ("BVBI", '<div class="flex flex-col"><p><a href="/immobilien/details/{i}">Titel {i}</a></p> {p} € {m} m²</div>', (_AT % "/immobilien/details/", "'Titel ' || i", "p", "m", "NULL", "''")),
    ("BVVG", '<div class="immomakler-listitem"><a href="/objekte/{i}">Ackerland {i}</a><a href="/objekte/?s">Alle Objekte</a> {r},5 ha</div>', (_AT % "/objekte/", "'Ackerland ' || i", "NULL", "r * 10000 + 5000", "NULL", "''")),
    ("BLB", '<article><h2>Haus in Ort</h2><a href="/pressemitteilung/{i}">w</a> Kaufpreisvorstellung: {p} EUR {m} m²</article>', (_AT % "/pressemitteilung/", "'Haus in Ort'", "p", "m", "NULL", "'Ort'")),
    ("BBG", '<div><a href="/properties/{i}"><h4>Laden – Altstadt</h4></a> {m} m2 {p} EUR</div>', (_AT % "/properties/", "'Laden – Altstadt'", "p", "m", "NULL", "'Altstadt'")),
    ("Stadt Potsdam", '<article><h3>T {i}</h3><a href="/s/{i}">w</a> {m} m²</article>', (_AT % "/s/", "'T ' || i", "NULL", "m", "NULL", "'Potsdam'")),
    ("ProPotsdam", '<li class="row"><a href="/verkaufsobjektdetails/{i}"></a><h3>Haus in der Mitte Neu</h3><i class="main-facts__text">{m} m²</i><i class="main-facts__text">{p} €</i></li>', (_AT % "/verkaufsobjektdetails/", "'Haus in der Mitte'", "p", "m", "NULL", "'Potsdam, Mitte'")),
    ("WG Karl Marx", '<div class="immo-object card" data-type="Wohnung"><a class="card-link" href="/w/{i}"></a><h3 class="card-title">{r}-Raum-Wohnung</h3><p class="space"><i class="number">{m},5 m²</i></p><p class="price"><i class="number">{p} €</i></p></div>', (_AT % "/w/", "r || '-Raum-Wohnung'", "p", "m + 0.5", "r", "'Potsdam'")),
    ("Süddeutsche", '<div class="card item-wrap"><a href="/immobilien/{i}"></a><p>{p},00 €</p><p>{m} m²</p><p>{r},5 Zi.</p><p>14467 Ort</p></div>', (_AT % "/immobilien/", "'Wohnung (Premium-Anzeige)'", "p", "m", "r + 0.5", "'14467 Ort'")),
    ("Schoba", '<table><tr><th>Wohnung<br>14467 Ort<br>Lage {i}</th></tr><tr><td>Zimmer: {r} Wohnfläche: ca. {m},5 m² Kaltmiete: {p},00 EUR <a href="vm-{i}.og-2.htm">w</a></td></tr></table>', (f"'{_SITE}/vm-' || i || '.og-2.htm'", "'Lage ' || i", "p", "m + 0.5", "r", "'14467 Ort'")),
    ("Ab ins Zuhause", '<div data-entries-list-target="entryCardWrapper"><a href="/angebot/{i}?x"></a><p class="text-truncate">T {i}</p><small>Neu</small><small>Ort</small><small>{r},5 Zi. · {m},5 m²</small><p class="fw-bold">{p} €</p></div>', (_AT % "/angebot/", "'T ' || i", "p", "m + 0.5", "r + 0.5", "'Ort'")),
    ("unknown", '<div class="my-listing"><h3>T {i}</h3><a href="/g/{i}">x</a> {p} € {m} m² {r} Zi</div>', (_AT % "/g/", "'T ' || i", "p", "m", "r", "''")),
]

SNIPPETS = [
    ("ImmoScout24", '<h1>2 Mietwohnungen</h1><div class="listing-card"><a href="/expose/1"></a><i data-testid="g-{i}-slide-0"></i><b data-testid="headline">T {i}</b><i data-testid="attributes">{p} € {m},5 m² {r} Zi.</i><i data-testid="hybridViewAddress">Ort</i></div><h3>Weitere Treffer</h3><div class="listing-card"><a href="/expose/2"></a></div>', (_AT % "/expose/", "'T ' || i", "p", "m + 0.5", "r", "'Ort'")),
    ("eBay", '<div class="s-card"><a href="/itm/123456"></a></div><div class="s-card"><a href="/itm/77{i}?x"></a><p class="s-item__title">Grundstück {m} m² Privat</p><p class="s-item__price">EUR {p},00</p></div>', (_AT % "/itm/77", "'Grundstück ' || m || ' m²'", "p", "m", "NULL", "''")),
    ("Regionalimmobilien24", '<article class="list-immoitem" id="oid-{i}"><i class="shariff" data-url="https://r.example/{i}"></i><h2>T {i}</h2><p class="listentry-details">{p},00 € {m},5 m² {r}.5 Zimmer</p><p class="listentry-adress">Adresse Ort</p></article>', ("'https://r.example/' || i", "'T ' || i", "p", "m + 0.5", "r + 0.5", "'Ort'")),
    ("Sparkasse", '<div data-testid="estate-link"><a href="/expose/F{i}.html#x"></a><b data-testid="estate-card-title">T {i}</b><i data-testid="estate-card-subtitle">Ort</i><i data-testid="cost-section">{p},00 €</i><i data-testid="mainfacts-section">{m} m² Wohnfläche {r},5 Zi</i></div>', (f"'{_SITE}/expose/F' || i || '.html'", "'T ' || i", "p", "m", "r + 0.5", "'Ort'")),
    ("Vonovia", '{"results":[{"wrk_id":{i},"slug":"s-{i}","titel":"T {i}","preis":"{p},5","groesse":{m},"anzahl_zimmer":"{r},5","plz":"14467","ort":"Ort"}]}', ("'/zuhause-finden/immobilien/s-' || i", "'T ' || i", "p + 0.5", "m", "r + 0.5", "'14467 Ort'")),
    ("BBG", '<div class="property_listing"><a href="/properties/haus-{i}#g">+</a> {p},00 EUR {m} m²</div>', (_AT % "/properties/haus-", "'haus ' || i", "p", "m", "NULL", "''")),
    ("BLB", '<article><a href="/x/{i}">Haus Weiterlesen ...</a><h3>Haus Weiterlesen ...</h3> Kaufpreis: {p},00 EUR {m} m²</article>', (_AT % "/x/", "'Haus'", "p", "m", "NULL", "''")),
    ("WBG Daheim", '<main><article><h3>T {i}</h3><a href="/w/{i}">w</a> {m},5 m² {r} Zimmer {p} €</article></main>', (_AT % "/w/", "'T ' || i", "p", "m + 0.5", "r", "'Potsdam'")),
]


def _read(spark: SparkSession, sf: str, forms: list, snippets: bool) -> DataFrame:
    """Every inbox row as a page of one of the sources."""
    templates = F.broadcast(spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(forms)], "k int, source string, template string"))
    i = read_table(spark, sf, "scan_inbox")
    price, size = F.pmod(F.floor(F.coalesce("price", F.lit(0.0))), F.lit(900)) + 100, F.pmod(F.floor(F.coalesce("m2", F.lit(0.0))), F.lit(180)) + 20
    values = i.select("entry_id", F.pmod("entry_id", F.lit(len(forms))).cast("int").alias("k"), price.alias("p"), size.alias("m"), (F.pmod("entry_id", F.lit(5)) + 1).alias("r")).join(templates, "k")
    html = F.col("template")
    for mark, value in (("i", "entry_id"), ("p", "p"), ("m", "m"), ("r", "r")):
        html = F.replace(html, F.lit("{" + mark + "}"), F.col(value).cast("string"))
    pages = values.select("entry_id", "source", F.lit(f"{_SITE}/list").alias("url"), html.alias("html"))
    return card_listings(pages, "entry_id", "source", "url", "html", snippets).withColumnRenamed("page_id", "entry_id")


def _sql(forms: list) -> str:
    pick = lambda n: "CASE k " + " ".join(f"WHEN {k} THEN {f[2][n]}" for k, f in enumerate(forms) if f[2][n]) + " END"
    source = "CASE k " + " ".join(f"WHEN {k} THEN '{f[0]}'" for k, f in enumerate(forms)) + " END"
    return f"""WITH v AS (SELECT entry_id, CAST(entry_id AS varchar) AS i, entry_id % {len(forms)} AS k, CAST(floor(coalesce(price, 0)) AS bigint) % 900 + 100 AS p, CAST(floor(coalesce(m2, 0)) AS bigint) % 180 + 20 AS m, entry_id % 5 + 1 AS r FROM scan_inbox)
SELECT entry_id, 0 AS pos, {pick(0)} AS url, {pick(1)} AS title, CAST({pick(2)} AS double) AS price, CAST({pick(3)} AS double) AS m2, CAST({pick(4)} AS double) AS rooms, {pick(5)} AS location, {source} AS source FROM v"""


def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows through result pages in the markup of each source."""
    return _read(spark, sf, PAGES, False)


def snippet_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox rows through page snippets in the markup of each source."""
    return _read(spark, sf, SNIPPETS, True)


QUERIES = {"page_cards": page_cards, "snippet_cards": snippet_cards}
ORACLES = {"page_cards": _sql(PAGES), "snippet_cards": _sql(SNIPPETS)}
