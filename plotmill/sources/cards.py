"""Result pages as HTML to listing rows: one extractor, one rule per source.

A rule names the card, the link that identifies it, and for each field the places to look at, in order: an element, a
pattern on its text and a number dialect. Sources are told by a part of their name; the first rule that fits is taken,
else the general one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmill.sources.html_tree import Node, parse_html

TITLE_CHARS = 120


def german(s: str) -> float | None:
    """Dots group, the first comma is the decimal."""
    m = re.match(r"[0-9]+\.?[0-9]*|\.[0-9]+", s.replace(".", "").replace(",", ".", 1))
    return float(m[0]) if m else None


def dotted(s: str) -> float | None:
    """A dot is the decimal."""
    m = re.match(r"[0-9]+\.?[0-9]*", s)
    return float(m[0]) if m else None


def half_up(s: str) -> float | None:
    v = german(s)
    return None if v is None else float(int(v + 0.5))


def room(s: str) -> float | None:
    """Comma or dot is the decimal."""
    return dotted(s.replace(",", ".", 1))


def room_half_up(s: str) -> float | None:
    v = room(s)
    return None if v is None else float(int(v + 0.5))


@dataclass(frozen=True)
class At:
    """Where a field stands: the first element of ``select`` (several with ``each``; by default the card), an attribute or
    its text, the first group of ``pattern`` in it. ``label`` takes the value of the row with such a label. ``line`` takes
    the first line that the pattern fits. ``const`` is a fixed text, and ``form`` wraps what was found."""

    select: str = ""
    pattern: str = ""
    attr: str = ""
    each: bool = False
    label: str = ""
    line: str = ""
    const: str = ""
    form: str = "{}"
    number: Callable[[str], float | None] | None = None
    times: float = 1.0


@dataclass(frozen=True)
class Rule:
    names: tuple[str, ...]
    card: str
    link: str = "a[href]"
    link_attr: str = "href"
    href: str = ""
    """Pattern that the link has to fit; its first group, if any, is the identity."""
    url: str = "{}"
    cut: str = ""
    base: str = ""
    title: tuple[At, ...] = (At("h1,h2,h3,h4,h5"),)
    price: tuple[At, ...] = ()
    m2: tuple[At, ...] = ()
    rooms: tuple[At, ...] = ()
    location: tuple[At, ...] = ()
    up: str = ""
    """The enclosing element that holds the fields."""
    drop: str = ""
    """Cards whose text fits this are none."""
    untitled: bool = False
    keep: Callable[[dict], bool] | None = None
    empty: str = ""
    """Text of a page that says it has no offers."""
    end: str = ""
    """Text of the heading after which cards are padding."""
    total: str = ""
    extra: dict = field(default_factory=dict, hash=False)


_EUR, _M2 = r"([\d.,]+)\s*€", r"([\d.,]+)\s*m²"


def _n(pattern: str, select: str = "", number: Callable = german, **more) -> At:
    return At(select, pattern, number=number, **more)


_PAD = "angrenzenden Regionen|Weitere Treffer|Umgebungstreffer|Hier schon gesucht"

#: Where each source's pages have their cards and fields.
PAGES: tuple[Rule, ...] = (
    Rule(("immoscout",), "li[data-id]", 'a[href*="/expose/"]', cut="#?", title=(At('[data-testid="title"]'), At("h2,h5,.result-list-entry__brand-title")), untitled=True, price=(_n("(.+)", '[data-testid="price"]'),), m2=(_n("(.+)", '[data-testid="area"]'),), rooms=(_n("(.+)", '[data-testid="rooms"]'),), location=(At('[data-testid="address"]'),), extra={"or": Rule((), ".listing-card", 'a[href*="/expose/"]', cut="#?", title=(At(),), price=(_n(_EUR),), m2=(_n(_M2),), rooms=(_n(r"(\d+)\s*Zi\."),))}),
    Rule(("immowelt",), '[data-testid^="classified-card-mfe-"]', 'a[href*="/expose/"]', cut="?", title=(At('[data-testid="cardmfe-description-text-test-id"]'), At('[data-testid="cardmfe-description-box-text-test-id"]', line=r"(?i)^[^€]*(?:zum Kauf|zur Miete)"), At('[data-testid="cardmfe-description-box-text-test-id"]')), untitled=True, price=(_n(r"([\d.]+(?:,\d+)?)", '[data-testid="cardmfe-price-testid"]'),), m2=(_n(_M2, '[data-testid="cardmfe-keyfacts-testid"]'), _n(_M2, '[data-testid="cardmfe-description-box-text-test-id"]', line=r"^[^€]*\d\s*(?:Zimmer|m²)[^€]*$")), rooms=(_n(r"(\d+(?:[.,]\d+)?)\s*Zimmer", '[data-testid="cardmfe-keyfacts-testid"]', room), _n(r"(\d+(?:[.,]\d+)?)\s*Zimmer", '[data-testid="cardmfe-description-box-text-test-id"]', room, line=r"^[^€]*\d\s*(?:Zimmer|m²)[^€]*$")), location=(At('[data-testid="cardmfe-description-box-address"]'),)),
    Rule(("kleinanzeigen",), "article[data-adid]", 'a[href*="/s-anzeige/"]', title=(At('script[type="application/ld+json"]', attr="json:title"), At("h2")), untitled=True, price=(_n(r"([\d.]+(?:,\d+)?)\s*€"),), m2=(_n(_M2),), rooms=(_n(r"([\d.,]+)\s*Zi\.?", "", room_half_up),), location=(At("", r"(\d{5}\s+\S+)"),), extra={"card_href": "data-href"}),
    Rule(("ohne-makler",), "a[data-om-id]", "", title=(At("img", attr="alt"), At()), price=(_n(_EUR, ".text-primary-500"),), m2=(_n(_M2),), location=(At(".text-slate-800"),)),
    Rule(("ivd24",), "a.rr-list-results[data-id]", "", title=(At("h2"),), price=(_n(_EUR, ".result-bar .float-right"),), m2=(_n(r"([\d.]+)\s*m²", ".result-bar .float-right", dotted),), location=(At("h5"),)),
    Rule(("zwangsversteigerung",), '.d_tab_objekte a[href*="/detail/"]', "", title=(At(attr="join:.middle:60: — :.left"),), price=(_n(r"([\d.]+)\s*€", ".right"),), m2=(_n(r"([\d.,]+)\s*m", ".middle"),), location=(At(".left"),)),
    Rule(("engel",), '[class*="StyledContent"]', 'a[href*="/exposes/"]', title=(At('[data-testid*="result-card_headline"]'),), price=(_n(r"([\d.]+)\s*€", '[data-testid*="result-card_price"]'),), m2=(_n(_M2, '[data-testid*="result-card_attribute"]', each=True),), location=(At('[data-testid*="result-card_location"]'),)),
    Rule(("dga",), ".auktion-details", ".addr-list a", title=(At(".addr-list a", attr="line:0"),), price=(_n(r"^\s*([1-9]\d*)", ".auktionLimitAmoutForSorting", dotted),), m2=(_n(_M2, ".addr-list a"),), location=(At(".addr-list a", attr="line:1:"),)),
    Rule(("bvbi",), 'a[href*="/immobilien/details/"]', "", title=(At(attr="own"),), price=(_n(r"([\d.]+)\s*€"),), m2=(_n(_M2),), up=".flex.flex-col", extra={"own_not": "^Jetzt ansehen$"}),
    Rule(("bvvg",), 'a[href*="/objekte/"]', "", href=r"^(?!.*merkliste)[^#?]*/objekte/[^#?]+$", title=(At(attr="own"),), m2=(_n(_M2), _n(r"([\d.,]+)\s*ha", times=10_000.0)), up=".immomakler-listitem,.immomakler-property,div", extra={"own_not": "^.{0,5}$"}),
    Rule(("blb",), "article", 'a[href*="/pressemitteilung"]', title=(At("h2,h3"), At('a[href*="/pressemitteilung"]')), drop="keine Immobilien", price=(_n(r"(?i)Kaufpreisvorstellung:\s*([\d.,]+)\s*EUR"),), m2=(_n(_M2),), location=(At("h2,h3", r"in\s+(.+?)$"),)),
    Rule(("bbg",), 'a[href*="/properties/"]', "", title=(At("h4,h3,h2"), At(attr="own")), price=(_n(r"(?i)([\d.,]+)\s*EUR"),), m2=(_n(r"([\d.,]+)\s*m[²2]"),), location=(At(attr="own", pattern=r"(?i)in\s+(.+?)$"), At(attr="own", pattern=r"[-–]\s*(.+?)$"), At(const="Brandenburg")), up="div"),
    Rule(("stadt potsdam",), "article", title=(At("h2,h3"), At("a[href]")), m2=(_n(_M2),), location=(At(const="Potsdam"),)),
    Rule(("propotsdam",), ".table-list__row,li.row", 'a[href*="/verkaufsobjektdetails/"]', title=(At("h3,h4,.table-list__headline", r"^(.*?)(?:\s*Neu)?$"),), price=(_n(_EUR, ".main-facts__text", each=True),), m2=(_n(_M2, ".main-facts__text", each=True),), location=(At("h3,h4,.table-list__headline", r"in\s+(?:der\s+)?(.+?)(?:\s+Neu)?$", form="Potsdam, {}"), At(const="Potsdam"))),
    Rule(("dibag",), ".elementor-heading-title", "", extra={"unit": True}, title=(), m2=(_n(r"([\d,]+)\s*m²"),), rooms=(_n(r"(?i)(\d+)\s*Zimmer"),), location=(At("", r"(?i)(In der Feldmark\s*\d+)", form="{}, 14476 Potsdam-Golm"), At(const="Potsdam-Golm"))),
    Rule(("semmelhaack",), "div.objekt-single-data", "a.zur-objektbeschreibung", price=(_n(r"([\d.,]+)", label="kaltmiete|inklusivmiete"),), m2=(_n(r"([\d.,]+)", label="nutzfläche|wohnfläche|fläche"),), rooms=(_n(r"([\d.,]+)", label="räume|zimmer"),), location=(At(label="adresse|standort"),), extra={"title_least": 5}),
    Rule(("karl marx", "wgkarlmarx"), ".immo-object.card", "a.card-link", title=(At("h3.card-title"),), untitled=True, price=(_n(r"([\d.,]+)", ".price .number"),), m2=(_n(r"([\d.,]+)", ".space .number"),), rooms=(_n(r"([1-9][\d.,]*)", ".rooms .number"), _n(r"(?i)(\d+)[\s-]*(?:Raum|Zimmer|Zi)", "h3.card-title")), location=(At(const="Potsdam"),), extra={"type": "wohnung", "legit_empty": True}),
    Rule(("süddeutsche",), "div.card.item-wrap", 'a[href*="/immobilien/"],a[href*="/expose/"]', title=(At("h1,h2,h3,h4,h5"), At("a.js-item-title-link"), At('a[href*="/immobilien/"],a[href*="/expose/"]'), At("img", attr="alt"), At(attr="premium")), price=(_n(r"([\d.]+,\d{2})\s*€"), _n(r"([\d.]+)\s*€")), m2=(_n(r"(?i)([\d.,]+)\s*m[2²]"),), rooms=(_n(r"([\d,]+)\s*Zi\.?"),), location=(At(line=r"\b\d{5}\b"),), keep=lambda x: x["price"] is not None or x["m2"] is not None),
    Rule(("schoba",), "a[href]", "", href=r"(?i)(?:^|/)vm-.*\.og[rml]?-.*\.htm", up="table", title=(At(".tabelletextleft-liste,th", attr="line:-1"),), untitled=True, price=(_n(r"(?:Nettokaltmiete|Kaltmiete|Bruttowarmmiete|Warmmiete):\s*([\d.,]+)\s*EUR"),), m2=(_n(r"Wohnfläche:\s*ca\.?\s*([\d.,]+)\s*m²"),), rooms=(_n(r"Zimmer:\s*(\d+)"),), location=(At(".tabelletextleft-liste,th", line=r"\d{5}\s+\D"),), drop=r"(?i)Verfügbar ab:[^:]*vermietet", keep=lambda x: (x["price"] or 0) > 0, extra={"need_up": True}),
    Rule(("ab ins zuhause", "ab-ins-zuhause"), '[data-entries-list-target="entryCardWrapper"]', 'a[href*="/angebot/"]', cut="?", title=(At("p.text-truncate"),), untitled=True, price=(_n(r"([\d.]+)\s*€", "p.fw-bold"),), m2=(_n(r"([\d.,]*[1-9][\d.,]*)\s*m²", "small", each=True),), rooms=(_n(r"([\d.,]+)\s*Zi\.?", "small", room, each=True),), location=(At("small", r"(?i)^(?!.*(?:Zi\.|m²))(?!Neu$)(.+)$", each=True),)),
    Rule(("immobilien.de",), 'a[href^="/expose/"]', "", href=r"^/expose/(\d+)", url="/expose/{}", title=(At(attr="own"), At(attr="id", form="Exposé {}")), price=(_n(r"(\d[\d.]*(?:,\d+)?)\s*€\s*(?:Kaltmiete|Warmmiete|Miete|Kaufpreis)"), _n(r"(\d[\d.]*(?:,\d+)?)\s*€")), m2=(_n(r"Fläche\s*(\d[\d.]*(?:,\d+)?)\s*m²"),), rooms=(_n(r"Zimmer\s*(\d+(?:[.,]\d+)?)", "", room),), location=(At("", r"€\s*/\s*m²\s*(\d{5}\s+.*?)\s*Fläche"), At("", r"(\d{5}\s+[^\d€]{2,60}?)\s*(?:Fläche|Zimmer|$)")), empty=r"Keine passenden Objekte gefunden|keine aktuellen Angebote", total=r"(\d[\d.]*)\s+(?:aktuelle Angebote|Immobilien in\s)", extra={"grow": True, "after_title": True}),
)

#: The general rule, for sources without one of their own.
GENERAL = Rule((), '[class*="listing"],[class*="result"],[class*="offer"],[class*="property"],[class*="apartment"],[class*="expose"]', title=(At('h2,h3,h4,[class*="title"]'), At()), untitled=True, price=(_n(r"(\d[\d.,]*)\s*€"),), m2=(_n(r"(\d[\d,]*)\s*m²"),), rooms=(_n(r"(\d+)\s*Zi"),), extra={"text": r"\d+\s*€|\d+\s*m²", "links": True})

#: The compact snippets' rules, where they differ from the pages'.
SNIPPETS: tuple[Rule, ...] = (
    Rule(("immoscout",), ".listing-card", 'a[href*="/expose/"]', extra={"not_class": "ad-card", "slide": True}, href=r"/expose/(\d+)", url="/expose/{}", title=(At('[data-testid="headline"]'),), untitled=True, price=(_n(r"([\d.]+(?:,\d+)?)\s*€", '[data-testid="attributes"]'), _n(r"([\d.]+(?:,\d+)?)\s*€")), m2=(_n(r"€\s*([\d.]+(?:,\d+)?)\s*m²", '[data-testid="attributes"]'), _n(r"€\s*([\d.]+(?:,\d+)?)\s*m²")), rooms=(_n(r"m²\s*([\d.]+(?:,\d+)?)\s*Zi\.", '[data-testid="attributes"]'), _n(r"m²\s*([\d.]+(?:,\d+)?)\s*Zi\.")), location=(At('[data-testid="hybridViewAddress"]'),), end=_PAD, total=r"(\d+)\s*(?:Mietwohnung|Wohnung|Haus|Häuser|Immobilie)"),
    Rule(("immowelt",), PAGES[1].card, PAGES[1].link, cut="?", title=PAGES[1].title, untitled=True, price=PAGES[1].price, m2=PAGES[1].m2, rooms=PAGES[1].rooms, location=PAGES[1].location, total=r"([\d.]+)\s*(?:Wohnung|Häuser|Haus|Immobilien)"),
    Rule(("kleinanzeigen",), PAGES[2].card, PAGES[2].link, title=PAGES[2].title, untitled=True, price=PAGES[2].price, m2=PAGES[2].m2, rooms=(_n(r"([\d.,]+)\s*Zi\.?", "", room),), location=PAGES[2].location, extra={"card_href": "data-href"}),
    Rule(("ebay",), '.s-card,.su-card-container,[class*="su-item-card"]', 'a[href*="/itm/"]', href=r"/itm/(?!123456\b)(\d+)", url="/itm/{}", title=(At(".su-card-container__header,.su-item-card__header,.s-item__title", r"^(?:Wird in neuem Fenster oder Tab geöffnet)?\s*(.*?)(?:\s*(?:Wird in neuem Fenster oder Tab geöffnet|Privat|Anzeige|Gewerblich))*$"), At("img", r"^(.*?)(?:\s*Bild \d+ von \d+)?$", attr="alt")), price=(_n(r"(?i)(?:EUR|€)\s*([\d.]+(?:,\d{1,2})?)", ".su-card-container__attributes__primary,.su-item-card__price,.s-item__price", half_up), _n(r"(?i)([\d.]+(?:,\d{1,2})?)\s*(?:EUR|€)", ".su-card-container__attributes__primary,.su-item-card__price,.s-item__price", half_up)), m2=(_n(r"(?i)([\d.,]+)\s*(?:m²|m2|qm)(?!\w)", ".su-card-container__header,.su-item-card__header,.s-item__title"),), rooms=(_n(r"(\d+)\s*Zi", ".su-card-container__header,.su-item-card__header,.s-item__title"),), drop=r"(?i)^Shop on|^mydays|Gutschein", keep=lambda x: (x["price"] or 0) > 0),
    Rule(("regionalimmobilien24",), 'article.list-immoitem,article[id^="oid-"]', ".shariff[data-url]", "data-url", title=(At("h2.listentry-click,h2,h3"), At(".shariff[data-url]", attr="data-title")), untitled=True, price=(_n(r"([\d.]+,\d{2})\s*€", ".listentry-details"), _n(r"([\d.]+)\s*€", ".listentry-details")), m2=(_n(_M2, ".listentry-details"),), rooms=(_n(r"([\d.,]+)\s*(?:Zimmer|Räume|Raum|Zi\.?)", ".listentry-details", room),), location=(At(".listentry-adress", r"(?i)^(?:adresse\s*)?(.*)$"),), empty=r"(?i)(?<!\d)0\s+(?:Miet|Immobilien|Objekte|Wohnungen|Häuser)"),
    Rule(("sparkasse",), '[data-testid="estate-link"]', 'a[href*="/expose/"]', cut="#", title=(At('[data-testid="estate-card-title"]'), At('a[href*="/expose/"]', r"/expose/([^/.?#]+)", attr="href")), untitled=True, price=(_n(r"([\d.]+(?:,\d+)?)\s*(?:€|EUR)", '[data-testid="cost-section"]', half_up),), m2=tuple(_n(p, '[data-testid="mainfacts-section"]') for p in (r"(?i)([\d.,]+)\s*m²\s*Grundstücksfläche", r"(?i)([\d.,]+)\s*m²\s*Wohnfläche", _M2)), rooms=(_n(r"(?i)(\d+(?:[.,]\d+)?)\s*Zi(?!\w)", '[data-testid="mainfacts-section"]', room),), location=(At('[data-testid="estate-card-subtitle"]'),)),
    Rule(("semmelhaack",), "div.objekt-single-data", 'a.zur-objektbeschreibung,a[href*="details-wohnobjekt"]', price=PAGES[15].price, m2=PAGES[15].m2, rooms=(_n(r"([\d.,]+)", number=half_up, label="räume|zimmer"),), location=PAGES[15].location, extra={"title_least": 5}),
    Rule(("vonovia",), "", extra={"json": True}),
    Rule(("engel",), "article", 'a[href*="/exposes/"]', href=r"(?i)/exposes/(?=([0-9a-f-]{8,}))", extra={"identity_only": True, "own_attributes": r"-(plotSurface|livingSurface)$"}, title=(At('[data-testid="search-components_result-card_headline"]'), At(attr="id", form="Objekt {}")), untitled=True, price=(_n(r"([\d.]+(?:,\d+)?)\s*(?:€|EUR)", '[data-testid="search-components_result-card_price"]', half_up),), m2=(_n(_M2, '[data-testid*="_result-card_attribute_"]', each=True),), location=(At("", r"^(.{0,76}),\s*Deutschland$", line=r",\s*Deutschland$"),)),
    Rule(("bbg",), '[class*="property_listing"]', 'a[href*="/properties/"]', href=r"^(?:https?://[^/]*)?/properties/", cut="#", title=(At('h1,h2,h3,h4,.listing-title,[class*="title"]', r"^([^+].*)$"), At('a[href*="/properties/"]', r"^([^+].*)$", each=True), At('a[href*="/properties/"]', r"/properties/([^/?#]+)", attr="slug")), price=(_n(r"([\d.]+(?:,\d+)?)\s*(?:EUR|€)", number=half_up),), m2=(_n(_M2),)),
    Rule(("blb",), 'article,[class*="teaser"],[class*="bb-flex-stretch"]', href=r"^(?!#)(?!.*immobilienangebote/?$)", title=(At("h1,h2,h3,h4", r"(?i)^(.*?)(?:\s*Weiterlesen\s*\.*)?$"), At("a[href]")), price=(_n(r"(?i)(?:Kaufpreis(?:vorstellung)?|Preis)\s*:?\s*([\d.]+(?:,\d+)?)\s*(?:EUR|€)", number=half_up), _n(r"([\d.]+(?:,\d+)?)\s*(?:EUR|€)", number=half_up)), m2=(_n(_M2),), empty=r"(?i)(?:zur\s*zeit|derzeit|momentan)[^.]{0,40}\bkeine\b[^.]{0,40}(?:immobilien|objekte|angebote)", extra={"text": r"(?i)(?:EUR|€)|m²|Kaufpreis|auf Anfrage"}),
    Rule(("daheim",), "article,.elementor-widget-container,.wp-block-column,li,.card,.angebot,div", extra={"text": r"(?is)(?=.*\d\s*(?:m²|m2|qm))(?=.*(?:zimmer|zi\.|raum|räume))", "most_children": 12, "no_link": "/angebote/"}, title=(At("h1,h2,h3,h4,h5"), At()), price=(_n(r"(?i)([\d.,]+)\s*(?:€|EUR|Kaltmiete)"),), m2=(_n(r"(?i)([\d.,]+)\s*(?:m²|m2|qm)"),), rooms=(_n(r"(?i)([\d.,]+)\s*(?:zimmer|zi\.|raum|räume)", number=half_up),), location=(At(const="Potsdam"),), empty=r"(?i)keine freien Wohnungen|keine (?:freien )?Angebote|derzeit keine|leider keine"),
)


def rule_for(source: str | None, snippets: bool = False) -> Rule:
    """The first rule whose name is part of the source's name, else the general one."""
    low = (source or "").lower()
    return next((r for r in (SNIPPETS if snippets else PAGES) if any(n in low for n in r.names)), GENERAL)


def _value(at: At, card: Node, own: Node, identity: str, title: str) -> str:
    if at.const:
        return at.const
    if at.label:
        for row in card.all(".row"):
            label, value = row.first(".label"), row.first(".value")
            if label and value and re.search(at.label, label.text().lower()):
                return _found(at, value.text())
        return ""
    kind, _, rest = at.attr.partition(":")
    if kind == "own":
        return _found(at, own.text())
    if kind == "id":
        return _found(at, identity)
    if kind == "premium":
        return "Wohnung (Premium-Anzeige)"
    if kind == "join":
        first, size, glue, second = re.match(r"(.*?):(\d+):(.*):(.*)$", rest).groups()
        a, b = card.first(first), card.first(second)
        return f"{(a.text() if a else '')[: int(size)]}{glue}{b.text() if b else ''}"
    nodes = [card] if not at.select else card.all(at.select) if at.each else [n for n in [card.first(at.select)] if n]
    for n in nodes:
        if kind == "json":
            try:
                text = str(json.loads("".join(c for c in n.children if isinstance(c, str))).get(rest) or "")
            except (ValueError, AttributeError):
                text = ""
        elif kind == "line":
            lines = n.lines()
            if rest.endswith(":"):
                text = ", ".join(lines[int(rest[:-1]) :])
            else:
                lines = [x for x in lines if not re.search(r"\d{5}\s+\D", x)] if rest == "-1" else lines
                text = lines[int(rest)] if lines else ""
        elif kind == "slug":
            text = unquote(n.attrs.get("href", ""))
        elif kind:
            text = n.attrs.get(kind, "")
        elif at.line:
            text = next((x for x in n.lines() if re.search(at.line, x)), "")
        else:
            text = n.text()
        if text and (v := _found(at, text)):
            return re.sub(r"[-_]+", " ", v).strip() if kind == "slug" else v
    return ""


def _found(at: At, text: str) -> str:
    if at.pattern:
        m = re.search(at.pattern, text)
        text = m[1] if m else ""
    return at.form.format(text.strip()) if text.strip() else ""


def _text(places: tuple[At, ...], *where) -> str:
    return next((v for a in places if (v := _value(a, *where))), "")


def _number(places: tuple[At, ...], *where) -> float | None:
    for a in places:
        v = _value(a, *where)
        if v and (n := a.number(v)) is not None:
            return n * a.times
    return None


def _json_page(html: str) -> list[dict]:
    """A page whose body is JSON with ``results``."""
    try:
        data = json.loads(html)
    except ValueError:
        return []
    out, seen = [], set()
    number = lambda v: float(v) if isinstance(v, (int, float)) else german(str(v or ""))
    for r in data.get("results") or [] if isinstance(data, dict) else []:
        ident = str(r.get("wrk_id") or r.get("slug") or "")
        if not ident or ident in seen:
            continue
        seen.add(ident)
        if r.get("slug"):
            rooms = r.get("anzahl_zimmer")
            out.append({"url": "/zuhause-finden/immobilien/" + r["slug"], "title": " ".join(str(r.get("titel") or "").split())[:TITLE_CHARS], "price": number(r.get("preis")), "m2": number(r.get("groesse")) or None, "rooms": room(str(rooms)) if rooms is not None else None, "location": " ".join(str(x) for x in (r.get("plz"), r.get("ort")) if x)[:60]})
    return out


def extract(html: str | None, source: str | None, page_url: str = "", snippets: bool = False) -> tuple[list[dict], bool]:
    """The listings of a page in its order, and whether the page says that there are none.

    Each identity counts once. Titles are cut to 120 characters; numbers that aren't found are null; cards without a link
    or, unless the rule allows it, without a title are none. Null and empty pages have no listings.
    """
    if not html or not html.strip():
        return [], False
    rule = rule_for(source, snippets)
    if rule.extra.get("json"):
        return _json_page(html), False
    root = parse_html(html)
    out = _cards(rule, root, page_url)
    if not out and "or" in rule.extra:
        out = _cards(rule.extra["or"], root, page_url)
    if not out and rule.extra.get("links"):
        out = _plain_links(root, page_url)
    whole = root.text() if rule.empty or rule.total else ""
    total = re.search(rule.total, whole) if rule.total else None
    stated = int(total[1].replace(".", "")) if total else None
    if snippets and stated is not None:
        out = out[:stated]
    says_empty = bool(rule.empty and re.search(rule.empty, whole)) or stated == 0 or bool(rule.extra.get("legit_empty") and root.first(rule.card))
    return out, says_empty and not out


def _cards(rule: Rule, root: Node, page_url: str) -> list[dict]:
    out, seen, more = [], set(), rule.extra
    order = {id(n): k for k, n in enumerate(root.walk())} if rule.end else {}
    stop = min((order[id(n)] for n in root.walk() if re.search(rule.end, "".join(c for c in n.children if isinstance(c, str)))), default=None) if rule.end else None
    for own in root.all(rule.card):
        if (stop is not None and order[id(own)] > stop) or ("not_class" in more and more["not_class"] in own.attrs.get("class", "")):
            continue
        if "type" in more and own.attrs.get("data-type") and more["type"] not in own.attrs["data-type"].lower():
            continue
        if more.get("most_children", 99) < sum(isinstance(c, Node) for c in own.children):
            continue
        if more.get("unit"):
            row = _unit(rule, own, page_url)
            if row:
                out.append(row)
            continue
        card = own
        if rule.up:
            around = own.parent.closest(rule.up) if own.parent else None
            if around is None and more.get("need_up"):
                continue
            card = around or own
        if more.get("grow"):
            card = _grown(own, rule)
        link = own if not rule.link else next((a for a in own.all(rule.link) if not rule.href or re.search(rule.href, a.attrs.get(rule.link_attr, ""))), None)
        href = own.attrs.get(more["card_href"], "") if more.get("card_href") else ""
        href = href or (link.attrs.get(rule.link_attr, "") if link else more.get("no_link", ""))
        fits = re.search(rule.href, href) if rule.href else None
        if not href or (rule.href and not fits):
            continue
        identity = (fits[1] or "") if fits and fits.re.groups else ""
        if more.get("slide") and (slide := own.first('[data-testid$="-slide-0"]')) and (m := re.search(r"(\d+)-slide-0$", slide.attrs["data-testid"])):
            identity = m[1]  # the gallery's id outranks the link's
        url = rule.url.format(identity) if identity and rule.url != "{}" else href
        for c in rule.cut:
            url = url.split(c)[0]
        url = urljoin(page_url, url)
        key = identity or url if "no_link" not in more or link else card.text()[:60]
        if key in seen or ("own_not" in more and re.search(more["own_not"], own.text())):
            continue
        text = card.text()
        if ("text" in more and not re.search(more["text"], text)) or (rule.drop and re.search(rule.drop, text)):
            continue
        if "own_attributes" in more:
            _only_own(card, identity, more["own_attributes"])
        where = (card, own, identity, "")
        title = _text(rule.title, *where)[:TITLE_CHARS].strip()
        if (not title and not rule.untitled) or len(title) < more.get("title_least", 0):
            continue
        if more.get("after_title") and title in text:
            rest = Node("div", {}, None)
            rest.children.append(text[text.index(title) + len(title) :])
            where = (rest, own, identity, "")
        seen.add(key)
        row = {"url": url, "title": title, **{f: _number(getattr(rule, f), *where) for f in ("price", "m2", "rooms")}, "location": _text(rule.location, *where)[:TITLE_CHARS]}
        if rule.keep is None or rule.keep(row):
            out.append(row)
    return out


def _grown(own: Node, rule: Rule) -> Node:
    """The largest enclosing element that holds no other identity."""
    card = own
    while card.parent is not None and card.parent.parent is not None and card.parent.tag != "body":
        ids = {m[1] for a in card.parent.all(rule.card) if (m := re.search(rule.href, a.attrs.get("href", "")))}
        if len(ids) > 1:
            break
        card = card.parent
    return card


def _only_own(card: Node, identity: str, pattern: str) -> None:
    """Attribute elements of another card, or of another kind, are ignored."""
    for n in card.all('[data-testid*="_result-card_attribute_"]'):
        if identity not in n.attrs["data-testid"] or not re.search(pattern, n.attrs["data-testid"]):
            n.attrs["data-testid"] = ""


def _unit(rule: Rule, heading: Node, page_url: str) -> dict | None:
    """A flat told by a heading with its house and unit; the fragment is its identity unless it has a document."""
    m = re.search(r"Haus\s+([A-Z])\s*\|\s*WE\s*(\d+)", heading.text())
    if not m:
        return None
    card = heading
    for _ in range(4):
        card = card.parent if card.parent is not None else card
    where = (card, heading, m[2], "")
    text = card.text()
    part = lambda p: (x := re.search(p, text)) and x[1] or "?"
    pdf = card.first('a[href$=".pdf"]')
    title = f"Haus {m[1]} WE {m[2]} — {part(r'(?i)(\d+)\s*Zimmer')} Zi, {part(r'([\d,]+)\s*m²')} m², {part(r'(?i)(DG|EG|\d+\.\s*OG)')}"
    return {"url": urljoin(page_url, pdf.attrs["href"]) if pdf else f"{page_url}#WE{m[2]}", "title": title, "price": None, "m2": _number(rule.m2, *where), "rooms": _number(rule.rooms, *where), "location": _text(rule.location, *where)}


def _plain_links(root: Node, page_url: str) -> list[dict]:
    """Links whose own text shows a price and a size or rooms; the first 200 links of a page without cards."""
    out, seen = [], set()
    for a in root.all("a[href]")[:200]:
        text, href = a.text(), a.attrs["href"]
        if href in seen or not 15 <= len(text) <= 200 or not re.search(r"\d+\s*€", text) or not re.search(r"\d+\s*m²|\d+\s*Zi", text):
            continue
        seen.add(href)
        where = (a, a, "", "")
        out.append({"url": urljoin(page_url, href), "title": text[:TITLE_CHARS], **{f: _number(getattr(GENERAL, f), *where) for f in ("price", "m2", "rooms")}, "location": ""})
    return out


def card_listings(pages: DataFrame, page_id: str, source: str, url: str, html: str, snippets: bool = False) -> DataFrame:
    """``page_id, pos, url, title, price, m2, rooms, location, source`` of all cards of all pages, in each page's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s, u, h in zip(pdf["id"], pdf["source"], pdf["url"], pdf["html"], strict=True):
                rows, _ = extract(h, s, u or "", snippets)
                out += [(i, k, r["url"], r["title"], r["price"], r["m2"], r["rooms"], r["location"], s) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["page_id", "pos", "url", "title", "price", "m2", "rooms", "location", "source"]).astype({"page_id": "int64", "pos": "int32", "price": "float64", "m2": "float64", "rooms": "float64"})

    read = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    numbers = ("price", "m2", "rooms")
    rows = read.mapInPandas(run, "page_id bigint, pos int, url string, title string, price double, m2 double, rooms double, location string, source string")
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers})
