"""Text, address and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title words that identify nothing.
TITLE_STOPWORDS = """
wohnung wohnungen zimmer raum raeume räume haus haushaelfte haushälfte etage geschoss stock lage angebot objekt immobilie wohnen
wohntraum tauschwohnung wohnungstausch tausche tausch swap nachmieter nachvermietung untermiete miete mieten vermietung provisionsfrei
erstbezug neubau schoene schöne schoenes schönes tolle tolles toller grosse große grosses großes grosser großer grosszuegige großzügige
gemuetliche gemütliche moderne modernes moderner attraktive attraktives attraktiver helle helles ruhige ruhiges charmante exklusive
gepflegte renovierte sanierte begehrter begehrte bester beste traumhafte kompakte barrierearme sofort frei neue neues neuer inkl mit ohne
und oder fuer für der die das den dem ein eine einer eines von vom zur zum auf bei aus ist sehr ihre ihr sie wir ganz top
""".split()


def canonical_url(url: Column) -> Column:
    """Without query and fragment; null and empty stay as they are."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def urls_in(text: Column) -> Column:
    """All addresses in a text; blanks, bars and closing brackets end one."""
    return F.regexp_extract_all(text, F.lit("https?://[^\\s|)\\]]+"), F.lit(0))


def tsv_field(text: Column) -> Column:
    """Tabs and line ends as blanks; null as empty."""
    return F.coalesce(F.regexp_replace(text, "[\\t\\r\\n]+", " "), F.lit(""))


def queue_field(text: Column) -> Column:
    """Bars as slashes, blanks squeezed and cut."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "|", "/"), "\\s+", " "))


def squash(text: Column) -> Column:
    """Lower case, letters (with umlauts) and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-zäöüß0-9]+", "")


def title_tokens(title: Column) -> Column:
    """Distinct words of four letters or more that aren't title stop words, in order of appearance."""
    stop = F.array(*map(F.lit, TITLE_STOPWORDS))
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-zäöüß]+")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 4), stop)


def title_key(title: Column) -> Column:
    """Comparable prefix of a title, umlauts spelt out; empty for titles too short or too general to identify anything."""
    low = F.lower(F.coalesce(title, F.lit("")))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    key = F.trim(F.left(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), F.lit(45)))
    return F.when((F.size(title_tokens(title)) >= 2) & (F.length(key) >= 20), key).otherwise("")


def unit_codes(text: Column) -> Column:
    """Distinct codes of flats such as ``H4-00-02``."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![A-Za-z0-9_])[A-Z][0-9]{1,2}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_])"), F.lit(0)))


def sets_conflict(a: Column, b: Column) -> Column:
    """Both known and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def report_path(cell: Column) -> Column:
    """Target of a Markdown link to a ``.md`` file; empty if there is none."""
    return F.regexp_extract(F.coalesce(cell, F.lit("")), "\\(([^)]*\\.md)\\)", 1)


def heading_parts(text: Column) -> Column:
    """Title and place of a report's first line, cut at the last em dash."""
    first = F.trim(F.substring_index(text, "\n", 1))
    heading = F.regexp_extract(first, "(?i)^#\\s*Evaluation:\\s*(.*)\\z", 1)
    title = F.regexp_extract(heading, "^(.+) — ", 1)
    return F.struct(F.when(title != "", F.trim(title)).otherwise(heading).alias("title"), F.regexp_extract(heading, "^.+ — (.*)\\z", 1).alias("place"))


def report_header(text: Column, key: str) -> Column:
    """Value of a ``**Key:** value`` line; empty if there is none."""
    return F.trim(F.regexp_extract(text, f"(?im)^\\*\\*{key}:\\*\\*[ \\t]*(.*)$", 1))


def section(text: Column, name: str) -> Column:
    """Body of the first ``## name...`` section, up to the next ``##`` heading."""
    return F.regexp_replace(F.regexp_extract(text, f"(?im)^##\\s+{name}[^\\n]*\\n((?:(?!##\\s)[^\\n]*\\n?)*)", 1), "^\\s+|\\s+\\z", "")


def strip_markdown(text: Column) -> Column:
    """Links, bold, italics and code marks removed, blanks squeezed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    t = F.regexp_replace(t, "\\*\\*|__|`", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "(^|\\s)\\*([^*]+)\\*", "$1$2"), "\\s+", " "))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def german_integer(x: Column) -> Column:
    """1975 as ``1.975``; empty for null."""
    return F.coalesce(F.translate(F.format_number(F.floor(x + 0.5).cast("bigint"), 0), ",", "."), F.lit(""))


def german_decimal(x: Column) -> Column:
    """77.97 as ``77,97``, 81.0 as ``81``; empty for null."""
    v = (F.floor(x * 100 + 0.5) / 100).cast("decimal(18,2)").cast("string")
    return F.coalesce(F.replace(F.regexp_replace(v, "\\.?0+\\z", ""), F.lit("."), F.lit(",")), F.lit(""))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def slug(text: Column) -> Column:
    """Lower case, umlauts spelt out, other characters as single hyphens."""
    low = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+\\z", "")


def with_page(url: Column, page: Column, name: str = "page") -> Column:
    """The address with its page parameter set, replaced or added."""
    has = url.rlike(f"[?&]{name}=[0-9]+")
    sep = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(has, F.regexp_replace(url, F.lit(f"([?&]{name}=)[0-9]+"), F.concat(F.lit("$1"), page.cast("string")))).otherwise(F.concat(url, sep, F.lit(f"{name}="), page.cast("string")))


def resolve_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value; names without a value stay and are listed in ``unresolved``."""
    url = template
    for name, value in values.items():
        url = F.when(value.isNull(), url).otherwise(F.replace(url, F.lit("{" + name + "}"), value.cast("string")))
    return F.struct(url.alias("url"), F.regexp_extract_all(url, F.lit("\\{(\\w+)\\}"), F.lit(1)).alias("unresolved"))


#: What messages of failed page loads show.
BOT_DEFENSE, TRANSIENT = "403|forbidden|net::ERR|blocked|ERR_HTTP2|access denied", "timeout|timed out|navigation"


def error_class(message: Column) -> Column:
    """First class that a failure message shows, whatever the case; ``error`` for any other, null included."""
    return F.when(message.rlike(f"(?i){BOT_DEFENSE}"), "bot_defense").when(message.rlike(f"(?i){TRANSIENT}"), "transient").otherwise("error")
