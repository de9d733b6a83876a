"""Text garbled by a wrong character encoding: best-first search for the cheapest text reachable.

All encodings concerned leave ASCII alone (those that don't, as UTF-16 and UTF-7, are out), so a garbled passage shows in
its runs of other characters, and each run can be restored by itself. Character references and percent codes of such
characters count as parts of a run. A run is taken with the class of its neighbours; equal runs in equal contexts are one
state. From each state the search goes on by encoding with one character set and decoding with another, or by
unescaping, cheapest state first, with the visited states hashed. A state's cost is the sum of its characters'
implausibility: minus the logarithm of how often the whole corpus has the character between such neighbours, and
surcharges for forms that no writing has. A run is garbled if a state cheaper by a margin is reached, or if it holds a
replacement or control character.

Functions run in Python tasks without this package on their path: they are shipped by value, and whatever is cached is
built inside the task.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmill.runtime import materialize

#: Contexts are sent to the executors whole, 16 bytes each; a corpus with more of them is refused.
MAX_CONTEXTS = 8_000_000
#: Nats by which a state must be cheaper: to convict a document alone, or together with another run of it.
STRONG, WEAK = 3.5, 2.0
#: Nats that a step costs: mending UTF-8, which accidental text rarely allows, and swapping single-byte character sets,
#: which maps any character to some other and is allowed once on a path.
MEND_COST, SWAP_COST = 0.2, 2.0
#: A text costlier than the run by more nats is not followed further.
DETOUR = 4.0
#: An escape where plain text should be, in nats.
ESCAPE_COST = 12.0
#: No writing consists of so many valid UTF-8 sequences in a row, however often the corpus has them: each costs so many
#: nats.
WHOLE_RUN, SEQUENCE_COST = 4, 30.0
#: States expanded per run, and more per character of it; beyond, only ever cheaper texts are followed.
EXPANSIONS, EXPANSIONS_PER_CHAR = 400, 20

#: Character sets that texts are read with by mistake, and those that texts are written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859_2", "iso8859_15", "cp437", "cp850", "mac_roman", "cp1251")
WRITTEN_IN = ("cp1252", "cp1250", "iso8859_2", "cp437", "cp850", "mac_roman")

#: Letters of German, French and Polish.
USUAL = set("äöüÄÖÜßàâæçèéêëîïôùûœÀÂÇÈÉÊËÎÏÔÙÛŒąćęłńóśźżĄĆĘŁŃÓŚŹŻ")

#: A reference to a character beyond ASCII, or a percent code of a byte beyond ASCII; both also escaped repeatedly.
_ESCAPE = re.compile(
    r"&(?:amp;)*(?:(?!(?:amp|lt|gt|quot|apos|nbsp);)[A-Za-z][A-Za-z0-9]{1,30}|#(?:12[89]|1[3-9][0-9]|[2-9][0-9]{2}|[0-9]{4,7})|#[xX](?:[89A-Fa-f][0-9A-Fa-f]|[0-9A-Fa-f]{3,6}));|%(?:25)*[89A-Fa-f][0-9A-Fa-f]"
)
_RUN = re.compile(rf"(?:[^\x00-\x7f]|{_ESCAPE.pattern})+")
_ADDRESS = re.compile(r"(?:://|\bwww\.)\S*\Z", re.I)

#: A valid UTF-8 sequence of several bytes, each byte as the character of that number.
_SEQUENCE = re.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def _near(c: str) -> str:
    """Class of a neighbour: ``0`` for digits, blank for blanks and ends, else itself."""
    return " " if not c or c in " \t\n\x0b\f\r" else "0" if "0" <= c <= "9" else c


def find_runs(text: str) -> Iterator[tuple[re.Match, tuple[str, str, str]]]:
    """The runs of a text with their contexts. Percent codes inside an address are none."""
    if text.isascii() and "&" not in text and "%" not in text:
        return
    for m in _RUN.finditer(text):
        if m[0][0] == "%" and m[0].isascii():
            at = max(text.rfind(c, 0, m.start()) for c in " \t\n<>\"")
            if _ADDRESS.search(text[at + 1 : m.start()]):
                continue
        yield m, (_near(text[m.start() - 1 : m.start()]), m[0], _near(text[m.end() : m.end() + 1]))


def runs(documents: DataFrame) -> DataFrame:
    """``doc_id, l, run, r, n``: each distinct run of a document in its context, and how often it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, counts = [], [], []
            texts = batch.column(1)
            for k, i in enumerate(batch.column(0).to_pylist()):
                for key, n in Counter(key for _, key in find_runs(texts[k].as_py())).items():
                    ids.append(i)
                    found.append(key)
                    counts.append(n)
            columns = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns, pa.array(counts, pa.int64())], ["doc_id", "l", "run", "r", "n"])

    schema = documents.select("doc_id").schema.add("l", "string").add("run", "string").add("r", "string").add("n", "long")
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Codec:
    """Character sets as tables: each character's byte, ASCII included, and back. Bytes that a set leaves undefined are C1
    control characters in the text."""

    def __init__(self) -> None:
        self.byte: dict[str, dict[int, int]] = {}
        for charset in {*READ_AS, *WRITTEN_IN}:
            table = {b: b for b in range(0x80, 0xA0)}
            for b in range(256):
                try:
                    table[ord(bytes([b]).decode(charset))] = b
                except UnicodeDecodeError:
                    pass
            self.byte[charset] = _Table(table)

    def encode(self, text: str, charset: str) -> bytes | None:
        as_bytes = text.translate(self.byte[charset])
        return None if "\uffff" in as_bytes else as_bytes.encode("latin-1")

    def mend(self, text: str, charset: str) -> tuple[str, int, int]:
        """Replace each stretch that, in ``charset``, is a valid multi-byte UTF-8 sequence by its character. Also how many
        there were, and of how many characters. Linear in the text."""
        if len(text) < 2:
            return text, 0, 0
        as_bytes, out, at, count, covered = text.translate(self.byte[charset]), [], 0, 0, 0
        for m in _SEQUENCE.finditer(as_bytes):
            out += (text[at : m.start()], m[0].encode("latin-1").decode())
            at, count, covered = m.end(), count + 1, covered + m.end() - m.start()
        return ("".join(out) + text[at:], count, covered) if count else (text, 0, 0)

    def sequences(self, text: str) -> int:
        """The most UTF-8 sequences that a character set shows in a text."""
        return max(self.mend(text, c)[1] for c in READ_AS)

    def whole(self, text: str) -> int:
        """The number of UTF-8 sequences that a text consists of in some character set; 0 if they are too few."""
        if len(text) < 2 * WHOLE_RUN:
            return 0
        return max((count for _, count, covered in (self.mend(text, c) for c in READ_AS) if count >= WHOLE_RUN and covered == len(text)), default=0)

    def neighbours(self, text: str, swapped: bool) -> Iterator[tuple[str, bool]]:
        """Texts one operation away (encode and decode with another character set, or unescape), and whether
        single-byte sets are swapped by then."""
        for read in READ_AS:
            yield self.mend(text, read)[0], swapped
            raw = None if swapped else self.encode(text, read)
            if raw is not None:
                for written in WRITTEN_IN:
                    if written != read:
                        try:
                            yield raw.decode(written), True
                        except UnicodeDecodeError:
                            pass
        if "&" in text:
            yield html.unescape(text), swapped
        if "%" in text:
            yield unquote(text, errors="surrogateescape").encode("utf-8", "surrogateescape").decode("latin-1") if _broken(text) else unquote(text), swapped


def _broken(text: str) -> bool:
    """Whether the percent codes of a text are no UTF-8; their bytes are then characters by number, for a swap to read."""
    return "\ufffd" in unquote(text) and "\ufffd" not in text and text.isascii()


class _Table(dict):
    """For ``str.translate``: characters that the set hasn't got become U+FFFF."""

    def __missing__(self, key: int) -> int:
        return 0xFFFF


def mend(text: str, charset: str) -> str:
    return Codec().mend(text, charset)[0]


def pack(left: Column, c: Column, right: Column) -> Column:
    """A context as one number: a code point has at most 21 bits."""
    code = lambda x: F.ascii(x).cast("bigint")
    return F.shiftleft(code(left), 42) + F.shiftleft(code(c), 21) + code(right)


class Plausibility:
    """Costs of characters, from the corpus' counts of (left class, character, right class), packed by ``pack`` and sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.single = {chr(c) for c in np.unique(keys >> 21 & 0x1FFFFF).tolist()}
        self.total = int(counts.sum()) + 1
        self.codec, self.known = Codec(), {}

    def count(self, left: str, c: str, right: str) -> int:
        key = ord(left) << 42 | ord(c) << 21 | ord(right)
        at = int(np.searchsorted(self.keys, key))
        return int(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0

    def char(self, left: str, c: str, right: str) -> float:
        key = (left, c, right)
        if (cost := self.known.get(key)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            cost = self.known[key] = self._char(left, c, right)
        return cost

    def _char(self, left: str, c: str, right: str) -> float:
        n = self.count(left, c, right)
        cost = math.log(self.total / (n or 0.3)) + (0 if c in self.single else 4)
        kind = unicodedata.category(c)
        if c == "�" or kind in ("Cc", "Co", "Cn"):
            return cost + 6
        if kind[0] != "L":
            # a sign inside a word, unless the corpus often has it just there (m²a)
            odd = left.isalpha() and right.isalpha() and kind[0] != "M" and n < max(20, self.total * 1e-4)
            return cost + (4 if odd else 0)
        if kind == "Lu" and left.isalpha() and left.islower() and left.isascii() and right.isalpha() and right.islower() and c not in USUAL:
            cost += 1
        latin = unicodedata.name(c, "").startswith("LATIN")
        if not latin and (left.isalpha() and left.isascii() or right.isalpha() and right.isascii()):
            cost += 4
        return cost + (0 if c in USUAL else 2)

    def cost(self, left: str, run: str, right: str) -> float:
        total, before = 0.0, left
        for k, c in enumerate(run):
            after = run[k + 1] if k + 1 < len(run) else right
            if not c.isascii():
                total += self.char(before, c, after)
            elif not (c.isalnum() or c in " .,;:-'\"()/!?"):
                total += 3  # escapes and signs that aren't text
            before = c
        if "&" in run or "%" in run:
            total += ESCAPE_COST * len(_ESCAPE.findall(run))
        return total + SEQUENCE_COST * self.codec.whole(run)

    @staticmethod
    def foreign(text: str) -> bool:
        """Whether the text's letters, two at least, are of one script other than Latin."""
        scripts = [unicodedata.name(c, "").split(" ")[0] for c in text if unicodedata.category(c)[0] == "L"]
        return len(scripts) > 1 and len(set(scripts)) == 1 and scripts[0] != "LATIN"

    def restore(self, left: str, run: str, right: str) -> tuple[str, float, bool]:
        """The cheapest text reachable from a run, by how much it is cheaper, and whether it is in no doubt: it is one
        operation away, or takes no swap of single-byte sets. A word in another script isn't swapped.

        Character references alone are markup, no wrong encoding, so the gain counts from the text they stand for.
        Mending shortens a text and swapping is done once, so paths end by themselves; text garbled n times takes n
        steps. Repeated garbling has very many ways to be mended in part: once the bound on expansions is reached, the
        search only goes on from the best text to cheaper ones, so it never stops short of a text that one step would
        make cheaper."""
        start = run
        while "&" in start and (t := html.unescape(start)) != start:
            start = t
        own = self.cost(left, start, right)
        best, best_cost, sure = start, own, True
        word = not (left.isalpha() or right.isalpha())
        heap, seen, expanded = [(own, 0, start, False)], {(start, False)}, 0
        limit = EXPANSIONS + EXPANSIONS_PER_CHAR * len(run)
        while heap:
            cost, depth, text, swapped = heapq.heappop(heap)
            expanded += 1
            if cost > own + DETOUR or expanded > limit and cost > best_cost:
                continue
            for t, s in self.codec.neighbours(text, swapped or word and self.foreign(text)):
                if t and (t, s) not in seen:
                    seen.add((t, s))
                    c = self.cost(left, t, right) + MEND_COST * (depth + 1) + (SWAP_COST if s else 0)
                    if c < best_cost:
                        best, best_cost, sure = t, c, depth == 0 or not s
                    heapq.heappush(heap, (c, depth + 1, t, s))
        return best, own - best_cost, sure


def judge_runs(distinct_runs: DataFrame, contexts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``l, run, r, restored, strong, doubtful`` of the suspicious ones; ``restored`` is null where no original can be
    reached, ``strong`` tells whether the run alone shows that its document is garbled, ``doubtful`` whether what is left
    in its place may still be garbled."""
    shared = distinct_runs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Plausibility(*shared.value)
        spoilt = re.compile("[\ufffd\x80-\x9f]")
        for pdf in batches:
            out = []
            for a, text, b in zip(pdf["l"], pdf["run"], pdf["r"], strict=True):
                fixed, gain, sure = model.restore(a, text, b)
                fixed = fixed if gain >= WEAK else None
                lost = bool(spoilt.search(text))
                left = text if fixed is None else fixed
                doubtful = fixed is not None and not sure or bool(spoilt.search(left)) or model.codec.sequences(left) > 1
                if fixed is not None or lost or doubtful:
                    out.append((a, text, b, fixed, lost or gain >= STRONG, doubtful))
            yield pd.DataFrame(out, columns=["l", "run", "r", "restored", "strong", "doubtful"])

    return distinct_runs.select("l", "run", "r").mapInPandas(run, "l string, run string, r string, restored string, strong boolean, doubtful boolean")


def garbled(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of all documents, and the verdicts of ``judge_runs`` on the distinct ones. Both are written, while the
    plan is built."""
    picked = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    found = materialize(runs(picked), "garble-found")
    distinct_runs = materialize(found.groupBy("l", "run", "r").agg(F.sum("n").alias("n")), "garble-runs")
    chars = F.transform(F.sequence(F.lit(1), F.length("run")), lambda k: F.struct(F.when(k == 1, F.col("l")).otherwise(F.substring("run", k - 1, F.lit(1))).alias("l"), F.substring("run", k, F.lit(1)).alias("c"), F.when(k == F.length("run"), F.col("r")).otherwise(F.substring("run", k + 1, F.lit(1))).alias("r")))
    counts = materialize(distinct_runs.select(F.explode(chars).alias("z"), "n").where(F.ascii("z.c") > 127).groupBy(pack(F.col("z.l"), F.col("z.c"), F.col("z.r")).alias("key")).agg(F.sum("n").alias("n")), "garble-contexts")
    if (n := counts.count()) > MAX_CONTEXTS:
        raise ValueError(f"{n} contexts of characters, more than {MAX_CONTEXTS}")
    table = counts.toArrow()
    keys, n_each = (table.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return found, materialize(judge_runs(distinct_runs, (keys[order], n_each[order])), "garble-verdicts")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents any part of whose text was decoded wrongly, restorable or not.

    Null and empty texts are never garbled. Equal texts are each reported. Letters of other languages, signs and drawing
    characters in contexts where the corpus has them are no case.
    """
    return _convicted(*garbled(documents)).select("doc_id")


def _convicted(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents with one strong run or two different weak ones, what to replace in them, and whether any of their runs
    is in doubt."""
    fix = F.struct("l", "run", "r", "restored")
    return (
        found.join(verdicts, ["l", "run", "r"])
        .groupBy("doc_id")
        .agg(F.collect_set(F.when(F.col("restored").isNotNull(), fix)).alias("fixes"), F.bool_or("strong").alias("strong"), F.bool_or("doubtful").alias("doubtful"))
        .where(F.col("strong") | (F.size("fixes") > 1))
    )


def restored_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, restored, complete`` of the garbled documents: the text with each garbled run replaced by the cheapest
    text reachable; ``complete`` is false if any run of the text, replaced or not, may still be garbled: it has lost
    characters, what stands in its place still reads as UTF-8 in some character set, or it took a swap among other steps."""
    both = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(_convicted(*garbled(documents)), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, fixes in zip(pdf["text"], pdf["fixes"], strict=True):
                table = {(f["l"], f["run"], f["r"]): f["restored"] for f in fixes}
                out, at = [], 0
                for m, key in find_runs(text):
                    if key in table:
                        out += (text[at : m.start()], table[key])
                        at = m.end()
                texts.append("".join(out) + text[at:])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "restored": texts, "complete": ~pdf["doubtful"]})

    return both.mapInPandas(run, both.select("doc_id").schema.add("restored", "string").add("complete", "boolean"))
