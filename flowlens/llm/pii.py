"""Personal data by offset-preserving deobfuscation.

Base spans are the patterns of the four kinds on the text as it is.  Further spans come from
a chain of transducers.  Each rewrites stretches of its input and carries, for every character
it writes, where in the source that character came from:

1. characters: invisible ones go; wide, styled and foreign digits, letters that look like Latin
   ones, and variants of dot, dash, blank and @ become ASCII;
2. marks: written-out ``(at)``, ``[dot]``, ``&#64;`` and the like become @ and ., with the blanks around;
3. words: spelled digits (four languages) become digits where at least ``LEAST_SPELLED`` digits stand in a
   row, with ``dot``, ``dash`` and ``plus`` among them; ``dot`` between digits becomes a dot;
4. addresses: ``name at host dot tld`` becomes an address, if its dots are written out or its name is not a
   plain word, and its last label is a known one, so that "at" in prose stays.

The base patterns then run on the result; a match's ends map back to the source.  A match counts if
something was rewritten inside it and the base has no such span.

Every pattern takes time linear in the text: stretches are entered at their beginning only,
quantifiers are possessive or bounded.

Defined cases: a null text is empty; its row has no spans.  Offsets are code points, ends exclusive.  Each row
is handled by itself, so repeated rows, a null doc_id and other columns change nothing.  An
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textbatch import lists, slices

KINDS = ("email", "ip", "card", "phone")
LEAST_SPELLED = 4
BLANKS = r"[ \t ]{0,2}"

# Cyrillic, Greek and other letters that look like Latin ones, beside those that Unicode's compatibility forms name.
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁԛԝһӏ"
    "АВЕКМНОРСТУХІЈЅԌ"
    "αοιυνρκϲϳ"
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧı",
    "aeopcyxijsdqwhl" "ABEKMHOPCTYXIJSG" "aoiuvpkcj" "ABEZHIKMNOPTYXi", strict=True))
# Marks that stand for ASCII ones.
MARKS = dict(zip("\u2024\u3002\uff61\u00b7\u2219\u2022" "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2043", "......" "--------", strict=True))
#: Characters without a width of their own.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
#: Characters that a transducer may rewrite; accented Latin letters are not among them.
FOREIGN = re.compile(
    "[\u00a0\u00ad\u00b2\u00b3\u00b7\u00b9\u0131\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u180e\u2000-\u200f\u2010-\u2015"
    "\u2022\u2024\u202f\u2043\u205f-\u2064\u2070-\u209c\u2100-\u214f\u2212\u2219\u2460-\u24ff\u2776-\u2793\u3000\u3002"
    "\ufe50-\ufe6b\ufeff\uff01-\uff5e\uff61\U0001d400-\U0001d7ff\U0001f100-\U0001f10a]")

# The digits' names, from zero, in English, German, French and Spanish.
NAMES = (("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
         ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
         ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
         ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"))
DIGIT_OF = {name: str(i) for names in NAMES for i, name in enumerate(names)} | {"oh": "0", "zwo": "2"}
# Words for the marks.
DOT_WORDS = ("dot", "point", "punkt", "punto")
DASH_WORDS = ("dash", "hyphen", "minus")
AT_WORDS = ("at", "arroba", "arobase", "ät")
# Last labels that an address written with words may have.
LABELS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "dev", "app", "uk", "de", "fr", "eu", "nl", "ch", "ca",
          "au", "jp", "cn", "ru", "br", "pl", "se", "dk", "fi", "pt", "mx", "test", "example", "invalid", "local", "localhost")


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


AT = rf"\[{BLANKS}(?:{_any(AT_WORDS)}|@){BLANKS}\]|\({BLANKS}(?:{_any(AT_WORDS)}|@){BLANKS}\)|" \
     rf"\{{{BLANKS}(?:{_any(AT_WORDS)}|@){BLANKS}\}}|<{BLANKS}(?:{_any(AT_WORDS)}|@){BLANKS}>|&#0{{0,4}}64;|&#x40;|&commat;"
DOT = rf"\[{BLANKS}(?:{_any(DOT_WORDS)}|\.){BLANKS}\]|\({BLANKS}(?:{_any(DOT_WORDS)}|\.){BLANKS}\)|" \
      rf"\{{{BLANKS}(?:{_any(DOT_WORDS)}|\.){BLANKS}\}}|<{BLANKS}(?:{_any(DOT_WORDS)}|\.){BLANKS}>|&#0{{0,4}}46;|&#x2e;|&period;"
MARKED = re.compile(rf"{BLANKS}(?:(?P<at>{AT})|(?P<dot>{DOT})){BLANKS}", re.IGNORECASE)
SPELLED = re.compile(rf"(?<![^\W_])(?:{_any(DIGIT_OF)})(?![^\W_])", re.IGNORECASE)
#: What may stand between two digits of a spelled number.
BETWEEN = re.compile(rf"(?:[ \t,;:/().-]|[0-9]|(?<![^\W_])(?:{_any(DOT_WORDS + DASH_WORDS)})(?![^\W_])){{1,24}}+", re.IGNORECASE)
INNER = re.compile(rf"(?P<dot>[ \t]*+(?:{_any(DOT_WORDS)})[ \t]*+)|(?P<dash>[ \t]*+(?:{_any(DASH_WORDS)})[ \t]*+)|(?P<gap>[ \t,;:/]++)",
                   re.IGNORECASE)
PLUS = re.compile(r"(?<![^\W_])plus[ \t]{1,2}\Z", re.IGNORECASE)
DIGIT_DOT = re.compile(rf"(?<=[0-9])[ \t]{{1,2}}(?:{_any(DOT_WORDS)})[ \t]{{1,2}}(?=[0-9])", re.IGNORECASE)
NAME, LABEL = r"[A-Za-z0-9_%+-]", r"[A-Za-z0-9-]{1,63}+"
DOT_WORD = rf"[ \t]{{1,2}}(?:{_any(DOT_WORDS)})[ \t]{{1,2}}"
WORDED = re.compile(rf"(?<={NAME})(?P<at>[ \t]{{1,2}}(?:{_any(AT_WORDS)}|@)[ \t]{{1,2}}|@[ \t]{{1,2}}|[ \t]{{1,2}}@|@)"
                    rf"(?P<host>{LABEL}(?:(?:\.|{DOT_WORD}){LABEL})+)", re.IGNORECASE)
DOT_WORDS_RE, SEPARATOR = re.compile(DOT_WORD, re.IGNORECASE), re.compile(rf"\.|{DOT_WORD}", re.IGNORECASE)
#: A piece of a name before "at": characters of names, or written-out dots between them.
NAME_END = re.compile(rf"(?:{NAME}|\.|{DOT_WORD}(?={NAME})){{1,128}}\Z", re.IGNORECASE)
#: Texts without any of these have no disguise.
HINTS = re.compile(rf"{FOREIGN.pattern}|[\[({{<]{BLANKS}(?:{_any(AT_WORDS + DOT_WORDS)}|@|\.){BLANKS}[\])}}>]|&(?:#|commat|period)"
                   rf"|{DOT_WORD}|[ \t]@|@[ \t]|[ \t](?:{_any(AT_WORDS)})[ \t]{{1,2}}{LABEL}\.[A-Za-z0-9]"
                   rf"|(?<![^\W_])(?:{_any(DIGIT_OF)})[ \t,;:/().-]{{1,4}}(?:{_any(DIGIT_OF)}|[0-9])", re.IGNORECASE)

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def identifiers(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS, leftmost and non-overlapping."""
    ips = [m.span() for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    cards, phones = [], []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            cards.append(m.span())
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            phones.append(m.span())
    return [list(emails(text)), ips, cards, phones]


class Mapped:
    """A text and, of each of its characters, the stretch of the source that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1
        #: Whether a character was written, and whether something before it was dropped.
        self.written, self.joined = np.zeros((2, len(text)), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the stretches (start, end, new), in order and apart."""
        if not edits:
            return
        text, starts, ends, written, joined, at = [], [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            written += [self.written[at:a], np.ones(len(new), bool)]
            if not new and b < len(self.text):
                self.joined[b] = True
            joined += [self.joined[at:a].copy(), np.zeros(len(new), bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.written, self.joined = (np.concatenate([*part, rest[at:]]) for part, rest in (
            (starts, self.starts), (ends, self.ends), (written, self.written), (joined, self.joined)))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a]), int(self.ends[b - 1])

    def changed(self, a: int, b: int) -> bool:
        """Whether something was rewritten or dropped inside a stretch."""
        return bool(self.written[a:b].any() or self.joined[a + 1:b].any())


def plain(c: str) -> str:
    """What a character of FOREIGN stands for."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES or c in MARKS:
        return LOOKALIKES.get(c) or MARKS[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if c.isspace():
        return " "
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() else c


def _characters(text: str) -> list[tuple[int, int, str]]:
    found = ((m.start(), m.end(), plain(m[0])) for m in FOREIGN.finditer(text))
    return [e for e in found if e[2] != text[e[0]]]


def _marks(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in MARKED.finditer(text)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    found = [m for m in SPELLED.finditer(text) if m[0].lower() in DIGIT_OF]
    edits, i = [], 0
    while i < len(found):
        j = i + 1
        while j < len(found) and BETWEEN.fullmatch(text, found[j - 1].end(), found[j].start()):
            j += 1
        # Digits next to the spelled ones are of the same number.
        digits = j - i + sum(c.isdigit() for c in text[max(0, found[i].start() - 24):found[j - 1].end() + 24])
        if digits >= LEAST_SPELLED:
            plus = PLUS.search(text, max(0, found[i].start() - 7), found[i].start())
            if plus:
                edits.append((plus.start(), plus.end(), "+"))
            for k in range(i, j):
                edits.append((found[k].start(), found[k].end(), DIGIT_OF[found[k][0].lower()]))
                if k + 1 < j:
                    edits += _gap(text, found[k].end(), found[k + 1].start())
        i = j
    return edits


def _gap(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """Rewrites between two spelled digits; blanks go only where they stand between digits alone."""
    out = []
    for m in INNER.finditer(text, a, b):
        if m["dot"] or m["dash"]:
            out.append((m.start(), m.end(), "." if m["dot"] else "-"))
        elif m.start() == a and m.end() == b:
            out.append((a, b, ""))
    return out


def _digit_dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in DIGIT_DOT.finditer(text)]


def _host(host: str) -> tuple[int, list[re.Match]]:
    """Where the host ends, at its last label that is a known one, and its written-out dots; 0 if there is none."""
    cuts = list(SEPARATOR.finditer(host))
    for i in range(len(cuts) - 1, -1, -1):
        end = cuts[i + 1].start() if i + 1 < len(cuts) else len(host)
        if host[cuts[i].end():end].lower() in LABELS:
            return end, [c for c in cuts[:i + 1] if c[0] != "."]
    return 0, []


def _addresses(text: str) -> list[tuple[int, int, str]]:
    edits, done = [], 0
    for m in WORDED.finditer(text):
        name = NAME_END.search(text, max(done, m.start() - 128), m.start())
        length, dots = _host(m["host"])
        if not name or not length:
            continue
        name_dots = list(DOT_WORDS_RE.finditer(name[0]))
        # "at" in prose: a plain word before it and a plain host behind.
        if not (dots or name_dots or "@" in m["at"] or m["at"].strip().isupper() or not name[0].split()[-1].isalpha()):
            continue
        edits += [(name.start() + d.start(), name.start() + d.end(), ".") for d in name_dots]
        if m["at"] != "@":
            edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in dots]
        done = m.start("host") + length
    return edits


TRANSDUCERS = (_characters, _marks, _spelled, _digit_dots, _addresses)


def disguised(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS that only the rewritten text shows, in the source's offsets."""
    if not HINTS.search(text):
        return [[] for _ in KINDS]
    mapped = Mapped(text)
    for transducer in TRANSDUCERS:
        mapped.rewrite(transducer(mapped.text))
    if not (mapped.written.any() or mapped.joined.any()):
        return [[] for _ in KINDS]
    return [[mapped.source(a, b) for a, b in spans if mapped.changed(a, b)] for spans in identifiers(mapped.text)]


def find(text: str | None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans and added spans of each of KINDS."""
    base = identifiers(text or "")
    added = []
    for known, more in zip(base, disguised(text or ""), strict=True):
        firsts = [a for a, _ in known]
        # A span that lies inside a base one, or is one, adds nothing.
        added.append([s for s in more if not ((i := bisect_right(firsts, s[0])) and known[i - 1][1] >= s[1])])
    return base, added


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            kinds, starts, ends, is_base, sizes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                base, added = find(text)
                rows = sorted((k, a, b, known) for known, found in ((True, base), (False, added))
                              for k, spans in enumerate(found) for a, b in spans)
                sizes.append(len(rows))
                for k, a, b, known in rows:
                    kinds.append(KINDS[k])
                    starts.append(a)
                    ends.append(b)
                    is_base.append(known)
            sizes = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), lists(kinds, sizes, pa.string()), lists(starts, sizes, pa.int64()),
                lists(ends, sizes, pa.int64()), lists(is_base, sizes, pa.bool_())],
                ["doc_id", "kinds", "starts", "ends", "base"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row of docs (doc_id, text), by kind as listed, start and end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        _find, f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>, base array<boolean>")
    return found.select("doc_id", F.arrays_zip(
        F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("base")).alias("spans"))


def mask(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The rows of docs with every span of their texts replaced by its kind; overlapping spans are one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), []
            for text in batch.column(at).to_pylist():
                spans = sorted((a, b, k) for found in find(text) for k, group in enumerate(found) for a, b in group)
                parts, done = [], 0
                for a, b, k in spans:
                    if a >= done:
                        parts += [text[done:a], mark.format(KINDS[k])]
                    done = max(done, b)
                texts.append(None if text is None else "".join([*parts, text[done:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)


def op13_deobfuscation(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    found = personal_data(docs)
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
