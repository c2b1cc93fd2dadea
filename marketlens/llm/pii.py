"""Personal data in texts, by expansion of anchors: one Aho-Corasick pass finds signs, parsers at those places find the spans.

The automaton finds at-signs (written out, too), schemes, plus signs before digits, digits that go on, dots between digits, pairs
of colons and words that announce a number. At each a parser reads as far to both sides as its kind allows and validates
what it has; it looks at its surroundings alone, so the same surroundings always give the same span.

Base spans are those of four plain patterns, by kind leftmost and without overlap, those that fail a test being dropped:
email (local part, at-sign, two labels or more), ip (four numbers up to 255), card (13 to 19 digits, single spaces or hyphens
between them, Luhn), phone (a plus sign, 9 to 15 digits). Beyond them are found (each disjoint from the base spans of its kind):

* email: at-sign or dots written out ("ann (at) example (dot) org", "ann at example dot org" with a known ending), percent-coded
  after mailto:, full-width signs, letters of any script in either part
  (where a base span has taken the rest, what it left is a span beside it);
* ip: the good four numbers of a dotted run whose other numbers exceed 255; addresses of version 6;
* card: numbers in a run of digits that is too long or fails as a whole, cut where its groups are; groups parted by dots or other
  spaces and hyphens; full-width digits no, as no reader of card numbers takes them;
* phone: a number whose pattern ran into a following one, cut before it or at its country's length; numbers without a plus sign
  after tel:, a word for telephone, or as a North American number with its area code in brackets;
* iban: country, check digits and account, modulo 97, in one piece or groups of four.

Spans are in code points, the end exclusive. A null or empty text has none; very long texts are read whole, in time
linear in their length. A null id is kept, rows that repeat an id or text each have their row. Of an empty table come
no rows. Further columns are ignored by spans(), kept by redact().
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import pieces

KINDS = ["email", "ip", "card", "phone", "iban"]
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"

# Characters of the four plain patterns, words and endings that announce or close what is sought, lengths of
# numbers by country code, IBAN lengths by country.
LOCAL = "A-Za-z0-9._%+-"
PHONE_WORDS = ["phone", "telephone", "mobile", "cell", "call", "fax", "whatsapp", "tel", "telefon", "handy", "mobil", "rufnummer", "teléfono", "telefono", "móvil", "movil", "celular", "téléphone", "portable"]
AT_WORDS = ["(at)", "[at]", "{at}", "<at>", " at ", "＠", "(arroba)", "[arroba]"]
OTHER_MARKS = "_/\u00a0\u2009\u202f\u2010\u2011\u2012\u2013\u2014"
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|eu|uk|ar|mx|ch|at"
PHONE_LENGTHS = {"1": (11, 11), "33": (11, 11), "34": (11, 11), "44": (11, 12), "49": (9, 14), "54": (11, 13)}
IBAN_LENGTHS = {"AD": 24, "AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"\w(?:[\w-]*\w)?(?:[.．]\w(?:[\w-]*\w)?)+")
_REST = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_SPELT_DOMAIN = re.compile(rf"\s?([A-Za-z0-9-]+)((?:\s?(?:\(dot\)|\[dot\]|\{{dot\}}|<dot>|\(punto\)|\[punto\]| dot |\.)\s?[A-Za-z0-9-]+)+)", re.IGNORECASE)
_BARE_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot (?:{ENDINGS})(?![A-Za-z0-9-])", re.IGNORECASE)
_SPELT_LOCAL = re.compile(rf"[{LOCAL}]+(?:\s?(?:\(dot\)|\[dot\]| dot )\s?[{LOCAL}]+)*\s?\Z", re.IGNORECASE)
_MAILTO = re.compile(rf"[{LOCAL}]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}")
_SIX = re.compile(r"[0-9A-Fa-f:]*(?:(?<=:)[0-9]+(?:\.[0-9]+){3})?")
_NUMBER = re.compile(r"[ .:#]{0,3}(\(?[0-9][0-9 ().\-/]{5,}[0-9])")
_BRACKETS = re.compile(r"\([2-9][0-9]{2}\)[ -]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_GROUPS = re.compile(rf"[0-9]+(?:[ .\-{OTHER_MARKS}]{{1,2}}[0-9]+)+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _cased(words: list[str]) -> set[str]:
    return {v for w in words for v in (w, w.capitalize(), w.upper())}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Anchors and which parser each calls."""
    found, digits = {}, "0123456789"
    found |= {f"{a}{gap}{b}": "run" for a in digits for b in digits for gap in ("", " ", "-")}
    found |= {f"{a}{gap}{b}": "groups" for a in digits for b in digits for gap in OTHER_MARKS}
    found |= {f"{a}.{b}": "dotted" for a in digits for b in digits}
    found |= {f"+{d}": "plus" for d in digits} | {f"({d}": "brackets" for d in digits}
    found |= {"@": "at", "::": "colons"} | {f"{a}:{b}": "colons" for a in "0123456789abcdefABCDEF" for b in "0123456789abcdefABCDEF"}
    found |= dict.fromkeys(_cased(AT_WORDS), "spelt") | dict.fromkeys(_cased(["mailto:"]), "mailto") | dict.fromkeys(_cased(["tel:", *PHONE_WORDS]), "number")
    found |= {f"{country}{a}{b}": "iban" for country in IBAN_LENGTHS for a in digits for b in digits}
    out = ahocorasick.Automaton()
    for word, parser in found.items():
        out.add_word(word, (parser, len(word)))
    out.make_automaton()
    return out


class _Kept:
    """Spans of a kind, found in any order; one that overlaps a kept one is refused."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (start, end))
        if k and self.spans[k - 1][1] > start or k < len(self.spans) and self.spans[k][0] < end:
            return False
        self.spans.insert(k, (start, end))
        return True

    def within(self, start: int, end: int) -> list[tuple[int, int]]:
        k = max(0, bisect_left(self.spans, (start, start)) - 1)
        out = []
        while k < len(self.spans) and self.spans[k][0] < end:
            out += [self.spans[k]] * (self.spans[k][1] > start)
            k += 1
        return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _back(text: str, at: int, least: int, good) -> int:
    """The start of the characters before `at` that are good, not before least."""
    while at > least and good(text[at - 1]):
        at -= 1
    return at


def _digits_in(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class _Text:
    """What one text's anchors lead to."""

    def __init__(self, text: str):
        self.text, self.base = text, {k: [] for k in KINDS}
        self.later: list[tuple[str, int]] = []
        self.runs, self.dotted, self.plus = [], [], []  # whole stretches that a pattern took, in order
        self.read = dict.fromkeys(("at", "run", "dotted", "plus"), 0)  # up to where each pattern has read
        for end, (parser, size) in _automaton().iter(text):
            start = end - size + 1
            if parser in self.read:
                getattr(self, "_" + parser)(start)
            else:
                self.later.append((parser, start))

    # the four patterns

    def _at(self, at: int) -> None:
        start, domain = _back(self.text, at, self.read["at"], _LOCAL_CHARS.__contains__), _DOMAIN.match(self.text, at + 1)
        if start < at and domain:
            self.base["email"].append((start, domain.end()))
            self.read["at"] = domain.end()
            if start and self.text[start - 1].isalpha():
                self.later.append(("before", start))
            if self.text[domain.end() : domain.end() + 1].isalpha():
                self.later.append(("behind", domain.end()))
        else:
            self.later.append(("wide", at))

    def _run(self, at: int) -> None:
        if at < self.read["run"]:
            return
        end = self.read["run"] = _RUN.match(self.text, at).end()
        digits = _digits_in(self.text[at:end]) if end - at <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            self.base["card"].append((at, end))
        elif end - at >= 13:
            self.runs.append((at, end))

    def _dotted(self, at: int) -> None:
        if at < self.read["dotted"]:
            return
        start = _back(self.text, at, self.read["dotted"], lambda c: "0" <= c <= "9")
        end = self.read["dotted"] = _DOTTED.match(self.text, start).end()
        numbers, place, bad = self.text[start:end].split("."), start, False
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                self.base["ip"].append((place, place + size))
            else:
                bad = True
            place += size + 1
        if bad:
            self.dotted.append((start, end))

    def _plus(self, at: int) -> None:
        if at < self.read["plus"] or not (found := _PHONE.match(self.text, at)):
            return
        self.read["plus"] = found.end()
        if 9 <= len(_digits_in(found.group())) <= 15:
            self.base["phone"].append(found.span())
        else:
            self.plus.append(found.span())

    # what lies beyond them

    def spans(self) -> list[tuple[str, int, int, bool]]:
        own = {k: set(v) for k, v in self.base.items()}
        self.kept = {k: _Kept(v) for k, v in self.base.items()}
        for start, end in self.dotted:
            self._good_four(start, end)
            self._groups(start)
        for start, end in self.runs:
            self._cut(start, end)
        for start, end in self.plus:
            self._shorter(start, end)
        for parser, start in self.later:
            getattr(self, "_" + parser)(start)
        return [(k, s, e, (s, e) in own[k]) for k in KINDS for s, e in self.kept[k].spans]

    def _good_four(self, start: int, end: int) -> None:
        """Stretches of exactly four numbers up to 255 between numbers beyond that."""
        stretch, place = [], start
        for n in [*self.text[start:end].split("."), "999"]:
            if len(n) <= 3 and int(n) <= 255:
                stretch.append((place, place + len(n)))
            else:
                if len(stretch) == 4:
                    self.kept["ip"].add(stretch[0][0], stretch[-1][1])
                stretch = []
            place += len(n) + 1

    def _cut(self, start: int, end: int) -> None:
        """Cards in a run of digit groups, from left to right, shortest first: a whole group, or groups of four (4-6-5 and 4-4-4-4-3 too)."""
        groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", self.text[start:end])]
        k = 0
        while k < len(groups):
            taken = 1
            for n in range(1, 6):
                sizes = tuple(e - s for s, e in groups[k : k + n])
                if len(sizes) == n and (n == 1 and 13 <= sizes[0] <= 19 or sizes in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))):
                    s, e = groups[k][0], groups[k + n - 1][1]
                    if luhn(_digits_in(self.text[s:e])) and self.kept["card"].add(s, e):
                        taken = n
                        break
            k += taken

    def _shorter(self, start: int, end: int) -> None:
        """A phone number in a stretch that goes on too far: up to a number of another kind, and as long as its country's are."""
        others = [s for k in ("ip", "card") for s, _ in self.kept[k].within(start + 1, end)]
        stops = [start + m.end() for m in re.finditer("[0-9](?![0-9])", self.text[start : min([end, *others])])]
        counted = [(len(_digits_in(self.text[start:e])), e) for e in stops[:16]]
        code = next((c for c in PHONE_LENGTHS if self.text.startswith(c, start + 1)), None)
        least, most = PHONE_LENGTHS.get(code, (9, 15))
        good = [e for n, e in counted if least <= n <= most]
        if good:
            self.kept["phone"].add(start, good[-1])

    def _wide(self, at: int) -> None:
        """Letters of any script on either side of an at-sign."""
        text = self.text
        start, domain = _back(text, at, max(0, at - 64), lambda c: c in _LOCAL_CHARS or c.isalpha()), _WIDE_DOMAIN.match(text, at + 1)
        if start < at and domain and any(c.isalpha() for c in text[start:at]) and domain.group()[-1].isalpha():
            self.kept["email"].add(start, domain.end())

    def _before(self, at: int) -> None:
        """What a base span leaves of a local part with letters that its pattern doesn't know."""
        self.kept["email"].add(_back(self.text, at, max(0, at - 64), lambda c: c in _LOCAL_CHARS or c.isalpha()), at)

    def _behind(self, at: int) -> None:
        """The same of a domain."""
        self.kept["email"].add(at, _REST.match(self.text, at).end())

    def _spelt(self, at: int) -> None:
        text = self.text
        word = next(w for w in AT_WORDS if text[at : at + len(w)].lower() == w)
        after, start = at + len(word), max(0, at - 96)
        if word == " at ":
            domain, start = _BARE_DOMAIN.match(text, after), _back(text, at, start, _LOCAL_CHARS.__contains__)
            if domain and start < at:
                self.kept["email"].add(start, domain.end())
            return
        domain = _SPELT_DOMAIN.match(text, after) or _WIDE_DOMAIN.match(text, after)
        local = _SPELT_LOCAL.search(text[start:at])
        if domain and domain.group()[-1].isalpha() and local and local.group().strip():
            self.kept["email"].add(start + local.start(), domain.end())

    def _mailto(self, at: int) -> None:
        end = start = at + len("mailto:")
        while end < len(self.text) and end - start < 320 and (self.text[end] in _LOCAL_CHARS or self.text[end] == "@"):
            end += 1
        coded = self.text[start:end]
        if "@" not in coded and _MAILTO.fullmatch(unquote(coded)):
            self.kept["email"].add(start, end)

    def _colons(self, at: int) -> None:
        """An address of version 6: eight groups, or fewer and one gap; with a digit, and two groups."""
        text, good = self.text, frozenset("0123456789abcdefABCDEF:").__contains__
        start = _back(text, at, max(0, at - 45), good)
        end = _SIX.match(text, start).end()
        end -= text[end - 1] == ":" and text[end - 2] != ":"
        value = text[start:end]
        if not 6 <= len(value) <= 45 or value.count(":") < 7 and "::" not in value:
            return
        if start and (text[start - 1].isalnum() or text[start - 1] in "._") or end < len(text) and text[end].isalnum():
            return
        if sum(map(bool, value.split(":"))) < 2 or not any("0" <= c <= "9" for c in value):
            return
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return
        self.kept["ip"].add(start, end)

    def _number(self, at: int) -> None:
        """A telephone number after a word that announces it; the word stands alone."""
        text = self.text
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        word = text[at:end].lower()
        if word not in PHONE_WORDS or at and text[at - 1].isalnum():
            return
        found = _NUMBER.match(text, end)
        if not found:
            return
        start, stop = found.span(1)
        digits = len(_digits_in(found.group(1)))
        if 7 <= digits <= 15 and not (stop < len(text) and text[stop].isalnum()) and not any(self.kept[k].within(start, stop) for k in ("card", "ip")):
            self.kept["phone"].add(start, stop)

    def _brackets(self, at: int) -> None:
        found = _BRACKETS.match(self.text, at)
        if found and not (at and (self.text[at - 1].isalnum() or self.text[at - 1] == "+")):
            self.kept["phone"].add(*found.span())

    def _groups(self, at: int) -> None:
        """A card in groups of four (or 4-6-5) with the same mark between them, of those that the plain pattern doesn't know."""
        text = self.text
        start = _back(text, at + 1, max(0, at - 19), lambda c: "0" <= c <= "9")
        found = _GROUPS.match(text, start)
        if not found or start and text[start - 1].isalnum():
            return
        parts = re.split("([0-9]+)", found.group())
        sizes, marks = tuple(map(len, parts[1::2])), set(parts[2:-1:2])
        if sizes in ((4, 4, 4, 4), (4, 6, 5)) and len(marks) == 1 and luhn(_digits_in(found.group())):
            self.kept["card"].add(*found.span())

    def _iban(self, at: int) -> None:
        text = self.text
        found = _IBAN.match(text, at)
        if not found or at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            return
        size, end, seen = IBAN_LENGTHS[text[at : at + 2]], at, 0
        while end < found.end() and seen < size:
            seen += text[end] != " "
            end += 1
        value = text[at:end].replace(" ", "")
        if seen == size and not (end < len(text) and text[end].isalnum()) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            self.kept["iban"].add(at, end)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """kind, start, end and whether it is a base span, by kind and start."""
    return _Text(text).spans() if text else []


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and spans, an array of kind, start, end, base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in pieces(batches):
            found = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with each span's characters replaced by its kind in square brackets; spans that overlap are one."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e, _ in find(text)):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return text and "".join(out) + text[at:]

    names = docs.columns
    k = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.set_column(k, names[k], pa.array([clean(t.as_py()) for t in b.column(k)], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
