"""Personal data, with deobfuscation that keeps offsets.

Base patterns run over the text as it is. Then transducers rewrite the text, each keeping for every character that it puts
out the source characters it came from: look-alike characters become plain ones and invisible ones go; digits spelled out
in a run become digits; written-out at and dot become @ and a full stop. The same patterns run over the result, and each
find is mapped back through the transducers to the source. A find is added where no base span of its kind overlaps it, or
where it holds those that do and goes on beyond them.

Null and empty texts have no spans. Time is in proportion to the text, but for a sorted look-up of each find among the base
spans. A text that no transducer would change is not rewritten. Repeated rows, empty tables and clashing names are as said
in `spans`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .spans import Cover, Span

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base. An address is looked for from its @ outwards, and a dotted number from the start of its digits,
# as the plain patterns would try every start of a long run of such characters.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Characters that look like an ASCII character.
LOOK_ALIKE = dict(zip("аеорсухіјѕһԁԛԝвмнктАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "aeopcyxijshdqwbmhktABEKMHOPCTXIJSABEZHIKMNOPTYXoavpi", strict=True)) | dict(zip("。．․‧∙·＠﹫‐‑‒–—−﹣⁺﹢", "......@@-------++", strict=True))
# Digits spelled out, in English, German, French and Spanish.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Last parts of a domain that a bare "dot" may stand before.
TOP = "com|org|net|edu|gov|info|biz|io|co|eu|uk|us|ca|au|de|at|ch|fr|be|es|it|nl|pl|mx|ar|br|in|jp|ru"
AT, DOT, PLUS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt", "plus|más|mas"
#: Of the words for at, those that mean nothing else.
PLAIN_AT = "arroba|arobase|klammeraffe|@"

_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?i)(?:\b(?:{PLUS})[ -])?\b(?:{_WORD})\b(?:[ ,.-]{{1,2}}\b(?:{_WORD}|[0-9]+)\b)+")
_RUN_WORD = re.compile(rf"(?i)\b(?:({PLUS})|({_WORD})|([0-9]+))\b|([.])")
_BRACKET_AT = re.compile(rf"(?i)(?<!\s)\s*+(?:[\[({{<]\s*(?:{AT}|@)\s*[\])}}>]|&\#64;|&\#x40;|&commat;)\s*")
_BRACKET_DOT = re.compile(rf"(?i)(?<!\s)\s*+(?:[\[({{<]\s*(?:{DOT}|\.)\s*[\])}}>]|&\#46;|&\#x2e;|&period;)\s*")
_NAME, _DOMAIN_PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# spelled dots on either side of the at; after an at that means nothing else, any last part of letters will do
_BARE = re.compile(rf"(?i)(?<!{_NAME})(?:{_NAME}+ (?:{DOT}) ){{0,4}}{_NAME}+(?:(?: (?:{AT}) |@| @ ){_DOMAIN_PART}+(?:(?: (?:{DOT}) |\.){_DOMAIN_PART}+)*(?: (?:{DOT}) (?:{TOP})\b)| (?:{PLAIN_AT}) {_DOMAIN_PART}+(?:(?: (?:{DOT}) |\.){_DOMAIN_PART}+)*(?: (?:{DOT}) |\.)[A-Za-z]{{2,}}\b)")
# a name of several parts before a bare at, and a domain with its own full stops after it
_NAMED = re.compile(rf"(?i)(?<!{_NAME})[A-Za-z][A-Za-z0-9]*(?:[._+-][A-Za-z0-9]+)+ at {_DOMAIN_PART}+(?:\.{_DOMAIN_PART}+)*\.(?:{TOP})\b")
_AT_DOMAIN = re.compile(rf" at [a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{TOP})\b")
_BARE_AT, _BARE_DOT = re.compile(rf"(?i) (?:{AT}|@) "), re.compile(rf"(?i) (?:{DOT}) ")
_FOREIGN = re.compile("[^\\x00-\\x7e\\xa0-\\xb6\\xb8-\\u024f\\u2018-\\u201f\\u2026\\u20ac]|\\xa0|\\xad")
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*(?:{AT}|{DOT}|@|\.)\s*[\])}}>]|&(?:#64|#x40|commat|#46|#x2e|period);")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, floor := m.end()))
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)
    return out


def detect(text: str) -> list[Span]:
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@lru_cache(4096)
def fold(c: str) -> str:
    """A look-alike's plain character; nothing for an invisible one."""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and len(plain) == 1 else c


class Tape:
    """A rewritten text, and for each of its characters the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def fold(self) -> None:
        made = [(fold(c) if c > "~" else c, a, b) for c, a, b in zip(self.text, self.start, self.end, strict=True)]
        made = [x for x in made if x[0]]
        self.text, self.start, self.end = "".join(x[0] for x in made), [x[1] for x in made], [x[2] for x in made]

    def rewrite(self, pattern: re.Pattern, parts) -> None:
        """Put in the place of each match the characters of parts(match): (characters, from, to), places within the text."""
        text, start, end, at = [], [], [], 0

        def copy(to: int) -> None:
            text.append(self.text[at:to])
            start.extend(self.start[at:to])
            end.extend(self.end[at:to])

        for m in pattern.finditer(self.text):
            copy(m.start())
            for chars, a, b in parts(m):
                text.append(chars)
                start.extend([self.start[a]] * len(chars))
                end.extend([self.end[b - 1]] * len(chars))
            at = m.end()
        copy(len(self.text))
        self.text, self.start, self.end = "".join(text), start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for x in _RUN_WORD.finditer(m.string, *m.span()):
        chars = "+" if x[1] else str(SPELLED[x[2].lower()]) if x[2] else x[3] or x[4]
        out.append((chars, *x.span()) if len(chars) == 1 else (chars[0], x.start(), x.start() + 1))
        out += [(c, x.start() + k, x.start() + k + 1) for k, c in enumerate(chars) if k]
    return out


def _plain(m: re.Match) -> list[tuple[str, int, int]]:
    """An address with its bare at and dots written as characters."""
    # the first at is the address's; a dot may stand on either side of it
    marks = sorted([(x.span(), "@") for x in _BARE_AT.finditer(m.string, *m.span())][:1] + [(x.span(), ".") for x in _BARE_DOT.finditer(m.string, *m.span())])
    out, at = [], m.start()
    for (a, b), c in marks:
        out += [(m.string[k], k, k + 1) for k in range(at, a)] + [(c, a, b)]
        at = b
    return out + [(m.string[k], k, k + 1) for k in range(at, m.end())]


def normalise(text: str) -> Tape | None:
    """The text rewritten by the transducers; None if none of them would change it."""
    low = text.lower()
    foreign, bracketed = not text.isascii() and _FOREIGN.search(text), _BRACKETED.search(text)
    spelled = not SPELLED.keys().isdisjoint(low.replace("-", " ").replace(",", " ").replace(".", " ").split())
    bare = any(f" {x} " in low for x in (*DOT.split("|"), *PLAIN_AT.split("|")))
    named = _AT_DOMAIN.search(low)
    if not (foreign or bracketed or spelled or bare or named):
        return None
    tape = Tape(text)
    if foreign:
        tape.fold()
    if bracketed or foreign:
        tape.rewrite(_BRACKET_AT, lambda m: [("@", *m.span())])
        tape.rewrite(_BRACKET_DOT, lambda m: [(".", *m.span())])
    if bare or foreign:
        tape.rewrite(_BARE, _plain)
    if named or foreign:
        tape.rewrite(_NAMED, _plain)
    if spelled or foreign:
        tape.rewrite(_RUN, _digits)
    return tape if tape.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that the method adds."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, []
    known = {kind: Cover((a, b) for k, a, b in base if k == kind) for kind in KINDS}
    more: list[Span] = []
    for kind, a, b in detect(tape.text):
        s, e = tape.source(a, b)
        if not known[kind].touches(s, e) or not (known[kind].holds(s, e) or known[kind].edges(s, e)):
            more.append((kind, s, e))
    return base, more
