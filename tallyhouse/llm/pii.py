"""Personal data: offset-preserving deobfuscation.

Plain identifiers are found in the text itself. Disguised ones are found in a
normalised copy made by a chain of transducers; each of them rewrites some
places and carries, for every character it puts out, where that character
begins and ends in the source. A span found in the copy is so mapped back to
source characters. It is added if a rewritten place lies in it and it is no part of a
plain span of the same kind: ``jane@mail.acme dot com`` has the plain span up to
``acme`` and an added one that ends with ``com``. Plain spans always stay.

Every search starts once per run of characters, so that very long texts stay
linear. A null text is an empty one and has no spans; an empty table gives no
rows, repeated rows each have their own. Two finds at one place are kept in order
of their beginnings: plain ones do not overlap each other, nor do added ones.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyhouse.llm.common import id_type, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried from its beginning only: later starts end alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each @: the run of local characters before it, a domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > end and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                yield start, found.end()
                end = found.end()
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.group().split(".")):
            yield found.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() <= 37:
            digits = "".join(_DIGIT.findall(found.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(found.group())) <= 15:
            yield found.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": emails,
    "ip": ips,
    "card": cards,
    "phone": phones,
}


# Look-alikes of ASCII letters that Unicode's own compatibility
# forms do not cover, and signs that stand for @ . + - or a space.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ѕ": "s", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o",
    "ѵ": "v", "ԛ": "q", "ԝ": "w", "․": ".", "。": ".", "｡": ".", "‧": ".", "∙": ".", "·": ".",
    "٫": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "＋": "+", "⁺": "+",
    # spaces of other widths, then characters without width
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}

# Digits as words in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".",
}


def _plain_form(char: str) -> str | None:
    """ASCII stand-in of one character, or None if it has none."""
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    if char.isdigit():
        return str(unicodedata.digit(char))
    form = unicodedata.normalize("NFKC", char)
    return form if form != char and form.isascii() and len(form) == 1 else None


@dataclass
class Copy:
    """A normalised text. ``starts`` and ``ends`` give the source range of each
    character, ``changed`` whether it was rewritten."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Copy:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:], np.zeros(len(text), bool))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Copy:
        """Replaces ordered, separate ranges. All characters of a replacement
        stand for its whole range; an empty one marks the character before it."""
        if not edits:
            return self
        parts, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            kept = self.changed[at:a].copy()
            if not new and len(kept):
                kept[-1] = True
            changed += [kept, np.ones(len(new), bool)]
            at = b
        parts.append(self.text[at:])
        return Copy(
            "".join(parts),
            np.concatenate([*starts, self.starts[at:]]),
            np.concatenate([*ends, self.ends[at:]]),
            np.concatenate([*changed, self.changed[at:]]),
        )


def homoglyphs(copy: Copy) -> Copy:
    if copy.text.isascii():
        return copy
    forms = {c: f for c in set(copy.text) if not c.isascii() and (f := _plain_form(c)) is not None}
    if not forms:
        return copy
    marks = re.compile("[" + re.escape("".join(forms)) + "]")
    return copy.rewrite([(*m.span(), forms[m.group()]) for m in marks.finditer(copy.text)])


_SPELLED_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_ITEM = rf"(?:{_SPELLED_WORD}|[0-9]++)"
# four items at least, set off by spaces or hyphens, seven digits in all
_SPELLED_RUN = re.compile(rf"(?<!\w){_ITEM}(?:[ \t,-]{{1,3}}{_ITEM}){{3,}}+(?!\w)", re.IGNORECASE)
_SPELLED_ITEM = re.compile(rf"({_SPELLED_WORD})(?!\w)(?:[ \t,-]{{1,3}}(?=(?:{_SPELLED_WORD}|[0-9])))?|([0-9]+)[ \t,-]{{1,3}}(?=[a-z])", re.IGNORECASE)
_HINT_WORD = "|".join(sorted((w for w, d in SPELLED.items() if d != "."), key=len, reverse=True))
# quick test on the text in lower case: a spelled digit, then another item
_SPELLED_HINT = re.compile(rf"\W(?:{_HINT_WORD})[ \t,-]{{1,3}}(?:{_SPELLED_WORD}|[0-9])|[0-9][ \t,-]{{1,3}}(?:{_HINT_WORD})")


def _may_spell(text: str) -> bool:
    return _SPELLED_HINT.search(" " + text.lower()) is not None


def spelled_digits(copy: Copy) -> Copy:
    if not _may_spell(copy.text):
        return copy
    edits = []
    for run in _SPELLED_RUN.finditer(copy.text):
        found = [
            (*m.span(), SPELLED[m[1].lower()] if m[1] else m[2])
            for m in _SPELLED_ITEM.finditer(copy.text, run.start(), run.end())
        ]
        digits = sum(len(_DIGIT.findall(new)) for _, _, new in found)
        if any(copy.text[a:b].strip(" \t,-").isalpha() for a, b, _ in found) and digits >= 4:
            edits += found
    return copy.rewrite(edits)


_AT = r"at|arobase|arroba|klammeraffe|ät"
_DOT = r"dot|point|punkt|punto"
_BRACKETED = re.compile(
    rf"(?<![ \t])[ \t]*+(?:\[[ \t]{{0,2}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,2}}\]|"
    rf"\([ \t]{{0,2}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,2}}\)|"
    rf"\{{[ \t]{{0,2}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,2}}\}}|"
    rf"<[ \t]{{0,2}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,2}}>|"
    rf"_(?:({_AT})|({_DOT}))_)[ \t]*+",
    re.IGNORECASE,
)
# Last parts of host names that end a spoken address in any case.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name io ai app dev co me tv eu uk us ca au nz ie de at ch "
    "fr be lu nl es pt it mx ar cl br se no dk fi pl cz ru in jp cn example test invalid"
).split()
_SPOKEN_DOT = rf"(?:[ \t]++(?:{_DOT})[ \t]++|[ \t]{{0,2}}\.[ \t]{{0,2}})"
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
_HOST = rf"[A-Za-z0-9-]++(?:{_SPOKEN_DOT}[A-Za-z0-9-]++)*"
_TLD = rf"(?:{'|'.join(TOP_DOMAINS)})(?![A-Za-z0-9-])"
# name at host dot tld: where "at" is spoken, the last dot has to be, too
_SPOKEN = re.compile(
    rf"{_NAME}[ \t]++(?:{_AT})[ \t]++{_HOST}[ \t]++(?:{_DOT})[ \t]++{_TLD}",
    re.IGNORECASE,
)
# the same with any last label, where it is no plain prose: "at the dot of", "at
# this point in" are left to the list above
_SPOKEN_HOST = rf"[A-Za-z0-9-]++(?:(?:[ \t]++(?:{_DOT})[ \t]++|\.)[A-Za-z0-9-]++)*"
_LABEL = r"[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_PROSE = (
    rf"(?:the|an?|this|that|each|every|one)[ \t]++(?:{_DOT})[ \t]|"
    rf"[A-Za-z0-9-]++[ \t]++point[ \t]++{_LABEL}(?![ \t]++(?:{_DOT})[ \t])"
)
_SPOKEN_ANY = re.compile(
    rf"{_NAME}[ \t]++(?:(?!at[ \t])(?:{_AT})[ \t]++|at[ \t]++(?!{_PROSE}))"
    rf"{_SPOKEN_HOST}[ \t]++(?:{_DOT})[ \t]++{_LABEL}",
    re.IGNORECASE,
)
_HALF_SPOKEN = re.compile(rf"{_NAME}[ \t]{{0,2}}@[ \t]{{0,2}}{_HOST}{_SPOKEN_DOT}{_TLD}", re.IGNORECASE)
# name dot name: the spoken dots before an address, if an @ follows
_SPOKEN_NAME = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:[ \t]++(?:{_DOT})[ \t]++[A-Za-z0-9._%+-]++)++",
    re.IGNORECASE,
)
_SPACED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ \t]{1,2}@[ \t]{0,2}|@[ \t]{1,2})"
    r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
)
_SPOKEN_SIGN = re.compile(rf"(?<![ \t])[ \t]++(?:({_AT})|({_DOT}))[ \t]++|[ \t]{{0,2}}(?:(@)|(\.))[ \t]{{0,2}}", re.IGNORECASE)
_NAME_DOT = re.compile(rf"(?<![ \t])[ \t]++(?:{_DOT})[ \t]++", re.IGNORECASE)
_NUMBER_DOT = re.compile(
    rf"(?<![0-9.])[0-9]{{1,3}}(?:[ \t]{{0,3}}(?:{_DOT}|\.)[ \t]{{0,3}}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE
)
_NUMBER_SIGN = re.compile(rf"[ \t]{{0,3}}(?:{_DOT}|\.)[ \t]{{0,3}}", re.IGNORECASE)
_SIGN_HINT = re.compile(rf"[\[({{<_][ \t]{{0,2}}(?:{_AT}|{_DOT}|@|\.)[ \t]{{0,2}}[\])}}>_]|[ \t0-9](?:{_DOT})[ \t0-9]|[ \t]@|@[ \t]|[0-9][ \t]+\.|[0-9]\.[ \t]+[0-9]", re.IGNORECASE)


def disguised_signs(copy: Copy) -> Copy:
    """``[at]``, ``(dot)``, ``name at host dot tld``, ``10 dot 0 dot 0 dot 1``."""
    if not _SIGN_HINT.search(copy.text):
        return copy

    def sign(m: re.Match) -> str:
        return "@" if any(m.groups()[::2]) else "."

    copy = copy.rewrite([(*m.span(), sign(m)) for m in _BRACKETED.finditer(copy.text)])
    for whole in (_SPOKEN_ANY, _SPOKEN, _HALF_SPOKEN, _SPACED):
        edits = []
        for run in whole.finditer(copy.text):
            edits += [
                (*m.span(), sign(m))
                for m in _SPOKEN_SIGN.finditer(copy.text, run.start() + 1, run.end())
                if m.group() not in "@."
            ]
        copy = copy.rewrite(edits)
    edits = []
    for run in _SPOKEN_NAME.finditer(copy.text) if "@" in copy.text else ():
        if not copy.text.startswith("@", run.end()):
            continue
        edits += [
            (*m.span(), ".")
            for m in _NAME_DOT.finditer(copy.text, run.start() + 1, run.end())
        ]
    copy = copy.rewrite(edits)
    edits = []
    for run in _NUMBER_DOT.finditer(copy.text):
        edits += [
            (*m.span(), ".")
            for m in _NUMBER_SIGN.finditer(copy.text, run.start(), run.end())
            if m.group() != "."
        ]
    return copy.rewrite(edits)


TRANSDUCERS: tuple[Callable[[Copy], Copy], ...] = (homoglyphs, disguised_signs, spelled_digits)


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans by kind, and those that only the normalised text shows."""
    digits = _DIGIT.search(text) is not None
    plain = {
        k: list(f(text)) if k == "email" or digits else [] for k, f in FINDERS.items()
    }
    copy = Copy.of(text)
    for step in TRANSDUCERS:
        copy = step(copy)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if copy.changed.any():
        for kind, finder in FINDERS.items():
            begins = [s for s, _ in plain[kind]]
            last = 0
            for a, b in finder(copy.text):
                start, end = int(copy.starts[a]), int(copy.ends[b - 1])
                if not copy.changed[a:b].any() or start < last:
                    continue
                # the plain span that begins at or before this one may hold all of it
                at = bisect_right(begins, start) - 1
                if at < 0 or plain[kind][at][1] < end:
                    added[kind].append((start, end))
                    last = end
    return plain, added


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: counts of plain spans by kind, the plain
    spans, those added by deobfuscation, and all of them, in code points with
    the end exclusive. An added span may hold a plain one of its kind or go on from
    within it; spans of different kinds may overlap."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                plain, added = find(text)
                out.append(
                    {f"n_{k}": len(plain[k]) for k in KINDS}
                    | {
                        "n_added": sum(map(len, added.values())),
                        "base_spans": joined(plain),
                        "added_spans": joined(added),
                        "spans": joined({k: plain[k] + added[k] for k in KINDS}),
                    }
                )
            if out:
                found = pd.DataFrame(out, index=batch.index)
                found.insert(0, "doc_id", batch["doc_id"])
                yield found

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs, id_col, text_col).mapInPandas(
        rows,
        f"doc_id {id_type(docs, id_col)}, {counts}, n_added long, base_spans string, "
        "added_spans string, spans string",
    )
