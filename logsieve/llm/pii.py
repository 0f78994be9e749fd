"""Personal data in whole texts: patterns propose spans, checksums confirm them, words around them move the score.

A kind has a pattern, a check of what it found and a score to begin with. A span whose check is a checksum begins high
and needs no other sign; one whose pattern alone says little begins below the threshold, and only a word that belongs
to its kind, close before or after it, lifts it over. Words that name other things (an invoice, a version) push scores
down. The four base kinds are always reported, whatever their score.

Patterns must be linear in a text's length: an address is looked for around each `@`, digits are only begun where no
digit stands before, and repeats are possessive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.texts import slices

THRESHOLD = 0.5
NEAR = 48                   # characters on either side that are searched for context words
LIFT = 0.4                  # what words of its kind add
FALL = 0.3                  # what words of other things take away

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9.-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def digits_of(span: str) -> str:
    return _NOT_DIGIT.sub("", span)


def luhn(digits: str) -> bool:
    """Every second digit from the right but one counts double, its own digits added up; the sum ends in zero."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod_97(iban: str) -> bool:
    """The first four characters moved to the end, letters as two digits, leave 1 on division by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def small_parts(ip: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in ip.split(".")))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            begin = done + len(text[done:at].rstrip(_LOCAL))
            if begin < at:
                yield begin, domain.end()
                done = at = domain.end()
                continue
        at += 1
        done = at               # neither part of an address reaches over an `@`


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _card(span: str) -> bool:
    digits = digits_of(span)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(span: str) -> bool:
    return 9 <= len(digits_of(span)) <= 15


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest part of each match, cut at a space or its end, that has a right remainder."""
    for m in _IBAN.finditer(text):
        span = m.group()
        cuts = [len(span), *(i for i in range(len(span) - 1, 14, -1) if span[i] == " ")]
        end = next((c for c in cuts if 15 <= len(plain := span[:c].replace(" ", "")) <= 34 and mod_97(plain)), None)
        if end:
            yield m.start(), m.start() + end


def _ssn(span: str) -> bool:
    """Numbers that are never issued don't count."""
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _cards_inside(text: str) -> Iterator[tuple[int, int]]:
    """Card numbers among the groups of a run of digits that as a whole is none."""
    for m in _CARD.finditer(text):
        span = m.group()
        if len(span) < 14 or _card(span):
            continue
        groups = list(re.finditer(r"[0-9]+", span))
        at = 0
        while at < len(groups):
            held = 0
            for last in range(at, min(at + 6, len(groups))):
                held += len(groups[last].group())
                found = span[groups[at].start():groups[last].end()]
                if held >= 13 and _card(found):
                    yield m.start() + groups[at].start(), m.start() + groups[last].end()
                    at = last
                    break
            at += 1


def _always(span: str) -> bool:
    return True


@dataclass(frozen=True)
class Kind:
    """`propose` gives spans from left to right, `check` confirms one, `words` are those that stand near one."""

    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    check: Callable[[str], bool]
    score: float
    words: tuple[str, ...] = ()
    other: tuple[str, ...] = ()


#: The base kinds in their order, then the added ones.
BASE = [
    Kind("email", _emails, _always, 0.8, ("mail", "contact", "write", "kontakt", "correo", "courriel")),
    Kind("ip", _matches(_IP), small_parts, 0.6, ("ip", "address", "host", "server", "adresse", "client"), ("version", "release", "section")),
    Kind("card", _matches(_CARD), _card, 0.7, ("card", "visa", "credit", "karte", "carte", "tarjeta", "cvv"), ("order", "invoice", "serial", "isbn")),
    Kind("phone", _matches(_PHONE), _phone, 0.6, ("phone", "tel", "call", "mobile", "fax", "telefon", "rufen", "appelez", "llame"), ("version",)),
]
ADDED = [
    Kind("iban", _ibans, _always, 0.8, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("card_inside", _cards_inside, _always, 0.3, ("card", "visa", "credit", "karte", "carte", "tarjeta"), ("order", "invoice", "serial", "isbn")),
    Kind("ssn", _matches(_SSN), _ssn, 0.3, ("ssn", "social", "security", "insurance"), ("order", "part", "invoice")),
    Kind("local_phone", _matches(_LOCAL_PHONE), lambda span: 7 <= len(digits_of(span)) <= 12, 0.2,
         ("phone", "tel", "call", "mobile", "fax", "telefon", "rufen", "appelez", "llame"), ("order", "invoice", "date", "version")),
]
_WORD = re.compile(r"[^\W\d_]+")


def score_of(kind: Kind, text: str, begin: int, end: int) -> float:
    """The kind's score, moved once by words of its own and once by words of other things near the span."""
    near = {w.lower() for part in (text[max(0, begin - NEAR):begin], text[end:end + NEAR]) for w in _WORD.findall(part)}
    return min(1.0, max(0.0, kind.score + LIFT * any(w in near for w in kind.words) - FALL * any(w in near for w in kind.other)))


def spans_of(text: str | None, base: list[Kind] = BASE, added: list[Kind] = ADDED, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind in their order, then start. Added spans do not overlap earlier kinds' ones."""
    text = text or ""
    out, taken = [], []
    has_digit = re.search("[0-9]", text) is not None
    for kind in base:
        if not has_digit and kind.name != "email":
            continue
        for a, b in kind.propose(text):
            if kind.check(text[a:b]):
                out.append((kind.name, a, b, round(score_of(kind, text, a, b), 3), True))
                taken.append((a, b))
    for kind in added if has_digit else []:
        taken.sort()
        own, at = [], 0
        for a, b in kind.propose(text):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            free = all(y <= a or x >= b for x, y in taken[at:at + 1])
            if free and kind.check(text[a:b]) and (score := score_of(kind, text, a, b)) >= threshold:
                own.append((a, b))
                out.append((kind.name, a, b, round(score, 3), False))
        taken += own
    return out


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of each whole text of `docs` (doc_id, text): spans (kind, start, end, score, base) in code points, end exclusive.

    The base kinds `email`, `ip`, `card`, `phone` are the leftmost matches of their patterns that pass their checks;
    kinds may overlap each other. Added kinds (`iban`, `card_inside`, `ssn`, `local_phone`) need a score of `threshold`
    and stand where no earlier kind does. Spans are sorted by kind in that order, then start. Null and empty texts have
    none. Every row gives a row, equal or null ids included; a slice of Arrow rows is handled at a time. Only doc_id
    and text are read, so extra columns cannot clash; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in spans_of(t, threshold=threshold)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.struct(fields)))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        apply, f"doc_id {id_type}, spans array<struct<kind string, start bigint, end bigint, score double, base boolean>>")


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
