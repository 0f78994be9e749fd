"""Base spans against the plain patterns, checksums, context words, long texts."""

import random
import re
import time

import pytest

from logsieve.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def base(text):
    return [s[:3] for s in pii.spans_of(text) if s[4]]


def added(text):
    return [(kind, text[a:b]) for kind, a, b, _, own in pii.spans_of(text) if not own]


def test_base_on_random_texts():
    rng = random.Random(4)
    parts = ["1", "2", "4", "0", "25", "@", "@", ".", ".", "a", "b-", "+", "+4", " ", "(", ")", "é", "\n", "_%", "٣", "4111 1111 1111 1111", "192.168.0.", "x@y.z"]
    found = 0
    for _ in range(40_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert base(text) == plain(text), text
        found += len(base(text))
    assert found > 5_000


def test_base_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain(texts[r.doc_id])


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE89370400440532013001")
    assert pii.small_parts("255.0.0.00255") and not pii.small_parts("256.0.0.1") and not pii.small_parts("1.1.1." + "9" * 5000)
    assert added("x DE89 3704 0044 0532 0130 00 y") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("x DE89 3704 0044 0532 0130 01 y") == []
    assert added("iban GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]


def test_context_decides():
    assert added("her social security number is 123-45-6789") == [("ssn", "123-45-6789")]
    assert added("take part 123-45-6789 of it") == [] and added("social 000-45-6789, social 900-45-6789") == []
    assert added("Call 030 555 77 13 today") == [("local_phone", "030 555 77 13")]
    assert added("the numbers 030 555 77 13 won") == [] and added("call on date 030 555 77 13") == []
    inside = "visa 12 4111 1111 1111 1111 7"
    assert base(inside) == [] and added(inside) == [("card_inside", "4111 1111 1111 1111")]
    assert added("12 4111 1111 1111 1111 7") == []
    score = {t: pii.spans_of(t)[0][3] for t in ("host 10.0.0.1 up", "at 10.0.0.1 up", "version 10.0.0.1 up")}
    assert score["host 10.0.0.1 up"] > score["at 10.0.0.1 up"] > score["version 10.0.0.1 up"]


def test_added_spans_keep_clear_of_base_ones():
    text = "call +1 (132) 555-1352 or tel 030 555 77 13, card 4111 1111 1111 1111"
    spans = sorted((a, b) for _, a, b, _, _ in pii.spans_of(text))
    assert len(spans) == 3 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("part", ["a", "1", "@", "a@", "+1(", "a@b", "+1.", "AB12", "1.1.1.", "1 ", "12 34-"])
def test_long_texts_take_time_in_proportion(part):
    def took(n):
        began = time.perf_counter()
        pii.spans_of(part * n)
        return time.perf_counter() - began
    took(1_000)
    assert took(160_000) < 12 * max(took(40_000), 0.02)


def test_nulls_repeats_clashes_and_empty(spark, table, clashes):
    long_ = "ü" * 300_000 + " a.b@c.de"
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "é a@b.c"), (3, "é a@b.c"), (4, long_)]
    got = sorted((repr(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find_personal_data(table(rows, spans="x", kind="y", **clashes).repartition(3)).collect())
    assert got == sorted([("1", []), ("2", []), ("None", [("email", 0, 5)]), ("3", [("email", 2, 7)]), ("3", [("email", 2, 7)]), ("4", [("email", 300_001, 300_009)])])
    assert pii.find_personal_data(table([])).count() == 0
