"""Rule-based quality verdicts as a short-circuit cascade, in column expressions only.

Every rule is a condition over features of the text. A sample tells each rule's cost (seconds of a scan that evaluates
it alone, beyond a scan that evaluates none) and its selectivity (the share it rejects); rules are then tried in the
order of rejection per cost inside one CASE, which stops at the first that holds. The order changes the work, never
the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.texts import packed
from logsieve.session import store

SAMPLE_ROWS = 2_000         # documents that tell cost and selectivity
SYMBOLS = "#*$%&|<>"
_SPACES = "[ \\t-\\r]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES + "+"), lambda w: w != "")


def _n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _n_repeat_words(text: Column) -> Column:
    """Words that stand in a window of three words found twice or more.

    A text whose windows have different hashes has none. Else hashes are sorted with the window's number in their
    lowest bits, so equal windows are neighbours, and no window is ever looked up among all. Should two different
    hashes agree in the bits that are left, hash and number are sorted side by side instead.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(places: Column) -> Column:
        return _let(places, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    def side_by_side(h: Column) -> Column:
        both = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return _let(both, lambda s: covered(F.transform(F.filter(s, lambda x, j: (
            F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)))), lambda x: x["i"])))

    def by_number(h: Column, mask: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def near(s: Column) -> Column:
            pairs = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.get(s, j).bitwiseXOR(F.get(s, j + 1)).between(F.lit(0), mask))
            return _let(pairs, lambda at: F.when(
                F.exists(at, lambda j: F.get(h, F.get(s, j).bitwiseAND(mask).cast("int")) != F.get(h, F.get(s, j + 1).bitwiseAND(mask).cast("int"))),
                side_by_side(h),
            ).otherwise(covered(F.concat(F.transform(at, lambda j: F.get(s, j).bitwiseAND(mask)), F.transform(at, lambda j: F.get(s, j + 1).bitwiseAND(mask))))))

        return _let(keys, near)

    def repeats(h: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h)))) - 1      # holds any number
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(mask, lambda m: by_number(h, m)))

    return _let(_words(text), lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(hashes(w), repeats))).cast("long")


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(_words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(t, _SPACES + "+", "")).cast("long"),
    "n_symbols": lambda t: F.length(F.regexp_replace(t, f"[^{SYMBOLS}]++", "")).cast("long"),
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_lines": lambda t: F.size(F.split(t, "\n")).cast("long"),
    "n_shouts": lambda t: (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
    "n_upper": lambda t: F.length(F.regexp_replace(t, "\\P{Lu}++", "")).cast("long"),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
Feature = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `reject`, over the features it names, holds."""

    name: str
    reject: Callable[[Feature], Column]


BASE_RULES = [
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("repeats_itself", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("shouts", lambda f: 2 * f("n_shouts") > f("n_words")),
    Rule("capitals", lambda f: 100 * f("n_upper") > 40 * f("word_chars")),
    Rule("long_words", lambda f: f("word_chars") > 12 * f("n_words")),
    Rule("short_words", lambda f: 2 * f("word_chars") < 5 * f("n_words")),
    Rule("repeated_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
]


def _over(text: Column, known: dict[str, Column]) -> Feature:
    return lambda name: known[name] if name in known else FEATURES[name](text)


def rule_order(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) by falling rejection per cost, as measured on a sample of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.count()
    sample = store(docs.select("text").sample(min(1.0, sample_rows / max(1, rows)), seed=7))

    def measure(condition: Column) -> tuple[float, float]:
        job = sample.agg(F.avg(condition.cast("double")).alias("share"), F.sum(F.length("text")))
        job.collect()                       # compiles it
        started = time.perf_counter()
        share = job.first()["share"]
        return time.perf_counter() - started, share or 0.0

    idle = measure(F.lit(False))[0]
    found = [(rule, *measure(rule.reject(_over(text, {})))) for rule in rules]
    found = [(rule, max(seconds - idle, 1e-3), share) for rule, seconds, share in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def verdict(text: Column, rules: list[Rule], known: dict[str, Column] | None = None) -> Column:
    """Name of the first rule of the list that rejects the text, else null; rules after it are not evaluated."""
    f = _over(F.coalesce(text, F.lit("")), known or {})
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(f), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule] = RULES, features: list[str] | None = None) -> DataFrame:
    """`docs` as struct `_row`, struct `_features` of the features asked for, and `_rejected_by`.

    A null text counts as an empty one, which has no words and one line and is rejected by the first base rule. Words
    are runs without [\\x20\\x09-\\x0D]. Equal rows get equal verdicts, texts are read whole, extra columns stay in
    `_row`, an empty table gives an empty result. Where several rules hold, `_rejected_by` names the first in the
    order that the sample gave; whether it is null does not depend on that order.
    """
    ordered = [rule for rule, _, _ in rule_order(docs, rules)]
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    df = packed(docs)
    if features:
        df = df.withColumn("_features", F.struct(*[FEATURES[n](text).alias(n) for n in features]))
    known = {n: F.col(f"_features.{n}") for n in features or []}
    return df.withColumn("_rejected_by", verdict(text, ordered, known))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    return judge(docs, rules).filter("_rejected_by is null").select("_row.*")
