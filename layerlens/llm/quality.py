"""Document quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import BLANK, WORD, let, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_window_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of the array w lie in a window of that many words which the array holds twice or more.

    Hashes only rule windows out; those that share a hash are compared as strings.
    """

    def neighbours(pairs: Column) -> Column:
        """Of an array sorted by its first field: the elements that share it with a neighbour."""

        def shared(p: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(pairs, j - 1)["key"] == p["key"]).otherwise(False)
            return before | F.coalesce(F.get(pairs, j + 1)["key"] == p["key"], F.lit(False))

        return F.filter(pairs, shared)

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + (i + window - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + window).alias("end"))
        return F.aggregate(starts, zero, step)["n"]

    def exact(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
        alike = let(pairs, neighbours)
        spelt = F.sort_array(F.transform(alike, lambda p: F.struct(F.array_join(F.slice(w, p["at"] + 1, window), " ").alias("key"), p["at"].alias("at"))))
        return covered(F.sort_array(F.transform(let(spelt, neighbours), lambda p: p["at"])))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)))
    return F.when(F.size(w) >= window, counted).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


#: Each measure of a text by itself, for a cascade that stops at the first rule that rejects.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.regexp_count(t, F.lit(WORD)).cast("long"),
    "word_chars": lambda t: F.length(_without(t, " \t\n\x0b\f\r")).cast("long"),
    "n_symbols": lambda t: _count_of(t, SYMBOLS),
    "n_dup_lines": duplicate_lines,
    "n_lines": lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))).cast("long"),
    "n_repeat_words": lambda t: let(words(t), repeated_window_words),
    "n_marks": lambda t: _count_of(t, "!?"),
    "n_digits": lambda t: _count_of(t, "0123456789"),
    "n_capitals": lambda t: _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
}


@dataclass(frozen=True)
class Rule:
    """rejects(m) is true for a text to reject; m gives a measure by its name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("too_few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: Thresholds far from clean prose in any of the usual languages: symbols and marks per word, shares of letters and lines.
METHOD_RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > 2 * m("n_words")),
    Rule("marks", lambda m: 10 * m("n_marks") > 6 * m("n_words")),
    Rule("capitals", lambda m: 10 * m("n_capitals") > 4 * m("word_chars")),
    Rule("digits", lambda m: 10 * m("n_digits") > 5 * m("word_chars")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("duplicate_lines", lambda m: (m("n_lines") >= 4) & (10 * m("n_dup_lines") > 3 * m("n_lines"))),
)


def _seconds(job: Callable[[], object], runs: int = 2) -> float:
    """The least of some runs: what the machine does besides only adds."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        job()
        took.append(time.perf_counter() - began)
    return min(took)


def cascade_order(docs: DataFrame, rules=BASE_RULES + METHOD_RULES, text_col: str = "text", sample_rows: int = 1000, seed: int = 11, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) by rejection per cost, dearest of the useless ones last.

    The sample holds about sample_rows rows, drawn evenly from all of docs; only the order hangs on it, never a verdict.
    One job counts what every rule rejects; a rule's cost is the time of a job of its own over that of a job without rules,
    both the least of two runs.  Measures named in known are there already and cost nothing.
    """
    n = docs.count()
    sample = docs.select(text_of(text_col).alias("t")).sample(min(1.0, sample_rows / max(1, n)), seed).cache()
    rejects = lambda rule: rule.rejects(lambda name: MEASURES[name](F.col("t")))
    costs = lambda rule: rule.rejects(lambda name: F.length("t").cast("long") if name in known else MEASURES[name](F.col("t")))
    try:
        hits = sample.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(rejects(r)).alias(r.name) for r in rules)).first()
        idle = _seconds(lambda: sample.agg(F.count_if(F.length("t") < 0)).first())
        took = {r.name: max(1e-4, _seconds(lambda r=r: sample.agg(F.count_if(costs(r))).first()) - idle) for r in rules}
    finally:
        sample.unpersist()
    measured = [(r, took[r.name], hits[r.name] / max(1, hits.rows)) for r in rules]
    return sorted(measured, key=lambda x: (-(x[2] / x[1]), x[1], x[0].name))


def cascade(rules, measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, in the order given, else null; later rules aren't evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(measure), rule.name) if out is None else out.when(rule.rejects(measure), rule.name)
    return F.lit(None).cast("string") if out is None else out


def quality_verdicts(docs: DataFrame, text_col: str = "text", order=None, metrics: tuple[str, ...] = ()) -> DataFrame:
    """docs with `kept` (boolean); with metrics also `measures`, a struct of those measures.

    Method: each rule's cost and share of rejections are measured on a sample, and the rules stand in one CASE in order of
    rejection per cost, so that a text rejected by a cheap rule never meets a dear one.  The measures asked for are computed
    for every row, once, in one pass over its words, and the rules read them; all others are computed only where the cascade
    comes to a rule that needs them.  A row stays if no rule rejects it, whatever the order.

    Defined results: a null or empty text has no words and is rejected; an empty table gives no rows; repeated rows get the
    same verdict each; other columns stay as they are, and columns named kept or measures are replaced.
    """
    ranked = [r for r, _, _ in (cascade_order(docs, text_col=text_col, known=metrics) if order is None else order)]
    alone = lambda name: MEASURES[name](text_of(text_col))
    if not metrics:
        return docs.withColumn("kept", cascade(ranked, alone).isNull())

    def measured(t: Column) -> Column:
        def by_words(w: Column) -> Column:
            own = {"n_words": F.size(w).cast("long"), "n_repeat_words": repeated_window_words(w)}
            return F.struct(*((own[k] if k in own else MEASURES[k](t)).alias(k) for k in metrics))

        return let(words(t), by_words)

    rated = docs.withColumn("measures", let(text_of(text_col), measured))
    return rated.withColumn("kept", cascade(ranked, lambda name: F.col("measures")[name] if name in metrics else alone(name)).isNull())


def base_failed(m: Callable[[str], Column]) -> Column:
    return BASE_RULES[0].rejects(m) | BASE_RULES[1].rejects(m)
