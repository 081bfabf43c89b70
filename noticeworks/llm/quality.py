"""Quality rules as a short-circuit cascade of column expressions.

Each rule rejects a document by an expression over its text, words and base counts. On a bounded sample every rule is run alone, over the sample
and over several copies of it: the time that a copy adds is its cost, free of what a job takes to start and its code to compile; the share
it rejects is its selectivity. The cascade is one CASE expression with the rules ordered by rejection per cost, so an expensive
rule is evaluated only for documents that no better one has rejected. The order decides how much work is done, never the verdict. Where the
base counts themselves are not asked for, the base tests take part in the cascade too, and counts are computed only where a rule comes to them.

Everything is per row: no shuffle, no Python.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import let
from noticeworks.session import cut_lineage

#: Different texts of the sample that costs and selectivities are estimated on, copies of it that are timed, and runs of which the least time counts.
SAMPLE, COPIES, RUNS = 2000, 8, 2
_MODULUS = 1 << 30

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Facts:
    """What rules judge a document by: columns, or expressions that are computed where a rule comes to them."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    """Name and rejecting expression of a document's facts."""

    name: str
    rejects: Callable[[Facts], Column]


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


RULES = (
    Rule("word_length", lambda d: (d.word_chars > 15 * d.n_words) | (d.word_chars < 2 * d.n_words)),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("shouting", lambda d: 3 * _times(d.text, "[!?]") > d.n_words),
    Rule("capitals", lambda d: 2 * _times(d.text, r"\p{Lu}") > _times(d.text, r"\p{L}")),
    Rule("digits", lambda d: 2 * _times(d.text, "[0-9]") > F.length(d.text)),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > F.size(lines_of(d.text))),
    Rule("few_words", lambda d: 20 * F.size(F.array_distinct(d.words)) < d.n_words),
)


def base_rules(min_words: int, max_repeat: int) -> tuple[Rule, ...]:
    """The base tests as rules."""
    return (Rule("base_length", lambda d: d.n_words < min_words), Rule("base_repeats", lambda d: 100 * d.n_repeat_words > max_repeat * d.n_words))


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    lines = lines_of(text)
    return F.size(lines) - F.size(F.array_distinct(lines))


def windows_of(words: Column) -> Column:
    """Hashes of the windows of three words, in order."""
    hashes = let(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) >= 3, F.slice(hashes, 1, F.size(words) - 2)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more. Sorting is left to texts that have such windows.

    Every value that a lambda uses is bound by ``let``: a filter on the result may be moved before the projections, and would otherwise
    compute whole arrays anew for each of their elements.
    """

    def same(hashes: Column, j: Column, x: Column) -> Column:
        return F.coalesce(F.get(hashes, j)["h"] == x["h"], F.lit(False))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def counted(windows: Column) -> Column:
        numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(numbered, lambda s: F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(at)).otherwise(0)

    return let(windows_of(words), counted)


def facts_of(text: Column, words: Column) -> Facts:
    """Facts as expressions of a text and its words."""
    return Facts(
        text, words, F.size(words).cast("long"), F.length(F.array_join(words, "")).cast("long"), _times(text, _SYMBOLS).cast("long"),
        duplicate_lines(text).cast("long"), repeated_words(words).cast("long"),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_facts(rows: DataFrame) -> tuple[DataFrame, Facts]:
    """``rows`` (text) with its words and base counts as columns, and these as facts. A null text is empty."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text")))
    facts = facts_of(F.col("text"), F.col("words"))
    return rows.withColumns({c: getattr(facts, c) for c in COUNTS}), Facts(*(F.col(c) for c in ("text", "words", *COUNTS)))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample: int = SAMPLE, counts: bool = True) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), most rejection per cost first, estimated on about ``sample`` different texts, drawn by a hash.

    With ``counts`` rules find the base counts ready, else they compute them.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    drawn = rows.filter(F.pmod("h", F.lit(_MODULUS)) < min(1.0, sample / n) * _MODULUS).dropDuplicates(["h"]).select("text")
    ready, facts = with_facts(drawn)
    ready = cut_lineage(ready)
    facts = facts if counts else facts_of(F.col("text"), F.col("words"))
    total = max(1, ready.count())
    copied = ready.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

    def least(of: DataFrame, expression: Column) -> tuple[float, int]:
        times, hits = [], 0
        for _ in range(RUNS):
            begin = time.perf_counter()
            hits = of.agg(F.count_if(expression)).first()[0]
            times.append(time.perf_counter() - begin)
        return min(times), hits

    timed = []
    for rule in rules:
        expression = rule.rejects(facts)
        many, _ = least(copied, expression)  # also compiles
        once, hits = least(ready, expression)
        timed.append((rule, max(1e-9, (many - once) / ((COPIES - 1) * total)), hits / total))
    return sorted(timed, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], text: Column, words: Column, facts: Facts | None = None) -> Column:
    """True for documents that no rule rejects; rules behind a rejecting one are not evaluated."""
    facts, out = facts or facts_of(text, words), F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.rejects(facts), F.lit(False)).otherwise(out)
    return out


def judge_quality(
    docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, min_words: int = 50, max_repeat: int = 50, keep_text: bool = True, counts: bool = True
) -> DataFrame:
    """All columns of ``docs`` (without the text if not ``keep_text``) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` per cent of them in repeated windows of three. ``kept``: not base_failed and no
    rule rejects. Without ``counts`` only ``kept`` is added, and what no rule comes to is not computed. Null and empty texts have no words
    and fail; texts of any length are read whole; repeated rows are judged alike; no rows give none. Columns of ``docs`` named like an added one are replaced.
    """
    added = (*COUNTS, "base_failed", "kept") if counts else ("kept",)
    kept = [c for c in docs.columns if c.lower() not in added or c == text_col]
    out = [F.col("row").getField(c).alias(c) for c in kept if keep_text or c != text_col]
    base = base_rules(min_words, max_repeat)
    # the caller's columns travel as one, so none of theirs can meet one of these
    rows = docs.select(F.struct(*(c for c in kept if keep_text or c != text_col)).alias("row") if out else F.lit(None).alias("row"), F.col(text_col).alias("text"))
    if not counts:
        ordered = [r for r, _, _ in order_rules(docs, (*base, *rules), text_col=text_col, sample=sample, counts=False)]
        text = F.coalesce("text", F.lit(""))
        judged = rows.withColumn("kept", let(words_of(text), lambda w: cascade(ordered, text, w)))
        return judged.select(*out, "kept")
    ordered = [r for r, _, _ in order_rules(docs, rules, text_col=text_col, sample=sample)]
    judged, facts = with_facts(rows)
    failed = base[0].rejects(facts) | base[1].rejects(facts)
    verdict = F.when(failed, F.lit(False)).otherwise(cascade(ordered, facts.text, facts.words, facts))
    return judged.withColumns({"base_failed": failed, "kept": verdict}).select(*out, *added)


#: The contract and the rules as DuckDB SQL.
ORACLE_SQL = r"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split)),
    repeated AS (
        SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 2)) AS pos FROM windows WHERE times > 1) GROUP BY doc_id),
    counted AS (
        SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct
        FROM split LEFT JOIN repeated USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars <= 15 * n_words AND word_chars >= 2 * n_words
            AND 10 * n_symbols <= n_words AND 3 * len(regexp_extract_all(t, '[!?]')) <= n_words
            AND 2 * len(regexp_extract_all(t, '\p{Lu}')) <= len(regexp_extract_all(t, '\p{L}')) AND 2 * len(regexp_extract_all(t, '[0-9]')) <= length(t)
            AND 2 * n_dup_lines <= n_lines AND 20 * n_distinct >= n_words AS kept
    FROM counted
"""
