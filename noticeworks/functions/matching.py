"""Containment: which of many names occur in a text.

A few names become a literal array of the plan.  More are compiled into Aho-Corasick
automata, each of a bounded number of characters, that read every text once: a narrow Arrow
pass over the text column alone, nothing is shuffled.  Beyond the automata's bound the names are joined:
every name stands behind one gram of at most ``GRAM`` characters, the one that the fewest
names have; texts that hold the gram are asked for the name.  All ways find the same
hits in the same order; only the plan depends on the names.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import let
from noticeworks.session import cut_lineage

INLINE_NAMES = 32
#: Characters of the names of one automaton, and of all that are broadcast.
AUTOMATON_CHARS = 1 << 20
BROADCAST_CHARS = 8 << 20
GRAM = 3


def _caseless(term: str) -> bool:
    return term.lower() == term.upper() and not any(map(unicodedata.combining, term))


def matched_terms(text: Column, terms: Iterable[str]) -> Column:
    """Terms found in the text, ignoring case, in the order of ``terms``.

    The text is folded only if some term has letters with case.
    """
    terms = [t for t in terms if t]
    if not terms:
        return _array([])
    if all(map(_caseless, terms)):
        return let(text, lambda t: F.filter(_array(terms), lambda term: F.contains(t, term)))
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low")) for t in terms])
    return let(
        F.lower(text),
        lambda low: F.transform(
            F.filter(table, lambda t: F.contains(low, t["low"])), lambda t: t["term"]
        ),
    )


def by_position(text: Column, names: Column) -> Column:
    """Names ordered by their first position in the text, then by name."""
    return let(
        text,
        lambda t: F.transform(
            F.array_sort(
                F.transform(names, lambda n: F.struct(F.instr(t, n).alias("at"), n.alias("name")))
            ),
            lambda s: s["name"],
        ),
    )


def cut_grams(text: Column, lengths: Iterable[int]) -> Column:
    """Distinct pieces of some lengths."""
    # a look-ahead with a group cuts all overlapping pieces in one pass
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]))


def name_blocks(rows: Iterable[tuple[str, str]], chars: int) -> list[list[tuple[str, str, int]]]:
    """(name, text to look for, order) in blocks of at most ``chars`` characters, or of one name."""
    blocks: list[list[tuple[str, str, int]]] = [[]]
    held = 0
    for order, (name, low) in enumerate(rows):
        if blocks[-1] and held + len(low) > chars:
            blocks.append([])
            held = 0
        blocks[-1].append((name, low, order))
        held += len(low)
    return blocks


_COMPILED: dict[str, ahocorasick.Automaton] = {}


def _automaton(token: str, shared) -> ahocorasick.Automaton:
    """Automaton of a broadcast block, compiled once in a worker, which keeps the last one."""
    if token not in _COMPILED:
        automaton, found = ahocorasick.Automaton(), {}
        for name, low, order in shared.value:
            found.setdefault(low, []).append((order, name))
        for low, names in found.items():
            automaton.add_word(low, (len(low), names))
        automaton.make_automaton()
        _COMPILED.clear()
        _COMPILED[token] = automaton
    return _COMPILED[token]


def _finder(shared) -> Callable:
    """Function of a text column: (at, rank, name) of each name of a block at its first place."""

    token = uuid.uuid4().hex

    def find(texts: pa.Array) -> pa.Array:
        automaton = _automaton(token, shared)
        ends, at, ranks, hits = [0], [], [], []
        for text in texts:
            first: dict[int, tuple[int, list]] = {}
            if text.is_valid:
                for end, (size, names) in automaton.iter(text.as_py()):
                    key = id(names)
                    if key not in first:
                        first[key] = end - size, names
            for place, names in first.values():
                for order, name in names:
                    at.append(place)
                    ranks.append(order)
                    hits.append(name)
            ends.append(len(hits))
        values = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(ranks, pa.int32()), pa.array(hits, pa.string())], names=["at", "rank", "name"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return F.arrow_udf(find, "array<struct<at: int, rank: int, name: string>>")


def _with_automata(df: DataFrame, text: Column, blocks: list, out: str, ignore_case: bool) -> DataFrame:
    """One pass per block; beyond the first the rows are written in between, so a worker holds one automaton."""
    sort = (lambda h: F.struct(h["rank"], h["name"])) if ignore_case else (lambda h: F.struct(h["at"], h["name"]))
    none = F.expr("cast(array() AS array<struct<at: int, rank: int, name: string>>)")
    step = df.withColumns({"_text": text, "_found": none})
    for i, block in enumerate(blocks):
        step = cut_lineage(step) if i else step
        find = _finder(df.sparkSession.sparkContext.broadcast(block))
        step = step.withColumn("_found", F.concat("_found", find(F.col("_text"))))
    names = F.transform(F.array_sort(F.transform("_found", sort)), lambda h: h["name"])
    return step.withColumn(out, names).drop("_text", "_found")


def with_name_hits(
    df: DataFrame, key: str, text: Column, names: DataFrame, out: str, *,
    ignore_case: bool = False, limit: int = INLINE_NAMES, chars: int = BROADCAST_CHARS, block_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """Add ``out``: names (column ``name``) contained in ``text``, by first position; none for a missing text.

    ``key`` identifies the rows of ``df``.  With ``ignore_case`` hits come in
    alphabetical order, as positions then have no meaning for the caller, or by
    a column ``rank`` of the names.  Up to ``limit`` names stand in the plan, up to ``chars``
    characters of names are broadcast in blocks, more are joined.
    """
    ranked = "rank" in names.columns
    listed = names.where(F.col("name") != "").groupBy("name").agg(F.min("rank" if ranked else "name").alias("rank"))
    few = listed.orderBy("rank", "name").limit(limit + 1).collect() if limit else []
    if limit and len(few) <= limit:
        inline = [r["name"] for r in few]
        if ignore_case:
            return df.withColumn(out, matched_terms(text, inline))
        found = let(text, lambda t: F.filter(_array(inline), lambda n: F.contains(t, n)))
        return df.withColumn(out, by_position(text, found))
    # folded by Spark on both sides, so that case means the same in all ways
    low = F.lower("name") if ignore_case else F.col("name")
    if (listed.agg(F.sum(F.length("name"))).first()[0] or 0) <= chars:
        rows = listed.orderBy("rank", "name").select("name", low.alias("low")).collect()
        return _with_automata(df, F.lower(text) if ignore_case else text, name_blocks(map(tuple, rows), block_chars), out, ignore_case) if rows else df.withColumn(out, _array([]))

    fold = F.lower if ignore_case else (lambda c: c)
    folded = listed.withColumn("low", fold(F.col("name"))).withColumn("n", F.least(F.length("low"), F.lit(GRAM)))
    lengths = sorted(r["n"] for r in folded.select("n").distinct().collect())  # at most GRAM of them
    if not lengths:
        return df.withColumn(out, _array([]))
    grams = folded.withColumn("_gram", F.explode(F.when(F.col("n") < GRAM, F.array("low")).otherwise(cut_grams(F.col("low"), [GRAM]))))
    rarest = grams.join(grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("shared")), "_gram").groupBy("rank", "name", "low").agg(
        F.min(F.struct("shared", "_gram"))["_gram"].alias("_gram")
    )
    candidates = (
        df.select(F.col(key), F.explode(let(fold(text), lambda t: cut_grams(t, lengths))).alias("_gram"))
        .join(rarest, "_gram")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(F.struct("rank", "name", "low"))).alias(out))
    )
    joined = df.join(candidates, key, "left")
    found = let(fold(text), lambda t: F.transform(F.filter(F.col(out), lambda c: F.contains(t, c["low"])), lambda c: c["name"]))
    found = F.coalesce(found, _array([]))
    return joined.withColumn(out, found if ignore_case else by_position(text, found))


def _array(values: list[str]) -> Column:
    if not values:
        return F.expr("cast(array() as array<string>)")
    return F.array(*[F.lit(v) for v in values])
