"""Secret scans: stated patterns, and a randomness test battery for what no pattern names.

Tokens of at least ``LEAST`` characters are read in the encoding they seem to have (hexadecimal, base 32, base 64). Three tests ask whether
their symbols look drawn at random: chi-squared for the uniformity of the alphabet, runs above and below its middle, and the correlation of
neighbours. A token that fails a test is no secret. For the others chi-squared is compared with what a text of that length would give
(letters of a text coincide more often than chance, so its distribution is non-central): that is the p-value of "this is ordinary text". The p-values of all documents
are controlled for false discoveries (Benjamini-Hochberg) within bands of length, on a histogram of their logarithms: at most ``BINS`` counts per band.
Random tokens are found in nine of ten cases from 20 characters of hexadecimal, 24 of base 64 and 48 of base 32; shorter ones of base 32 look too much like text.

Everything is built from column expressions. Positions come from the texts between matches, in code points. Two passes over the documents, no join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import let

# Patterns of the contract. The runs of 20 and 24 characters and more are its runs that do not fail.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
TOKEN = "[A-Za-z0-9+/_-]{%d,}={0,2}"
#: Alphabets by encoding, and how often two letters of a text written in it coincide (of European languages; within a-f for hexadecimal).
HEXADECIMAL, BASE32, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
COINCIDENCE = {HEXADECIMAL: 0.26, BASE32: 0.065, BASE64: 0.065}
#: A test rejects randomness below this probability; share of false discoveries.
REJECT, FALSE_SHARE = 0.001, 0.01
#: Histogram of -log10 p: bins of a tenth up to 30.
STEP, BINS = 0.1, 300
MASK = "[SECRET]"


def prefixes(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array. Chunks of its square root's size keep the work at n * sqrt(n)."""

    def chunked(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, op))
        bases = let(totals, lambda t: F.transform(t, lambda _, i: F.aggregate(F.slice(t, 1, i), zero, op)))
        return let(bases, lambda b: F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda _, j: op(F.get(b, i), F.aggregate(F.slice(c, 1, j + 1), zero, op))))))

    def of(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        chunks = let(width, lambda r: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / r).cast("int") - 1), lambda c: F.slice(a, c * r + 1, r)))
        return F.when(F.size(a) > 0, let(chunks, chunked)).otherwise(F.slice(a, 1, 0))

    return let(values, of)


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value of the group) of a pattern's matches, in code points."""

    def of(whole: Column, between: Column, value: Column) -> Column:
        steps = F.transform(whole, lambda x, k: F.length(F.get(between, k)) + F.when(k > 0, F.length(F.get(whole, k - 1))).otherwise(0))
        starts = prefixes(steps, F.lit(0), lambda a, b: a + b)
        return let(starts, lambda s: F.transform(whole, lambda x, k: F.struct(F.get(s, k).alias("start"), (F.get(s, k) + F.length(x)).alias("end"), F.get(value, k).alias("value"))))

    def found(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda w: let(F.split(t, pattern, -1), lambda b: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v: of(w, b, v))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(text, found)).otherwise(none)


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, kind, end) of each stated pattern."""
    assigned = F.filter(_places(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGNED)
    return {"assign": _spans(assigned, "assign"), "access": _spans(_places(text, ACCESS), "access"), "hex": _spans(_places(text, HEX), "hex")}


def _normal(z: Column) -> Column:
    """Lower tail of the normal distribution; its logarithm's leading term far out, so small values stay apart."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    tail = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def text_p(token: Column) -> Column:
    """Probability of ordinary text looking as random as the token; 1 if a test rejects randomness."""

    def battery(symbols: Column, alphabet: str) -> Column:
        size, coincide = len(alphabet), COINCIDENCE[alphabet]
        counts = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda a: F.length(symbols) - F.length(F.replace(symbols, F.substring(F.lit(alphabet), a, F.lit(1)), F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        values = F.transform(F.split(symbols, ""), lambda c: F.position(c, F.lit(alphabet)).cast("double"))

        def judged(v: Column, chi: Column) -> Column:
            n = F.size(v).cast("double")
            free = float(size - 1)
            uniform = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
            middle = (size + 1) / 2
            high = F.size(F.filter(v, lambda x: x > middle)).cast("double")
            low = n - high
            runs = 1 + F.size(F.filter(v, lambda x, i: (i > 0) & ((x > middle) != (F.get(v, i - 1) > middle)))).cast("double")
            mean_runs = 2 * high * low / n + 1
            spread_runs = F.sqrt(F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / (n - 1)))
            mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
            both = let(mean, lambda m: F.struct(
                F.aggregate(F.transform(v, lambda x, i: F.coalesce((x - m) * (F.get(v, i + 1) - m), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x).alias("near"),
                F.aggregate(F.transform(v, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x).alias("all"),
            ))
            serial = let(both, lambda b: b["near"] / F.greatest(F.lit(1e-9), b["all"])) * F.sqrt(n)
            limit = 3.29  # two-sided REJECT
            random = (uniform < 3.09) & (F.abs((runs - mean_runs) / spread_runs) < limit) & (F.abs(serial) < limit)
            shift = n * (size * coincide - 1)
            return F.when(random, _normal((chi - (free + shift)) / F.sqrt(2 * free + 4 * shift))).otherwise(1.0)

        return let(values, lambda v: let(size / F.length(symbols) * squares - F.length(symbols), lambda chi: judged(v, chi)))

    def of(t: Column) -> Column:
        bare = F.regexp_replace(t, "=+$", "")
        standard = F.translate(bare, "-_", "+/")
        return (
            F.when(t.rlike("^[0-9]+$"), F.lit(1.0))
            .when(t.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), let(F.lower(bare), lambda s: battery(s, HEXADECIMAL)))
            .when(t.rlike("^[A-Z2-7]+=*$"), let(bare, lambda s: battery(s, BASE32)))
            .otherwise(let(standard, lambda s: battery(s, BASE64)))
        )

    return let(token, of)


def _tokens(text: Column, least: int) -> Column:
    """Array of (start, end, band, bin) of the tokens tried."""

    def tried(x: Column) -> Column:
        bin_ = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(text_p(x["value"]), F.lit(1e-300))) / STEP).cast("int"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.floor(2 * F.log2((x["end"] - x["start"]).cast("double"))).cast("int").alias("band"), bin_.alias("bin"))

    return F.transform(_places(text, TOKEN % least), tried)


def discoveries(tokens: DataFrame, share: float) -> dict[int, int]:
    """Per band of length, the least bin that is a discovery. ``tokens`` has band and bin; the histogram is bounded."""
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("band", "bin").count().collect():
        counts.setdefault(r["band"], {})[r["bin"]] = r["count"]
    cuts = {}
    for band, bins in counts.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b * STEP) <= share * seen / total:
                cuts[band] = b
    return cuts


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, share: float = FALSE_SHARE) -> DataFrame:
    """All columns of ``docs`` and n_assign, n_access, n_hex, base_spans, secret_spans (arrays of (start, kind, end), ordered; kind numbers KINDS).

    ``secret_spans`` adds the tokens that the battery finds and no pattern touches. Null and empty texts have none; repeated rows are judged alike, and each
    counts among the tokens tried; texts of any length are read whole; no rows give none. Columns of ``docs`` named like an added one are replaced.
    """
    added = ("n_assign", "n_access", "n_hex", "base_spans", "secret_spans")
    tried = docs.select(F.explode(_tokens(F.coalesce(F.col(text_col), F.lit("")), least)).alias("x")).select("x.band", "x.bin")
    cuts = discoveries(tried, share)
    kept = [c for c in docs.columns if c.lower() not in added or c == text_col]
    # the caller's columns travel as one, so none of theirs can meet one of these
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    rows = rows.withColumns({**base, "tokens": _tokens(F.col("text"), least)}).withColumn("base_spans", F.sort_array(F.concat("assign", "access", "hex")))

    def least_bin(band: Column) -> Column:
        out = F.lit(BINS + 1)
        for k, b in sorted(cuts.items()):
            out = F.when(band == k, F.lit(b)).otherwise(out)
        return out

    def free(x: Column) -> Column:
        return ~F.exists("base_spans", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))

    new = F.filter("tokens", lambda x: (x["bin"] >= least_bin(x["band"])) & free(x))
    random = F.transform(new, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    counted = {f"n_{k}": F.size(k).cast("long") for k in KINDS[:3]}
    rows = rows.withColumns(counted | {"secret_spans": F.sort_array(F.concat("base_spans", random))})
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), *added)


def shown(found: DataFrame) -> DataFrame:
    """Adds base_sha256 and spans (kind:start:end, comma-joined)."""
    return found.withColumns({"base_sha256": F.sha2(_shown(F.col("base_spans")), 256), "spans": _shown(F.col("secret_spans"))})


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every run of spans replaced by ``mask``."""

    def of(s: Column) -> Column:
        ends = prefixes(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        fresh = let(ends, lambda e: F.filter(F.transform(s, lambda x, k: F.struct(F.coalesce(F.get(e, k - 1), F.lit(0)).alias("after"), x["start"].alias("start"))), lambda p, k: (k == 0) | (p["start"] > p["after"])))
        pieces = F.transform(fresh, lambda p: F.substring(text, p["after"] + 1, p["start"] - p["after"]))
        last = let(ends, lambda e: F.substring(text, F.element_at(e, -1) + 1, F.length(text)))
        return F.array_join(F.concat(pieces, F.array(last)), mask)

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(text)
