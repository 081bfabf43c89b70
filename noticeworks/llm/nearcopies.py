"""Near copies by word shingles: long SimHash fingerprints with Golay keys for most links, prefixes of the shingle sets for all others.

Two texts at a similarity of 0.8 differ in about an eighth of the bits of a SimHash, too many for one segment to stay equal. So a
fingerprint has ``BITS`` bits, and each of ``GROUPS`` keys takes some of its bits: 23 as a word of the Golay code, which forgives
errors, and ``EXACT`` that must be equal. A text has an index row per group (the codeword next to its segment) and about five probe rows
(the codewords within 4 bits); texts meet where an index row and a probe row of one key do. What meets is compared
by fingerprints, then by the shingles themselves, and only pairs of the asked similarity are linked.

Within a key every text is paired with one other: the least whose first 64 bits are near, among the first ``TRIED`` groups with an index row. So
these keys cost a few rows per text, whatever the size of a crowd; they link most copies into groups, but not all.

All other links are found without chance or cap. Shingles have one order, rare ones first; of two sets of the asked similarity each has a common
shingle among its first 1 - ``similarity``. Texts of different groups that meet there are compared by the places of that shingle and by the parities
of their shingles in ``PARITY`` bins: no more bins differ than shingles do, so what these rule out is no link. Of a key with many texts each gives its
nearest few; a round with more for each follows for those that have others, until none are left. Texts that were linked meanwhile are one group and need no
comparison. Such keys are compared block by block. Texts of equal words take part once. Shingle sets are cut for the texts of pairs alone: a bitmap
of fixed size tells the pass over the texts which these are, and a join confirms it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.basics import let
from noticeworks.llm import textbytes as tb
from noticeworks.llm.components import components
from noticeworks.llm.simhash import golay_indices
from noticeworks.session import cut_lineage, dealt

WORDS, SIMILARITY = 5, 0.8
#: Shingles that fingerprints are made of: shorter ones change less.
PRINT_WORDS = 3
BITS, GROUPS, SEGMENT, EXACT = 512, 4, 23, 12
#: Share of bits that two texts of the asked similarity differ in at most, all but surely.
DIFFERENT = 0.21
#: Counters that the shingles of a text are summed up in before its bits are drawn.
COUNTERS = 2048
BITMAP = 1 << 26
#: Rows of keys that one group of the pairing holds, about, and texts of a key that every other is compared with.
BUCKET = 1 << 17
TRIED = 64
#: Bits of 64 that two texts of the asked similarity differ in at most, all but surely.
SKETCH = 21


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Sign of every counter in every bit, and the bits of each group."""
    rng = np.random.default_rng(20240711)
    signs = rng.integers(0, 2, (COUNTERS, BITS)).astype(np.float32) * 2 - 1
    return signs, np.array([rng.choice(BITS, SEGMENT + EXACT, replace=False) for _ in range(GROUPS)])


class Shingles:
    """Words of the texts of a chunk, A-Z in lower case, and hashes of runs of them."""

    def __init__(self, texts: list[bytes | None]):
        words = [(t or b"").lower().split() for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        raw = b" ".join(x for w in words for x in w)
        data = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.begin = np.concatenate([[0], gaps + 1]) if len(data) else np.empty(0, np.int64)
        self.end = np.concatenate([gaps, [len(data)]]) if len(data) else np.empty(0, np.int64)
        self.hashes = tb.Hashes(data)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each run of ``size`` words; a text of fewer words, but not none, is one run."""
        n = np.where(self.counts >= size, self.counts - size + 1, np.minimum(self.counts, 1))
        text = np.repeat(np.arange(len(n)), n)
        start = self.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        last = start + np.minimum(size, self.counts[text]) - 1
        return self.hashes.of(self.begin[start], self.end[last]), text

    def prints(self) -> np.ndarray:
        """Fingerprints as rows of bytes."""
        h, text = self.of(PRINT_WORDS)
        place = text * COUNTERS + (h >> np.uint64(32)).astype(np.int64) % COUNTERS
        counters = np.bincount(place, np.where(h & np.uint64(1), 1.0, -1.0), len(self.counts) * COUNTERS).astype(np.float32)
        return np.packbits(counters.reshape(-1, COUNTERS) @ _tables()[0] > 0, axis=1)


def _words_key(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join((text or b"").lower().split()))


def _parts(batch: pa.RecordBatch, rows: int = 128, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in part.column(part.num_columns - 1)]
        for i, j in tb.slices(np.array([len(t or b"") for t in texts], np.int64), limit):
            yield part.slice(i, j - i), texts[i:j]


def _bit(bitmap, values: np.ndarray, bits: int) -> np.ndarray:
    at = values & (bits - 1)
    return (np.frombuffer(bitmap.value, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1


def _marked(batch: pa.RecordBatch, bitmap, bits: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the rows of (id hash, text) whose bit is set."""
    for a in range(0, batch.num_rows, 1024):
        part = batch.slice(a, 1024)
        yield from _parts(part.filter(pa.array(_bit(bitmap, np.asarray(part.column(0)), bits))))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit, fp) of (id, text): the unit is the hash of the words."""
    for batch in batches:
        for part, texts in _parts(batch):
            keys = np.array([_words_key(t) for t in texts], np.uint64).view(np.int64)
            prints = Shingles(texts).prints()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([p.tobytes() for p in prints], pa.binary())], names=["id", "unit", "fp"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.uint8).reshape(len(column), BITS // 8)


KEYS = "bucket int, keys binary, units binary, groups binary, sketches binary, probes binary"


def _keys(buckets: int, chosen: range):
    """Pass over (unit, group, fp): the keys of some thousand texts, in one row for each bucket; a row per key would be mostly overhead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(SEGMENT, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                of, group, prints = *(np.asarray(batch.column(c).slice(a, 2048)) for c in (0, 1)), _matrix(batch.column(2).slice(a, 2048))
                sketch = np.ascontiguousarray(prints[:, :8]).view(np.uint64).ravel()
                bits = np.unpackbits(prints, axis=1)
                keys, places_of, probes = [], [], []
                for g in chosen:
                    places = _tables()[1][g]
                    segment = bits[:, places[:SEGMENT]].astype(np.int64) @ weights
                    same = bits[:, places[SEGMENT:]].astype(np.int64) @ weights[:EXACT]
                    nearest, row, index = golay_indices(segment)
                    base = (np.int64(g) << 32) | (same << 12)
                    keys += [base | nearest, base[row] | index]
                    places_of += [np.arange(len(of)), row]
                    probes.append(np.repeat([False, True], [len(of), len(row)]))
                key = tb.mixed(np.concatenate(keys).astype(np.uint64))
                bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                at = np.concatenate(places_of)[order]
                which, begins = np.unique(bucket[order], return_index=True)
                ends = [*begins[1:].tolist(), len(key)]
                columns = (key[order], of[at], group[at], sketch[at], np.concatenate(probes)[order])
                parts = [[x[i:j].tobytes() for i, j in zip(begins.tolist(), ends, strict=True)] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "keys", "units", "groups", "sketches", "probes"])

    return run


def _paired(rows: pa.Table) -> pa.Table:
    """Pairs (a < b) of one bucket: of each key, every text with the least index text of another group and a near sketch, or, where too many groups would have to be tried, with the least."""
    kinds = (("keys", np.uint64), ("units", np.int64), ("groups", np.int64), ("sketches", np.uint64), ("probes", bool))
    key, unit, group, sketch, probe = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in kinds)
    order = np.lexsort((unit, group, probe, key))  # of a key, index rows come first, by group
    key, unit, group, sketch, probe = key[order], unit[order], group[order], sketch[order], probe[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(key)]]))
    heads = ~probe  # the first index row of each group
    heads[1:] &= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    place = np.flatnonzero(heads)
    first, tries = np.repeat(np.searchsorted(place, begins), sizes), np.repeat(np.add.reduceat(heads, begins), sizes)
    left, parts = np.flatnonzero(np.repeat(sizes, sizes) > 1), []
    for k in range(TRIED):
        left = left[tries[left] > k]
        if not len(left):
            break
        other = place[first[left] + k]
        near = (group[other] != group[left]) & (np.bitwise_count(sketch[other] ^ sketch[left]) <= SKETCH)
        parts.append(np.stack([unit[other[near]], unit[left[near]], np.zeros(near.sum(), np.int64)]))
        left = left[~near]
    left = left[tries[left] > TRIED]
    left = left[group[place[first[left]]] != group[left]]
    parts.append(np.stack([unit[place[first[left]]], unit[left], np.ones(len(left), np.int64)]))
    x, y, crowd = np.concatenate(parts, axis=1)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), crowd]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1], "crowd": pairs[2]})


def _apart(fp_a: str, fp_b: str, most: float):
    """Pass over pairs with fingerprints that keeps those that differ in at most a share of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = np.bitwise_count(_matrix(batch.column(fp_a)) ^ _matrix(batch.column(fp_b))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(differ <= most * BITS))

    return run


def _sets(bitmap, bits: int, words: int):
    """Pass over (id hash, text): (unit, shingles) of the texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _marked(batch, bitmap, bits):
                keys = np.array([_words_key(t) for t in texts], np.uint64).view(np.int64)
                h, text = Shingles(texts).of(words)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                sets = [np.unique(h[a:e]).view(np.int64) for a, e in zip(cut, cut[1:], strict=False)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["unit", "shingles"])

    return run


def _alike(similarity: float) -> F.Column:
    """Whether the sets sa and sb are similar enough; the sizes alone rule out most."""
    x, y = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return F.when(F.least(x, y) >= similarity * F.greatest(x, y), let(both, lambda n: (n > 0) & (n >= similarity * (x + y - n)))).otherwise(False)


def _set_bits(keys: DataFrame, bits: int) -> bytes:
    """Bitmap of the column ``bit`` below ``bits``: at most bits / 8 bytes, put together by Spark."""
    found = bytearray(max(bits // 8, 4096))
    for r in keys.groupBy(F.shiftright("bit", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m")).collect():
        found[r["b"] << 12 : (r["b"] + 1) << 12] = r["m"]
    return bytes(found)


#: Bins of the parities of a shingle set.
PARITY = 1024
#: Units whose shingles are counted (one in so many), and how many of these make a shingle a frequent one; the order of the shingles alone depends on it.
COUNTED, FREQUENT = 32, 3
#: Texts that a key may have to be joined with itself.
FEW = 64
#: Partners that a text of a larger key gives in the first round; ``MORE`` times as many in each further one.
NEAREST, MORE = 4, 8
#: Texts of a key that are compared in one group, and rows of one group, about.
BLOCK, ROWS = 8192, 1 << 13
#: A distance beyond all others.
FAR = PARITY + 1


def _common(x, y, similarity: float):
    """Least number of common shingles of sets of sizes x and y that are similar enough."""
    return np.maximum(1, np.ceil(similarity / (1 + similarity) * (x + y) - 1e-6)).astype(np.int64)


def _once(texts: list[bytes | None], words: int, often=lambda h: np.zeros(len(h))) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different shingles of each text, by ``often`` and hash."""
    h, text = Shingles(texts).of(words)
    order = np.lexsort((h, often(h), text))
    h, text = h[order], text[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]
    return h[once], text[once]


def _counted(words: int):
    """Pass over (text): the shingles of one in ``COUNTED`` units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _parts(batch):
                h, _ = _once([t for t in texts if tb.mixed(np.uint64(_words_key(t))) % np.uint64(COUNTED) == 0], words)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["shingle"])

    return run


def _prefixes(chosen, frequent, bits: int, words: int, similarity: float):
    """Pass over (id hash, text): of the texts whose bit is set, as many of the first shingles as may all be missing in a similar set, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _marked(batch, chosen, bits):
                keys = np.array([_words_key(t) for t in texts], np.uint64).view(np.int64)
                h, text = _once(texts, words, lambda h: _bit(frequent, h.view(np.int64), bits))
                size = np.bincount(text, minlength=len(texts))
                place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
                taken = place <= (size - np.maximum(1, np.ceil(similarity * size - 1e-6)))[text]
                h, text, place = h[taken], text[taken], place[taken]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[text]), pa.array(size[text], pa.int32()), pa.array(place, pa.int32())], names=["key", "unit", "size", "place"])

    return run


def _parities(wanted, bits: int, words: int):
    """Pass over (id hash, text): (unit, parities of the bins of its shingles) of the texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _marked(batch, wanted, bits):
                keys = np.array([_words_key(t) for t in texts], np.uint64).view(np.int64)
                h, text = _once(texts, words)
                parity = np.bincount(text * PARITY + (h >> np.uint64(20)).astype(np.int64) % PARITY, minlength=len(texts) * PARITY) & 1
                packed = np.packbits(parity.astype(np.uint8).reshape(-1, PARITY), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in packed], pa.binary())], names=["unit", "parities"])

    return run


def _bins(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), PARITY // 64)


def _few_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that differ in no more bins than shingles may differ."""
    for batch in batches:
        if batch.num_rows:
            differ = np.bitwise_count(_bins(batch.column("pa")) ^ _bins(batch.column("pb"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= np.asarray(batch.column("most"))))


def _possible(nearest: int, similarity: float):
    """Pairs (a < b) of the keys of one group that may be similar: of each text the ``nearest`` of other groups. A pair that is left has two texts that are also given as (a, a)."""

    def run(rows: pa.Table) -> pa.Table:
        run_of, unit, group, size, place, side = (rows[c].to_numpy() for c in ("run", "unit", "group", "size", "place", "side"))
        size, place = size.astype(np.int64), place.astype(np.int64)
        sketch = _bins(rows["parities"])
        order = np.lexsort((unit, side, run_of))
        run_of, unit, group, size, place, side, sketch = (x[order] for x in (run_of, unit, group, size, place, side, sketch))
        begins = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
        ends = np.concatenate([begins[1:], [len(unit)]])

        def apart(i, j):
            """Bins that rows i and j differ in, ``FAR`` where they cannot be similar."""
            out = np.full(len(i), FAR, np.int16)
            at = np.flatnonzero((group[i] != group[j]) & ((side[i] != side[j]) | (side[i] == 0)))
            x, y = size[i[at]], size[j[at]]
            least = _common(x, y, similarity)
            ok = np.minimum(x - place[i[at]], y - place[j[at]]) >= least
            at, most = at[ok], (x + y - 2 * least)[ok]
            for k in range(0, len(at), 1 << 14):
                p = at[k : k + (1 << 14)]
                d = np.bitwise_count(sketch[i[p]] ^ sketch[j[p]]).sum(axis=1, dtype=np.int64)
                out[p] = np.where(d <= most[k : k + (1 << 14)], d, FAR)
            return out

        pairs = [np.empty((2, 0), np.int64)]
        for a, e in zip(begins.tolist(), ends.tolist(), strict=True):
            m = a + int((side[a:e] < 2).sum())
            for first, last, others in ((a, e, (a, e)),) if side[a] == 0 else ((a, m, (m, e)), (m, e, (a, m))):
                n = others[1] - others[0]
                step = max(1, (1 << 16) // max(1, n))
                for s in range(first, last if n else first, step):
                    i = np.arange(s, min(s + step, last))
                    d = apart(np.repeat(i, n), np.tile(np.arange(*others), len(i))).reshape(len(i), n)
                    best = np.argpartition(d, min(nearest, n) - 1, axis=1)[:, :nearest]
                    r, c = np.nonzero(np.take_along_axis(d, best, axis=1) < FAR)
                    more = unit[i[(d < FAR).sum(axis=1) > nearest]]
                    pairs += [np.stack([unit[i[r]], unit[others[0] + best[r, c]]]), np.stack([more, more])]
        x, y = np.concatenate(pairs, axis=1)
        out = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.table({"a": out[0], "b": out[1]})

    return run


def _other_links(spark, rows: DataFrame, units: DataFrame, links: DataFrame, words: int, similarity: float, bitmap_bits: int) -> DataFrame:
    """``links`` and others that join all groups with a link between them."""

    def bitmap(rows: DataFrame, column: str):
        return spark.sparkContext.broadcast(_set_bits(rows.select(F.col(column).bitwiseAND(bitmap_bits - 1).alias("bit")), bitmap_bits))

    def in_groups(rows: DataFrame) -> DataFrame:
        return rows.join(components(links).withColumnRenamed("node", "unit"), "unit", "left").withColumn("group", F.coalesce("root", "unit")).drop("root")

    texts = rows.select(F.xxhash64("id").alias("one"), "t")
    frequent = bitmap(texts.select("t").mapInArrow(_counted(words), "shingle long").groupBy("shingle").count().filter(F.col("count") >= FREQUENT), "shingle")
    places = texts.mapInArrow(_prefixes(bitmap(units, "one"), frequent, bitmap_bits, words, similarity), "key long, unit long, size int, place int")
    places = places.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    places = cut_lineage(places.filter("n > 1").distinct())
    x = in_groups(places.filter(F.col("n") <= FEW)).drop("n")
    y = x.toDF(*(c if c == "key" else f"{c}2" for c in x.columns))
    least = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-6))
    met = x.join(y, "key").filter((F.col("unit") < F.col("unit2")) & (F.col("group") != F.col("group2")) & (F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")) >= least))
    met = cut_lineage(met.select(F.col("unit").alias("a"), F.col("unit2").alias("b"), (F.col("size") + F.col("size2") - 2 * least).cast("long").alias("most")).distinct())
    large = places.filter(F.col("n") > FEW).drop("n")
    wanted = cut_lineage(units.join(met.select(F.col("a").alias("unit")).union(met.select("b")).union(large.select("unit")).distinct(), "unit", "left_semi").select("unit", "one"))
    parities = texts.mapInArrow(_parities(bitmap(wanted, "one"), bitmap_bits, words), "unit long, parities binary")
    parities = cut_lineage(parities.join(wanted, "unit", "left_semi").groupBy("unit").agg(F.first("parities").alias("parities")))
    of = {s: parities.select(F.col("unit").alias(s), F.col("parities").alias(f"p{s}")) for s in "ab"}
    short = met.join(of["a"], "a").join(of["b"], "b").mapInArrow(_few_bins, "a long, b long")
    nearest = NEAREST
    while True:
        grouped = cut_lineage(in_groups(large))
        keys = grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y")
        keys = cut_lineage(keys.select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        total = keys.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
        dealing = grouped.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("unit"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        dealing = dealing.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("run"), "unit", "group", "size", "place", side.alias("side"))
        dealing = dealt(dealing.join(parities, "unit").withColumn("bucket", F.pmod("run", F.lit(max(1, total // ROWS)))), "bucket")
        possible = cut_lineage(dealing.groupBy("bucket").applyInArrow(_possible(nearest, similarity), "a long, b long").distinct())
        pairs = possible.filter("a <> b")
        near = cut_lineage(pairs.union(short).distinct()) if nearest == NEAREST else pairs
        links = cut_lineage(links.union(_similar(spark, rows, units, near, words, similarity, bitmap_bits)))
        more = possible.filter("a = b").select(F.col("a").alias("unit"))
        if more.isEmpty():
            return links
        large = cut_lineage(large.join(more, "unit", "left_semi"))
        nearest *= MORE


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, different: float = DIFFERENT, bitmap_bits: int = BITMAP) -> DataFrame:
    """Per row of ``docs``: id_col and component_id, the smallest id reachable over links of similar texts.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles (lower case A-Z; fewer words: the whole sequence) is at least
    ``similarity``; the groups are exact. Texts of equal words are always linked, so are all
    without words. Null ids are linked, but never name a component. Repeated rows keep a row each; no rows give none. Only the
    two named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = cut_lineage(rows.mapInArrow(_units, f"id {kind}, unit long, fp binary"))
    # rows of one unit have one fingerprint; the least id stands for it
    units = cut_lineage(prints.groupBy("unit").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.min(F.xxhash64("id")).alias("one")))
    links = _links(spark, rows, units, words, similarity, different, bitmap_bits)
    named = units.select("unit", "least").join(components(links).withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(named.join(names, "root").select("unit", "component_id"))
    return prints.select("id", "unit").join(labels, "unit").select(F.col("id").alias(id_col), "component_id")


def _links(spark, rows: DataFrame, units: DataFrame, words: int, similarity: float, different: float, bitmap_bits: int) -> DataFrame:
    """Links (a, b) of similar units."""
    prints = {s: units.select(F.col("unit").alias(s), F.col("fp").alias(f"fp_{s}")) for s in "ab"}
    keys = units.select("unit", F.col("unit").alias("group"), "fp").mapInArrow(_keys(max(1, units.count() * GROUPS * 7 // BUCKET), range(GROUPS)), KEYS)
    met = cut_lineage(keys.groupBy("bucket").applyInArrow(_paired, "a long, b long, crowd long").select("a", "b").distinct())
    near = cut_lineage(met.join(prints["a"], "a").join(prints["b"], "b").mapInArrow(_apart("fp_a", "fp_b", different), "a long, b long"))
    return _other_links(spark, rows, units, _similar(spark, rows, units, near, words, similarity, bitmap_bits), words, similarity, bitmap_bits)


def _similar(spark, rows: DataFrame, units: DataFrame, near: DataFrame, words: int, similarity: float, bitmap_bits: int) -> DataFrame:
    """Pairs of ``near`` whose shingle sets are similar enough."""
    wanted = near.select(F.col("a").alias("unit")).union(near.select("b")).distinct()
    bit = F.col("one").bitwiseAND(bitmap_bits - 1)
    bitmap = spark.sparkContext.broadcast(_set_bits(units.join(wanted, "unit", "left_semi").select(bit.alias("bit")), bitmap_bits))
    sets = rows.select(F.xxhash64("id").alias("one"), "t").mapInArrow(_sets(bitmap, bitmap_bits, words), "unit long, shingles array<long>")
    sets = cut_lineage(sets.join(wanted, "unit", "left_semi").groupBy("unit").agg(F.first("shingles").alias("s")))
    held = {s: sets.select(F.col("unit").alias(s), F.col("s").alias(f"s{s}")) for s in "ab"}
    return cut_lineage(near.join(held["a"], "a").join(held["b"], "b").filter(_alike(similarity)).select("a", "b"))
