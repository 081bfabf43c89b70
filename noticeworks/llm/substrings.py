"""Removal of repeated substrings: suffixes sorted bucket by bucket behind a difference-cover sample.

The cover holds, for any two positions of equal text, a shift after which both are sampled. So a string of ``window``
bytes that occurs twice has a sampled string that occurs twice. That gives three passes over blocks of
documents, each block a range of ids (and of text hashes within one) of at most ``BLOCK`` bytes, or one text:

1. every block names its sampled strings (numbers without repeats, a run of 4-byte names per name bucket); one bucket at a
   time is sorted, and a bit per name returns to the block: occurs again or not;
2. suffixes with a sampled string within the window that occurs again are the only ones to be sorted. A block names their first
   ``window`` bytes (7 bytes and the bucket, once per block), and one bucket at a time is sorted by name and block; a bit per name returns: an
   earlier block has it or not;
3. a block marks the suffixes with an earlier equal one, and removes what they cover.

Names are 64-bit hashes instead of ranks: to resolve ties among suffixes of this length by ranks, the byte strings would have to
be shuffled (over ten times the input). What is held at once is a block or a bucket. A text that occurs as a whole in several
documents takes part once; the later copies are removed whole.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb
from noticeworks.session import cut_lineage

WINDOW = 100
#: Bytes of text of a block, names of a bucket.
BLOCK = 2 << 20
BUCKET = 4 << 20
#: (modulus, multiplier, seeds): the seeds' orbits under the multiplier are a perfect difference cover of the modulus.
COVERS = ((57, 7, (0, 38, 1, 5)), (13, 3, (0, 1)), (7, 2, (1,)), (1, 1, (0,)))
LEAST_NAMED = 8

MESSAGE = "block int, bucket int, id long, key long, bits binary"
NAMES = "block int, bucket int, names binary, many binary"


def difference_cover(window: int) -> tuple[int, np.ndarray]:
    """(modulus, mask of its residues) of the sparsest cover that leaves ``LEAST_NAMED`` bytes to name."""
    modulus, multiplier, seeds = next(c for c in COVERS if window - c[0] + 1 >= LEAST_NAMED or c[0] == 1)
    mask = np.zeros(modulus, bool)
    for x in seeds:
        while not mask[x]:
            mask[x] = True
            x = x * multiplier % modulus
    return modulus, mask


def _deal(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit name, by its upper half."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(names: np.ndarray, width: int) -> bytes:
    """Lower ``width`` bytes of ascending 64-bit names, byte by byte: the first plane hardly changes, and the shuffle compresses it."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, width - 1 :: -1].T.tobytes()


def _names(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, width - 1 :: -1] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _runs(deal: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of an ascending array."""
    which, begin = np.unique(deal, return_index=True)
    return list(zip(which.tolist(), begin.tolist(), [*begin[1:].tolist(), len(deal)], strict=False))


class Block:
    """The documents of a block that take part, ordered by id, and what the passes derive from them."""

    def __init__(self, docs: pa.Table, messages: pa.Table, window: int):
        gone = {(r["id"], r["key"]) for r in messages.filter(pc.equal(messages["bucket"], -1)).select(["id", "key"]).to_pylist()}
        ids, keys = docs["id"].to_pylist(), docs["key"].to_pylist()
        one = {(i, k): n for n, (i, k) in enumerate(zip(ids, keys, strict=True)) if (i, k) not in gone}
        order = sorted(one, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        self.ids, self.keys, self.window = [i for i, _ in order], [k for _, k in order], window
        unpack, packed = zstandard.ZstdDecompressor().decompress, docs["packed"]
        texts = [unpack(packed[one[x]].as_buffer()) for x in order]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        del texts
        self.lengths = np.repeat(np.diff(self.starts).astype(np.int32), np.diff(self.starts))
        self.room = (np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(self.data))).astype(np.int32)
        self.hashes = tb.Hashes(self.data)

    def sample(self, buckets: int) -> None:
        """Names of the sampled strings: position, bucket and 4-byte name, and their numbering."""
        modulus, mask = difference_cover(self.window)
        named = self.window - modulus + 1
        fits = np.flatnonzero(self.room >= named)
        self.at = fits[mask[(self.lengths[fits] - self.room[fits]) % modulus]]
        names = self.hashes.of(self.at, self.at + named)
        packed = (_deal(names, buckets).astype(np.uint64) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))
        self.names, self.number, self.times = np.unique(packed, return_inverse=True, return_counts=True)

    def candidates(self, again: np.ndarray, buckets: int) -> None:
        """Suffixes with a sampled string that occurs again, and the names of their first bytes."""
        modulus, _ = difference_cover(self.window)
        repeated = np.zeros(len(self.data) + 1, np.int32)
        repeated[self.at + 1] = again[self.number]
        np.cumsum(repeated, out=repeated)
        start = np.flatnonzero(self.room >= self.window)
        self.suffix = start[repeated[start + modulus] > repeated[start]]
        del self.at, self.names, self.number, self.times, self.room, self.lengths, repeated, start
        windows, first, same = np.unique(self.hashes.of(self.suffix, self.suffix + self.window), return_index=True, return_inverse=True)
        del self.hashes
        # the bucket comes from a second hash, so it adds to the 7 bytes that are sent
        begin = self.suffix[first]
        deal = _deal(tb.Hashes(self.data, 1).of(begin, begin + self.window), buckets)
        order = np.argsort(deal.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.windows, self.first, self.same, self.deal = windows[order], first[order], place[same], deal[order]

    def removed(self, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the removed bytes, and of those that begin a run."""
        later = np.ones(len(self.suffix), bool)
        later[self.first] = False
        start = self.suffix[later | earlier[self.same]]
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[start] += 1
        np.add.at(edge, start + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        if len(gone):
            begins[1:] &= ~gone[:-1]
            inner = self.starts[1:-1][self.starts[1:-1] < len(gone)]
            begins[inner] = gone[inner]
        return gone, begins


def _bits(messages: pa.Table, names_of: np.ndarray, tag: int) -> np.ndarray:
    """Bits that buckets returned, in the order of the names. Buckets of the second sort are numbered from ``tag``."""
    out = np.zeros(len(names_of), bool)
    found = {m["bucket"] - tag: m["bits"] for m in messages.select(["bucket", "bits"]).to_pylist() if m["bits"] is not None and (m["bucket"] >= _SECOND) == (tag > 0)}
    for b, a, e in _runs(names_of):
        out[a:e] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=e - a).astype(bool)
    return out


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


_SECOND = 1 << 30


def _passes(window: int, buckets: int) -> tuple[Callable, Callable, Callable]:
    def emitted(block: int, deal: np.ndarray, names: np.ndarray, width: int, many: np.ndarray | None) -> pa.Table:
        return _table(NAMES, [(block, b, _planes(names[a:e], width), None if many is None else np.packbits(many[a:e]).tobytes()) for b, a, e in _runs(deal)])

    def prepared(docs: pa.Table, messages: pa.Table) -> Block:
        block = Block(docs, messages, window)
        block.sample(buckets)
        return block

    def sampled(block: Block) -> np.ndarray:
        return (block.names >> np.uint64(32)).astype(np.int64)

    def first(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(NAMES, [])
        block = prepared(docs, messages)
        return emitted(docs["block"][0].as_py(), sampled(block), block.names, 4, block.times > 1)

    def second(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(NAMES, [])
        block = prepared(docs, messages)
        block.candidates(_bits(messages, sampled(block), 0), buckets)
        return emitted(docs["block"][0].as_py(), block.deal, block.windows, 7, None)

    def third(docs: pa.Table, messages: pa.Table) -> pa.Table:
        schema = "id long, key long, n_removed long, n_spans long, kept binary"
        if not docs.num_rows:
            return _table(schema, [])
        block = prepared(docs, messages)
        block.candidates(_bits(messages, sampled(block), 0), buckets)
        gone, begins = block.removed(_bits(messages, block.deal, _SECOND))
        n_gone, n_runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        rows = []
        for i, k, a, e in zip(block.ids, block.keys, block.starts.tolist(), block.starts[1:].tolist(), strict=False):
            rows.append((i, k, int(n_gone[e] - n_gone[a]), int(n_runs[e] - n_runs[a]), block.data[a:e][~gone[a:e]].tobytes()))
        return _table(schema, rows)

    return first, second, third


def _again(names: pa.Table) -> pa.Table:
    """One name bucket: which names occur in two blocks, or more than once in one."""
    rows = names.to_pylist()
    parts = [_names(r["names"], 4).astype(np.uint32) for r in rows]
    many = [np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)]
    whole = np.concatenate(parts)
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    flag = np.concatenate(many).astype(bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return _answers(rows, parts, flag, 0)


def _earlier(names: pa.Table) -> pa.Table:
    """One suffix bucket: which names an earlier block has too."""
    rows = sorted(names.to_pylist(), key=lambda r: r["block"])
    parts = [_names(r["names"], 7) for r in rows]
    whole = np.concatenate(parts)
    order = np.argsort(whole, kind="stable")
    flag = np.zeros(len(whole), bool)
    flag[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    return _answers(rows, parts, flag, _SECOND)


def _answers(rows: list[dict], parts: list[np.ndarray], flag: np.ndarray, tag: int) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return _table(MESSAGE, [(r["block"], r["bucket"] + tag, None, None, np.packbits(flag[a:e]).tobytes()) for r, a, e in zip(rows, [0, *ends], ends, strict=False)])


def _pieces(piece_bytes: int) -> Callable:
    """Pass over sorted (known, id, key, n_bytes): first place and bytes of each run of documents of at most ``piece_bytes``, or of one document."""

    def run(batches):
        starts, sizes = [], []
        for batch in batches:
            for *place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not sizes or sizes[-1] + n > piece_bytes:
                    starts.append(place)
                    sizes.append(0)
                sizes[-1] += n
        known, ids, keys = zip(*starts, strict=True) if starts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.bool_()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["known", "id", "key", "n_bytes"])

    return run


def block_bounds(documents: DataFrame, block_bytes: int) -> list[tuple[bool, int, int]]:
    """Places (known, id, key) at which blocks after the first begin: each holds at most ``block_bytes``, or one document.

    ``documents`` has distinct (id, key) and n_bytes. Every range of places is cut into pieces on its own; the driver only joins neighbours.
    """
    placed = documents.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "key", "n_bytes")
    ranges = placed.repartitionByRange("known", "id", "key").sortWithinPartitions("known", "id", "key")
    bounds, held = [], None
    for *place, n in sorted(map(tuple, ranges.mapInArrow(_pieces(max(1, block_bytes // 8)), "known boolean, id long, key long, n_bytes long").collect())):
        if held is not None and held + n <= block_bytes:
            held += n
        else:
            if held is not None:
                bounds.append(tuple(place))
            held = n
    return bounds


def _dealt(bounds: list[tuple[bool, int, int]], packed: bool) -> Callable:
    """Pass over (id, key, text) or (id, key) that adds the block of the document, and compresses each text for the shuffle, once in a batch."""

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(one := {x: n for n, x in enumerate(places)}) < len(places):
                batch, places = batch.take(pa.array(list(one.values()), pa.int64())), list(one)
            blocks = pa.array([bisect.bisect_right(bounds, (i is not None, i or 0, k)) for i, k in places], pa.int32())
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                columns = [blocks.slice(a, 512), part.column(0), part.column(1)]
                if packed:
                    columns.append(pa.array([compressor.compress(v.as_buffer()) for v in part.column(2)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "key", "packed"][: len(columns)])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: bool = True, block_bytes: int = BLOCK, bucket_names: int = BUCKET) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans (runs), kept_sha256 (of the rest), and ``kept`` (bytes, if asked for).

    Removes every byte covered by a ``window``-byte string that also starts earlier: in a document of a smaller id, or before in the
    same one. Null ids come first; documents of one id are ordered by a hash of their texts; rows that repeat an id and
    its text are one document, and each gets its result. Null and empty texts have 0 bytes; texts shorter than the window stay whole; no
    rows give none. ids are integers. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    short = F.when(size < window, F.col("text").cast("binary"))
    light = cut_lineage(rows.select("id", "key", size.alias("n_bytes"), F.when(size >= window, F.md5("text")).alias("digest"), short.alias("short")))
    times = light.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "key")).alias("o"), F.count("*").alias("times"))
    # written, so that the join by digest can split a hot one
    owner = cut_lineage(times.filter("times > 1").drop("times"))
    copies = light.join(owner, "digest").filter(~F.col("id").eqNullSafe(F.col("o.id"))).select("id", "key").distinct()
    total = light.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_names // 2))
    bounds = []
    if total > block_bytes:
        bounds = block_bounds(light.filter("digest is not null").groupBy("id", "key").agg(F.max("n_bytes").alias("n_bytes")), block_bytes)
    texts = rows.filter(size >= window).select("id", "key", "text").mapInArrow(_dealt(bounds, True), "block int, id long, key long, packed binary").groupBy("block")
    gone = copies.mapInArrow(_dealt(bounds, False), "block int, id long, key long")
    gone = cut_lineage(gone.select("block", F.lit(-1).alias("bucket"), "id", "key", F.lit(None).cast("binary").alias("bits")))
    first, second, third = _passes(window, buckets)
    # One plan without cuts: all three passes read the one shuffle of the texts.
    again = texts.cogroup(gone.groupBy("block")).applyInArrow(first, NAMES).groupBy("bucket").applyInArrow(_again, MESSAGE)
    told = gone.union(again)
    earlier = texts.cogroup(told.groupBy("block")).applyInArrow(second, NAMES).groupBy("bucket").applyInArrow(_earlier, MESSAGE)
    done = texts.cogroup(told.union(earlier).groupBy("block")).applyInArrow(third, "id long, key long, n_removed long, n_spans long, kept binary")
    done = done.withColumn("kept_sha256", F.sha2("kept", 256))
    if not keep:
        done = done.drop("kept")
    same = [light[c].eqNullSafe(done[c]) for c in ("id", "key")]
    nothing = F.lit("").cast("binary")
    out = light.join(done, same, "left").select(
        light["id"].alias(id_col),
        "n_bytes",
        F.when(F.col("n_bytes") < window, 0).otherwise(F.coalesce("n_removed", "n_bytes")).alias("n_removed"),
        F.when(F.col("n_bytes") < window, 0).otherwise(F.coalesce("n_spans", F.lit(1))).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(F.coalesce("short", nothing), 256)).alias("kept_sha256"),
        *([F.coalesce("kept", "short", nothing).alias("kept")] if keep else []),
    )
    return out


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests; ids are distinct."""
    seen, out = set(), []
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out
