"""Removal of passages that other documents have too: repeated-phrase automata, one for each block of documents.

A window is ``window`` consecutive words. Every window has an anchor: the run of words in it whose hash is least. Windows of equal
words have equal anchors, so passages that recur are found from a sixteenth of the positions:

1. each block of documents tells its anchors; those of two documents go back to the blocks that have them;
2. windows with such an anchor are the only ones that are told by name. Of a name in two documents the first place owns it, which
   confirms the passage; the pieces of text that hold owned windows are cut from their documents and sent to the blocks that have the name;
3. each block compiles the phrases of its pieces into an Aho-Corasick automaton (half a window long, so each window of a piece holds
   one), streams all its documents through it, and where a phrase occurs compares the words of the windows around it with the piece.

So the automata are sharded by the documents that need them: what one compiles and what it reads both follow the block, and the
work is linear in the text. A block names each anchor and window once, so a passage in a third of all documents is one slim row per block.
Names are 64-bit hashes; what is removed is compared word by word, so a clash can only hide a window (one in 10**19 per pair).

A text that occurs as a whole in several documents takes part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb
from noticeworks.session import cut_lineage

WINDOW = 50
#: Bytes of text of a block, on average; one text may be longer.
BLOCK = 2 << 20
#: Order of a null id: before all others.
FIRST = -(1 << 63)


def anchor_words(window: int) -> int:
    return max(1, window * 2 // 5)


def phrase_words(window: int) -> int:
    """Each ``window`` words of a piece hold a phrase that begins at a multiple of this length."""
    return max(1, window // 2)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Texts:
    """Texts of words with one space between them: bytes, word ranges, and the text of each word."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        edges = np.array([0], np.int64) if texts else np.empty(0, np.int64)
        self.begin = np.concatenate([edges, gaps + 1])
        self.end = np.concatenate([gaps, edges + len(self.data)])
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.begin, np.concatenate([[0], np.cumsum(sizes)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = tb.Hashes(self.data)

    def runs(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word that has so many after it, also across texts."""
        n = max(0, len(self.begin) - width + 1)
        return self.hashes.of(self.begin[:n], self.end[len(self.end) - n :])

    def whole(self, width: int) -> np.ndarray:
        """Which of these runs lie in one text."""
        n = max(0, len(self.begin) - width + 1)
        return self.text[:n] == self.text[len(self.text) - n :]


class Block(Texts):
    """Documents of a block that take part, by rank, and the rank of each."""

    def __init__(self, docs: pa.Table, gone: set[tuple[int, bytes]]):
        unpack = zstandard.ZstdDecompressor().decompress
        one = {}
        for rank, digest, packed in zip(docs["rank"].to_pylist(), docs["digest"].to_pylist(), docs["packed"], strict=True):
            if (rank, digest) not in gone:
                one.setdefault((rank, digest), packed)
        self.keys = sorted(one)
        super().__init__([unpack(one[k].as_buffer()) for k in self.keys])
        self.rank = np.array([r for r, _ in self.keys], np.int64)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of each window, and which windows lie in one text."""
        k = anchor_words(window)
        return least_of(self.runs(k), window - k + 1), self.whole(window)


def _firsts(names: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each name, and whether it has several ranks. Ranks ascend."""
    order = np.argsort(names, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]])) if len(names) else np.empty(0, np.int64)
    last = np.concatenate([begins[1:], [len(names)]]) - 1 if len(names) else begins
    return order[begins], ranks[order[begins]] != ranks[order[last]]


def _gone(messages: pa.Table) -> set[tuple[int, bytes]]:
    """Copies of texts that an earlier document has as a whole."""
    mask = pc.is_null(messages["anchor"])
    told = messages.filter(pc.and_(mask, pc.is_null(messages["piece"])))
    return set(zip(told["rank"].to_pylist(), told["words"].to_pylist(), strict=True))


def _arrow(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip((x.split() for x in schema.split(", ")), columns, strict=True)})


NAMES = "name long, rank long, block int, piece int, several int"
PIECES = "block int, piece int, rank long, words binary"


def _passes(window: int, keep: bool) -> tuple[Callable, Callable, Callable, Callable]:
    def named(number: int, block: Block, names: np.ndarray, at: np.ndarray) -> pa.Table:
        """Each of the ``names`` at the words ``at``, once."""
        ranks = block.rank[block.text[at]]
        first, several = _firsts(names, ranks)
        begin = block.first[block.text[at[first]]]
        piece = at[first] - (at[first] - begin) % (window + 1)  # every window + 1 words a piece of 2 * window begins
        return _arrow(NAMES, names[first].view(np.int64), ranks[first], np.full(len(first), number), piece, several)

    def tell_anchors(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow(NAMES, [], [], [], [], [])
        block = Block(docs, _gone(messages))
        anchors, whole = block.anchors(window)
        at = np.flatnonzero(whole)
        if len(at):  # neighbours mostly share one
            at = at[np.concatenate([[True], (np.diff(anchors[at]) != 0) | (np.diff(block.text[at]) != 0)])]
        return named(docs["block"][0].as_py(), block, anchors[at], at)

    def tell_windows(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow(NAMES, [], [], [], [], [])
        block = Block(docs, _gone(messages))
        anchors, whole = block.anchors(window)
        known = np.sort(messages["anchor"].drop_null().to_numpy().view(np.uint64))
        if not len(known):
            return _arrow(NAMES, [], [], [], [], [])
        near = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
        at = np.flatnonzero(whole & (known[near] == anchors))
        return named(docs["block"][0].as_py(), block, block.runs(window)[at], at)

    def cut_pieces(docs: pa.Table, messages: pa.Table) -> pa.Table:
        starts = np.unique(messages["piece"].drop_null().to_numpy())
        if not docs.num_rows or not len(starts):
            return _arrow(PIECES, [], [], [], [])
        block = Block(docs, _gone(messages))
        number, text = docs["block"][0].as_py(), block.text[starts]
        last = np.minimum(starts + 2 * window, block.first[text + 1]) - 1
        words = [block.raw[a:e] for a, e in zip(block.begin[starts].tolist(), block.end[last].tolist(), strict=True)]
        return _arrow(PIECES, np.full(len(starts), number), starts, block.rank[text], words)

    def remove(docs: pa.Table, messages: pa.Table) -> pa.Table:
        schema = "rank long, digest binary, n_words long, n_removed long, kept binary"
        if not docs.num_rows:
            return _arrow(schema, [], [], [], [], [])
        block = Block(docs, _gone(messages))
        pieces = messages.filter(pc.is_valid(messages["piece"]))
        gone = removed_words(block, pieces["rank"].to_numpy(), pieces["words"].to_pylist(), window)
        out = []
        for t, (rank, digest) in enumerate(block.keys):
            a, e = int(block.first[t]), int(block.first[t + 1])
            left = np.flatnonzero(~gone[a:e]) + a
            kept = b" ".join(block.raw[i:j] for i, j in _stretches(block, left))
            out.append((rank, digest, e - a, e - a - len(left), kept if keep else hashlib.sha256(kept).hexdigest().encode()))
        return _arrow(schema, *zip(*out, strict=True)) if out else _arrow(schema, [], [], [], [], [])

    return tell_anchors, tell_windows, cut_pieces, remove


def _stretches(block: Texts, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of the runs of consecutive ``words``."""
    if len(words):
        cut = np.flatnonzero(np.diff(words) != 1)
        first, last = words[np.concatenate([[0], cut + 1])], words[np.concatenate([cut, [len(words) - 1]])]
        yield from zip(block.begin[first].tolist(), block.end[last].tolist(), strict=True)


def removed_words(block: Block, ranks: np.ndarray, pieces: list[bytes], window: int) -> np.ndarray:
    """Which words of a block lie in a window that a piece of a smaller rank has too."""
    n = len(block.begin)
    edge = np.zeros(n + 1, np.int64)
    if pieces:
        at = phrase_starts(block, pieces, window)
        order = np.argsort(ranks, kind="stable")
        ranks, pieces = ranks[order], Texts([pieces[i] for i in order.tolist()])
        places = np.flatnonzero(pieces.whole(window))
        names, first = np.unique(pieces.runs(window)[places], return_index=True)
        owner = places[first]
        mine = block.runs(window)[at]
        i = np.minimum(np.searchsorted(names, mine), len(names) - 1)
        same = (names[i] == mine) & (ranks[pieces.text[owner[i]]] < block.rank[block.text[at]])
        at, owner = at[same], owner[i[same]]
        if len(at):  # runs of windows beside each other are compared at once
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 1))
            first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
            for a, e, p in zip(at[first].tolist(), at[last].tolist(), owner[first].tolist(), strict=True):
                ours = block.raw[block.begin[a] : block.end[e + window - 1]]
                theirs = pieces.raw[pieces.begin[p] : pieces.end[p + e - a + window - 1]]
                if ours == theirs:
                    edge[a] += 1
                    edge[e + window] -= 1
    return np.cumsum(edge)[:n] > 0


def phrase_starts(block: Block, pieces: list[bytes], window: int) -> np.ndarray:
    """First words of the windows of the block's documents around each occurrence of a phrase of the pieces."""
    size = phrase_words(window)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for piece in pieces:
        words = piece.decode("latin-1").split(" ")  # a character for each byte, so places are places of bytes
        for i in range(0, len(words) - size + 1, size):
            automaton.add_word(f" {' '.join(words[i : i + size])} ")
    automaton.make_automaton()
    ends = np.fromiter((e for e, _ in automaton.iter(f" {block.raw.decode('latin-1')} ")), np.int64) - 1
    start = np.searchsorted(block.end, ends) - size + 1
    edge = np.zeros(len(block.begin) + 1, np.int64)
    np.add.at(edge, np.maximum(start - (window - size), 0), 1)
    np.add.at(edge, start + 1, -1)
    return np.flatnonzero((np.cumsum(edge)[: max(0, len(block.begin) - window + 1)] > 0) & block.whole(window))


def _measured(window: int, keep: bool) -> Callable:
    """Pass over (rank, text, digest) of all rows: number of words, and what is kept of texts without a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n_words, short = [], []
                for text in part.column(1):
                    words = text.as_buffer().to_pybytes().split()
                    n_words.append(len(words))
                    kept = b" ".join(words) if len(words) < window else None
                    short.append(kept if keep or kept is None else hashlib.sha256(kept).hexdigest().encode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(short, pa.binary())], names=["rank", "digest", "n_words", "short"])

    return run


def _dealt(window: int) -> Callable:
    """Pass over (block, rank, digest, text): documents with a window, their words compressed for the shuffle, each once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            seen, rows = set(), []
            for block, rank, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (rank, digest) in seen:
                    continue
                seen.add((rank, digest))
                if len(words := text.as_buffer().to_pybytes().split()) >= window:
                    rows.append((block, rank, digest, compressor.compress(b" ".join(words))))
                if len(rows) == 512:
                    yield _arrow("block int, rank long, digest binary, packed binary", *zip(*rows, strict=True)).to_batches()[0]
                    rows = []
            if rows:
                yield _arrow("block int, rank long, digest binary, packed binary", *zip(*rows, strict=True)).to_batches()[0]

    return run


def remove_shared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: bool = True, block_bytes: int = BLOCK) -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept_sha256 (of the kept words with one space between them), and ``kept`` (this text, if asked for).

    Words are runs of bytes other than space and tab to carriage return. Removes every word covered by a window that also starts in a row
    of a smaller id. Null ids come before all others; rows of one id never count against each other. Null, empty and blank
    texts have no words; texts shorter than a window stay whole; no rows give none. ids are integers. One text of any length is held by one
    task at tens of bytes per byte. Only the two named columns are read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("rank"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    raw = F.col("text").cast("binary").alias("text")
    light = cut_lineage(rows.select("rank", raw, "digest").mapInArrow(_measured(window, keep), "rank long, digest binary, n_words long, short binary"))
    long = light.filter(F.col("n_words") >= window)
    owner = cut_lineage(long.groupBy("digest").agg(F.min("rank").alias("owner"), F.max("rank").alias("last")).filter("last > owner"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("rank", "digest"), F.lit(max(1, -(-total // block_bytes)))).cast("int").alias("block")
    texts = rows.select(block, "rank", "digest", raw).mapInArrow(_dealt(window), "block int, rank long, digest binary, packed binary").groupBy("block")
    no_long, no_int, no_words = (F.lit(None).cast(t) for t in ("long", "int", "binary"))

    def messages(df: DataFrame, block: str = "block", anchor=no_long, piece=no_int, rank=no_long, words=no_words) -> DataFrame:
        return df.select(F.col(block).alias("block"), *(c.alias(n) for c, n in ((anchor, "anchor"), (piece, "piece"), (rank, "rank"), (words, "words"))))

    copies = long.join(owner, "digest").filter(F.col("rank") > F.col("owner")).select(block, "rank", "digest").distinct()
    gone = cut_lineage(messages(copies, rank=F.col("rank"), words=F.col("digest")))
    tell_anchors, tell_windows, cut_pieces, remove = _passes(window, keep)

    def ask(told: DataFrame, answer: Callable, schema: str) -> DataFrame:
        return texts.cogroup(told.groupBy("block")).applyInArrow(answer, schema)

    name = Window.partitionBy("name")
    recurs = (F.count("*").over(name) > 1) | (F.max("several").over(name) > 0)
    # One plan without cuts: all passes read the one shuffle of the texts.
    anchors = ask(gone, tell_anchors, NAMES).withColumn("recurs", recurs).filter("recurs")
    windows = ask(gone.union(messages(anchors, anchor=F.col("name"))), tell_windows, NAMES)
    windows = windows.withColumns({"recurs": recurs, "o": F.min(F.struct("rank", "block", "piece")).over(name)}).filter("recurs AND (block <> o.block OR several > 0)")
    need = windows.select("block", F.col("o.block").alias("owner"), F.col("o.piece").alias("piece")).distinct()
    pieces = ask(gone.union(messages(need.select("owner", "piece").distinct(), "owner", piece=F.col("piece"))), cut_pieces, PIECES).withColumnRenamed("block", "owner")
    sent = messages(need.join(pieces, ["owner", "piece"]), piece=F.col("piece"), rank=F.col("rank"), words=F.col("words"))
    done = ask(gone.union(sent), remove, "rank long, digest binary, n_words long, n_removed long, kept binary").select("digest", F.col("rank").alias("owner"), "n_removed", "kept")

    def shown(df: DataFrame, n_removed, kept) -> DataFrame:
        digest = F.sha2(kept, 256) if keep else kept.cast("string")
        return df.select(F.when(F.col("rank") != FIRST, F.col("rank")).alias(id_col), "n_words", n_removed.alias("n_removed"), digest.alias("kept_sha256"), *([kept.alias("kept")] if keep else []))

    nothing = F.lit(b"" if keep else hashlib.sha256(b"").hexdigest().encode())
    mine = F.col("rank") == F.col("owner")
    judged = shown(long.join(done, "digest"), F.when(mine, F.col("n_removed")).otherwise(F.col("n_words")), F.when(mine, F.col("kept")).otherwise(nothing))
    return judged.union(shown(light.filter(F.col("n_words") < window), F.lit(0).cast("long"), F.col("short")))


#: The contract as DuckDB SQL.
ORACLE_SQL = r"""
    WITH word_lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS p
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM word_lists WHERE len(w) >= 50)),
    firsts AS (SELECT p, min(doc_id) AS owner FROM windows GROUP BY p HAVING count(*) > 1),
    gone AS (
        SELECT doc_id, list(DISTINCT pos) AS positions
        FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS pos FROM windows JOIN firsts USING (p) WHERE owner < doc_id) GROUP BY doc_id),
    kept AS (
        SELECT doc_id, word_lists.w AS w, positions FROM word_lists LEFT JOIN gone USING (doc_id)),
    texts AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t
        FROM (SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, positions, unnest(generate_series(1, len(w))) AS k FROM kept)
              ANTI JOIN (SELECT doc_id, unnest(positions) AS k FROM gone) USING (doc_id, k)) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(positions), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM kept LEFT JOIN texts USING (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests; ids are distinct."""
    earlier, out = set(), []
    for d, t in sorted(docs, key=lambda x: FIRST if x[0] is None else x[0]):
        words = (t or "").encode().split()
        windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        gone = {i + k for i, w in enumerate(windows) if w in earlier for k in range(window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
        earlier |= set(windows)
    return out
