"""Substring dedup: passages of 50 words that an earlier document holds are removed, found by a count-min prefilter.

A window is 50 consecutive words; words are what stands between ASCII white space. A window's anchor is the smallest hash
of the 20-word grams in it, so that equal windows have equal anchors, and consecutive windows with one anchor are a run.

First pass: each partition counts in a count-min sketch of its own the documents of each anchor. The sketch is as wide as the
corpus asks for and cut into blocks; what a partition has touched of a block is one row, and the rows of a block are added up.
Cells that reach two are the repeated ones. An anchor's count is at least that of each of its windows and a sketch only
overestimates, so no repeated window is lost.

Second pass: runs whose anchor's cells are all repeated are grouped exactly. Runs equal as a whole (a 128-bit digest) are
decided by the smallest doc_id that holds them. What remains are the first holders of runs that share an anchor with another
run: only their windows are hashed one by one (128 bits) and grouped. No window is sent through a shuffle for its own sake
before that, no text is collected, nothing is broadcast, and groups are reduced to minima before they are shuffled.

A document is a doc_id: rows that repeat one are one document (none of them is smaller), and a null doc_id counts as the
largest, so that rows without an id lose what others hold but nothing to each other. A null text has no words; a text of fewer
than 50 stays. A passage repeated within one document only stays. Long texts are hashed in pieces that overlap by 49 words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, unused

WORDS = 50
GRAM = 20
#: Cells of a row of the sketch for each expected anchor, and the bits of a cell's place in its block.
ROOM = 8
BLOCK_BITS = 16
#: The rows of the sketch: an anchor's cell is given by its bits from these places on.
ROWS = (0, 20)
#: Bytes of text that are hashed at once, and anchors after which a partition hands on its sketch.
PIECE = 1 << 19
HELD = 1 << 21
LAST = 2**63 - 1
BLANK = re.compile(rb"[\x09-\x0d\x20]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd multipliers of the polynomial hashes, of letters and of words, modulo 2**64.
LETTERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACES = (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; different values stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n at least; kept up to the usual size of a piece."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 2 * PIECE), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= 2 * PIECE:
            _powers[base] = held
    return held


def folded(x: np.ndarray, n: int, join: Callable) -> np.ndarray:
    """What `join` makes of each n consecutive values, in about 2 log n passes. join(a, b, size of a's stretches, of b's)."""
    part, size, out, done = x, 1, None, 0
    while size <= n:
        if n & size:
            out = part if out is None else join(out, part, done, size)
            done += size
        if 2 * size <= n:
            part = join(part, part, size, size)
        size *= 2
    return out


def hashed(base: int) -> Callable:
    def join(a: np.ndarray, b: np.ndarray, size: int, more: int) -> np.ndarray:
        m = max(0, min(len(a), len(b) - size))
        return a[:m] * np.uint64(pow(base, more, 1 << 64)) + b[size : size + m]

    return join


def smallest(a: np.ndarray, b: np.ndarray, size: int, more: int) -> np.ndarray:
    m = max(0, min(len(a), len(b) - size))
    return np.minimum(a[:m], b[size : size + m])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first byte of each word and two 64-bit hashes of it."""
    codes = np.frombuffer(data, np.uint8)
    space = SPACE[codes]
    turns = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = turns[::2], turns[1::2]
    hashes = []
    for base in LETTERS:
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(base, len(codes) + 1)[: len(codes)], out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), len(codes) + 1)
        hashes.append(mixed((sums[ends] - sums[starts]) * back[starts]))
    return starts, hashes[0], hashes[1]


def pieces(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's index, word's place in it, two hashes) of all words; texts come together up to PIECE bytes, a longer one in pieces of its own, each from 49 words before the end of the last."""
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, k1, k2 = word_hashes(b"\n".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        own = np.searchsorted(ends, starts, "right")
        first = np.searchsorted(own, np.arange(len(group)))
        return np.asarray(owners)[own], np.arange(len(own)) - first[own], k1, k2

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= PIECE:
            group.append(text)
            owners.append(i)
            size += len(text)
            if size >= PIECE:
                yield together()
                group, owners, size = [], [], 0
            continue
        at, place, step = 0, 0, PIECE
        while at < len(text):
            found = BLANK.search(text, at + step)
            end = found.start() if found else len(text)
            starts, k1, k2 = word_hashes(text[at:end])
            if end < len(text) and len(starts) < 2 * WORDS:  # very long words
                step *= 2
                continue
            yield np.full(len(starts), i), np.arange(place, place + len(starts)), k1, k2
            if end >= len(text):
                break
            ahead = len(starts) - (WORDS - 1)
            at, place, step = at + int(starts[ahead]), place + ahead, PIECE
    if group:
        yield together()


def windows(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, place, anchor, two hashes) of all windows, piece by piece."""
    for own, place, k1, k2 in pieces(texts):
        n = len(own) - WORDS + 1
        if n <= 0:
            continue
        whole = own[:n] == own[WORDS - 1 :]
        grams = mixed(folded(k1, GRAM, hashed(PLACES[0])))
        anchor = folded(grams, WORDS - GRAM + 1, smallest)
        pair = [mixed(folded(k, WORDS, hashed(base)))[whole] for k, base in zip((k1, k2), PLACES, strict=True)]
        yield own[:n][whole], place[:n][whole], anchor[whole], *pair


def runs(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, place of the first window, windows, anchor, two digests) of the runs; a run has at most 31 windows, as far as its anchor reaches."""
    most = WORDS - GRAM + 1
    for own, place, anchor, w1, w2 in windows(texts):
        if not len(own):
            continue
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(new)
        within = np.arange(len(own)) - begin[np.cumsum(new) - 1]
        begin = np.flatnonzero(within % most == 0)
        within %= most
        n = np.diff(begin, append=len(own))
        digests = [mixed(np.add.reduceat(w * powers(base, most)[within], begin) + n.astype(np.uint64)) for w, base in ((w1, LETTERS[1]), (w2, LETTERS[0]))]
        yield own[begin], place[begin], n, anchor[begin], *digests


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))


def partition_sketch(bits: int) -> Callable:
    """For mapInArrow: (row, block, cells, twice) of what a partition has in each block of its sketch; twice tells which of its cells it counts more than once."""

    def blocks(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, shift in enumerate(ROWS):
            cells, n = np.unique((anchors >> np.uint64(shift)) & np.uint64((1 << bits) - 1), return_counts=True)
            block = cells >> np.uint64(BLOCK_BITS)
            begin = np.flatnonzero(np.diff(block, prepend=block[0] + np.uint64(1)))
            ends = np.append(begin, len(cells)).astype(np.int32)
            low, twice = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16), (n > 1).astype(np.uint8)
            packed = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (low, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), row, np.int32)), _long(block[begin]), *packed], names=["row", "block", "cells", "twice"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for own, _, _, anchor, _, _ in runs(_bytes(batch.column(0))):
                order = np.lexsort((anchor, own))
                own, anchor = own[order], anchor[order]
                first = np.ones(len(own), bool)
                first[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[first])
                n += int(first.sum())
            if n >= HELD:
                yield from blocks(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from blocks(np.concatenate(held))

    return sketch


def merged_block(key: tuple, parts: pa.Table) -> pa.Table:
    """The cells of one block that all partitions together count at least twice."""
    cells, twice = (np.frombuffer(b"".join(parts.column(c).to_pylist()), kind) for c, kind in (("cells", np.uint16), ("twice", np.uint8)))
    full = np.flatnonzero(np.bincount(cells, twice + 1, 1 << BLOCK_BITS) >= 2)
    return pa.table({"row": pa.array(np.full(len(full), key[0].as_py(), np.int32)), "cell": pa.array((key[1].as_py() << BLOCK_BITS) | full)})


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc, same, text): (doc, same, place, n, h, d1, d2) of each run."""
    for batch in batches:
        doc, same = (batch.column(i).to_numpy() for i in (0, 1))
        for own, place, n, h, d1, d2 in runs(_bytes(batch.column(2))):
            columns = [doc[own], same[own], place, n, h, d1, d2]
            yield pa.RecordBatch.from_arrays([_long(x) for x in columns], names=["doc", "same", "place", "n", "h", "d1", "d2"])


def _spread(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, n) of all spans of a column of lists of (place, n)."""
    flat = spans.flatten()
    owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return owner, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc, same, text, spans): (w1, w2, doc, same, place) of each window of the runs in spans."""
    for batch in batches:
        doc, same = (batch.column(i).to_numpy() for i in (0, 1))
        owner, first, n = _spread(batch.column(3))
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wanted = np.unique((np.repeat(owner, n) << 40) + np.repeat(first, n) + within)
        for own, place, _, w1, w2 in windows(_bytes(batch.column(2))):
            keep = np.isin((own << 40) + place, wanted)
            columns = [w1[keep], w2[keep], doc[own[keep]], same[own[keep]], place[keep]]
            yield pa.RecordBatch.from_arrays([_long(x) for x in columns], names=["w1", "w2", "doc", "same", "place"])


def kept_rows(text_at: int, spans_at: int, names: list[str], stay: list[int]) -> Callable:
    """For mapInArrow: the columns that stay, the kept words, and how many there were and are gone. A span of n windows covers n + 49 words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = _bytes(batch.column(text_at)), batch.column(spans_at)
            owner, first, n = _spread(spans)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            kept, n_words, n_removed = [], [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                n_words.append(len(words))
                a, b = bounds[i], bounds[i + 1]
                if a < b:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first[a:b], 1)
                    np.subtract.at(change, first[a:b] + n[a:b] + WORDS - 1, 1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], *made], names=names)

    return each


def sketch_bits(total_bytes: int) -> int:
    """Bits of a cell's number: ROOM cells for each anchor expected of so much text (6 bytes a word, two anchors in 32 words)."""
    return max(BLOCK_BITS, int(np.ceil(np.log2(ROOM * max(1, total_bytes) / 96))))


def repeated_cells(texts: DataFrame, bits: int) -> DataFrame:
    """(row, cell) of the merged sketch that are counted at least twice. texts: one column."""
    parts = texts.mapInArrow(partition_sketch(bits), "row int, block long, cells binary, twice binary")
    return parts.groupBy("row", "block").applyInArrow(merged_block, "row int, cell long")


def candidates(keyed: DataFrame, bits: int) -> DataFrame:
    """(doc, same, place, n, h, d1, d2) of the runs that the sketch takes for repeated. keyed: doc, same, text."""
    full = stored(repeated_cells(keyed.select("text"), bits), "cells")
    found = keyed.mapInArrow(run_rows, "doc long, same long, place long, n long, h long, d1 long, d2 long")
    for row, shift in enumerate(ROWS):
        cell = F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << bits) - 1))
        found = found.withColumn("cell", cell).join(full.where(F.col("row") == row).select("cell"), "cell", "left_semi").drop("cell")
    return stored(found, "runs")


def removed_spans(keyed: DataFrame, bits: int) -> DataFrame:
    """(doc, same, place, n): n consecutive windows from a place on, each of which a smaller doc holds too."""
    found = candidates(keyed, bits)
    run = ["h", "d1", "d2"]
    first = stored(found.groupBy(*run).agg(F.min("doc").alias("first"), F.count("*").alias("held")), "first")
    # A run that occurs once tells nothing of itself; only runs that occur again are looked up.
    again = first.where("held > 1").select(*run, "first")
    whole = found.join(again, run).where(F.col("doc") > F.col("first")).select("doc", "same", "place", "n")
    # Stored, so that the join below deals out both sides and a common anchor's runs can be split among tasks.
    shared = stored(first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "anchors")
    holders = found.join(first.join(shared, "h", "left_semi").select(*run, F.col("first").alias("doc")), [*run, "doc"], "left_semi")
    listed = holders.groupBy("doc", "same").agg(F.collect_set(F.struct("place", "n")).alias("spans"))
    texts = keyed.join(listed, ["doc", "same"]).select("doc", "same", "text", "spans")
    each = stored(texts.mapInArrow(window_rows, "w1 long, w2 long, doc long, same long, place long"), "windows")
    least = each.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("w1", "w2", "first")
    single = each.join(least, ["w1", "w2"]).where(F.col("doc") > F.col("first")).select("doc", "same", "place", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(single)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `text` as its kept words joined by one space, and n_words and n_removed, which replace columns of these names. Other columns stay."""
    doc: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    same = F.xxhash64(F.col(text_col))
    keyed = docs.select(doc.alias("doc"), same.alias("same"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0]
    spans = removed_spans(keyed, sketch_bits(total or 0))
    own, copy, lost = unused(docs, "__doc", "__same", "__spans")
    spans = spans.groupBy(F.col("doc").alias(own), F.col("same").alias(copy)).agg(F.collect_set(F.struct("place", "n")).alias(lost))
    whole = docs.withColumns({own: doc, copy: same}).join(spans, [own, copy], "left").select(*[f"`{c}`" for c in docs.columns], lost)
    replaced = {"n_words", "n_removed", text_col.lower()}
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in replaced]
    fields = [*[docs.schema.fields[i] for i in stay], T.StructField(text_col, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return whole.mapInArrow(kept_rows(at, len(docs.columns), [f.name for f in fields], stay), T.StructType(fields))
