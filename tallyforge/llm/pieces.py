"""SentencePiece encoding and decoding with N-best segmentations over the piece lattice.

A text's blanks are marked as in the vocabulary, with one blank put before the text. Forward Viterbi gives each place the
best score of reaching it; these scores are exact heuristics for an A-star search backwards from the end, which so finds
segmentations in descending order and expands no path that is not among the N best. At most N paths are kept open, as each
stands for its own best completion. No piece holds a blank after another character, nor a Latin letter beside a mark (but
for a few marks, whose runs are left whole), so every path passes through the places between: the lattice falls into chunks,
and the N best of a text are put together exactly from those of its chunks. A forward pass gives each chunk's best path and
what its second best loses; chunks recur, so these are remembered. The search itself is needed for the few chunks of a text
that lose least. Characters that no piece covers become byte pieces, so that decoding gives the text back.

Scores are logarithms: those of a unigram vocabulary as they are, while the ranks of a BPE vocabulary become a Zipf law.
Null and empty texts have no pieces. The vocabulary file is read on the driver and its pieces are broadcast.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pytext import memory, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
BLANK = "▁"
LATIN = "A-Za-zÀ-ɏ"
#: Chunks that a worker remembers in each of two generations, and characters of the longest that it does.
KEPT, LONGEST_KEPT = 400_000, 48
#: For so many remembered chunks the N best of one are remembered, for the search is run for the same few chunks again and again.
KEPT_WAYS = 40


@dataclass
class Vocabulary:
    """ids and scores of the pieces, with blanks as such; the ids of the 256 byte pieces; the bytes that each id decodes to."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    byte_score: float
    decoded: list[bytes]
    longest: int = 0
    #: Scores of the pieces, and None for what only begins one.
    table: dict[str, float | None] = field(default_factory=dict)
    chunks: str = ""

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.table = {x[:k]: None for x in self.ids for k in range(1, len(x))} | self.scores
        letter, bound = re.compile(f"[{LATIN}]").match, set()
        for x in self.ids:
            for a, b in zip(x, x[1:], strict=False):
                if " " not in (a, b) and bool(letter(a)) != bool(letter(b)):
                    bound.add(b if letter(a) else a)
        if any("\n" in x or " " in x.lstrip(" ") for x in self.ids):
            raise ValueError("pieces hold a blank or line feed after another character")
        marks = "".join(map(re.escape, sorted(bound)))
        whole = f"[^ \\n{marks}]*[{marks}][^ \\n]*|" if marks else ""
        self.chunks = f" *(?:{whole}[{LATIN}]+|[^ \\n{LATIN}]+)| +|\\n"


def load(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    given = {i: sp.get_score(i) for i in plain}
    if len(given) > 1 and all(float(x).is_integer() for x in given.values()):  # ranks
        total = math.log(sum(1 / (3 - x) for x in given.values()))
        given = {i: -math.log(3 - x) - total for i, x in given.items()}
    text = {i: sp.id_to_piece(i).replace(BLANK, " ") for i in plain}
    bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    decoded = [b""] * n
    for i, x in text.items():
        decoded[i] = x.encode()
    for b, i in enumerate(bytes_):
        decoded[i] = bytes([b])
    return Vocabulary({x: i for i, x in text.items()}, {x: given[i] for i, x in text.items()}, bytes_, min(given.values(), default=0.0) - 1, decoded)


def search(chunk: str, v: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a chunk as (score, ids), the best first; fewer if there are not so many."""
    size, scores, ids = len(chunk), v.scores, v.ids
    best = [0.0] + [-math.inf] * size
    into: list[list] = [[] for _ in range(size + 1)]
    for i in range(size):
        here = best[i]
        for j in range(i + 1, min(size, i + v.longest) + 1):
            piece = chunk[i:j]
            s = scores.get(piece)
            if s is not None:
                into[j].append((i, s, ids[piece]))
                if here + s > best[j]:
                    best[j] = here + s
        if chunk[i] not in scores:
            raw = chunk[i].encode()
            s = v.byte_score * len(raw)
            into[i + 1].append((i, s, tuple(v.bytes_[b] for b in raw)))
            best[i + 1] = max(best[i + 1], here + s)
    found, opened, count = [], [(-best[size], 0, size, 0.0, None)], 0
    while opened and len(found) < n:
        total, _, at, behind, path = opened.pop(0)
        if at == 0:
            out = []
            while path:
                out.extend(path[0]) if isinstance(path[0], tuple) else out.append(path[0])
                path = path[1]
            found.append((-total, tuple(out)))
            continue
        for start, s, piece in into[at]:
            count += 1
            ahead = behind + s
            insort(opened, (-(ahead + best[start]), count, start, ahead, (piece, path)))
        del opened[n - len(found) :]
    return found


def best_two(chunk: str, v: Vocabulary) -> tuple[tuple[int, ...], float, float]:
    """ids and score of the best segmentation of a chunk, and what the second best loses (infinite if there is none)."""
    size, get, longest, none = len(chunk), v.table.get, v.longest, -math.inf
    first, second, back = [none] * (size + 1), [none] * (size + 1), [0] * (size + 1)
    first[0] = 0.0
    for i in range(size):
        a, b = first[i], second[i]
        for j in range(i + 1, min(size, i + longest) + 1):
            s = get(chunk[i:j], 0)
            if not s:
                if j == i + 1:
                    x = v.byte_score * len(chunk[i].encode())
                    b, (a, b0) = b + x, (a + x, b)
                    if a > first[j]:
                        first[j], second[j], back[j] = a, max(first[j], b), i
                    elif a > second[j]:
                        second[j] = a
                    a, b = a - x, b0
                if s == 0:
                    break
                continue
            x = a + s
            if x > first[j]:
                y = b + s
                second[j] = first[j] if first[j] > y else y
                first[j] = x
                back[j] = i
            elif x > second[j]:
                second[j] = x
    out, at, ids = [], size, v.ids
    while at:
        start = back[at]
        piece = ids.get(chunk[start:at])
        out.append((piece,) if piece is not None else tuple(v.bytes_[x] for x in chunk[start:at].encode()))
        at = start
    return tuple(chain.from_iterable(reversed(out))), first[size], first[size] - second[size]


class Chunks(dict):
    """(ids as 32-bit integers, score, loss of the second best, length) of a chunk, remembered in two generations; long ones, as of scripts without blanks, are not.

    The length is 0 if the ids do not decode to the chunk.
    """

    def __init__(self, v: Vocabulary, kept: int):
        self.v, self.kept, self.old = v, kept, memory({})
        memory(self)

    def __missing__(self, chunk: str) -> tuple:
        own = self.old.get(chunk)
        if own is None:
            ids, score, loss = best_two(chunk, self.v)
            same = b"".join(map(self.v.decoded.__getitem__, ids)) == chunk.encode()
            own = array("i", ids).tobytes(), score, loss, len(chunk) if same else 0
        if len(chunk) > LONGEST_KEPT:
            return own
        if len(self) >= self.kept:
            self.old.clear()
            self.old.update(self)
            self.clear()
        self[chunk] = own
        return own


class Encoder:
    """Encodes with remembered chunks."""

    def __init__(self, v: Vocabulary, n: int = N_BEST, kept: int = KEPT):
        self.v, self.n, self.kept, self.split, self.known = v, n, kept, re.compile(v.chunks).findall, Chunks(v, kept)
        self.searched = memory({})

    def ways(self, chunk: str, best: tuple) -> list[tuple[float, bytes]]:
        """The N best of a chunk, beginning with the given one."""
        own = self.searched.get(chunk)
        if own is None:
            found = [(score, array("i", ids).tobytes()) for score, ids in search(chunk, self.v, self.n)]
            own = [(best[1], best[0]), *(x for x in found if x[1] != best[0])][: self.n]
            if len(chunk) <= LONGEST_KEPT:
                if len(self.searched) >= self.kept // KEPT_WAYS:
                    self.searched.clear()
                self.searched[chunk] = own
        return own

    def encode(self, text: str | None) -> tuple[np.ndarray, list[float], list[dict[int, bytes]], list[tuple]]:
        """ids of the best, scores of the N best, for each of these the ids of the chunks that differ from the best by place, and the chunks."""
        if not text:
            return np.empty(0, np.int32), [], [], []
        texts = self.split(" " + text)
        parts = list(map(self.known.__getitem__, texts))
        ids = np.frombuffer(b"".join(map(itemgetter(0), parts)), np.int32)
        top = math.fsum(map(itemgetter(1), parts))
        if self.n == 1:
            return ids, [top], [{}], parts
        loss = np.fromiter(map(itemgetter(2), parts), np.float64, len(parts))
        few = min(self.n - 1, len(parts))
        at = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1])
        at = sorted(at[np.argsort(loss[at], kind="stable")][:few].tolist())
        # Any of the N best departs from the best in these chunks only: a departure elsewhere loses no less than each of theirs and than none.
        ways = [self.ways(texts[k], parts[k]) for k in at]
        opened, count, ranked = [(0.0, 0, 0, {})], 0, []
        while opened and len(ranked) < self.n:
            lost, _, k, change = heapq.heappop(opened)
            if k == len(at):
                ranked.append((lost, change))
                continue
            for rank, (s, other) in enumerate(ways[k]):
                count += 1
                heapq.heappush(opened, (lost + parts[at[k]][1] - s, count, k + 1, change | {at[k]: other} if rank else change))
        return ids, [top - lost for lost, _ in ranked], [change for _, change in ranked], parts

    def n_best(self, text: str | None) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text in full."""
        _, scores, changes, parts = self.encode(text)
        return [(s, np.frombuffer(b"".join(change.get(i, p[0]) for i, p in enumerate(parts)), np.int32).tolist()) for s, change in zip(scores, changes, strict=True)]


def whole(text: str | None, parts: list[tuple]) -> bool:
    """Whether decoding gives the text back: its chunks stand in order and apart, so it does if each comes back and their lengths add up."""
    return not text or sum(map(itemgetter(3), parts)) == len(text) + 1


def edits(changes: list[dict[int, bytes]], parts: list[tuple]) -> list[list[tuple[int, int, list[int]]]]:
    """Each further segmentation as (at, n, ids): n ids of the best one from place `at` are replaced by those given."""
    places, at, last = {}, 0, 0
    for k in sorted(set().union(*changes[1:])):
        at += sum(map(len, map(itemgetter(0), parts[last:k]))) // 4
        places[k], last = at, k
    return [[(places[k], len(parts[k][0]) // 4, np.frombuffer(change[k], np.int32).tolist()) for k in sorted(change)] for change in changes[1:]]


def edited(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The segmentation that `edits` describes."""
    out, last = [], 0
    for at, n, new in changes:
        out += [*ids[last:at], *new]
        last = at + n
    return out + list(ids[last:])


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of any of its segmentations; bytes that are no UTF-8 are replaced."""
    return b"".join(map(v.decoded.__getitem__, ids)).decode(errors="replace")[1:]


_ENCODER: list = []


def _encoder(v: Vocabulary, n: int, kept: int) -> Encoder:
    """The worker's encoder: its memory serves one task after the other while they have the same vocabulary."""
    if not _ENCODER or (_ENCODER[0].n, _ENCODER[0].kept) != (n, kept) or _ENCODER[0].v.ids != v.ids or _ENCODER[0].v.scores != v.scores:
        _ENCODER[:] = [Encoder(v, n, kept)]
    return _ENCODER[0]


def _remembered() -> tuple:
    return (_ENCODER[0].known, _ENCODER[0].known.old, _ENCODER[0].searched) if _ENCODER else ()


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", n: int = N_BEST, kept: int = KEPT, lasting: bool = True, keep_text: bool = False) -> DataFrame:
    """The rows with ids, scores, others and lossless in place of the text, or beside it with `keep_text`; columns of these names are replaced.

    ids: the best segmentation. scores: those of the N best, descending. others: each further one of the N best as edits of
    the best, (at, n, ids): n ids from place `at` are replaced (`edited` puts it together). lossless: whether decoding gives
    the text back.

    kept: the chunks that a worker remembers, of up to LONGEST_KEPT characters, each some 330 bytes (1 kB at most) and in two generations; fewer cost time, not results.
    lasting: whether a worker remembers them from one task to the next, which saves time and holds memory while it idles.
    """
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

    edit = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    docs = docs.drop("ids", "scores", "others", "lossless")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the pieces of a vocabulary file

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, n, kept)
        for batch in batches:
            ids, ends, scores, others, same = [], [0], [], [], []
            for text in batch.column(text_col):
                text = text.as_py()
                own, ranked, changes, parts = encoder.encode(text)
                ids.append(own)
                ends.append(ends[-1] + len(own))
                scores.append(ranked)
                others.append([[{"at": a, "n": m, "ids": x} for a, m, x in one] for one in edits(changes, parts)])
                same.append(whole(text, parts))
            best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            left = [c for c in batch.schema.names if keep_text or c != text_col]
            more = [best, pa.array(scores, pa.list_(pa.float64())), pa.array(others, edit), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), *more], names=[*left, "ids", "scores", "others", "lossless"])

    change = StructType([StructField("at", IntegerType()), StructField("n", IntegerType()), StructField("ids", ArrayType(IntegerType()))])
    more = [StructField("ids", ArrayType(IntegerType())), StructField("scores", ArrayType(DoubleType())), StructField("others", ArrayType(ArrayType(change))), StructField("lossless", BooleanType())]
    return docs.mapInArrow(tidied(encoded, _remembered if lasting else tuple), StructType([f for f in docs.schema.fields if keep_text or f.name != text_col] + more))
