"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all labelled documents. A document is a mixture
of languages: expectation-maximisation over its trigrams gives the languages' proportions, and the set of languages is the
one that forward selection finds by penalised likelihood, each further language costing `PENALTY` times the logarithm of
the trigram count. The prediction is the language of the largest proportion. Its score is that proportion as it is expected
after the text's n trigrams with `PRIOR` more of each of the L languages, (share * n + PRIOR) / (n + L * PRIOR): a long text
in one language comes close to 1, one of a few letters stays near 1 / L.

Texts that are null or hold no letter are `und` with score 0, as are all texts when nothing was learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pytext import tidied

BUCKETS = 1 << 14
PENALTY = 3.0
ROUNDS, CLOSE = 30, 1e-3
SMOOTHING = 0.5
UNKNOWN = "und"
PART = 1 << 20
#: Languages up to which their distributions are sent to the workers; more are an error, as no table of languages has so many.
MOST_LANGUAGES = 1000
#: Trigrams of each language that the score adds to a text's own.
PRIOR = 1.0
_WORD = re.compile(r"[^\W\d_]").finditer


@cache
def _letters() -> np.ndarray:
    """Each code point itself if it is a letter or a mark that combines with one, else a blank."""
    return np.array([c if (x := category(chr(c))[0]) == "L" or x == "M" else 32 for c in range(0x110000)], np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD(text))


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the text's hashed letter trigrams; what is no letter counts as a blank, and runs of blanks as one."""
    out = np.zeros(BUCKETS, np.int64)
    if not text or not has_letter(text):
        return out
    for at in range(0, len(text), PART):
        c = np.frombuffer(f" {text[max(0, at - 2) : at + PART].lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _letters()[c]
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            own += trigrams(text.as_py())
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities, from (lang, text). What reaches the driver is a row for each language and bucket."""
    counts = labelled.where("lang is not null").select("lang", "text").mapInArrow(tidied(_counted), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MOST_LANGUAGES} can be told apart")
    out = np.zeros((len(names), BUCKETS))
    row = {x: i for i, x in enumerate(names)}
    out[[row[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    out += SMOOTHING
    return names, out / out.sum(axis=1, keepdims=True)


def proportions(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights and log likelihood of counts n under the rows of p, by expectation-maximisation."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(ROUNDS):
        mixed = share @ p
        step = share * (p @ (n / mixed)) / total
        moved = np.abs(step - share).max()
        share = step
        if moved < CLOSE:
            break
    return share, float(n @ np.log(share @ p))


def languages(counts: np.ndarray, p: np.ndarray, logs: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The chosen languages, as rows of p, and their proportions."""
    at = np.flatnonzero(counts)
    n, own = counts[at].astype(np.float64), p[:, at]
    single = logs[:, at] @ n
    chosen = [int(single.argmax())]
    share, best = np.ones(1), single[chosen[0]]
    if len(p) == 1:
        return chosen, share
    cost = penalty * np.log(max(2.0, n.sum()))
    whole, most = proportions(n, own)
    for k in np.argsort(-whole):
        if most - best <= cost:
            break
        if k in chosen:
            continue
        wider = [*chosen, int(k)]
        share2, value = proportions(n, own[wider])
        if value - best <= cost:
            break
        chosen, share, best = wider, share2, value
    return chosen, share


def identify(docs: DataFrame, names: list[str], p: np.ndarray, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The rows with lang_pred, score and mixture (the chosen languages and their proportions, the largest first); columns of these names are replaced."""
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

    docs = docs.drop("lang_pred", "score", "mixture")
    shared = docs.sparkSession.sparkContext.broadcast(p)  # MOST_LANGUAGES x BUCKETS at most
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        logs = np.log(p)
        for batch in batches:
            first, score, mixture = [], [], []
            for text in batch.column(text_col):
                counts = trigrams(text.as_py())
                if not names or not counts.any():
                    first.append(UNKNOWN), score.append(0.0), mixture.append([])
                    continue
                chosen, share = languages(counts, p, logs, penalty)
                order = sorted(range(len(chosen)), key=lambda i: (-share[i], names[chosen[i]]))
                mixture.append([{"lang": names[chosen[i]], "share": float(share[i])} for i in order])
                first.append(names[chosen[order[0]]]), score.append((min(1.0, float(share[order[0]])) * float(counts.sum()) + PRIOR) / (float(counts.sum()) + PRIOR * len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, kind)], names=[*batch.schema.names, "lang_pred", "score", "mixture"])

    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())])))]
    return docs.mapInArrow(tidied(named), StructType([*docs.schema.fields, *more]))
