"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language over all labelled texts: each task adds up a matrix of a fixed size and emits its
cells once, and the cells are summed by a shuffle. The result is a matrix of log-probabilities with one row for each
bucket and one column for each language; it is the only thing broadcast, and its size is bounded by
``2 ** BITS * MAX_LANGUAGES`` cells. Prediction turns each text into sparse bucket counts and multiplies a batch of
them with the matrix.

Character case is folded for letters, and every run of other characters counts as one space, as do a text's ends, so
digits and markup do not vote. A null text, or one without a letter, gets ``und`` and score 0. With no labelled text at
all, every text gets ``und``. Ties go to the language that sorts first. Repeated rows teach and are scored each; null ids
are in no fold. A long text is read in blocks, with the n-grams across their edges. An empty table gives an empty result.
Only doc_id, text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import mix64, ship, tidy

#: Buckets are 2 ** BITS; n-grams have the lengths ORDERS; counts are smoothed by ALPHA.
BITS, ORDERS, ALPHA = 14, (1, 2, 3), 0.5
#: Bound of the broadcast matrix. More languages than this are an error, as no known corpus has them.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Characters of a text that are read at a time.
_CHARS = 200_000


def _letters() -> np.ndarray:
    """For each code point: its folded letter, or a space (0x20)."""
    fold = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


_fold: list[np.ndarray] = []


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a text, in any order, block by block."""
    if not _fold:
        _fold.append(_letters())
    longest = max(ORDERS)
    before = np.array([0x20], np.uint64)  # the last codes of the text so far, where runs of others are one space
    for i in range(0, len(text) + 1, _CHARS):
        block = text[i : i + _CHARS]
        code = _fold[0][np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if i + len(block) == len(text):
            code = np.append(code, np.uint32(0x20))
        gap = code == 0x20
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[:1] |= before[-1] != 0x20
        code = np.concatenate([before, code[keep].astype(np.uint64)])
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, longest + 1):
            gram = gram[: len(code) - n + 1] * np.uint64(0x110000) + code[n - 1 :]
            if n in ORDERS:
                new = gram[max(0, len(before) - n + 1) :]  # those that end in this block
                yield (mix64(new[new != 0x20] if n == 1 else new) >> np.uint64(64 - BITS)).astype(np.int64)
        before = code[-max(1, longest - 1) :]


def sparse_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs; none without a letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(text) <= _CHARS:
        total = np.bincount(np.concatenate(list(buckets(text))), minlength=1 << BITS)
    else:
        total = np.zeros(1 << BITS, np.int64)
        for found in buckets(text):
            total += np.bincount(found, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log-probabilities, from rows (text, lang)."""
    ship(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                at, n = sparse_counts(text.as_py())
                if len(at):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << BITS, np.int64)
                    sums[lang][at] += n
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    if len(rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the matrix is bounded to so many")
    cells = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # at most MAX_LANGUAGES * 2 ** BITS rows of sums
    langs = sorted(set(found["lang"].to_pylist()))
    matrix = np.full((1 << BITS, max(1, len(langs))), ALPHA)
    column = np.searchsorted(langs, found["lang"].to_numpy()) if langs else np.empty(0, int)
    np.add.at(matrix, (found["bucket"].to_numpy(), column), found["n"].to_numpy())
    return langs, np.log(matrix) - np.log(matrix.sum(axis=0))


def predict(df: DataFrame, langs: list[str], matrix: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` with lang_pred and score, the posterior of that language under equal priors.

    The posterior is taken per n-gram mean raised to the square root of their number: n-grams of a text overlap, so
    their product alone would call every guess certain.
    """
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast((langs, matrix))
    kept = df.select(*keep).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            columns, counts, sizes = [], [], []
            sums = np.zeros((len(batch), matrix.shape[1]))
            first = 0

            def add(stop: int) -> None:
                """Multiply the rows gathered so far, as one sparse matrix, with the model."""
                nonlocal first
                if columns:
                    at, n = np.concatenate(columns), np.concatenate(counts)
                    edges = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
                    full = np.flatnonzero(np.diff(edges))
                    if len(full):
                        sums[first + full] = np.add.reduceat(matrix[at] * n[:, None], edges[full], axis=0)
                    columns.clear(), counts.clear()
                first = stop

            held = 0
            for i, text in enumerate(texts):
                at, n = sparse_counts(text.as_py())
                columns.append(at), counts.append(n), sizes.append(int(n.sum()))
                held += len(at)
                if held > 500_000 or i + 1 == len(batch):
                    add(i + 1)
                    held = 0
            total = np.array(sizes, float)
            logit = sums / np.sqrt(np.maximum(total, 1))[:, None]
            logit -= logit.max(axis=1, keepdims=True)
            posterior = np.exp(logit)
            posterior /= posterior.sum(axis=1, keepdims=True)
            best = posterior.argmax(axis=1)
            known = (total > 0) & bool(langs)
            names = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            value = np.where(known, posterior[np.arange(len(best)), best], 0.0) if len(best) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept.names), pa.array(names, pa.string()), pa.array(value)], [*kept.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*keep, F.col("text").alias("__text")).mapInArrow(tidy(score), schema)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of an id, written as text, falls into a fold; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the rows that are not held out."""
    rows = documents.select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    langs, matrix = train(rows.where("NOT held_out"))
    return predict(rows.drop("lang"), langs, matrix, ["doc_id", "held_out"])
