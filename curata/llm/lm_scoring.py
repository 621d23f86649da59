"""Operator 6: language-model scores with stupid backoff, computed relationally.

Words are maximal runs of other than ASCII white space, with A-Z lower-cased. An n-gram is up to ``order`` words of one
text that follow each other; the empty one occurs before each word, so its count is the number of words N. With c() for
counts over the whole corpus, the score of a text is the sum over its words w of log S(w | the order - 1 words before),

    S(w | h) = c(h w) / c(h)        if c(h w) > 0
    S(w | h) = BACKOFF * S(w | h')  otherwise, with h' the words of h but the first;

an unknown word's S(w) is BACKOFF / N. The corpus is the scored documents, unless another one is given; nothing is
counted over less than all of it, and no count is too low to be used.

1. *blocks*: the texts of a task are read once into blocks: hashes of the distinct words, and the texts as numbers of
   words. A block's distinct n-grams with their numbers are exploded to rows (block, shard, keys, ns), where the shard
   follows from a hash of the n-gram.
2. *count and join*: rows are partitioned by shard. There the table (key, count) of the shard is summed from all blocks'
   rows, and joined to them: (block, shard, counts), the counts in the order of the block's n-grams. A block sends an
   n-gram once, so a word or pair that is everywhere is an entry for each block, not for each occurrence.
3. *score*: a block meets its counts, in a join by block, and terms are summed for each text.

N-grams of up to two words take one round of 1 and 2 and each further order another one, so that the shuffle files of a
round are gone before the next; its counts are kept as a table in the shared folder until the scores are read.

Blocks and shards follow the input in number up to 100 GB or so of text, and grow eight times in size beyond it (sized()),
so that a block has many n-grams for each shard it writes to. What a block costs does not depend on the number of shards:
rows are made of the shards that it has n-grams for, and keys are packed as differences.

N-grams are told apart by a 64-bit hash within a shard that another hash chose: among n n-grams in s shards, n^2 / s / 2^65
pairs are expected to share both, 0.001 for 10 billion in 3,000 shards. Words have 64-bit hashes.

Null and empty texts and those of white space have no words and score 0. Each row is scored on its own, rows with null or
repeated ids too, and blocks are dealt as rows come, so rows that are alike do not meet in one. Long texts are hashed in
parts and make a block longer. An empty table gives an empty result, an empty
corpus has N = 1. Only columns doc_id and text are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType
from pyspark.sql.types import _parse_datatype_string as parse

from curata.llm.common import drop_staged, mix64, ship, staged, tidied_table, tidy
from curata.llm.kernels import blocks as parts_of
from curata.llm.kernels import column_bytes, planes, unplanes, words

BACKOFF, ORDER = 0.4, 3
#: Bytes of text in a block, and (block, n-gram) entries in a shard, about; and how much they may grow.
BLOCK_BYTES, SHARD_ENTRIES, GROWTH = 8 << 20, 1 << 20, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sized(text_bytes: int) -> tuple[int, int]:
    """Bytes of a block and number of shards of a round for so much text."""
    growth = min(GROWTH, max(1, text_bytes >> 37))
    # a round has at most two n-grams a word, and a word has 8 bytes or so
    return BLOCK_BYTES * min(4, growth), 1 + text_bytes // 4 // (SHARD_ENTRIES * growth)


def _grams(h: np.ndarray, row: np.ndarray, orders: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the n-gram of each order that ends at each word, and which there are; (orders, words) each."""
    place = np.arange(len(h)) - np.searchsorted(row, row)  # of the word in its text
    a, b = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    first, second, there = [], [], []
    for k in range(1, orders.stop):
        # of the n-gram one word shorter that ends a word before
        a, b = (mix64(np.append(np.uint64(0), x[:-1]) * _BASE + h + np.uint64(k * c)) for x, c in ((a, 1), (b, 1001)))
        if k in orders:
            first.append(a)
            second.append(b)
            there.append(place >= k - 1)
    return tuple(np.array(x).reshape(len(orders), len(h)) for x in (first, second, there))


def _entries(h: np.ndarray, row: np.ndarray, orders: range, shards: int):
    """Distinct n-grams of a block in the order of (shard, hash): hashes, shards, numbers; also each n-gram's entry by
    (order, word). The empty n-gram is the first entry if orders has 1."""
    first, second, there = _grams(h, row, orders)
    key, shard = first[there], (second[there] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    bits = np.uint64(shards.bit_length())
    both = shard << (np.uint64(64) - bits) | key >> bits
    order = np.argsort(both)
    new = np.ones(len(order), bool)
    s, k = both[order], key[order]
    new[1:] = k[1:] != k[:-1]
    same = s[1:] == s[:-1]
    if (new[1:] & same).any():  # hashes that differ in their lowest bits only
        order = np.lexsort((key, shard))
        k = key[order]
        new[1:] = (k[1:] != k[:-1]) | (shard[order][1:] != shard[order][:-1])
    else:
        new[1:] |= ~same
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    keys, places = key[order[at]], shard[order[at]].astype(np.int64)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    if 1 in orders:
        keys, places, n, entry = np.append(np.uint64(0), keys), np.append(0, places), np.append(len(h), n), entry + 1
    index = np.full(there.shape, -1)
    index[there] = entry
    return keys, places, n, index


BLOCK = "block long, sizes array<long>, codes binary, n long, words binary, n_words long"


def _blocks(ids: pa.DataType, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 36
        waiting: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            texts = whole.column(1).combine_chunks()
            h, row = words(*column_bytes(texts))
            known, codes, n = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(known), np.uint32)  # frequent words get low numbers, whose high bytes are alike
            rank[np.argsort(-n, kind="stable")] = np.arange(len(known), dtype=np.uint32)
            known = known[np.argsort(rank)]
            column = whole.column(0).combine_chunks().cast(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            sizes = np.bincount(row, minlength=len(column))
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sizes], pa.list_(pa.int64())), pa.array([planes(rank[codes], 4)], pa.binary()), pa.array([len(h)]), pa.array([known.tobytes()], pa.binary()), pa.array([len(known)]), lists], ["block", "sizes", "codes", "n", "words", "n_words", "ids"])

        size = 0
        for batch in parts_of(batches, block_bytes):
            own = int(column_bytes(batch.column(1))[1][-1])
            if waiting and size + own > block_bytes:
                yield made()
                waiting, size, k = [], 0, k + 1
            waiting.append(batch)
            size += own
        if waiting:
            yield made()

    return tidy(run)


def blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    """The texts of documents (doc_id, text) in blocks; each reader finds the same ones, as they are written."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    return staged(rows.mapInArrow(_blocks(to_arrow_type(kind), block_bytes), parse(BLOCK).add("ids", ArrayType(kind))), "blocks")


def _words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, in order, and the text each belongs to."""
    known = np.frombuffer(row["words"], np.uint64)
    return known[unplanes(row["codes"], row["n"], 4)], np.repeat(np.arange(len(row["sizes"])), row["sizes"])


SENT = [("block", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("ns", pa.binary()), ("n", pa.int64())]
ANSWER = [("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("n", pa.int64())]


def _rows(rows: list[tuple], schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*rows)) or [()] * len(schema), schema)], [name for name, _ in schema])


def exploded(block: dict, orders: range, shards: int) -> list[tuple]:
    """Rows (block, shard, keys, ns, n) of the shards that the block has n-grams for."""
    keys, places, n, _ = _entries(*_words_of(block), orders, shards)
    full, begins = np.unique(places, return_index=True)
    out = []
    for shard, a, b in zip(full.tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]):
        steps = np.diff(keys[a:b], prepend=np.uint64(0))  # keys rise, but for the empty one, which is 0 and first
        out.append((block["block"], shard, planes(steps, 8), planes(n[a:b], 8), b - a))
    return out


def _explode(orders: range, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                rows = exploded(batch.slice(at, 1).to_pylist()[0], orders, shards)
                for k in range(0, max(1, len(rows)), 2000):
                    yield _rows(rows[k : k + 2000], SENT)

    return tidy(run)


def _count_and_join(rows: pa.Table) -> pa.Table:
    """A shard's table, summed from the corpus's rows, joined to the documents' rows."""
    given = rows.select(["block", "shard", "keys", "ns", "n", "asked", "counted"]).to_pylist()
    gram = np.concatenate([np.cumsum(unplanes(r["keys"], r["n"], 8), dtype=np.uint64) for r in given])
    n = np.concatenate([unplanes(r["ns"], r["n"], 8).astype(np.int64) * r["counted"] for r in given])
    order = np.argsort(gram)
    new = np.ones(len(gram), bool)
    new[1:] = gram[order[1:]] != gram[order[:-1]]
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    count = np.empty(len(gram), np.int64)
    count[order] = total[np.cumsum(new) - 1]
    out, at = [], 0
    for r in given:
        if r["asked"]:
            out.append((r["block"], r["shard"], planes(count[at : at + r["n"]], 8), r["n"]))
        at += r["n"]
    return pa.Table.from_batches([_rows(out, ANSWER)])


def _score(rounds: list[range], shards: int):
    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        row_of = block.select(["sizes", "codes", "n", "words"]).to_pylist()[0]
        h, row = _words_of(row_of)
        given = counts.sort_by([("round", "ascending"), ("shard", "ascending")])
        data, sizes, of, total, by_order = given.column("counts").to_pylist(), given.column("n").to_pylist(), given.column("round").to_numpy(), 1.0, []
        for k, orders in enumerate(rounds):
            index = _entries(h, row, orders, shards)[3]
            own = np.concatenate([unplanes(data[i], sizes[i], 8).astype(np.int64) for i in np.flatnonzero(of == k)] or [np.zeros(1, np.int64)])
            if k == 0:
                total = max(1.0, float(own[0]))
            by_order += [np.where(i >= 0, own[i], -1) for i in index]  # -1: the text has no such n-gram
        term = np.where(by_order[0] > 0, np.log(np.maximum(by_order[0], 1)), np.log(BACKOFF)) - np.log(total)
        for context, count in zip(by_order, by_order[1:]):
            before = np.append(1, context[:-1])
            known = np.log(np.maximum(count, 1)) - np.log(np.maximum(before, 1))
            term = np.where(count > 0, known, np.where(count == 0, np.log(BACKOFF) + term, term))
        n = len(row_of["sizes"])
        score = np.bincount(row, term, minlength=n) if len(row) else np.zeros(n)
        return pa.table([block.column("ids").combine_chunks().flatten(), pa.array(row_of["sizes"], pa.int64()), pa.array(score.astype(float))], ["doc_id", "n_words", "score"])

    return tidied_table(run)


def score(documents: DataFrame, corpus: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, n_words and score (natural logarithm) of every row of ``documents`` (doc_id, text)."""
    ship(documents.sparkSession)
    measure = lambda df: df.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    block_bytes, shards = sized(measure(documents) + (0 if corpus is None else measure(corpus)))
    given = blocks(documents, block_bytes)
    others = None if corpus is None else blocks(corpus, block_bytes)
    kind, answer = "block long, shard long, keys binary, ns binary, n long", "block long, shard long, counts binary, n long"
    rounds = [range(1, min(order, 2) + 1), *(range(k, k + 1) for k in range(3, order + 1))]
    made, counts = [], None
    for k, orders in enumerate(rounds):
        sent = given.drop("ids").mapInArrow(_explode(orders, shards), kind).withColumn("asked", F.lit(True)).withColumn("counted", F.lit(corpus is None))
        if others is not None:
            sent = sent.unionByName(others.drop("ids").mapInArrow(_explode(orders, shards), kind).withColumn("asked", F.lit(False)).withColumn("counted", F.lit(True)))
        made.append(staged(sent.groupBy("shard").applyInArrow(tidied_table(_count_and_join), answer), "counts"))
        joined = made[-1].withColumn("round", F.lit(k))
        counts = joined if counts is None else counts.unionByName(joined)
    if others is not None:
        drop_staged(others)
    schema = documents.select("doc_id").schema.add("n_words", "long").add("score", "double")
    out = staged(given.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_score(rounds, shards), schema), "scores")
    drop_staged(given, *made)
    return out


#: DuckDB SQL of score(), rounded to 4 digits, over ``documents``: no n-gram of the corpus itself backs off.
SQL = r"""
    WITH t AS (
        SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS ws FROM documents
    ), w AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t) x WHERE w <> ''),
    p AS (SELECT doc_id, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c1 AS (SELECT w, count(*)::DOUBLE AS c FROM p GROUP BY w), c2 AS (SELECT v, w, count(*)::DOUBLE AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
    c3 AS (SELECT u, v, w, count(*)::DOUBLE AS c FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
    s AS (
        SELECT p.doc_id, CASE WHEN p.u IS NOT NULL THEN ln(c3.c / h2.c) WHEN p.v IS NOT NULL THEN ln(c2.c / h1.c) ELSE ln(c1.c / (SELECT count(*) FROM w)) END AS term
        FROM p JOIN c1 ON c1.w = p.w LEFT JOIN c1 h1 ON h1.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w
        LEFT JOIN c2 h2 ON h2.v = p.u AND h2.w = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
    )
    SELECT t.doc_id, count(s.term) AS n_words, round(coalesce(sum(s.term), 0), 4) AS score FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id
"""
