r"""Operator 11: importance resampling towards a target distribution, with a dictionary of distinct features.

Words are runs ``[0-9a-z\x80-]+`` of a text with A-Z lower-cased; features are all runs of one to ORDER words, joined by
one space, repeats counted. A feature's bucket is its CRC-32 modulo BUCKETS. With S and s for the features of the
documents and of a bucket, and T and t for those of the target texts, a bucket's gain is

    floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))),

a document's weight is the sum of the gains of its features, and of the documents with LEAST_WORDS words or more a share
of PERCENT is drawn without replacement by Gumbel's trick: the highest weights plus seeded noise.

1. *blocks*: the documents of a task are read once into blocks: distinct words, and the texts as numbers of words.
2. *dictionary*: blocks send their distinct features, as strings with counts, to shards chosen by a hash. A shard sums
   the counts of each string, hashes each distinct string once, adds the counts up by bucket, and answers each block
   with the buckets of its strings, in their order. This goes in slices, one after the other, each with its own share of
   the strings, so that the strings on disk at a time are a part of all.
3. *gains*: the buckets' sums give 10,000 gains, whose number is fixed.
4. *join*: a block meets its answers, and gains are added up over the counts of its documents' features.
5. *rank*: scores are dealt to ranges; a score's rank is its place in its range after the sizes of the ranges before.

A feature that is everywhere is an entry for each block, not for each occurrence. Strings are compared as strings; hashes
only choose shards. Numbers of blocks and shards follow the input, sizes do not.

Null texts have no words, weight 0 and no rank. A null doc_id draws its noise as an empty one. Rows with repeated ids are
counted and drawn each on its own; ties of scores go to smaller ids, then to smaller weights. Long texts make a block
longer. An empty table gives an empty result, an empty target T = 0. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curata.llm.common import drop_staged, mix64, ship, staged, tidied_table, tidy
from curata.llm.kernels import blocks as slices_of
from curata.llm.kernels import _BYTE, _PLACE, column_bytes, crc_sql, grow, planes, shrink, unplanes, values

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Bytes of text in a block; strings in a shard, about; slices of the dictionary; bits of a packed feature.
BLOCK_BYTES, SHARD_STRINGS, SLICES, PACKED_BITS = 12 << 20, 1 << 20, 4, 63

_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lines(data: bytes) -> pa.LargeStringArray:
    """Strings that each end with a line feed."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    lengths = np.diff(ends, prepend=-1) - 1
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(raw[raw != 10]))


def _as_lines(strings: pa.Array) -> bytes:
    return b"\n".join([*values(strings), b""])


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words, lower-cased, and how many each text has."""
    ink = _INK[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = ink[edges]
    last[edges[edges > 0] - 1] = ink[edges[edges > 0] - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(_LOWER[raw[ink]]))
    return words, np.diff(np.searchsorted(starts, offsets))


def _word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A hash of each word, a sum over its bytes: it only chooses slices and shards."""
    raw, offsets = column_bytes(words)
    if not len(words):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    np.minimum(place, len(_PLACE) - 1, out=place)
    return mix64(np.add.reduceat(np.take(_BYTE, raw) * np.take(_PLACE, place), offsets[:-1]))


def _to_block(ids: pa.Array, texts: pa.Array) -> dict:
    words, sizes = _words(*column_bytes(texts))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.uint32)
    rank = np.empty(len(coded.dictionary), np.uint32)  # frequent words get low numbers, whose high bytes are alike
    rank[np.argsort(-np.bincount(codes, minlength=len(rank)), kind="stable")] = np.arange(len(rank), dtype=np.uint32)
    lines = _as_lines(coded.dictionary.take(pa.array(np.argsort(rank))))
    return {"ids": ids, "sizes": sizes, "codes": planes(rank[codes], 4), "n": len(codes), "words": shrink(lines), "bytes": len(lines)}


BLOCK = "block long, sizes array<long>, codes binary, n long, words binary, bytes long"


def _blocks(ids: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 36
        waiting: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            b = _to_block(*(table.column(c).combine_chunks() for c in (0, 1)))
            columns = [pa.array([k]), pa.array([b["sizes"]], pa.list_(pa.int64())), pa.array([b["codes"]], pa.binary()), pa.array([b["n"]]), pa.array([b["words"]], pa.binary()), pa.array([b["bytes"]])]
            whole = pa.ListArray.from_arrays(pa.array([0, len(b["ids"])], pa.int32()), b["ids"].cast(ids))
            return pa.RecordBatch.from_arrays([*columns, whole], ["block", "sizes", "codes", "n", "words", "bytes", "ids"])

        size = 0
        for batch in slices_of(batches, BLOCK_BYTES):
            own = int(column_bytes(batch.column(1))[1][-1])
            if waiting and size + own > BLOCK_BYTES:
                yield made()
                waiting, size, k = [], 0, k + 1
            waiting.append(batch)
            size += own
        if waiting:
            yield made()

    return tidy(run)


def blocks(documents: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType
    from pyspark.sql.types import _parse_datatype_string as parse

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    return staged(rows.mapInArrow(_blocks(to_arrow_type(kind)), parse(BLOCK).add("ids", ArrayType(kind))), "blocks")


class Features:
    """The features of a block: packed numbers of words, by order, and the shard of each."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, words: pa.LargeStringArray, shards: int, slices: int):
        self.codes, self.words, self.shards = codes, words, np.uint64(shards)
        self.bits = max(1, len(words).bit_length())
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))).astype(np.int32)  # words to the text's end
        self.hash = _word_hashes(words)
        self.slice_of = (mix64(self.hash) % np.uint64(slices)).astype(np.uint16)

    def of(self, order: int, at: np.ndarray) -> np.ndarray:
        """The packed numbers of the features that begin at ``at``."""
        packed = self.codes[at].astype(np.int64)
        for k in range(1, order):
            if self.bits * (k + 1) > PACKED_BITS:  # too many words for their bits: number what is there so far
                packed = np.unique(packed, return_inverse=True)[1]
            packed = packed * (1 << self.bits) + self.codes[at + k]
        return packed

    def distinct(self, order: int, at: np.ndarray, packed: np.ndarray):
        """Distinct packed numbers' words and shards in order, and how often each is there."""
        if self.bits * order <= PACKED_BITS:
            found, n = np.unique(packed, return_counts=True)
            codes = [found >> self.bits * (order - 1 - k) & (1 << self.bits) - 1 for k in range(order)]
        else:
            found, where, n = np.unique(packed, return_index=True, return_counts=True)
            codes = [self.codes[at[where] + k] for k in range(order)]
        h = np.zeros(len(found), np.uint64)
        for c in codes:
            h = mix64(h * np.uint64(3) + self.hash[c])
        shard = h % self.shards
        return codes, n, shard.astype(np.uint16 if self.shards < 65536 else np.int64)

    def slice(self, slice_: int) -> Iterator[tuple]:
        """By order: where the slice's features begin, their packed numbers, and distinct() of them.

        The first word chooses the slice.
        """
        at = np.flatnonzero((self.slice_of == slice_)[self.codes])
        for order in range(1, ORDER + 1):
            at = at[self.left[at] >= order]
            packed = self.of(order, at)
            yield at, packed, *self.distinct(order, at, packed)


def _features(row, shards: int, slices: int) -> Features:
    n, size = row["n"], row["bytes"]
    return Features(unplanes(row["codes"], n, 4), np.array(row["sizes"], np.int64), _lines(grow(row["words"], size)), shards, slices)


def _explode(slice_: int, shards: int, slices: int):
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    line = pa.scalar("\n", pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(len(batch)):
                (row,) = batch.slice(place, 1).to_pylist()
                own = _features(row, shards, slices)
                ended = pc.binary_join_element_wise(own.words, line, none)  # a feature's last word ends its line
                parts = []  # of each order, its strings and counts by shard
                for _, _, codes, n, shard in own.slice(slice_):
                    order = np.argsort(shard, kind="stable")
                    codes = [pa.array(c[order]) for c in codes]
                    last = ended.take(codes[-1])
                    raw, offsets = column_bytes(pc.binary_join_element_wise(*(own.words.take(c) for c in codes[:-1]), last, space) if len(codes) > 1 else last)
                    parts.append((raw, offsets, n[order], np.searchsorted(shard[order], np.arange(shards + 1))))
                out: list[tuple] = []
                size = 0
                for s in range(shards):
                    lines = b"".join(raw[offsets[edges[s]] : offsets[edges[s + 1]]].tobytes() for raw, offsets, _, edges in parts)
                    if not lines:
                        continue
                    own_n = np.concatenate([n[edges[s] : edges[s + 1]] for _, _, n, edges in parts])
                    out.append((row["block"], s, shrink(lines), len(lines), planes(own_n, 4), len(own_n)))
                    size += len(lines)
                    if size > 8 << 20:
                        yield _batch(out, SENT)
                        out, size = [], 0
                yield _batch(out, SENT)

    return tidy(run)


SENT = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("strings", pa.binary()), ("bytes", pa.int64()), ("ns", pa.binary()), ("n", pa.int64())])
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("buckets", pa.binary()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _dictionary(rows: pa.Table) -> pa.Table:
    """A shard: the buckets of each block's strings, and as a row without a block the sums of the buckets."""
    given = rows.to_pylist()
    strings = pa.concat_arrays([_lines(grow(r["strings"], r["bytes"])) for r in given])
    n = np.concatenate([unplanes(r["ns"], r["n"], 4) for r in given])
    coded = strings.dictionary_encode()
    del strings
    index = coded.indices.to_numpy()
    total = np.bincount(index, n, minlength=len(coded.dictionary))  # exact below 2^53
    bucket = np.fromiter(map(zlib.crc32, values(coded.dictionary)), np.uint32, len(coded.dictionary)) % np.uint32(BUCKETS)
    sums = np.bincount(bucket, total, minlength=BUCKETS).astype(np.int64)
    out = [(None, given[0]["shard"], planes(sums, 8), BUCKETS)]
    at = 0
    for r in given:
        out.append((r["block"], r["shard"], planes(bucket[index[at : at + r["n"]]], 2), r["n"]))
        at += r["n"]
    return pa.Table.from_batches([_batch(out, ANSWER)])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total += unplanes(data, BUCKETS, 8).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])


def dictionary(given: DataFrame, slices: int = SLICES) -> tuple[list[DataFrame], int, np.ndarray]:
    """Of blocks: the answers (block, shard, buckets, n) of each slice, the number of shards, and the buckets' sums."""
    words = given.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = int(1 + words * 3 // 2 // slices // SHARD_STRINGS)
    answers = []
    for k in range(slices):
        sent = given.select("block", "sizes", "codes", "n", "words", "bytes").mapInArrow(_explode(k, shards, slices), "block long, shard long, strings binary, bytes long, ns binary, n long")
        answers.append(staged(sent.groupBy("shard").applyInArrow(tidied_table(_dictionary), "block long, shard long, buckets binary, n long"), "answers"))
    sums = np.zeros(BUCKETS, np.int64)
    for a in answers:
        found = a.where("block is null").select("buckets").mapInArrow(tidy(_sums), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        sums[found["bucket"].to_numpy()] += found["n"].to_numpy()
    return answers, shards, sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weigh(gain: np.ndarray, shards: int, slices: int, some: range):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.select(["sizes", "codes", "n", "words", "bytes"]).to_pylist()[0]
        own = _features(row, shards, slices)
        sizes = np.array(row["sizes"], np.int64)
        weight = np.zeros(len(sizes))
        said = answers.sort_by([("slice", "ascending"), ("shard", "ascending")])
        data, lengths, of = said.column("buckets").to_pylist(), said.column("n").to_pylist(), said.column("slice").to_numpy()
        for k in some:
            bucket = np.concatenate([unplanes(data[i], lengths[i], 2) for i in np.flatnonzero(of == k)] or [np.zeros(0, np.uint16)])
            parts = list(own.slice(k))
            order = np.argsort(np.concatenate([p[4] for p in parts]), kind="stable")
            value = np.empty(len(order))
            value[order] = gain[bucket]
            begin = 0
            for at, packed, _, n, _ in parts:
                each = np.empty(len(packed))
                each[np.argsort(packed)] = np.repeat(value[begin : begin + len(n)], n)  # equal ones lie together, in any order
                weight += np.bincount(own.row[at], each, minlength=len(sizes))  # exact below 2^53
                begin += len(n)
        features = sum(np.maximum(sizes - k, 0) for k in range(ORDER))
        ids = block.column("ids").combine_chunks().flatten()
        names = ["block", "row", "doc_id", "n_words", "n_features", "weight"]
        return pa.table([pa.array(np.full(len(sizes), block.column("block")[0].as_py())), pa.array(np.arange(len(sizes))), ids, pa.array(sizes), pa.array(features), pa.array(weight.astype(np.int64))], names)

    return tidied_table(run)


def weights(documents: DataFrame, target: DataFrame, slices: int = SLICES) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``documents`` (doc_id, text), for texts like ``target`` (text)."""
    ship(documents.sparkSession)
    like = blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    asked, _, wanted = dictionary(like, 1)
    drop_staged(like, *asked)
    given = blocks(documents)
    answers, shards, sums = dictionary(given, slices)
    gain = gains(sums, wanted)
    schema = documents.select("doc_id").schema
    fields = [StructField("block", LongType()), StructField("row", LongType()), *schema.fields, *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))]
    parts = []
    for some in (range(0, slices // 2), range(slices // 2, slices)):  # one after the other: half of the answers move at a time
        if not some:
            continue
        said = None
        for k in some:
            a = answers[k].where("block is not null").withColumn("slice", F.lit(k))
            said = a if said is None else said.unionByName(a)
        met = given.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_weigh(gain, shards, slices, some), StructType(fields))
        parts.append(staged(met, "weights"))
        drop_staged(*(answers[k] for k in some))
    drop_staged(given)
    if len(parts) == 1:
        return parts[0].drop("block", "row")
    both = parts[0].unionByName(parts[1]).groupBy("block", "row")
    out = staged(both.agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), F.min("n_features").alias("n_features"), F.sum("weight").alias("weight")).drop("block", "row"), "weights")
    drop_staged(*parts)
    return out


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``documents``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(documents, target, slices).withColumn("score", F.col("weight") + noise)
    columns = ["doc_id", "n_features", "weight", "score"]
    fit = scored.where(F.col("n_words") >= LEAST_WORDS).select(*columns)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight")]
    ranges = staged(fit.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    before = np.append(0, np.cumsum([r["n"] for r in sizes])).tolist()
    drawn = before[-1] * percent // 100
    offsets = scored.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, before long")
    place = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).cast("long")
    ranked = ranges.join(F.broadcast(offsets), "part").withColumn("place", place)
    rest = scored.where(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(rest)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL of resample() over ``documents``, towards ``benchmark``.
SQL = f"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT 'd' AS side, doc_id AS id, {_SQL_WORDS} AS ws FROM documents
        UNION ALL SELECT 't', item_id, {_SQL_WORDS} FROM benchmark
    ), f AS MATERIALIZED (
        SELECT side, id, f, count(*) AS n FROM (
            SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w
        ) x GROUP BY ALL
    ), keyed AS (SELECT f AS k FROM f), {crc_sql('keyed')},
    c AS (SELECT k AS f, crc % 10000 AS bucket FROM crc),
    k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM f JOIN c USING (f) GROUP BY bucket),
    g AS (
        SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k) + 10000)::DOUBLE)))::BIGINT AS gain FROM k
    ), e AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
    s AS (
        SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM w LEFT JOIN e ON e.id = w.id WHERE w.side = 'd'
    ), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn FROM s WHERE n_words >= 20)
    SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id
"""
