"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of 2 * HALF bytes that overlap by half and together cover all of it. On each byte
position, FILTERS learned filters of WIDTH bytes fire; their rectified mean over a chunk, and the share of distinct
3-byte strings in it, enter a small dense layer, whose units are max-pooled over the whole text and combined into one
probability.

It is fitted in the driver on a bounded sample: of each class the SAMPLE labelled documents that come first by a hash of
their id. Of a text over SAMPLE_BYTES, stretches of whole chunks from all over it are learnt from, evenly spaced, which
have so many bytes together. The network has a few thousand numbers; these are all that is broadcast. Scoring is one pass
without a shuffle, over whole texts.

A null or empty text is scored as one chunk of padding. With labels of one class only, or none, every text gets 0.5.
Repeated label rows count once; a document with contradicting labels is not learnt from, and of texts that share an id
the smallest is. Null ids are in no fold. Scores of equal texts are equal. An empty table gives an empty result. Only
doc_id and text are read, and columns that are kept may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import ship, tidy
from curata.llm.kernels import blocks, column_bytes
from curata.llm.langid import held_out

#: Bounds of the sample that the network is fitted on: documents of each class, and bytes of a document, which are taken
#: from a longer one in stretches of so many bytes.
SAMPLE, SAMPLE_BYTES, STRETCH = 1000, 16_000, 1024
HALF, WIDTH, FILTERS, UNITS = 64, 3, 12, 16
STEPS, BATCH, RATE, DECAY = 300, 48, 0.01, 1e-4
#: A score from here on counts as label 1.
CUT = 0.3


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (FILTERS + 1, UNITS)
    dense_bias: np.ndarray  # (UNITS,)
    out: np.ndarray  # (UNITS,)
    out_bias: np.ndarray  # (1,)

    @classmethod
    def start(cls, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(f(0.3, WIDTH, 256, FILTERS), f(0, FILTERS), f(0.5, FILTERS + 1, UNITS), f(0, UNITS), f(0.3, UNITS), f(0, 1))

    def numbers(self) -> list[np.ndarray]:
        return [getattr(self, x.name) for x in fields(self)]


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up with zero bytes to whole halves, two at least; halves of each text."""
    sizes = np.diff(offsets)
    halves = np.maximum(2, -(-sizes // HALF))
    out = np.zeros(int(halves.sum()) * HALF, np.uint8)
    to = (np.cumsum(halves) - halves) * HALF
    out[np.arange(len(raw)) + np.repeat(to - offsets[:-1], sizes)] = raw
    return out, halves


def shifted(data: np.ndarray, halves: np.ndarray) -> list[np.ndarray]:
    """The bytes 0 to WIDTH - 1 positions on, with zeros behind each text's end: a text's result depends on it alone."""
    end = np.cumsum(halves) * HALF
    out = [data]
    for j in range(1, WIDTH):
        on = np.append(data[j:], np.zeros(j, np.uint8))
        for k in range(1, j + 1):
            on[end - k] = 0
        out.append(on)
    return out


def half_sums(net: Network, on: list[np.ndarray], keep: bool = False):
    """Sum of the rectified filters over each half; with ``keep`` also the filters themselves."""
    a = net.filters[0][on[0]] + net.bias
    for j in range(1, WIDTH):
        a += net.filters[j][on[j]]
    np.maximum(a, 0, out=a)
    return (a.reshape(-1, HALF, FILTERS).sum(axis=1), a) if keep else a.reshape(-1, HALF, FILTERS).sum(axis=1)


def distinct_share(on: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Distinct 3-byte strings in each chunk, as a share of its positions."""
    gram = (on[0].astype(np.uint32) | on[1].astype(np.uint32) << np.uint32(8) | on[2].astype(np.uint32) << np.uint32(16)).reshape(-1, HALF)
    share = np.empty(len(first), np.float32)
    for i in range(0, len(first), 4096):
        at = first[i : i + 4096]
        window = np.sort(np.concatenate([gram[at], gram[at + 1]], axis=1), axis=1)
        share[i : i + 4096] = (window[:, 1:] != window[:, :-1]).mean(axis=1)
    return share


def chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each chunk's first half, and where each text's chunks begin."""
    inner = np.ones(int(halves.sum()), bool)
    inner[np.cumsum(halves) - 1] = False
    return np.flatnonzero(inner), np.cumsum(halves - 1) - (halves - 1)


def probabilities(net: Network, raw: np.ndarray, offsets: np.ndarray, step: int = 4096) -> np.ndarray:
    """The network's answer for each text; the filters are held for ``step`` halves at a time."""
    data, halves = padded(raw, offsets)
    on = shifted(data, halves)
    sums = np.concatenate([half_sums(net, [x[i * HALF : (i + step) * HALF] for x in on]) for i in range(0, len(data) // HALF, step)])
    first, begin = chunks(halves)
    x = np.concatenate([(sums[first] + sums[first + 1]) / (2 * HALF), distinct_share(on, first)[:, None]], axis=1)
    pooled = np.maximum.reduceat(np.maximum(x @ net.dense + net.dense_bias, 0), begin, axis=0)
    return 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias[0]).astype(float)))


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the cross entropy, with both classes weighed alike; same input, same network."""
    net = Network.start()
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    r = np.random.default_rng(2)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.numbers()]
    order = np.empty(0, int)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(texts)):
            order = np.concatenate([order, r.permutation(len(texts))])
        at, order = order[:BATCH], order[BATCH:]
        grads = gradients(net, [texts[k] for k in at], labels[at].astype(np.float32), weight[at])
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, (m, v) in zip(net.numbers(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return net


def gradients(net: Network, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    offsets = np.cumsum([0, *map(len, texts)])
    data, halves = padded(np.frombuffer(b"".join(texts), np.uint8), offsets)
    on = shifted(data, halves)
    sums, a = half_sums(net, on, keep=True)
    first, begin = chunks(halves)
    x = np.concatenate([(sums[first] + sums[first + 1]) / (2 * HALF), distinct_share(on, first)[:, None]], axis=1)
    u = np.maximum(x @ net.dense + net.dense_bias, 0)
    stop = np.append(begin[1:], len(first))
    winner = np.stack([b + u[b:s].argmax(axis=0) for b, s in zip(begin, stop)])  # (texts, UNITS)
    pooled = u[winner, np.arange(UNITS)]
    p = 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias[0])))
    d = ((p - y) * weight / len(texts)).astype(np.float32)
    d_pool = d[:, None] * net.out * (pooled > 0)
    d_u = np.zeros_like(u)
    np.add.at(d_u, (winner, np.arange(UNITS)), d_pool)
    d_x = (d_u @ net.dense.T)[:, :FILTERS] / (2 * HALF)
    d_sums = np.zeros_like(sums)
    np.add.at(d_sums, first, d_x)
    np.add.at(d_sums, first + 1, d_x)
    d_a = np.repeat(d_sums, HALF, axis=0) * (a > 0)
    live = np.flatnonzero(np.repeat(np.abs(d_sums).sum(axis=1) > 0, HALF))
    d_live = d_a[live]
    d_filters = np.stack([np.stack([np.bincount(on[j][live], d_live[:, f], 256) for f in range(FILTERS)], axis=1) for j in range(WIDTH)]).astype(np.float32)
    return [d_filters, d_live.sum(axis=0), (x.T @ d_u).astype(np.float32), d_u.sum(axis=0), pooled.T @ d, np.array([d.sum()], np.float32)]


def learn(documents: DataFrame, labels: DataFrame) -> Network:
    """Fit the network on the sample; held-out rows are not in it."""
    ship(documents.sparkSession)
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    order = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = [ids.where(F.col("label") == k).orderBy(order, "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "label"))  # 2 * SAMPLE rows of two numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([excerpt(t.as_buffer().to_pybytes()) if t.is_valid else b"" for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["doc_id", "label", "text"])

    texts = documents.select("doc_id", "text").join(sample, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    each = texts.mapInArrow(tidy(cut), "doc_id long, label int, text binary").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["label"], bytes(r["text"])) for r in each.collect())
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], int))


def excerpt(text: bytes) -> bytes:
    """A text, or evenly spaced stretches of a long one."""
    if len(text) <= SAMPLE_BYTES:
        return text
    starts = np.linspace(0, len(text) - STRETCH, SAMPLE_BYTES // STRETCH).astype(int)
    return b"".join(text[i : i + STRETCH] for i in starts)


def scored(df: DataFrame, net: Network, keep: list[str], score: str = "score") -> DataFrame:
    """Columns ``keep`` of ``df`` and the probability that a text is of label 1."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(net)
    kept = df.select(*keep).schema
    taken = ["text" if c == "text" else f"__{i}" for i, c in enumerate(keep)]  # names cannot clash in between

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20):
            raw, offsets = column_bytes(block.column(block.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*(block.column(block.schema.get_field_index(c)) for c in taken), pa.array(probabilities(model.value, raw, offsets))], [*kept.names, score])

    schema = T.StructType([*kept.fields, T.StructField(score, T.DoubleType())])
    own = [] if "text" in keep else [F.col("text")]
    return df.select(*(F.col(c).alias(t) for c, t in zip(keep, taken)), *own).mapInArrow(tidy(run), schema)


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = documents.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    return scored(rows, learn(documents, labels), ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
