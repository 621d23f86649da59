r"""Operator 12: packing of token ids into sequences under several limits, by vector bin packing.

A sequence holds at most ``tokens`` ids, ``segments`` pieces and ``loss`` ids that bear loss, all at once. The open
sequence takes, from a pool of examples, the one that fits with the largest dot product of what it needs and what is left
(each a vector of shares of the limits, weighted by the mean need of the pool); if none fits, the longest one is cut to
what is left. So a limit that runs short draws examples that spare it. A sequence that a limit other than tokens closes,
and the last of a task, is dealt into sequences of powers of two. Nothing else of a sequence is padded, so the loss is
none: lengths are ``tokens`` or a power of two. Examples that shall stay whole (``cut=False``) are cut only where one
alone exceeds a limit; sequences may then be shorter.

Packing goes on within each of Spark's partitions, in the order of its rows, with a pool of fixed size: no shuffle, and
memory does not follow the input. sequence_id is the partition's number in the high bits and a counter in the low ones,
so a task that runs again gives the same sequences. The last sequences of a partition are short, ten at most.

Texts are tokenised in the same pass. A match of a byte-level pattern never spans a boundary before a space that a
character other than white space follows (white space before it leaves the last space to the next match), nor one behind
the last letter of a run, nor one beside a single line feed. So a text is cut there, and each distinct part is encoded by
the tokenizer once while a table of fixed size has it. Special tokens in a text are taken as the tokenizer takes them.

Token ids are binary: little-endian unsigned 32-bit numbers, as training files hold them. Null texts count as empty: their
ids are the closing id alone. Null ids have no pieces. Rows with null or repeated ids, and repeated texts, are packed each
on its own; there are no ties but of equal dot products, where the earlier example goes first. A very long text makes a
block of its own. An empty table gives an empty result. Only doc_id and text (or ids and loss) are read, so
other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import ship, tidy
from curata.llm.kernels import blocks, column_bytes, values

TOKENS, SEGMENTS = 1024, 256
#: Examples in a pool; bytes of texts read at a time; parts whose ids are kept; bytes of ids in a batch.
POOL, BLOCK_BYTES, KEPT_PARTS, BATCH_BYTES = 512, 4 << 20, 1_000_000, 4 << 20

#: Latin letters and other ASCII marks, of which no library doubts what they are.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x7F)]] = True
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

_tokenizers: dict[str, Tokens] = {}


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts of the texts begin that can be encoded alone."""
    n = len(raw)
    trail = np.zeros(n, bool)  # second bytes of U+00C0 to U+00FF but the signs of multiplication and division
    trail[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    lead = np.zeros(n, bool)
    lead[:-1] = trail[1:]
    ascii_letter = _LETTER[raw]
    letter = ascii_letter | trail
    ink = _MARK[raw] | trail | lead  # certainly not white space
    cut = np.zeros(n + 1, bool)
    cut[1:n] = letter[:-1] & (raw[1:] < 0x80) & ~ascii_letter[1:]
    cut[: n - 1] |= (raw[:-1] == 32) & ink[1:]
    line = np.flatnonzero(raw == 10)
    line = line[(line > 0) & (line < n - 1)]
    line = line[ink[line - 1] & ink[line + 1]]
    cut[line] = cut[line + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Tokens:
    """Ids of texts by a byte-level tokenizer of the library ``tokenizers``, packed as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _learn(self, parts: list[bytes]) -> None:
        """Encode new parts: words with a space as one text, other words as lines of one, the rest one by one."""
        texts = [p.decode() for p in parts]
        spaced, lines, others = [], [], []
        for t in texts:
            (others if not _WORD.fullmatch(t) else spaced if t[0] == " " else lines).append(t)
        for t, got in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.kept[t.encode()] = np.array(got.ids, "<u4").tobytes()
        for words, line in ((spaced, 0), (lines, 1)):
            for s in range(0, len(words), 5000):
                some = words[s : s + 5000]
                got = self.tokenizer.encode(("\n" * line).join(some), add_special_tokens=False)
                begins = np.array(got.offsets, np.int32)[:, 0]
                lengths = np.fromiter(map(len, some), np.int64, len(some))
                starts = np.cumsum(lengths + line) - lengths - line
                data = np.array(got.ids, "<u4").tobytes()
                firsts, lasts = (4 * np.searchsorted(begins, x) for x in (starts, starts + lengths))
                self.kept.update((t.encode(), data[a:b]) for t, a, b in zip(some, firsts.tolist(), lasts.tolist()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column."""
        raw, offsets = column_bytes(texts)
        data = raw.tobytes()
        if any(s in data for s in self.special):  # special tokens are found before the pattern is applied
            whole = [data[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        if not len(raw):
            return [b""] * len(texts)
        starts = _cuts(raw, offsets)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(data)]).dictionary_encode()
        parts = values(coded.dictionary)
        got = list(map(self.kept.get, parts))
        if new := [p for p, ids in zip(parts, got) if ids is None]:
            if len(self.kept) > KEPT_PARTS:  # those met first are the frequent ones
                self.kept = dict(islice(self.kept.items(), KEPT_PARTS // 2))
                self.kept.update((p, ids) for p, ids in zip(parts, got) if ids is not None)
            self._learn(new)
            got = list(map(self.kept.__getitem__, parts))
        pool = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        which = coded.indices.to_numpy()
        length = sizes[which]
        ends = np.cumsum(length)
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - length), length) + np.arange(ends[-1])].tobytes()
        edges = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]


class Packer:
    """Packs examples into sequences; gives pieces (key, start, length, ids, tokens of the example, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, pool: int = POOL):
        self.limits, self.cut, self.size = np.array([tokens, segments, loss], float), cut, pool
        self.keys: list = []
        self.need = np.zeros((0, 3))  # of each example in the pool, what is left of it: ids, pieces, ids that bear loss
        self.sequence = -1
        self.out: list[tuple] = []
        self.open: list[tuple] = []
        self.left = self.limits.copy()

    def add(self, key, ids: bytes, mask: bytes | None) -> None:
        example = [key, ids, None if mask is None else np.append(0, np.cumsum(np.frombuffer(mask, np.uint8) != 0)), 0, len(ids) // 4]
        # what fills sequences alone does so at once
        while example[3] < example[4] and ((need := self._need(example)) > self.limits).any() or example[3] < example[4] == example[3] + self.limits[0]:
            given = self.open, self.left
            self.open, self.left = [], self.limits.copy()
            self._place(example, self._fits(example))
            self._close()
            self.open, self.left = given
        if example[3] < example[4]:
            self.keys.append(example)
            self.need = np.vstack([self.need, self._need(example)])
            if len(self.keys) >= self.size:
                self._fill(self.size // 2)

    def finish(self) -> None:
        self._fill(0)
        self._close()

    def _need(self, example) -> np.ndarray:
        _, _, bears, start, end = example
        return np.array([end - start, 1, end - start if bears is None else bears[end] - bears[start]], float)

    def _fits(self, example) -> int:
        """How many ids of the example the open sequence can still take."""
        _, _, bears, start, end = example
        most = min(end - start, int(self.left[0])) if self.left[1] >= 1 else 0
        if bears is None:
            return min(most, int(self.left[2]))
        return min(most, int(np.searchsorted(bears, bears[start] + self.left[2], "right")) - 1 - start)

    def _place(self, example, n: int) -> None:
        _, _, bears, start, _ = example
        self.open.append((example, start, n))
        self.left -= [n, 1, n if bears is None else bears[start + n] - bears[start]]
        example[3] += n

    def _fill(self, until: int) -> None:
        weight = self.need.mean(axis=0) / self.limits**2 if len(self.need) else None
        while len(self.keys) > until:
            fits = (self.need <= self.left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, self.need @ (weight * self.left), -1.0)))
                self._place(self.keys[k], int(self.need[k, 0]))
            else:
                k = int(np.argmax(self.need[:, 0]))
                n = self._fits(self.keys[k]) if self.cut else 0
                if n:
                    self._place(self.keys[k], n)
                    self.need[k] = self._need(self.keys[k])
                self._close()
                continue
            del self.keys[k]
            self.need = np.delete(self.need, k, axis=0)
            if not self.left[0]:
                self._close()

    def _close(self) -> None:
        """End the open sequence: whole, or in powers of two, the largest first."""
        total = sum(n for _, _, n in self.open)
        whole = total == self.limits[0] or not self.cut
        sizes = [total] if whole else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        pieces = iter(self.open)
        example, start, n = next(pieces, (None, 0, 0))
        for size in sizes if total else []:
            self.sequence += 1
            offset = 0
            while offset < size:
                if not n:
                    example, start, n = next(pieces)
                take = min(n, size - offset)
                self.out.append((example[0], start, take, example[1][4 * start : 4 * (start + take)], example[4], self.sequence, offset))
                offset, start, n = offset + take, start + take, n - take
        self.open, self.left = [], self.limits.copy()


def _packed(read, key: pa.DataType, limits: tuple) -> object:
    """An Arrow function: examples that ``read`` gives of a batch, packed over the whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer = Packer(*limits)
        kinds = [key, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * 7
            columns[5] = [base + s for s in columns[5]]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

        for batch in batches:
            size = 0
            for example in read(batch):
                packer.add(*example)
                size += len(example[1])
                if size > BATCH_BYTES:
                    yield taken()
                    size = 0
            yield taken()
        packer.finish()
        yield taken()

    return tidy(run)


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _run(rows: DataFrame, read, limits: tuple) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    ship(rows.sparkSession)
    schema = rows.select("doc_id").schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(_packed(read, to_arrow_type(schema["doc_id"].dataType), limits), schema)


def pack(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True) -> DataFrame:
    """Pieces of examples (doc_id, ids and, if there, loss: a byte for each id, other than 0 if it bears loss; null: all do).

    Returns doc_id, start (ids of the example before the piece), length, ids, doc_tokens (of the whole example),
    sequence_id and offset (in the sequence).
    """
    masked = "loss" in examples.columns

    def read(batch: pa.RecordBatch):
        masks = batch.column(2) if masked else [None] * len(batch)
        for key, ids, mask in zip(batch.column(0), batch.column(1), masks):
            yield key.as_py(), ids.as_py() or b"", mask.as_py() if mask is not None else None

    return _run(examples.select("doc_id", "ids", *["loss"] * masked), read, (tokens, segments, tokens if loss is None else loss, cut))


def pack_texts(documents: DataFrame, path: str, closing: int = 0, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True) -> DataFrame:
    """As pack(), of documents (doc_id, text): the ids of each whole text by the tokenizer file, then ``closing``."""
    end = closing.to_bytes(4, "little")

    def read(batch: pa.RecordBatch):
        for block in blocks([batch], BLOCK_BYTES):
            for key, ids in zip(block.column(0), Tokens.of(path).encode(block.column(1))):
                yield key.as_py(), ids + end, None

    return _run(documents.select("doc_id", "text"), read, (tokens, segments, tokens if loss is None else loss, cut))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
