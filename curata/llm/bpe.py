r"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the splitting pattern) is cut into halves down to single bytes, and encodings are joined upwards.
``join`` re-encodes a window across the seam, and widens it until both its edges are stable: a token sequence is the
BPE encoding of its bytes exactly when each pair of neighbours is the encoding of its own two tokens' bytes (the merges
inside such a pair run in the same order alone as within the text, so the first merge over a boundary would have to
occur in the pair too). Pairs inside the left, the window and the right are so already, which leaves the two edges.
``join`` is therefore associative with the empty encoding as unit, and any tree gives the same ids. Nodes of up to
SHORT bytes, stable pairs and windows are kept in tables of a bounded size, as words share them.

Texts are concatenations of pieces, so their ids are concatenated. With a pattern of PATTERNS, a match never goes on from
a character other than white space into a space, so a text is first cut there, and what lies between two such cuts is
matched once and kept. Decoding looks up the leaves' bytes and joins neighbours' extents up a tree of each row's tokens.

Null texts count as empty, an empty text has no ids, and an empty table gives an empty result. Rows keep all their columns,
whatever their names, but a column with the name of a new one (in any case) is replaced by it. Ties and repeated rows need
no rule. No shuffle: encoding and decoding are one pass of Arrow batches, and a long text is read in blocks.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import ship, tidy

#: Entries of a generation of the table of stretches, and of each other one; a table holds two generations.
CACHE, SMALL_CACHE = 250_000, 80_000
#: Longer pieces are not kept.
CACHED_CHARS = 48
#: Nodes of the tree up to so many bytes are kept.
SHORT = 4
#: Wider windows are merged with a heap.
WIDE = 64
#: A longer text is read in blocks of about so many characters, and a longer stretch in blocks of so many matches.
LONG_TEXT, BLOCK = 1_000_000, 100_000
#: Bytes of ids or texts after which a part of a batch is sent on.
PART_BYTES = 4_000_000
#: Fixed value: the pattern for which no match goes on from a character other than white space into a space. Its matches
#: are a space at most at their start, then letters, digits or others, all but white space; or white space alone.
PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


#: Up to here, what Python and the pattern call a letter has been the same in all versions of Unicode.
LAST_LETTER = "\u017f"
#: What a stable pair is replaced by: nothing.
_STABLE: list[int] = []


class Kept(dict):
    """A table of at most 2 * size entries: when the young generation is full, the old one goes."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Ranks are tokens by priority; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cut_at_spaces = pattern in PATTERNS
        self.token = {i: t for t, i in ranks.items()}
        self.sizes = np.zeros(max(self.token, default=0) + 1, np.int64)
        self.sizes[list(self.token)] = [len(t) for t in self.token.values()]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.token[i] for i in sorted(self.token)), np.uint8)
        self.pairs = Kept(self._pair, SMALL_CACHE)
        self.nodes = Kept(self._node, SMALL_CACHE)
        self.pieces = Kept(self._piece, SMALL_CACHE)  # ids as int32, which are joined faster than numbers
        self.stretches = Kept(self._stretch, CACHE)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """The definition, for a short window: merge the pair of least rank, the leftmost of equals, while there is one."""
        rank, never = self.ranks.get, len(self.ranks) + 1
        cuts = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], never)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], never)
        return [self.ranks[data[i:j]] for i, j in zip(cuts, cuts[1:])]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes, from their encodings."""
        if not left or not right:
            return left + right
        pairs = self.pairs
        window = pairs[left[-1] << 32 | right[0]]
        if not window:  # stable: the common case
            return left + right
        i = j = 1
        while True:
            left_ok = i >= len(left) or not pairs[left[-i - 1] << 32 | window[0]]
            right_ok = j >= len(right) or not pairs[window[-1] << 32 | right[j]]
            if left_ok and right_ok:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)
            data = b"".join(map(self.token.__getitem__, left[max(0, len(left) - i) :] + right[:j]))
            window = self.merged(data) if len(data) <= WIDE else self.queued(data)

    def _pair(self, pair: int) -> list[int]:
        """The encoding of two tokens' bytes (in the high and the low half); empty if it is these two: a stable pair."""
        window = self.merged(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF])
        return _STABLE if len(window) == 2 and window[0] == pair >> 32 else window

    def queued(self, data: bytes) -> list[int]:
        """As merged(), with a heap over a linked list: for wide windows."""
        import heapq

        n = len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            k = after[i]
            if k < n and (r := self.ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[k]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            k = after[i] if alive[i] else n
            if not alive[i] or end[i] != mid or k >= n or end[k] != stop:
                continue
            alive[k] = False
            end[i], after[i] = stop, after[k]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """Encode a piece: halves recursively, then join."""
        if len(data) <= 1:
            return [self.ranks[data]] if data else []
        half = len(data) // 2
        left, right = data[:half], data[half:]
        if len(data) <= 2 * SHORT:
            return self.join(self.nodes[left], self.nodes[right])
        return self.join(self.encode_bytes(left), self.encode_bytes(right))

    def _node(self, data: bytes) -> list[int]:
        return self.encode_bytes(data)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.encode_bytes(piece.encode())).tobytes()

    def _matched(self, text: str) -> bytes:
        """Ids of a text, as int32: those of its matches."""
        if len(text) <= LONG_TEXT:
            found = [self.pattern.findall(text)]
        else:
            matches = (m.group() for m in self.pattern.finditer(text))
            found = iter(lambda: list(itertools.islice(matches, BLOCK)), [])
        return b"".join(b"".join([self.pieces[p] if len(p) <= CACHED_CHARS else self._piece(p) for p in block]) for block in found)

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a space and what follows it up to the next cut."""
        if stretch.isalpha() and max(stretch) <= LAST_LETTER:
            return self._piece(" " + stretch)  # a space and letters are one match
        core, last = stretch[:-1], stretch[-1]
        if last in ".,;:!?" and core.isalpha() and max(core) <= LAST_LETTER:
            return self.stretches[core] + self.pieces[last]  # and a mark behind them is another
        return self._matched(" " + stretch)

    def _cut(self, text: str) -> bytes:
        """Ids of a text that is cut at spaces: before each, if what stands before it is no white space."""
        stretches = text.split(" ")
        ids: list[bytes | None] = list(map(self.stretches.get, stretches))  # none that ends with white space is kept
        ids[0] = None  # as no space precedes it
        i = ids.index(None)
        while i >= 0:
            stop = i  # white space goes on to the next stretch that ends with something else
            while (not stretches[stop] or stretches[stop][-1].isspace()) and stop + 1 < len(stretches):
                stop += 1
            if 0 < i == stop and len(stretches[i]) <= CACHED_CHARS and stretches[i] and not stretches[i][-1].isspace():
                ids[i] = self.stretches[stretches[i]]
            else:
                ids[i] = self._matched(" " * (i > 0) + " ".join(stretches[i : stop + 1]))
                ids[i + 1 : stop + 1] = [b""] * (stop - i)
            try:
                i = ids.index(None, stop + 1)
            except ValueError:
                break
        return b"".join(ids)

    def _blocks(self, text: str):
        """A long text in parts that are cut where _cut() may cut."""
        at = 0
        while len(text) - at > LONG_TEXT:
            stop = at + LONG_TEXT
            while (stop := text.find(" ", stop)) > 0 and text[stop - 1].isspace():
                stop += 1
            if stop < 0:
                break
            yield text[at:stop]
            at = stop
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        if not self.cut_at_spaces:
            ids = self._matched(text)
        elif len(text) <= LONG_TEXT:
            ids = self._cut(text)
        else:
            # a block but the first begins with a space, which is cut off again by the empty stretch before it
            ids = b"".join(self._cut(block) for block in self._blocks(text))
        return np.frombuffer(ids, np.int32)

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of rows of ids, and where each row's bytes begin: extents of tokens are joined up each row's tree."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        count, nodes = np.diff(offsets), ends
        while count.max(initial=0) > 1:
            begin = np.cumsum(count) - count
            place = np.arange(len(nodes)) - np.repeat(begin, count)
            keep = (place & 1 == 1) | (place + 1 == np.repeat(count, count))  # a right child's end, or an only child's
            nodes, count = nodes[keep], (count + 1) // 2
        edges = np.zeros(len(count) + 1, np.int64)
        edges[1:][count > 0] = nodes
        return data, np.maximum.accumulate(edges)

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.decode_rows(ids, np.array([0, len(ids)]))[0].tobytes()


@lru_cache(2)
def _tokenizer(path: str, pattern: str) -> Bpe:
    return Bpe.from_file(path, pattern)


def _encoded(bpe: Bpe, column: pa.Array):
    """Parts of a column of texts, as lists of ids: what a part holds is bounded, whatever the length of its texts."""
    held, size = [], 0
    for i, value in enumerate(column):
        held.append(bpe.encode(value.as_py()) if value.is_valid else np.empty(0, np.int32))
        size += held[-1].nbytes
        if size > PART_BYTES or i + 1 == len(column):
            offsets = np.cumsum([0, *map(len, held)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))
            held, size = [], 0


def _decoded(bpe: Bpe, column: pa.Array):
    """Parts of a column of ids, as bytes."""
    sizes = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PART_BYTES // 4, "right")))
        part = column.slice(start, stop - start)
        offsets = np.append(0, np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        data, edges = bpe.decode_rows(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
        yield pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
        start = stop


_STEPS = {"encode": (_encoded, T.ArrayType(T.IntegerType())), "decode": (_decoded, T.BinaryType())}


def _mapped(df: DataFrame, path: str, pattern: str, steps: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with the columns of steps (what to do, source, target), each made from the one before, in one pass."""
    ship(df.sparkSession)
    new = {target.lower() for *_, target in steps}
    sources = [k for k, name in enumerate(df.columns) if name == steps[0][1]] or [k for k, name in enumerate(df.columns) if name.lower() == steps[0][1].lower()]
    kept = [k for k, name in enumerate(df.columns) if name.lower() not in new]
    names = [f"c{k}" for k in range(len(df.columns))]  # names cannot clash on the way
    plain = df.toDF(*names)
    extra = [] if sources[0] in kept else [names[sources[0]]]
    plain = plain.select([names[k] for k in kept] + extra)
    schema = T.StructType([*plain.schema.fields[: len(kept)], *(T.StructField(f"t{k}", _STEPS[what][1]) for k, (what, *_) in enumerate(steps))])
    where = plain.columns.index(names[sources[0]])

    def run(batches):
        bpe = _tokenizer(path, pattern)

        def follow(columns: list, column: pa.Array, k: int):
            if k == len(steps):
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                return
            start = 0
            for part in _STEPS[steps[k][0]][0](bpe, column):
                yield from follow([*(c.slice(start, len(part)) for c in columns), part], part, k + 1)
                start += len(part)

        for batch in batches:
            yield from follow(batch.columns[: len(kept)], batch.column(where), 0)

    return plain.mapInArrow(tidy(run), schema).toDF(*(df.columns[k] for k in kept), *(target for *_, target in steps))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of its texts, without special tokens; null texts have none."""
    return _mapped(df, path, pattern, [("encode", text, ids)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for. Not every id sequence is UTF-8, so the column is binary."""
    return _mapped(df, path, pattern, [("decode", ids, decoded)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of its texts and the bytes that these decode to, in one pass."""
    return _mapped(df, path, pattern, [("encode", text, ids), ("decode", ids, decoded)])


def tokens(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and digests of the round trip of ``df`` (doc_id, text)."""
    both = round_trip(df.select("doc_id", "text"), path, pattern).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
