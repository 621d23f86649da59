"""Operator 5: removal of repeated passages with difference-cover suffix arrays.

A byte is removed if a WIDTH-byte string that covers it also starts in a document with a smaller id; strings never cross
documents, and all are judged on the input.

Suffixes only need an order up to WIDTH bytes, so equal strings must meet, and others need not. One sort of all suffixes
would ship two thirds of them with their triple and place, some 7 bytes for each byte of text, in its first round alone
(see the README for figures), so it is cut into many independent ones. Each string has an anchor, the ANCHOR bytes in it
with the least hash (the leftmost of equals), which equal strings share:

0. *units*: runs of strings between anchors whose hash is divisible by UNIT (about 400 bytes) are hashed, and all strings
   of a unit that a smaller document has too are to be removed, without looking closer. This leaves one copy of what
   copies share. What a larger document's unit holds is not a source either, as the smaller one's copy is. The stretches
   between these units are written once, and all that follows reads them only.
1. *anchors*: each task lists the anchors of its stretches. Partitioned by hash, those that occur in two documents or
   more are set in a filter, which is broadcast. Its bits follow the number of strings up to a bound, so that few others
   pass; what passes costs work only.
2. *segments*: strings that follow each other and share a listed anchor make one segment (about 65 bytes). They are
   written in slices by anchor. The steps behind take one slice after the other, so what they move and write at a time is
   a part of all, and a slice is deleted when its results are there. Equal segments are collapsed to the smallest and
   largest document id before the shuffle.
3. *suffix arrays*: distinct segments are partitioned and sorted by anchor. Those that agree with another one of their
   anchor in 15 bytes beside it, on either side, may share a string (30 bytes of it lie beside the anchor); about
   SORT_BYTES of these are concatenated and sorted by difference cover modulo 3: triples at sampled positions are sorted
   and named, the names are recursed on until they differ, the remaining suffixes are sorted by their first byte and the
   rank behind it, and the two orders are merged. Adjacent suffixes with the same WIDTH-byte prefix are one string, whose
   smallest document is known then. An anchor with over HOT_SEGMENTS distinct segments would make one task long: its
   strings become rows, are hashed to 128 bits, and take their minimum by a combining aggregate.
4. *removal*: results go back to the segments' occurrences by an equi-join (split by Spark where one is hot), and to
   their documents.

Staged tables are deleted when the last step that reads them has ended. Null texts count as empty. Rows with a null id are
returned as they are, and remove nothing. Rows that share an id do not remove each other's bytes; they are told apart by
their text's hash. A long text is scanned in tiles and is one row. An empty table gives an empty result. Only columns
doc_id and text are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import drop_part, drop_staged, mix64, packed, shards, ship, staged, staged_parts, text_or_empty, tidy
from curata.llm.kernels import _BYTE, _PLACE, blocks, column_bytes, pack48, unpack48

WIDTH, ANCHOR = 50, 20
#: One of so many anchors begins a unit.
UNIT = np.uint64(24)
#: Bits of the filter of anchors at most, as a power of two: 64 MB, the only thing broadcast.
FILTER_BITS = 29
#: Slices of the anchors at most, and strings for which another one is worth its jobs.
SLICES, SLICE_STRINGS = 4, 1 << 26
#: Suffix arrays are built over about so many bytes at a time, or over one anchor's segments.
SORT_BYTES = 1 << 20
#: An anchor with more segments than this is not sorted in one task: its strings are rows of their own.
HOT_SEGMENTS = 20_000
#: Strings that are looked at together; their places must fit into 16 bits.
TILE = 60_000
_VALUE = (_BYTE >> np.uint64(32)).astype(np.uint32)
_MASK = np.uint64((1 << 48) - 1)


def _anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``raw`` with another anchor than the string before, and where their anchors begin.

    The anchor is where a 16-bit hash of ANCHOR bytes is least, the leftmost of equals, so it follows from the string's
    bytes alone. Bytes are read in tiles that stay in the processor's cache; places in a tile have 16 bits.
    """
    firsts, places = [], []
    window, before = WIDTH - ANCHOR + 1, -1
    for at in range(0, len(raw) - WIDTH + 1, TILE):
        v = np.take(_VALUE, raw[at : at + TILE + WIDTH - 1])
        v = v[:-1] * np.uint32(0x85EBCA6B) + v[1:]
        v = v[:-2] * np.uint32(0xC2B2AE35) + v[2:]
        least = v[: len(v) - 16] * np.uint32(0x9E3779B1)
        least += v[8 : len(v) - 8] * np.uint32(0x27D4EB2F)
        least += v[16:] * np.uint32(0x165667B1)
        least &= np.uint32(0xFFFF0000)
        least |= np.arange(len(least), dtype=np.uint32)
        span = 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        place = (least & np.uint32(0xFFFF)).astype(np.int64) + at
        new = np.ones(len(place), bool)
        new[0] = place[0] != before
        np.not_equal(place[1:], place[:-1], out=new[1:])
        own = np.flatnonzero(new)
        firsts.append(own + at)
        places.append(place[own])
        before = place[-1]
    return np.concatenate(firsts), np.concatenate(places)


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first byte in the row, number of strings, anchor hash and the anchor's offset of each segment, in order.

    ``raw`` holds the rows' texts one after another, ``offsets`` where each begins, and the end.
    """
    if len(raw) < WIDTH:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), none
    first, place = _anchors(raw)
    # strings of a row begin before its last WIDTH - 1 bytes; those behind belong to no row
    begin, end = offsets[:-1], offsets[1:] - WIDTH + 1
    some = begin < end
    edges = np.sort(np.concatenate([first, begin[some], end[some]]), kind="stable")
    edges = edges[np.append(True, edges[1:] != edges[:-1])]
    n = np.diff(np.append(edges, len(raw)))
    row = np.searchsorted(offsets, edges, "right") - 1
    inside = (row < len(end)) & (edges < end[np.minimum(row, len(end) - 1)])
    at, n, row = edges[inside], n[inside], row[inside]
    anchor = place[np.searchsorted(first, at, "right") - 1]
    h = np.zeros(len(at), np.uint64)
    for k in range(ANCHOR):
        h += np.take(_BYTE, np.take(raw, anchor + k)) * _PLACE[k]
    return row, at - begin[row], n, mix64(h) & _MASK, anchor - at


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (numbers from 1 on) in the order of their suffixes, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # one position behind the end joins the sample where the last suffix would otherwise lack a rank behind it
    one = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([one, np.arange(2, n, 3)])
    triples = _packed([t[sample + k] for k in range(3)])
    order = np.argsort(triples)  # equal triples get one name, in any order
    new = np.append(0, triples[order[1:]] != triples[order[:-1]])
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) + 1
    if new.sum() + 1 < len(order):
        order = suffix_array(name)  # of the names in the order of the sample: all of one residue, then of the other
    rank = np.zeros(n + 4, np.int64)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_packed([t[rest], rank[rest + 1]]))]
    # merge: how many sampled suffixes of either residue are before each remaining one; their order is that of (first
    # number, rank behind it), and of (first two numbers, rank behind these)
    at = np.arange(len(rest))
    for residue in (1, 2):
        other = sampled[sampled % 3 == residue]
        both = np.concatenate([other, rest])
        keys = _packed([t[both + k] for k in range(residue)] + [rank[both + residue]])
        at += np.searchsorted(keys[: len(other)], keys[len(other) :])
    out = np.empty(n, np.int64)
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of the columns, in the order of the rows."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) < 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, b in zip(columns, bits):
            key = key << np.uint64(b) | c.astype(np.uint64)
        return key
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    key = np.empty(len(order), np.uint64)
    key[order] = np.cumsum(new)
    return key


def string_groups(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each WIDTH-byte string of the texts in ``data``, in order: its text, and a number of equal ones."""
    runs = np.diff(offsets) - WIDTH + 1
    owner = np.repeat(np.arange(len(runs)), runs)
    start = np.arange(len(owner)) + (WIDTH - 1) * owner  # a text has WIDTH - 1 bytes more than strings
    index = np.full(len(data), -1)
    index[start] = np.arange(len(start))
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[index[order] >= 0]
    words = np.zeros(len(data) + 8, np.uint64)
    padded = np.append(data, np.zeros(16, np.uint8)).astype(np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    a, b = order[1:], order[:-1]
    differ = np.zeros(len(a), bool)
    for k in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
        differ |= words[a + k] != words[b + k]
    group = np.empty(len(start), np.int64)
    group[index[order]] = np.cumsum(np.append(0, differ.astype(np.int64)))[: len(order)]
    return owner, group


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their units: (unit, doc_id, text_hash, start, n), n strings from byte start on."""
    from xxhash import xxh3_128_digest

    for block in blocks(batches, 2 << 20):
        raw, offsets = column_bytes(block.column(1))
        row, first, n, h, _ = segments(raw, offsets)
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] % UNIT == 0)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h)) - 1
        n = first[last] + n[last] - first[at]
        begin = offsets[row[at]] + first[at]
        data = memoryview(raw)
        units = [xxh3_128_digest(data[i:j]) for i, j in zip(begin.tolist(), (begin + n + WIDTH - 1).tolist())]
        rows = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), block.column(0).take(rows), block.column(2).take(rows), pa.array(first[at].astype(np.int32)), pa.array(n.astype(np.int32))], ["unit", "doc_id", "text_hash", "start", "n"])


def _pick(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each ``begin`` to its ``end``, one after another, and their offsets."""
    sizes = end - begin
    edges = np.append(0, np.cumsum(sizes))
    return raw[np.repeat(begin - edges[:-1], sizes) + np.arange(edges[-1])], edges


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their units to be removed (doc_id, text, text_hash, gone) to what these leave: the stretches of strings
    (doc_id, text, text_hash, first) between them, ``first`` being the place of a stretch in its text."""
    for block in blocks(batches, 2 << 20):
        raw, offsets = column_bytes(block.column(1))
        gone = block.column(3)
        lists = gone.fill_null([]) if gone.null_count else gone
        owner = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
        start, n = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        # from a text's first string or a unit's end to a unit's first string or a text's end, in order
        begin, end = offsets[owner] + start, offsets[owner] + start + n
        low = np.sort(np.concatenate([offsets[:-1], end]))
        high = np.sort(np.concatenate([np.maximum(offsets[1:] - WIDTH + 1, offsets[:-1]), begin]))
        low, high = low[low < high], high[low < high]
        if not len(low):
            continue
        row = np.searchsorted(offsets, low, "right") - 1
        data, edges = _pick(raw, low, high + WIDTH - 1)
        rows = pa.array(row)
        texts = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([block.column(0).take(rows), texts, block.column(2).take(rows), pa.array((low - offsets[row]).astype(np.int32))], ["doc_id", "text", "text_hash", "first"])


def _list_anchors(parts: int):
    """Texts to rows (shard, anchors, many): distinct anchors, and whether two documents of the task have them."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        shard = (mix64(h) >> np.uint64(32)).astype(np.int64) * parts >> 32
        order = np.argsort(shard, kind="stable")
        h, many, shard = h[order], n[order] > 1, shard[order]
        edges = np.searchsorted(shard, np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack48(h[at])]), pa.array([np.packbits(many[at]).tobytes()])], ["shard", "anchors", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, 2 << 20):
            row, _, _, h, _ = segments(*column_bytes(block.column(1)))
            # a batch has few documents: their numbers fit beside the 48 bits of an anchor
            _, number = np.unique(block.column(0).to_numpy(), return_inverse=True)
            own = np.sort(number.astype(np.uint64)[row] << np.uint64(48) | h)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            h = own & _MASK
            held.append(h[new])
            size += len(held[-1])
            if size > 2_000_000:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def filter_bits(strings: int) -> int:
    """For so many strings: about four bits for each of their anchors, of which a part is listed."""
    return min(FILTER_BITS, max(12, (strings >> 2).bit_length()))


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return mix64(h) >> np.uint64(64 - bits)


def _shared(bits: int):
    """Anchors by shard to the filter's words (word, mask) of those that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, anchors, many in zip(*(c.to_pylist() for c in batch.columns)):
                h = unpack48(anchors)
                held.setdefault(shard, []).append(h << np.uint64(1) | np.unpackbits(np.frombuffer(many, np.uint8), count=len(h)))
        while held:
            h = np.concatenate(held.popitem()[1])
            h.sort()
            often = (h & np.uint64(1)).astype(bool)
            h >>= np.uint64(1)
            same = h[1:] == h[:-1]
            often[1:] |= same
            bit = np.unique(_bit(h[often], bits))
            word, first = np.unique(bit >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else bit
            for k in range(0, len(word), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([word[k : k + (1 << 20)].astype("<u4").tobytes()]), pa.array([mask[k : k + (1 << 20)].astype("<u8").tobytes()])], ["word", "mask"])

    return run


def shared_anchors(texts: DataFrame, parts: int, bits: int) -> np.ndarray:
    """The filter: a word for each 64 bits."""
    listed = texts.mapInArrow(tidy(_list_anchors(parts)), "shard int, anchors binary, many binary").repartition(parts, "shard")
    words = staged(listed.mapInArrow(tidy(_shared(bits)), "word binary, mask binary"), "filter")  # so the anchors' shuffle is removed
    found = np.zeros(1 << (bits - 6), np.uint64)
    for word, mask in words.toLocalIterator():  # the filter's size in all
        found[np.frombuffer(word, "<u4")] |= np.frombuffer(mask, "<u8")
    drop_staged(words)
    return found


def _cut(filter_, slices: int):
    """Texts to their segments with a listed anchor: (anchor, content_hash, content, doc_id, text_hash, start, place, slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        words = filter_.value
        bits = len(words).bit_length() + 5
        for block in blocks(batches, 2 << 20):
            raw, offsets = column_bytes(block.column(1))
            row, first, n, h, place = segments(raw, offsets)
            bit = _bit(h, bits)
            at = np.flatnonzero((words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            begin = offsets[row[at]] + first[at]
            data, edges = _pick(raw, begin, begin + n[at] + WIDTH - 1)
            view, cuts = memoryview(data), edges.tolist()
            hashes = np.array([xxh3_64_intdigest(view[i:j]) for i, j in zip(cuts, cuts[1:])], np.uint64)
            content = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
            columns = [pa.array(h[at].astype(np.int64)), pa.array(hashes.view(np.int64)), content, block.column(0).take(pa.array(row[at])), block.column(2).take(pa.array(row[at])), pa.array((block.column(3).to_numpy()[row[at]] + first[at]).astype(np.int32)), pa.array(place[at].astype(np.int8)), pa.array((h[at] % np.uint64(slices)).astype(np.int32))]
            batch = pa.RecordBatch.from_arrays(columns, ["anchor", "content_hash", "content", "doc_id", "text_hash", "start", "place", "slice"])
            for k in range(0, len(batch), 20_000):
                yield batch.slice(k, 20_000)

    return run


def _may_share(anchor: np.ndarray, place: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which segments agree with another one of their anchor in half the bytes that a string has beside it."""
    side = (WIDTH - ANCHOR) // 2
    h = _BYTE[raw]
    for n in (1, 2, 4):
        h = h[:-n] * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * n)) + h[n:]
    keys, rows = [], []
    for number, start, fits in (
        (1, offsets[:-1] + place + ANCHOR, offsets[1:] - offsets[:-1] >= place + ANCHOR + side),
        (2, offsets[:-1] + place - side, place >= side),
    ):
        at = np.flatnonzero(fits)
        both = mix64(h[start[at]] * np.uint64(0xC2B2AE3D27D4EB4F) + h[start[at] + side - 8])
        keys.append(mix64(anchor[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + both + np.uint64(number)))
        rows.append(at)
    _, inverse, often = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    found = np.zeros(len(anchor), bool)
    found[np.concatenate(rows)[often[inverse] > 1]] = True
    return found


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments (anchor, content_hash, content, least, most, place), sorted by anchor, to the smallest document
    of their strings: one number, or a list of them. Segments are taken up to a change of anchor."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        anchor, content_hash, least, most = (rows.column(c).to_numpy() for c in ("anchor", "content_hash", "least", "most"))
        place = rows.column("place").to_numpy().astype(np.int64)
        raw, offsets = column_bytes(rows.column("content").combine_chunks())
        lists, size = [], np.zeros(len(rows), np.int64)
        low = np.where(least < most, least, -1)  # alone under its anchor: its documents tell
        at = np.flatnonzero(_may_share(anchor, place, raw, offsets))
        if len(at):
            owner, group = string_groups(*_pick(raw, offsets[at], offsets[at + 1]))
            of_group = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(of_group, group, least[at][owner])
            each = of_group[group]
            begin = np.searchsorted(owner, np.arange(len(at)))
            first, last = np.minimum.reduceat(each, begin), np.maximum.reduceat(each, begin)
            low[at] = np.where(first == last, np.where(first < most[at], first, -1), -1)
            mixed = (first != last) & (first < most[at])
            size[at] = np.where(mixed, np.diff(np.append(begin, len(each))), 0)
            lists = each[mixed[owner]]
        out = np.flatnonzero((low >= 0) | (size > 0))
        edges = np.append(0, np.cumsum(size[out])).astype(np.int32)
        one = pa.array(low[out], mask=size[out] > 0)
        several = pa.ListArray.from_arrays(pa.array(edges), pa.array(lists, pa.int64()), mask=pa.array(size[out] == 0))
        return pa.RecordBatch.from_arrays([pa.array(anchor[out]), pa.array(content_hash[out]), one, several], ["anchor", "content_hash", "least", "leasts"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += column_bytes(batch.column(2))[1][-1]
        if size > SORT_BYTES:
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            stop = int(np.searchsorted(anchors, anchors[-1]))
            if stop:
                yield solve(rows.slice(0, stop))
                held = rows.slice(stop).to_batches()
                size = sum(int(column_bytes(b.column(2))[1][-1]) for b in held)
    if held:
        yield solve(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments to their strings: (anchor, content_hash, i, string, least, most)."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for anchor, content_hash, content, least, most in zip(*(batch.column(k).to_pylist() for k in range(5))):
            n = len(content) - WIDTH + 1
            strings = [xxh3_128_digest(content[i : i + WIDTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([content_hash] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(strings, pa.binary()), pa.array([least] * n, pa.int64()), pa.array([most] * n, pa.int64())], ["anchor", "content_hash", "i", "string", "least", "most"])


def _smallest_of_hot(rows: DataFrame) -> DataFrame:
    """As _smallest(), for anchors with very many segments, which must not meet in one task: by string."""
    strings = rows.mapInArrow(tidy(_strings), "anchor long, content_hash long, i int, string binary, least long, most long")
    low = strings.groupBy("string").agg(F.min("least").alias("low"))
    each = strings.join(low, "string").groupBy("anchor", "content_hash").agg(F.array_sort(F.collect_list(F.struct("i", "low"))).alias("found"), F.max("most").alias("most"))
    return each.where("exists(found, x -> x.low < most)").select("anchor", "content_hash", F.lit(None).cast("long").alias("least"), F.col("found.low").alias("leasts"))


def _found(cut: DataFrame, parts: int) -> DataFrame:
    """Of a slice's segments: doc_id, text_hash and runs (start, n) of the strings that a smaller document has too."""
    distinct = cut.groupBy("anchor", "content_hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("content").alias("content"), F.first("place").alias("place"))
    distinct = staged(distinct.select("anchor", "content_hash", "content", "least", "most", "place"), "distinct", packed)
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENTS).select("anchor")
    cold = distinct.repartition(parts, "anchor").join(hot, "anchor", "left_anti").select(distinct.columns)
    results = cold.sortWithinPartitions("anchor").mapInArrow(tidy(_smallest), "anchor long, content_hash long, least long, leasts array<long>")
    results = staged(results.unionByName(_smallest_of_hot(distinct.join(hot, "anchor", "left_semi").select(distinct.columns))), "results")
    drop_staged(distinct)
    found = cut.select("anchor", "content_hash", "doc_id", "text_hash", "start", (F.octet_length("content") - WIDTH + 1).alias("n")).join(results, ["anchor", "content_hash"]).where("leasts IS NOT NULL OR least < doc_id")
    pieces = F.expr("filter(transform(leasts, (x, i) -> struct(start + i AS start, if(x < doc_id, 1, 0) AS n)), x -> x.n = 1)")
    runs = F.when(F.col("leasts").isNull(), F.array(F.struct("start", "n"))).otherwise(pieces)
    out = staged(found.select("doc_id", "text_hash", runs.alias("runs")), "found")
    drop_staged(results)
    return out


def repeated_strings(documents: DataFrame, slices: int | None = None) -> DataFrame:
    """doc_id, text_hash and runs (start, n): n strings from byte start on are to be removed."""
    spark = documents.sparkSession
    ship(spark)
    parts = shards(spark)
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), F.xxhash64(text_or_empty()).alias("text_hash"))
    units = staged(texts.mapInArrow(tidy(_units), "unit binary, doc_id long, text_hash long, start int, n int"), "units")
    strings = units.agg(F.sum("n").alias("n")).first()["n"] or 0
    slices = slices or int(min(SLICES, 1 + strings // SLICE_STRINGS))
    several = units.groupBy("unit").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("unit", "least")
    gone = staged(units.join(several, "unit").where("doc_id > least").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "gone")
    drop_staged(units)
    gone_of = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("runs").alias("gone"))
    keyed = texts.join(gone_of, (F.col("doc_id") == F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("doc_id", "text", "text_hash", "gone")
    left = staged(keyed.mapInArrow(tidy(_left), "doc_id long, text binary, text_hash long, first int"), "left", packed)
    listed = spark.sparkContext.broadcast(shared_anchors(left, parts, filter_bits(strings)))
    cut = staged_parts(left.mapInArrow(tidy(_cut(listed, slices)), "anchor long, content_hash long, content binary, doc_id long, text_hash long, start int, place byte, slice int"), "segments", "slice", slices)
    drop_staged(left)
    listed.unpersist()
    each = gone.select("doc_id", "text_hash", F.col("runs").cast("array<struct<start: int, n: int>>"))
    found = []
    for k in range(slices):
        found.append(_found(cut.where(F.col("slice") == k).drop("slice"), -(-parts // slices)))
        drop_part(cut, "slice", k)
        each = each.unionByName(found[-1])
    runs = staged(each.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    drop_staged(cut, gone, *found)
    return runs


def removal(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed bytes) and kept (the remaining bytes) of every row."""
    spark = documents.sparkSession
    runs = repeated_strings(documents)
    rows = documents.select("doc_id", text_or_empty().cast("binary").alias("text"))
    marks = runs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "runs")
    every = rows.join(marks, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left").select("doc_id", "text", "runs")
    from pyspark.sql.types import _parse_datatype_string as parse

    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("spans", parse("array<struct<start: long, end: long>>")).add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in blocks(batches, 4 << 20):
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                text = text.as_buffer().to_pybytes()
                own: list[list[int]] = []
                for start, n in sorted((r["start"], r["n"]) for r in runs.as_py() or ()):
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], start + n + WIDTH - 1)
                    else:
                        own.append([start, start + n + WIDTH - 1])
                edges = [0, *(x for pair in own for x in pair), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
                spans.append([{"start": i, "end": j} for i, j in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return every.mapInArrow(tidy(run), schema)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removal(documents).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
