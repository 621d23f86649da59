"""Vectorised reading of many texts at once: bytes of an Arrow column, words and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from curata.llm.common import mix64

#: Fixed values of the hashes: any odd multiplier, and one random number for each byte.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.where(_IS_SPACE, np.uint64(0), _BYTE[_LOWER])
_PLACE = mix64(np.arange(2001, 2065, dtype=np.uint64)) | np.uint64(1)
#: Bytes whose words are hashed at a time.
_PART = 4 << 20


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary() if not pa.types.is_large_binary(column.type) else column.type).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def values(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column; slices are much faster than Arrow's conversion, scalar by scalar."""
    raw, offsets = column_bytes(column)
    data, edges = raw.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def blocks(batches, target: int = 4 << 20):
    """Slices of record batches with about ``target`` bytes of their column ``text``; one longer text makes its own."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("text"))
        offsets = column_bytes(sizes)[1]
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + target, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order, and the row each belongs to."""
    found, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + _PART)
        while stop < len(raw):  # a part ends behind white space
            space = np.flatnonzero(_IS_SPACE[raw[stop - 1 : stop - 1 + _PART]])
            stop = stop + int(space[0]) if len(space) else min(len(raw), stop + _PART)
            if len(space):
                break
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop)]
        found.append(_words(raw[at:stop], inner - at, at))
        at = stop
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, starts = (np.concatenate(x) for x in zip(*found))
    return h, np.searchsorted(offsets, starts, "right") - 1


def _words(raw: np.ndarray, edges: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a part's words and where they start; ``edges`` are the beginnings of texts within it.

    The hash is a sum of products, of a random number for each byte and one for each place in the word.
    """
    ink = ~_IS_SPACE[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    first[edges] = ink[edges]  # a text's first byte begins a word
    last[edges[edges > 0] - 1] = ink[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.arange(starts[0], len(raw), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    np.minimum(place, len(_PLACE) - 1, out=place)
    value = _VALUE[raw[starts[0] :]]
    value *= _PLACE[place]
    h = np.add.reduceat(value, starts - starts[0])
    lengths = ends - starts
    for i in np.flatnonzero(lengths >= len(_PLACE)):  # the few long ones, each on its own
        from xxhash import xxh64_intdigest

        h[i] = np.uint64(xxh64_intdigest(_LOWER[raw[starts[i] : ends[i]]].tobytes(), seed=7))
    return mix64(h + lengths.astype(np.uint64)), starts + at


def shrink(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b""


def grow(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd", 1).decompress(data, size, asbytes=True) if size else b""


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as bytes, all low ones first: high bytes, which are often alike, become small."""
    return shrink(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(grow(data, n * width), np.uint8).reshape(width, n).T.copy().view(f"<u{width}").reshape(-1)


def crc_sql(strings: str) -> str:
    """Common table expressions of DuckDB, after WITH RECURSIVE, for the table crc (k, crc) of a table's column k.

    A checksum is the exclusive or of what each byte adds, which depends on the byte and on how many follow it, and of
    what the length adds.
    """
    return f"""b0 AS (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS b) x
    ), hexed AS MATERIALIZED (SELECT k, hex(encode(k)) AS h FROM (SELECT DISTINCT k FROM {strings}) x),
    adds AS (
        SELECT 0 AS d, b, c FROM b0
        UNION ALL SELECT d + 1, adds.b, xor(adds.c >> 8, b0.c) FROM adds JOIN b0 ON b0.b = adds.c & 255 WHERE d < (SELECT max(length(h)) // 2 FROM hexed)
    ), empty AS (
        SELECT 0 AS n, 4294967295 AS c
        UNION ALL SELECT n + 1, xor(empty.c >> 8, b0.c) FROM empty JOIN b0 ON b0.b = empty.c & 255 WHERE n < (SELECT max(length(h)) // 2 FROM hexed)
    ), spelt AS (SELECT k, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i, h FROM hexed),
    crc AS (
        SELECT spelt.k, xor(xor(bit_xor(adds.c), any_value(empty.c)), 4294967295) AS crc FROM spelt JOIN empty ON empty.n = spelt.n
        JOIN adds ON adds.d = spelt.n - 1 - spelt.i AND adds.b = ('0x' || substr(spelt.h, 2 * spelt.i + 1, 2))::INT GROUP BY spelt.k
    )"""


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in a sorted list of row numbers; n + 1 positions."""
    return np.searchsorted(rows, np.arange(n + 1))


def pack48(x: np.ndarray) -> bytes:
    """Little-endian numbers of 48 bits: all low halves, then all high parts."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def unpack48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
