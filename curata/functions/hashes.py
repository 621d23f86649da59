"""64-bit perceptual hashes kept as signed longs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pieces(h: Column, max_distance: int) -> Column:
    """Array of structs (i, v): max_distance + 1 disjoint pieces; hashes that near agree in one of them."""
    k = max_distance + 1
    width = 64 // k
    mask = (1 << width) - 1 if width < 64 else -1
    return F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit(mask)).alias("v")) for i in range(k)))


def trivial(h: Column) -> Column:
    """Hashes of flat images: no bit set, or all."""
    return h.isin(0, -1)


def gradient_hash(values: Column, bits: int = 63) -> Column:
    """A hash with bit i set if component i is smaller than the next one."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(values, i) < F.get(values, i + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda h, b: h * 2 + b)


def simhash(text: Column) -> Column:
    """A hash of 60 bits of a text's distinct words, near for texts that share most of them; 0 without words.

    Bit i is set if it is in the MD5 hashes (first 15 digits) of more than half of the words.
    """

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        import hashlib
        import re

        known, space = {}, re.compile("[\\x20\\x09-\\x0D]+")
        out = np.zeros(len(texts), np.int64)
        for row, t in enumerate(texts):
            words = set(space.split(t)) - {""} if t else ()
            if words:
                for w in words:
                    if w not in known:
                        known[w] = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
                h = np.array([known[w] for w in words], ">u8")
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out[row] = np.packbits(2 * bits > len(h)).view(">i8")[0]
                if len(known) > 500_000:
                    known.clear()
        return pd.Series(out)

    return run(text)
