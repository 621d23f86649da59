"""What the first bytes of an image file tell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def header(content: Column) -> Column:
    """struct(format, width, height) from a file's first bytes: PNG, GIF, BMP and JPEG; nulls for others."""

    @F.pandas_udf("format string, width int, height int")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_header(x) for x in files], columns=["format", "width", "height"])

    return run(content)


def _header(data: bytes | None) -> tuple:
    if not data:
        return None, None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"GIF":
        return "GIF", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM":
        return "BMP", int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in range(0xC0, 0xD0) and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return "JPEG", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return "JPEG", None, None
    return None, None, None
