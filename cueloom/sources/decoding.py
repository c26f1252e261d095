"""Bytes of subtitle files to text, whatever their encoding."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

#: Lead bytes of the frequent characters in each standard: level 1 of GB 2312 (rows 16 to 55), level 1 of
#: Big5 (A440 to C67E), kana and level 1 kanji of Shift JIS, Hangul of KS X 1001 (rows 16 to 40).
FREQUENT = {
    "gb18030": ((0xB0, 0xD7),),
    "big5": ((0xA4, 0xC6),),
    "shift_jis": ((0x82, 0x83), (0x88, 0x97)),
    "cp949": ((0xB0, 0xC8),),
}
#: Share of the characters beyond ASCII that must be frequent ones for an encoding to be taken at its word.
LIKELY = 0.5
SINGLE_BYTE = ("cp1258", "cp1252")


def _plausibility(data: bytes, encoding: str) -> float:
    """Share of frequent characters among those beyond ASCII, as the encoding reads them; -1 if it can't read them."""
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        return -1.0
    found = {c: n for c, n in Counter(text).items() if not c.isascii()}  # each character is looked at once
    hits = sum(n for c, n in found.items() if any(low <= c.encode(encoding)[0] <= high for low, high in FREQUENT[encoding]))
    return hits / sum(found.values()) if found else 0.0


def encoding_of(data: bytes) -> str:
    """The encoding of some bytes: by their mark, UTF-8 if valid, else the East Asian one whose frequent characters fit
    best, on ties that with the fewest of them, else the first that reads them at all."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    try:
        data.decode("utf-8")
        return "utf-8-sig"
    except UnicodeDecodeError:
        pass
    shares = {name: _plausibility(data, name) for name in FREQUENT}
    best = max(shares, key=lambda name: (shares[name], -sum(high - low for low, high in FREQUENT[name])))
    if shares[best] >= LIKELY:
        return best
    for name in SINGLE_BYTE:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    readable = [name for name, share in shares.items() if share >= 0]
    return readable[0] if readable else "utf-8"


def decode_bytes(data: bytes | None) -> str | None:
    return None if data is None else data.decode(encoding_of(data), "replace")


#: Files of a batch that are Python objects at once; the rest of it stays in Arrow's buffers.
PIECE = 100


@F.arrow_udf(StringType())
def decode_text(content: pa.Array) -> pa.Array:
    pieces = [pa.array([decode_bytes(data) for data in content.slice(at, PIECE).to_pylist()], pa.string()) for at in range(0, len(content), PIECE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


def read_encoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value) of files in any of the encodings."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), decode_text("content").alias("value"))
