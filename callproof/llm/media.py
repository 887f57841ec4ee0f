"""Texts stored as lossless WebP images and read back to pixel arrays and features.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64, become ARGB
pixels, 16 to a row.  Payloads of more than 16,384 rows (the format's limit) are stored as
several WebP files one after the other, so the memory for one image is bounded.  Images of at
most 16 colours are stored with a palette; of others the smallest of four forms is stored: plain
pixels, pixels with back-references and a colour cache, and differences from the pixel on the left
or above (the predictor transform), each in fixed prefix codes.  Reading back goes through the
general decoder, whatever the image uses, and ``tools`` names what it met.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal bytes; a text of
any length is stored whole; repeated rows are returned once each; a null ``doc_id`` is kept;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import webp
from ._common import unused

ROW_BYTES = 64
WIDTH = ROW_BYTES // 4
STRIP = ROW_BYTES * 16384


def byte_weights() -> np.ndarray:
    """How common each byte is taken to be in running text; any weights give a right code."""
    w = np.ones(256, np.int64)
    w[128:192] = 3
    w[0xC3] = 20
    for letters, weight in (("0123456789", 3), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (".,\n", 16), ("bcdfgjklmpquvwxyz", 14), ("aehinorst", 60), (" ", 130)):
        w[[*letters.encode()]] = weight
    return w


def token_weights() -> tuple[np.ndarray, np.ndarray]:
    """The same for bytes, copies by length and cache slots (nine, two and seven parts), and for copies by distance."""
    parts = ((9, byte_weights()), (2, 2 ** np.maximum(1, 11 - np.arange(webp.LENGTH_CODES) // 2)), (7, np.ones(1 << CACHE_BITS, np.int64)))
    return np.concatenate([(w * share * 20_000 // w.sum()).astype(np.int64) + 1 for share, w in parts]), np.ones(webp.DISTANCE_CODES, np.int64)


def difference_weights() -> np.ndarray:
    """The same for differences of bytes: the smaller, the more common."""
    d = np.minimum(np.arange(256), 256 - np.arange(256))
    return 4096 // (1 + d) // (1 + d // 16) + 8 + 12288 * (d == 0)


CACHE_BITS = 8
NO_COPIES = np.zeros(webp.LENGTH_CODES, np.int64)
PLAIN = webp.Codes(np.r_[byte_weights(), NO_COPIES], byte_weights())
TOKENS = webp.Codes(token_weights()[0], byte_weights(), token_weights()[1], CACHE_BITS)
DIFFERENCES = webp.Codes(np.r_[difference_weights(), NO_COPIES], difference_weights())


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b"\0")


def store(payload: bytes) -> bytes:
    """A payload as one or more WebP files."""
    files = []
    for at in range(0, len(payload), STRIP):
        pixels = np.frombuffer(payload[at : at + STRIP], ">u4").astype(np.uint32)
        if len(np.unique(pixels[:WIDTH * 4])) <= 16 and len(np.unique(pixels)) <= 16:
            files.append(webp.encode(pixels.reshape(-1, WIDTH), palette=True))
        else:
            files.append(webp.smallest(pixels, WIDTH, PLAIN, TOKENS, DIFFERENCES))
    return b"".join(files)


def images(stored: bytes, used: set[str] | None = None) -> Iterator[np.ndarray]:
    """The pixel arrays of stored files; ``used`` gets the tools met."""
    at = 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        yield webp.decode(stored[at:end], used)
        at = end


@F.pandas_udf(BinaryType())
def stored_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts -> stored images."""
    for batch in texts:
        yield pd.Series([store(payload_of(t)) for t in batch])


READ = StructType(
    [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("tools", StringType())]
)


def described(stored: bytes) -> tuple:
    """What is read back from a stored image."""
    used: set[str] = set()
    payload = b"".join(p.astype(">u4").tobytes() for p in images(stored, used))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    # whole numbers only, so equal texts give equal features on any machine
    total, square = samples.sum(0, dtype=np.int64), int((samples.astype(np.int64) ** 2).sum())
    steps = int(np.abs(np.diff(samples.astype(np.int16), axis=0)).sum(dtype=np.int64))
    bright = np.bincount(samples.ravel() >> 5, minlength=8)
    feature = f"{WIDTH}x{len(samples) // WIDTH};sum={','.join(map(str, total.tolist()))};square={square};step={steps};bins={','.join(map(str, bright.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, "+".join(sorted(used))


@F.pandas_udf(READ)
def read_column(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Stored images -> digests and features of what is read back."""
    for batch in media:
        yield pd.DataFrame([described(m) for m in batch], columns=READ.names)


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The rows with their text stored as images in ``media_col``, which gets a ``_`` where ``docs`` has it."""
    return docs.withColumn(unused(docs, media_col), stored_column(F.col(text_col).cast("string")))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: what its stored image holds, read back."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return with_media(own).select("doc_id", size, read_column("media").alias("m")).select("doc_id", "n_bytes", "m.*")


def op5_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return media_features(table(spark, sf_dir, "documents"))
