"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n
(full pieces of ``limit`` first, then ever shorter powers of two).  Every piece is a
sequence of its own, so no sequence crosses documents and none is padded; sequences
of equal length form a bucket, from which batches of equal shape are drawn.  All of it
is done where the document is read: nothing is shuffled or gathered.

Defined results: a null or empty text has the end token only (one piece of length 1);
repeated rows are packed once each, with sequence ids of their own; a null ``doc_id`` is
kept; further columns of the input are ignored.  Sequence ids number the pieces within
Spark's input partitions, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ._common import KEPT, give_back, unused
from .bpe import Splitter, vocabulary

LIMIT = 2048
END_TOKEN = 1
#: Pieces of text whose ids a worker keeps in each of two generations (just below a step of a dict's size; some 90 MB in all), and words of composed pieces.
CHUNKS_KEPT, PARTS_KEPT = 170_000, 50_000
#: Documents whose pieces are returned in one go.
DOCS_AT_ONCE = 500


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """The lengths of a document's pieces, longest first: powers of two, at most ``limit``."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1 and 1 << k < limit]


class IdTable(dict):
    """The ids, as bytes, of pieces between white space, made when a piece is first asked for.

    A new piece is cut into the tokenizer file's words, which go through the tokenizers library's model.  When the table is
    full it becomes the older generation, from which pieces that come again are taken back.
    """

    def __init__(self, path: str, keep: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.split, self.tokenize, self.keep = Splitter(path), Tokenizer.from_file(path).model.tokenize, keep
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            value = array("I", [self.split.special[chunk]]).tobytes() if chunk in self.split.special else self.made(self.split.words(chunk))
        self[chunk] = value
        return value

    def made(self, words: list[str]) -> bytes:
        return self.word(words[0]) if len(words) == 1 else b"".join(map(self.part, words))

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word if word.isascii() and word.isprintable() else self.split.spelled(word))]).tobytes()

    def part(self, word: str) -> bytes:
        """The ids of one of several words, mostly a mark or a common word."""
        if (value := self.parts.get(word)) is None:
            if len(self.parts) >= PARTS_KEPT:
                self.parts.clear()
            value = self.parts[word] = self.word(word)
        return value

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split.chunks(text)))


def id_table(path: str) -> IdTable:
    """The table of a tokenizer file, kept by the worker for its later tasks."""
    give_back(use := ("packing", path))
    if use not in KEPT:
        KEPT[use] = IdTable(path, CHUNKS_KEPT)
        give_back(use)  # what reading the file took
    return KEPT[use]


def packed(docs: DataFrame, path: str, *, limit: int = LIMIT, end_token: int = END_TOKEN, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and, if asked for, ``ids``.

    Some documents are packed at a time, so that the ids of a batch of long texts are not held whole.
    """
    id_field = docs.schema[id_col]

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_table(path)
        end = np.array([end_token], "<u4").tobytes()
        for batch in rows:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                own = [table.ids(text) + end for text in part.column(1).to_pylist()]
                yield piece_rows(part.column(0), own, limit, with_ids)

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [StructField("doc_id", id_field.dataType), *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")], *[StructField("ids", ArrayType(IntegerType()))] * with_ids]
    made = own.mapInArrow(pieces, StructType(fields)).withColumn("sequence_id", F.monotonically_increasing_id())
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), *["ids"] * with_ids)


def piece_rows(ids: pa.Array, own: list[bytes], limit: int, with_ids: bool = True) -> pa.RecordBatch:
    """One row per piece of the documents whose token ids ``own`` holds."""
    lengths = [piece_lengths(len(x) // 4, limit) for x in own]
    counts = np.fromiter(map(len, lengths), np.int64, len(own))
    doc = np.repeat(np.arange(len(own)), counts)
    size = np.fromiter(chain.from_iterable(lengths), np.int64, len(doc))
    start = np.fromiter(chain.from_iterable(accumulate(x, initial=0) for x in lengths), np.int64, len(doc) + len(own))
    start = np.delete(start, np.cumsum(counts + 1) - 1)  # where each document ends
    crc = np.fromiter((zlib.crc32(own[d][4 * a : 4 * (a + n)]) for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)), np.int64, len(doc))
    total = np.fromiter((len(x) // 4 for x in own), np.int64, len(own))[doc]
    columns = {"doc_id": ids.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crc), "doc_tokens": pa.array(total)}
    if with_ids:
        ends = np.r_[0, np.cumsum(size)].astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), "<i4")))
    return pa.RecordBatch.from_pydict(columns)


def batches(pieces: DataFrame, tokens: int = 65536) -> DataFrame:
    """Adds ``batch``: sequences of one length, ``tokens`` together, drawn within Spark's partitions of each bucket.

    Each batch is named by bucket, partition and number, so none needs a count over all rows; the column gets a ``_`` where
    the pieces have it.
    """
    part, batch = unused(pieces, "part"), unused(pieces, "batch")
    own = pieces.withColumn(part, F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("bucket", part).orderBy("sequence_id")) - 1
    return own.withColumn(batch, F.concat_ws("-", "bucket", part, (place * F.col("length") / tokens).cast("long"))).drop(part)


def op4_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return packed(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
