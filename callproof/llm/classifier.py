"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's words give two streams: the words themselves (lower case, without trailing marks) and their
shapes (case, digits, marks, and whether the word repeats the one before).  The unigrams and bigrams of
both are hashed into ``2 ** BITS`` slots; a text's vector holds each slot's share of all its n-grams, so a
score is a sparse dot product: the mean weight of the n-grams, scaled.

Training takes a bounded sample of the labelled rows (``TRAIN_ROWS``, by hash of the id), hashed where they
are read, and runs the updates in the order of that hash in one task, so it is the same each time.  Its input
does not grow with the corpus.  The weights (at most ``2 ** BITS`` floats, 1 MB) are broadcast; every text is
scored whole, where it is read.

Defined results: a null or empty text has no n-grams and its score is that of the bias; without a training row
every score is 0.5; rows with equal text get equal scores; a null ``doc_id`` is never a training row; repeated
rows are scored once each; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, StructField, StructType

BITS = 18
#: The sample of labelled rows that training takes at most (about; chosen by hash).
TRAIN_ROWS = 12_000
PASSES = 3
SCALE = 30.0
WORDS_KEPT = 300_000


class Hasher:
    """Words -> hashed n-gram slots; the codes of words are kept while there is room."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.codes: dict[bytes, int] = {}
        self.word = np.zeros(1024, np.uint64)
        self.shape = np.zeros(1024, np.uint64)

    def code(self, words: list[bytes]) -> np.ndarray:
        """A number for each word."""
        codes = self.codes
        fresh = {w for w in words if w not in codes}
        if fresh:
            if len(codes) + len(fresh) > WORDS_KEPT:
                codes.clear()
                fresh = {*words}
            n = len(codes) + len(fresh)
            if n > len(self.word):
                self.word, self.shape = np.resize(self.word, 2 * n), np.resize(self.shape, 2 * n)
            for w in fresh:
                k = codes[w] = len(codes)
                self.word[k] = xxhash.xxh64_intdigest(w.lower().rstrip(b".,;:!?"), 1)
                self.shape[k] = xxhash.xxh64_intdigest(shape(w), 2)
        return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))

    def slots(self, text: str | None) -> np.ndarray:
        """The slots of all n-grams of a text, repeats included."""
        words = text.encode("utf-8", "replace").split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        code = self.code(words)
        word, form = self.word[code], self.shape[code].copy()
        form[1:][code[1:] == code[:-1]] = np.uint64(0x9E3779B97F4A7C15)  # the same word again
        grams = [word, form]
        for one, k in ((word, 0xC2B2AE3D27D4EB4F), (form, 0x165667B19E3779F9)):
            grams.append((one[:-1] * np.uint64(k) + one[1:]) * np.uint64(0x9E3779B97F4A7C15))
        return ((np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def mean(self, text: str | None, weights: np.ndarray) -> float:
        slots = self.slots(text)
        return float(weights[slots].mean()) if len(slots) else 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        slots = self.slots(text)
        if not len(slots):
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        at, n = np.unique(slots, return_counts=True)
        return at.astype(np.int32), (n / len(slots) * SCALE).astype(np.float32)


_RUNS = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")


def shape(word: bytes) -> bytes:
    """A whole word with its runs of small letters and digits as a and 0, of capitals as A or, where longer, AA; marks stay."""
    return _RUNS.sub(lambda m: b"0" if m[0][:1].isdigit() else b"A" if m[0].isupper() and len(m[0]) == 1 else b"AA" if m[0].isupper() else b"a", word)


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], size: int, *, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader: weights by slot, and the bias, after one update per row."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = size

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
        return np.where(np.abs(za) <= l1, 0.0, w)

    for at, x, y in rows:
        at, x = np.append(at, bias), np.append(x, 1.0)
        w = weights(at)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
        g = (p - y) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
        z[at] += g - sigma * w
        n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[bias])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, y, order)`` of at most about ``rows`` labelled documents, those whose id hashes lowest.

    ``keep`` says which ids may be learned from.  The ids sent to all tasks are bounded by ``rows``.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label).cast("int").alias("y")).where(F.col("label_id").isNotNull() & F.col("y").isin(0, 1) & keep)
    known = known.groupBy("label_id").agg(F.max("y").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    order = F.xxhash64(F.lit(7), F.col("label_id").cast("string"))
    chosen = known.withColumn("order", order).where(F.col("order") < int((2 * share - 1) * (2**63 - 1))) if share < 1 else known.withColumn("order", order)
    return docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "label_id").select("text", "y", "order")


def train(sample: DataFrame, *, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias from ``sample(text, y, order)``."""
    vector = StructType([StructField("at", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType()))])

    @F.pandas_udf(vector)
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bits)
        for batch in texts:
            yield pd.DataFrame([hasher.vector(t) for t in batch], columns=["at", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "y"])
        data = [*zip(rows["at"], rows["x"], rows["y"], strict=True)]
        w, bias = ftrl((r for _ in range(passes) for r in data), 1 << bits)
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "bias": [bias]})

    vectors = sample.select("y", "order", hashed("text").alias("v")).select("y", "order", "v.at", "v.x")
    found = vectors.groupBy().applyInPandas(learn, StructType([StructField("w", BinaryType()), StructField("bias", DoubleType())])).first()
    if found is None:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(found["w"], "<f4").copy(), float(found["bias"])


def score_column(spark, weights: np.ndarray, bias: float, bits: int = BITS):
    """A column function: text -> the chance of label 1."""
    shared = spark.sparkContext.broadcast(weights)  # 2 ** bits floats

    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, w = Hasher(bits), shared.value
        for batch in texts:
            logit = np.array([bias + SCALE * hasher.mean(t, w) for t in batch], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return scored


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def classify(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, label_held_out: Column, *, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    weights, bias = train(training_sample(docs, labels, label, ~label_held_out, rows, id_col=id_col, text_col=text_col))
    scored = score_column(docs.sparkSession, weights, bias)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).cast(BooleanType()).alias("held_out"), scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, "quality", remainder("doc_id", 3) == 1, remainder("label_id", 3) == 1)
