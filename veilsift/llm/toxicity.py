"""Toxicity by a character n-gram linear classifier on naive Bayes features.

Features are the hashed n-grams of the lower-cased text's characters (code points), present or not, scaled by their
smoothed naive Bayes log-count ratio; a logistic regression is trained over them. N-grams whose ratio is nearer to zero
than ``LEAST_RATIO``, or that fewer than ``LEAST_DOCS`` documents of the sample hold, carry no feature. The ratios are
counted by the tasks and only buckets that tell come to the driver. Scoring reads whole texts in slices, so its memory is
bounded.

``SAMPLE`` labelled rows at most, chosen by a hash of doc_id, and of those about ``SAMPLE_BYTES`` of text, are the bounded
sample that the model is fitted on; the intercept is corrected for the sample's share of toxic rows. Every document is
scored.

Edge cases: a null or empty text scores as the intercept alone; rows without a label, or with one other than 0 and 1,
aren't learned from; repeated labels of one document count once, toxic if any is; without two classes the score is the
share of toxic labels, smoothed; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import mapped, settled, text_key, without

ORDERS, BITS, LEAST_RATIO, LEAST_DOCS = (4, 5, 6, 7, 8), 22, 1.5, 5
SAMPLE, SAMPLE_BYTES = 4000, 12_000_000
SLICE = 1 << 20
THRESHOLD = 0.3


def hashed_grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, slice by slice; slices overlap so that none is lost."""
    text, longest = text.lower(), max(ORDERS)
    for lo in range(0, max(1, len(text)), SLICE):
        codes = np.frombuffer(text[lo : lo + SLICE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled = codes + np.uint32(1)
        for n in range(2, longest + 1):
            if len(codes) < n:
                break
            rolled = rolled[: len(codes) - n + 1] * np.uint32(2654435761) + codes[n - 1 :]
            if n in ORDERS:
                own = rolled if lo + SLICE >= len(text) else rolled[:SLICE]
                yield ((own ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def present(text: str | None, chosen: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, of the chosen ones only if given."""
    parts = [g if chosen is None else g[chosen[g]] for g in hashed_grams(text or "")]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Weights of the chosen buckets (their ratios multiplied in) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        chosen, dense = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.float32)
        chosen[self.buckets], dense[self.buckets] = True, self.weights
        return chosen, dense

    def scores(self, texts: list[str | None]) -> np.ndarray:
        chosen, dense = self.table()
        return np.array([score_of(present(t, chosen), dense, self.intercept) for t in texts])


def score_of(found: np.ndarray, dense: np.ndarray, intercept: float) -> float:
    z = dense[found].sum() / np.sqrt(max(1, len(found))) + intercept
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_ratios(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Smoothed naive Bayes log-count ratios from the toxic and other documents that hold each bucket."""
    return np.log((yes + 1) / (n_yes + 2)) - np.log((no + 1) / (n_no + 2))


def constant(share: float, rows: int) -> Model:
    """The model that knows of no feature: the share of toxic labels, smoothed."""
    p = (share * rows + 1) / (rows + 2)
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))


def train(kept: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray, ratio: np.ndarray, share: float, steps: int = 150, shrink: float = 1e-4, rate: float = 0.05) -> Model:
    """Logistic regression over the features of each row scaled by their ratios, by Adam.

    ``kept``: places in ``buckets`` of each row's features; ``share``: toxic rows among all labelled rows.
    """
    yes = toxic.astype(bool)
    lengths = np.array([len(x) for x in kept])
    columns, rows = np.concatenate(kept).astype(np.int64), np.repeat(np.arange(len(kept)), lengths)
    scale = 1 / np.sqrt(np.maximum(1, lengths))
    values, n = ratio[columns] * scale[rows], len(kept)
    w, b = np.zeros(len(buckets)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns] * values, minlength=n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        g, gb = np.bincount(columns, weights=error[rows] * values, minlength=len(w)) / n + shrink * w, error.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / up) / (np.sqrt(v / down) + 1e-8)
        b -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    b += np.log(share / (1 - share)) - np.log(yes.sum() / (~yes).sum())
    return Model(buckets, w * ratio, float(b))


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model from labelled rows for which ``held_out`` (over doc_id) is false; a quarter to a half of the sample is toxic."""
    spark = docs.sparkSession
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        marks = marks.where(~held_out)
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    order = F.xxhash64("doc_id")
    most = {1: min(totals.get(1, 0), sample // 4), 0: min(totals.get(0, 0), sample - sample // 4)}
    wanted = [r for kind, n in most.items() for r in marks.where(F.col("toxic") == kind).orderBy(order).limit(n).collect()]  # at most ``sample`` rows
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in wanted], "doc_id bigint, toxic int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # rows that repeat a document count once
    # Texts of the sample up to a number of bytes, in the order of the hash: whole texts or none.
    sizes = sorted(rows.select("doc_id", "toxic", F.octet_length("text").alias("size"), order.alias("place")).collect(), key=lambda r: r["place"])
    taken, size = [], 0
    for r in sizes:
        if size + r["size"] <= SAMPLE_BYTES:
            taken.append((r["doc_id"],))
            size += r["size"]

    fitted = settled(rows.join(F.broadcast(spark.createDataFrame(taken, "doc_id bigint")), "doc_id").select("doc_id", "toxic", "text"), "sample")
    sizes = {r["toxic"]: r["n"] for r in fitted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share, n = totals.get(1, 0) / sum(totals.values()), sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        return constant(share, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[toxic, present(text.as_py())] += 1
        at = np.flatnonzero(held.any(axis=0))
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[1, some].astype(np.int64)), pa.array(held[0, some].astype(np.int64))], ["bucket", "yes", "no"])

    counted = fitted.select("toxic", "text").transform(mapped, count, "bucket int, yes bigint, no bigint").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    ratio = F.log((F.col("yes") + 1) / (sizes[1] + 2)) - F.log((F.col("no") + 1) / (sizes[0] + 2))
    told = counted.where((F.col("yes") + F.col("no") >= LEAST_DOCS) & (F.abs(ratio) >= LEAST_RATIO)).toArrow().sort_by("bucket")  # of 2^BITS buckets, those that tell
    buckets = told.column("bucket").to_numpy().astype(np.int64)
    if not len(buckets):
        return constant(share, n)
    shared = spark.sparkContext.broadcast(buckets)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
        chosen[shared.value], place[shared.value] = True, np.arange(len(shared.value))
        for batch in batches:
            found = [place[present(t.as_py(), chosen)].astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])

    got = fitted.transform(mapped, pick, "doc_id bigint, toxic int, found binary").toArrow().sort_by("doc_id")  # at most ``sample`` rows
    kept = [np.frombuffer(x.as_py(), "<i4") for x in got.column("found")]
    toxic = got.column("toxic").to_numpy().astype(float)
    return train(kept, toxic, buckets, log_ratios(told.column("yes").to_numpy(), told.column("no").to_numpy(), sizes[1], sizes[0]), share)


SCORED = "doc_id bigint, text_key bigint, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key of the text and score of each row, from its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^BITS weights, some ten thousand in practice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, dense = shared.value.table()
        for batch in batches:
            got = [score_of(present(t.as_py(), chosen), dense, shared.value.intercept) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.float64())], ["doc_id", "text_key", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text").transform(mapped, run, SCORED)


def every_fourth(doc_id: Column) -> Column:
    """The fold that isn't learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; the fold ``held_out`` isn't learned from."""
    return judged(docs, labels).drop("text_key")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxicity`` with the key of each text."""
    model = learn(docs, labels, every_fourth(F.col("doc_id")))
    held = F.coalesce(every_fourth(F.col("doc_id")), F.lit(False))
    return scored(docs, model).select("doc_id", "text_key", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def untoxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns are kept."""
    verdicts = settled(judged(docs, labels), "toxicity")
    return without(docs, verdicts.where("predicted = 1"))
