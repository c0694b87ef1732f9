"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words, pairs of words, and one mark for a word
repeated at once) stand for target text (documents labelled good) and raw text (all
documents). A document's weight is the log ratio of both models per n-gram. The documents
kept are the top k by weight / temperature + Gumbel noise, which is sampling without
replacement by importance. k is the number of documents above a cut that is set on
labelled documents held out from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import MULTIPLIER, PUNCTUATED, SAME, mix, row_slices, running, table, word_hashes
from lagcast.session import materialize

#: Buckets of n-grams; labelled rows used (the bound of the sample, half to fit and half to set the cut).
BUCKETS, LABELLED = 1 << 14, 40_000
#: Prior counts per bucket; scale of the weights against the noise; how much worse losing a good row is than keeping a bad one.
PRIOR, TEMPERATURE, LOSS = 1.0, 0.005, 20.0


def ngrams(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of a column of texts."""
    hashes, begins = word_hashes(column, SAME, PUNCTUATED)
    rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    same_row = rows[1:] == rows[:-1]
    pairs = mix(hashes[:-1] * np.uint64(MULTIPLIER) + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = np.uint64(0)
    buckets = np.concatenate((hashes, pairs[same_row])) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate((rows, rows[1:][same_row]))


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """id and good (0 or 1) of at most `bound` labelled ids, by hash; of several labels of an id the lowest counts, null ones don't."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("good"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(bound)


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw of each bucket; counts cover all documents, summed per bucket by Spark."""
    # The sample is bounded, so it may be broadcast.
    half = sample.where((F.col("good") == 1) & (F.pmod(F.xxhash64("label_id"), F.lit(2)) == 0))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(half), F.col("doc_id") == F.col("label_id"), "left").select("text", "good")

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column("good").is_valid().to_numpy(zero_copy_only=False)
            for first, part in row_slices(batch.column("text")):
                buckets, rows = ngrams(part)
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                total[1] += np.bincount(buckets[target[first + rows]], minlength=BUCKETS)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[0][there]), pa.array(total[1][there])], ["bucket", "raw", "target"])

    summed = joined.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.full((2, BUCKETS), PRIOR)
    # The model itself: one row per bucket.
    for r in summed.collect():
        counts[:, r["bucket"]] += r["raw"], r["target"]
    raw, target = np.log(counts / counts.sum(1, keepdims=True))
    return target - raw if counts[1].sum() > PRIOR * BUCKETS else np.zeros(BUCKETS)


def weight(model: np.ndarray):
    """A column function: log importance weight per n-gram of a text; null for a text without words."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
        for first, part in row_slices(column):
            buckets, rows = ngrams(part)
            n[first : first + len(part)] = np.bincount(rows, minlength=len(part))
            total[first : first + len(part)] = np.bincount(rows, model[buckets], minlength=len(part))
        return pa.array(total / np.maximum(n, 1), mask=n == 0)

    return score


def best_cut(scores: list[tuple[float, int]]) -> float:
    """The cut with the least cost on (weight, good) rows, midway between two weights; minus infinity if one kind lacks."""
    good, bad = np.sort([w for w, g in scores if g == 1]), np.sort([w for w, g in scores if g != 1])
    if not len(good) or not len(bad):
        return -np.inf
    edges = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(([edges[0] - 1e-9], (edges[1:] + edges[:-1]) / 2))
    cost = LOSS * np.searchsorted(good, cuts) / len(good) + (len(bad) - np.searchsorted(bad, cuts)) / len(bad)
    # Of the cuts that cost least, the middle of the widest stretch.
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(cuts[least[len(least) // 2]])


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` that are kept (all their columns), and the scores (doc_id, log_weight, key) of those kept.

    Documents without words are rejected. Rows with equal doc_id and text have equal keys, so repeated
    rows are kept or rejected together; a null doc_id is a document of its own without a label.
    With labels of one kind only, every document with words is kept. No rows give no rows.
    """
    sample = materialize(labelled_sample(labels))
    score = weight(fit(docs, sample))
    # The key repeats in any later pass: its noise is a hash of the row.
    noise = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    key = lambda w: w / TEMPERATURE - F.log(-F.log(noise))
    scored = materialize(docs.select("doc_id", "text").withColumn("log_weight", score("text")).where("log_weight IS NOT NULL").select("doc_id", "log_weight", key(F.col("log_weight")).alias("key")))
    held_out = sample.where((F.col("good") != 1) | (F.pmod(F.xxhash64("label_id"), F.lit(2)) == 1))
    cut = best_cut([tuple(r) for r in scored.join(F.broadcast(held_out), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.first("log_weight"), F.first("good")).drop("doc_id").collect()])
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    placed = running(scored.withColumn("one", F.lit(1)), [F.col("key").desc(), F.col("doc_id"), F.col("log_weight")], "one")
    least = placed.where(F.col("index") == k - 1).agg(F.min("key")).first()[0]
    floor = F.lit(np.inf if least is None else float(least))
    kept = docs.where(F.coalesce(key(score("text")) >= floor, F.lit(False)))
    return kept, scored.where(F.col("key") >= floor)


def op5_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept by importance resampling, with their weight and key."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]
