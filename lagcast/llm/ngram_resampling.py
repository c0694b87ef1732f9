"""Importance resampling towards a target distribution, with Arrow kernels.

Texts are lower-cased, split, flattened and dictionary-encoded by Arrow. Runs of words are
made by shifting the dictionary's indices, so only distinct runs are written out and hashed
(CRC-32) into buckets. Counts of the buckets over all documents and over the target texts
give each bucket a gain; a document's weight is the sum of its features' gains, taken from
the dictionary's gains and reduced by segments of rows. Gumbel noise on the weights and the
k highest scores are a draw without replacement by importance.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import row_slices, running, table, unused, utf8
from lagcast.session import materialize

#: Words in a feature at most, buckets, least words of a drawn document, its share in percent, seed of the noise.
MOST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: What lies between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that are split at once.
PIECE = 1 << 20
IN_WORD = np.ones(256, bool)
IN_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def pieces(column, most: int, size: int = PIECE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of texts, the row of each, and how many words of it the part before has counted.

    Texts of more than `size` bytes are cut between words; a part repeats the last most - 1 words before
    it, so that runs over the cut are seen.
    """
    data, offsets = utf8(column)
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= size:
        # A copy: case kernels misread a part of an array whose offsets don't begin at 0.
        return pa.concat_arrays([column.cast(pa.large_string()).fill_null("")]), np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    texts, rows, again = [], [], []
    for i, (at, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        carried, to = 0, at
        while True:
            to = min(to + size, last)
            while to < last and IN_WORD[data[to]]:
                # Words are rarely longer than the step.
                step = np.flatnonzero(~IN_WORD[data[to : to + 4096]])
                to = min(last, to + (int(step[0]) if len(step) else 4096))
            texts.append(data[at:to].tobytes())
            rows.append(i)
            again.append(carried)
            if to >= last:
                break
            word = IN_WORD[data[at:to]]
            begins = np.flatnonzero(word & ~np.append(False, word[:-1]))
            carried = min(most - 1, len(begins))
            at = at + int(begins[-carried]) if carried else to
    return pa.array(texts, pa.large_binary()).cast(pa.large_string()), np.array(rows), np.array(again, np.int64)


def features(column, most: int, buckets: int):
    """Per number of words: bucket of each distinct run of words, index into these of every run, and its row."""
    texts, rows_of, again = pieces(column, most)
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    encoded = pc.list_flatten(split).dictionary_encode()
    words, index = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    piece = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    # Splitting leaves an empty word where a text begins or ends between words.
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        stay = index != blank
        index, piece = index[stay], piece[stay]
    # Place of each word in its piece.
    place = np.arange(len(piece)) - np.searchsorted(piece, piece)
    runs, labels = index.astype(np.int64), words
    for n in range(1, most + 1):
        if n > 1:
            runs = runs[: max(0, len(index) - n + 1)] * len(words) + index[n - 1 :]
            whole = piece[: len(runs)] == piece[n - 1 :]
            distinct, code = np.unique(runs[whole], return_inverse=True)
            labels = pc.binary_join_element_wise(labels.take(pa.array(distinct // max(1, len(words)))), words.take(pa.array(distinct % max(1, len(words)))), pa.scalar(" ", words.type))
            runs = np.full(len(whole), -1, np.int64)
            runs[whole] = code
        crc = np.fromiter(map(zlib.crc32, labels.cast(pa.large_binary()).to_pylist()), np.int64, len(labels))
        # A run that ends in a repeated word was counted with the piece before.
        own = (runs >= 0) & (place[n - 1 :][: len(runs)] >= again[piece[n - 1 :][: len(runs)]])
        yield crc % buckets, runs[own], rows_of[piece[: len(runs)][own]]
        runs = np.maximum(runs, 0)


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts per bucket; a task sends each of its buckets once."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in row_slices(batch.column("text")):
                for bucket, runs, _ in features(part, most, buckets):
                    total += np.bincount(bucket, np.bincount(runs, minlength=len(bucket)), minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw of each bucket, with one more count in each bucket."""
    over, under = (target + 1.0) * (raw.sum() + float(len(raw))), (raw + 1.0) * (target.sum() + float(len(raw)))
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def fitted(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from all documents and all target texts."""
    counts = []
    for texts in (docs, target):
        counted = np.zeros(buckets)
        # One row per bucket, whatever the size of the corpus.
        for r in bucket_counts(texts, most, buckets).collect():
            counted[r["bucket"]] = r["n"]
        counts.append(counted)
    return gains(*counts)


def scored(docs: DataFrame, gain: np.ndarray, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), words, n_features, weight, score of every document."""
    buckets, table_of = len(gain), pa.array(gain)

    def score(batches):
        for batch in batches:
            size = batch.num_rows
            words, n, weight = (np.zeros(size, np.int64) for _ in range(3))
            for first, part in row_slices(batch.column("text")):
                for k, (bucket, runs, rows) in enumerate(features(part, most, buckets)):
                    if not len(runs):
                        continue
                    taken = pc.take(pc.take(table_of, pa.array(bucket)), pa.array(runs)).to_numpy(zero_copy_only=False)
                    # Rows are in order, so each is one segment.
                    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    at, many = first + rows[begins], np.diff(np.append(begins, len(rows)))
                    weight[at] += np.add.reduceat(taken, begins)
                    n[at] += many
                    if k == 0:
                        words[at] = many
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "row_key", "words", "n_features", "weight"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    made = keyed.mapInArrow(score, "doc_id long, row_key long, words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return made.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, n_features, weight, score, rank of every document; rank is null for one that is not drawn.

    A feature is a run of 1 to `most` words. Of the N documents with at least `least_words` words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id (null last), then to fewer
    features; rows that are equal in all of these get ranks next to each other. Null and empty texts have no
    features and weight 0. A null doc_id draws its noise from the seed alone. Without target texts the gains are
    those of the prior; no rows give no rows. Other columns are left out, whatever their names. Arrays
    cover about a megabyte of text at a time, also within one long text.
    """
    found = materialize(scored(docs, fitted(docs, target, most, buckets), most, seed))
    able = found.where(F.col("words") >= least_words)
    k = percent * able.count() // 100
    # Equal rows may be many, so their place in the table deals them out.
    salted = able.select("doc_id", "row_key", "n_features", "weight", "score", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row_key"), F.col("salt")]
    placed = running(salted, order, "one").withColumn("rank", F.when(F.col("index") < k, F.col("index") + 1))
    columns = ["doc_id", "row_key", "n_features", "weight", "score", "rank"]
    rest = found.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*columns).unionByName(rest.select(*columns))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that are drawn, all their columns; of equal rows as many as are drawn."""
    key, nth = unused(docs, "row_key"), unused(docs, "nth")
    ranked = resample(docs, target, **settings).where("rank IS NOT NULL")
    many = ranked.groupBy(F.col("row_key").alias(key)).agg(F.count(F.lit(1)).cast("int").alias("many"))
    # A row stands for its copies: one row per key, repeated as often as drawn.
    first = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(many, key)
    once = first.dropDuplicates([key])
    return once.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col("many")))).select(*docs.columns)


def op12_arrow_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents, drawn towards the texts of `benchmark`."""
    made = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH poly AS (SELECT list(c ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
words AS (
  SELECT 'd' AS side, doc_id AS id, n, word FROM (
    SELECT doc_id, row_number() OVER () AS n, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents)
  UNION ALL
  SELECT 'b', NULL, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), poly),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, totals),
weights AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * many // 100 THEN place END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""
