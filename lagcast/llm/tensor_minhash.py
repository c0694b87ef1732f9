"""MinHash near-duplicate search with tensored banding.

Two small collections of band hashes, each of a few minhashes, stand for a set. A table's key
is a pair of them, one of each collection, so m + m hashes give m * m tables and a key has twice
the minhashes of a band. Two sets share a key exactly if they share a band in both
collections; bands that no other set has are dropped before pairs are formed. In each table
sets are compared with its most central set, then only with sets not linked to them yet;
every link is confirmed on whole texts. The result is components, never all pairs of a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import MULTIPLIER, mix, row_slices, table
from lagcast.llm.components import components
from lagcast.llm.jaccard_join import keyed_texts, links_around_hubs, measure, set_members, shingle_sets, vertex, with_components
from lagcast.session import materialize

WORDS, PERCENT = 3, 85
#: Bands of a collection and minhashes of a band: 160 minhashes give 256 tables of 10. At a Jaccard of 0.85 two sets share
#: no band of one collection with probability (1 - 0.85**5)**16, so 0.9998 of such pairs meet, and more of nearer
#: ones; of pairs at 0.5 one in six does, at 0.3 one in 700.
BANDS, ROWS = 16, 5


def coefficients(bands: int, rows: int) -> np.ndarray:
    """An odd multiplier for each minhash of both collections."""
    n = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)
    return (mix(n * np.uint64(MULTIPLIER)) | np.uint64(1)).reshape(2, bands, rows)


def band_hashes(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hashes of the bands of both collections of each set that is not empty: an array (2, bands, sets)."""
    tokens = mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    made = np.zeros((2, bands, len(sets)), np.uint64)
    for side, collection in enumerate(coefficients(bands, rows)):
        for band, multipliers in enumerate(collection):
            for m in multipliers:
                made[side, band] = mix(made[side, band] * np.uint64(MULTIPLIER) + np.minimum.reduceat(tokens * m, begins)) if sets else 0
    return made


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_key, v (number of the set), n (its size), left, right (its bands) of every document (doc_id, text, row_key)."""

    def make(batches):
        for batch in batches:
            for first, part in row_slices(batch.column("text")):
                sets = shingle_sets(part, words)
                there = np.array([len(s) > 0 for s in sets], bool)
                made = np.zeros((2, len(sets), bands), np.int64)
                if there.any():
                    made[:, there] = band_hashes([s for s in sets if len(s)], bands, rows).view(np.int64).transpose(0, 2, 1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(side.ravel())) for side in made]
                kept = [batch.column(c).slice(first, len(part)) for c in ("doc_id", "row_key")]
                numbers = [pa.array([vertex(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *numbers, *lists], ["doc_id", "row_key", "v", "n", "left", "right"])

    return docs.mapInArrow(make, "doc_id long, row_key long, v long, n long, left array<long>, right array<long>")


def shared_bands(sketched: DataFrame) -> DataFrame:
    """v, n, side, band, value, many: bands that `many` > 1 different sets have."""
    once = sketched.where("n > 0").dropDuplicates(["v"])
    sides = [once.select("v", "n", F.lit(i).alias("side"), F.posexplode(c).alias("band", "value")) for i, c in enumerate(("left", "right"))]
    rows = materialize(sides[0].unionByName(sides[1]))
    key = ["side", "band", "value"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return materialize(rows.join(counts, key))


def table_keys(shared: DataFrame) -> DataFrame:
    """key, v, n, central (how many sets share a band with v, counted by band) for every pair of shared bands of both sides."""
    central = shared.groupBy("v").agg(F.sum("many").alias("central"))
    one, two = (shared.where(F.col("side") == i).select("v", *([] if i else ["n"]), F.struct("band", "value").alias(f"band{i}")) for i in (0, 1))
    keys = one.join(two, "v").withColumn("key", F.xxhash64("band0", "band1")).select("key", "v", "n")
    return materialize(keys.join(central, "v"))


def table_hubs(keys: DataFrame) -> DataFrame:
    """key, hub: the most central set of every table key that several sets have."""
    return keys.groupBy("key").agg(F.max(F.struct("central", "v")).alias("best"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", F.col("best.v").alias("hub"), F.col("best.central").alias("hub_central"))


def open_pairs(keys: DataFrame, hub_of: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """head, v: sets of one table key whose hubs and components differ and whose sizes allow a link.

    A key's rows are first grouped by hub and component, so sets of one of these never meet.
    """
    known = keys.join(hub_of, "v", "left").join(roots.select(F.col("vertex").alias("v"), "root"), "v", "left")
    known = known.select("key", "v", "n", F.coalesce("hub", "v").alias("hub"), F.coalesce("root", "v").alias("root"))
    several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("hub").alias("hub0"), F.max("hub").alias("hub1"))
    entries = materialize(known.join(several.where("low <> high AND hub0 <> hub1").select("key"), "key"))
    groups = entries.groupBy("key", "hub", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = f"100 * x.most >= {percent} * y.least AND 100 * y.most >= {percent} * x.least"
    met = groups.alias("x").join(groups.alias("y"), F.expr(f"x.key = y.key AND x.root < y.root AND x.hub <> y.hub AND {sizes}"))
    met = met.select("x.key", F.col("x.hub").alias("hub1"), F.col("x.root").alias("root1"), F.col("y.hub").alias("hub2"), F.col("y.root").alias("root2"))
    side = lambda k: entries.select("key", F.col("hub").alias(f"hub{k}"), F.col("root").alias(f"root{k}"), F.col("v").alias(f"v{k}"), F.col("n").alias(f"n{k}"))
    pairs = met.join(side(1), ["key", "hub1", "root1"]).join(side(2), ["key", "hub2", "root2"]).where("hub1 <> v2 AND hub2 <> v1").where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return materialize(pairs.select(F.col("v1").alias("head"), F.col("v2").alias("v")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row_key, n_shingles, component, component_id, kept of every document.

    Documents are candidates if they share a key of a table, and link when 100 * intersection >= percent * union of
    their whole sets of shingles of `words` words (A-Z lower-cased; with fewer words the whole sequence is one shingle).
    component_id is the smallest doc_id that links lead to; kept is whether that is the document's own.
    Texts without words, and nulls, link to nothing, not to each other either. Repeated rows and equal sets are one
    component; a null doc_id takes part, but does not name a component unless all its doc_ids are null. Very long
    texts are hashed in slices, their sets are held whole. Extra columns are left out; no rows give no rows.
    """
    texts = keyed_texts(docs)
    sketched = materialize(sketches(texts, words, bands, rows))
    members = materialize(set_members(sketched))
    named = members.select("row_key", "v")
    keys = table_keys(shared_bands(sketched))
    hubs = table_hubs(keys)
    # Every set meets the most central one of all its tables; the others of its tables follow from the links around that one.
    joined = keys.join(hubs, "key").where("v <> hub")
    hub_of = materialize(joined.groupBy("v").agg(F.max_by("hub", F.struct("hub_central", "hub")).alias("hub")))
    measured = measure(texts, named, hub_of.select(F.col("hub").alias("head"), "v"), relations=True, words=words)
    hit = 100 * F.col("shared") >= percent * (F.col("head_n") + F.col("n") - F.col("shared"))
    link = lambda df: df.where(hit).select(F.col("head").alias("a"), F.col("v").alias("b"))
    inner = materialize(link(measured).unionByName(links_around_hubs(measured, percent)))
    outer = measure(texts, named, open_pairs(keys, hub_of, components(inner), percent), relations=False, words=words)
    found = with_components(sketched, members, components(inner.unionByName(link(outer))))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 3-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
