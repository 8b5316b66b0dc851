"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, join_hot, materialise, pick, raw_texts, ship, sift, slices, table
from .graph import components

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and splits at \\x20 and \\x09-\\x0D
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(buf, SEED)], np.uint64)
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(buf[a:b], SEED) for a, b in zip((ends - lens)[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long. A null text has no words."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches, text_col, 8 << 20):
            fps = np.array([fingerprint(t, width) for t in raw_texts(column(b, text_col))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, id_col).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def ball(half: int) -> list[int]:
    """Every 64-bit mask of at most `half` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for r in range(half + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): ids of fingerprints that differ in at most `radius` bits, enough of them to connect all that do.

    fps: (fp, id), each fp once. Each fingerprint emits its ball of half the radius; two fingerprints within the radius have
    a variant in common, and all that share a variant are within the radius of each other. So a variant's fingerprints (at
    most as many as the ball has masks, however large the corpus) need only a link each to the least of them, not all pairs.
    """
    if radius < 0 or radius % 2 or radius > 6:
        raise ValueError("the radius must be 0, 2, 4 or 6")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = fps.select("fp", "id", F.explode(masks).alias("mask")).select("fp", "id", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min(F.struct("id", "fp")).over(Window.partitionBy("variant"))
    met = variants.withColumn("least", least).where("id != least.id")
    links = met.select(F.col("id").alias("u"), F.col("least.id").alias("v"), F.col("fp").bitwiseXOR(F.col("least.fp")).alias("x")).distinct()
    return links.where(F.bit_count("x") <= radius).select("u", "v")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable over links.

    Two documents are linked where their fingerprints differ in at most `radius` bits. Texts without words have the
    fingerprint 0 and are linked like any other; repeated rows appear as often as they come in. A row without an id has
    its fingerprint, no component, and links nothing. An empty table gives an empty result.
    """
    each = materialise(spark, fingerprints(docs, width, id_col, text_col), "fingerprints")
    reps = each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    reps = materialise(spark, reps, "fingerprint-ids")
    found = components(spark, near_links(reps.select("fp", "id"), radius))
    known = reps.join(found, reps["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n")
    known = materialise(spark, known, "fingerprint-components")
    out = join_hot(each, known, "fp", each.count())
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents without all but the smallest doc_id of each group; the columns stay as they are.

    Rows of one doc_id count as copies, of which one stays. Rows without a doc_id stay.
    """
    found = materialise(spark, near_duplicates(spark, docs, width, radius), "near-duplicates")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    return without(docs, found.where("component_id < doc_id").select(F.col("doc_id").alias("id")), again)


def without(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The documents without those of gone(id), and one row (the least text by hash) of each doc_id of again(id), which
    several rows have. Rows without a doc_id stay. Only rows that a filter of these ids lets through are shuffled."""
    gone, again, names = gone.select(F.col("id").alias("_gone")).distinct(), again.select(F.col("id").alias("_again")).distinct(), docs.columns
    single = gone.unionByName(again.withColumnRenamed("_again", "_gone"))
    doubtful, kept = sift(docs, "doc_id", single)
    kept = kept.unionByName(doubtful.join(single, doubtful["doc_id"] == single["_gone"], "left_anti"))
    if again.isEmpty():
        return kept
    several = again.join(gone, again["_again"] == gone["_gone"], "left_anti")
    several = doubtful.join(several, doubtful["doc_id"] == several["_again"], "left_semi")
    mark = "_row" + "_" * max(map(len, names))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return kept.unionByName(several.withColumn(mark, rank).where(F.col(mark) == 1).select(*names))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
