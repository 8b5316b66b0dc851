"""Line dedup: documents probe a sharded minimal perfect hash of the lines that several documents hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteCache, column, discard, materialise, pack_arrays, pick, raw_texts, read_file, scratch, ship, slices, table, unpack_arrays, write_file
from .mph import PerfectHash

SHARD_KEYS = 250_000
SALTS = 32  # tasks that read a shard, at most
CACHE_MB = 96
NO_ID = 2**63 - 1  # stands for a document without an id: it owns no line that another document holds
ID, MARK = f"coalesce(cast(doc_id as bigint), {NO_ID}L) as doc_id", "xxhash64(text) as mark"
_CACHE = ByteCache(CACHE_MB << 20)


def line_key(line: bytes, least: int) -> bytes | None:
    """A line without white space at its ends and with A-Z lower-cased; None if under `least` code points."""
    key = line.strip().lower()
    return key if len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least else None


def hashed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each key: what the perfect hash takes, and the fingerprint that is compared."""
    import xxhash

    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return h[:, 0], h[:, 1]


def line_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, mark, h1, h2): the distinct keys of each row's lines. mark is a hash of the text, as rows may share a doc_id."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            keys, n = [], []
            for t in raw_texts(column(b, "text")):
                own = {k for x in t.split(b"\n") if (k := line_key(x, least)) is not None}
                keys += own
                n.append(len(own))
            h1, h2 = hashed(keys) if keys else (np.zeros(0, np.uint64),) * 2
            row = np.repeat(np.arange(len(n)), n)
            ids, marks = (column(b, x).to_numpy(zero_copy_only=False) for x in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], marks[row], h1.view(np.int64), h2.view(np.int64))], ["doc_id", "mark", "h1", "h2"])

    return pick(docs, "doc_id", "text").selectExpr(ID, MARK, "text").mapInArrow(run, "doc_id long, mark long, h1 long, h2 long")


def shared_lines(keys: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h1, h2, owner, n_docs): keys that at least `min_docs` documents hold, their smallest doc_id and how many hold them."""
    return keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def build_index(spark: SparkSession, keys: DataFrame, min_docs: int = 2, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Writes the shards of the index of line_keys() to the shared folder; their folder and how many they are.

    A shard holds a perfect hash of its share of the keys, and arrays in its order: 64-bit fingerprints, counts, owners.
    The number of shards follows the number of keys, so that a shard keeps its size however large the corpus.
    """
    lines = materialise(spark, shared_lines(keys, min_docs), "shared-lines")
    shards = max(1, -(-lines.count() // shard_keys))
    at = scratch(spark, "line-index")

    def build(key, part):
        h1 = part["h1"].to_numpy().view(np.uint64)
        # two keys with one h1 can't both be hashed: the later ones, next to none, are kept in a list
        _, first = np.unique(h1, return_index=True)
        rest = np.setdiff1d(np.arange(len(h1)), first)
        mph = PerfectHash.build(h1[first])
        place = np.empty(len(first), np.int64)
        place[mph.lookup(h1[first])] = first
        place = np.concatenate((place, rest))
        arrays = {k: part[k].to_numpy()[place] for k in ("h2", "owner")} | {"count": np.minimum(part["n_docs"].to_numpy()[place], 2**32 - 1).astype(np.uint32), "rest": h1[rest]}
        shard = int(key[0].as_py())
        size = write_file(f"{at}/{shard:06d}", [pack_arrays({"shard": shard, "keys": len(h1)}, mph.arrays() | arrays)])
        return pa.table({"shard": pa.array([shard], pa.int64()), "bytes": pa.array([size], pa.int64())})

    dealt = lines.withColumn("shard", F.expr(f"pmod(h1, {shards}L)"))
    discard(materialise(spark, dealt.groupBy("shard").applyInArrow(build, "shard long, bytes long"), "line-index-shards"), lines)
    return at, shards


def probe(at: str, shard: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, count) of each key of one shard, -1 and 0 where the index doesn't hold it. A shard without a file is empty."""
    owner, count = np.full(len(h1), -1, np.int64), np.zeros(len(h1), np.int64)

    def load(path):
        try:
            raw = read_file(path)
        except FileNotFoundError:
            return None, 0
        arrays = unpack_arrays(raw)[1]
        return (PerfectHash.of(arrays), arrays), len(raw)

    found = _CACHE.get(f"{at}/{shard:06d}", load)
    if found is None:
        return owner, count
    mph, arrays = found
    place = mph.lookup(h1)
    ok = (place >= 0) & (arrays["h2"][place].view(np.uint64) == h2)
    owner[ok], count[ok] = arrays["owner"][place[ok]], arrays["count"][place[ok]]
    for i, x in enumerate(arrays["rest"]):
        same = (h1 == x) & (h2 == arrays["h2"][mph.n + i].view(np.uint64))
        owner[same], count[same] = arrays["owner"][mph.n + i], arrays["count"][mph.n + i]
    return owner, count


def dropped_keys(spark: SparkSession, docs: DataFrame, least: int, min_docs: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, mark, gone): for each document that loses lines, the hashes of their keys.

    The keys, not the texts, are sent to the shard that would hold them, where they probe its arrays. A shard is read by
    SALTS tasks at most, however many documents there are, and a line that a third of all documents hold is dealt to as many.
    """
    keys = materialise(spark, line_keys(docs, least), "line-keys")
    at, shards = build_index(spark, keys, min_docs, shard_keys)

    def run(batches):
        for b in batches:
            h1, h2 = (column(b, x).to_numpy().view(np.uint64) for x in ("h1", "h2"))
            ids, shard = column(b, "doc_id").to_numpy(), column(b, "shard").to_numpy()
            gone = np.zeros(len(ids), bool)
            for s in np.unique(shard).tolist():
                rows = np.flatnonzero(shard == s)
                owner, _ = probe(at, s, h1[rows], h2[rows])
                gone[rows] = (owner >= 0) & (owner != ids[rows])
            keep = pa.array(gone)
            yield pa.RecordBatch.from_arrays([column(b, x).filter(keep) for x in ("doc_id", "mark", "h1")], ["doc_id", "mark", "h1"])

    routed = keys.withColumn("shard", F.expr(f"pmod(h1, {shards}L)")).repartition("shard", F.expr(f"pmod(mark, {SALTS}L)")).sortWithinPartitions("shard")
    marks = routed.mapInArrow(run, "doc_id long, mark long, h1 long").groupBy("doc_id", "mark").agg(F.collect_set("h1").alias("gone"))
    marks = materialise(spark, marks, "dropped-lines")  # a table of known size, which the planner broadcasts only if it is small
    discard(keys)
    return marks


def cleaned(batches, least: int, gone: str):
    """Each batch with (texts without the lines whose keys are in `gone`, lines before, lines dropped)."""
    for b in slices(batches, "text", 16 << 20):
        texts, n, dropped = raw_texts(column(b, "text")), [], []
        for i, (t, hashes) in enumerate(zip(texts, column(b, gone).to_pylist(), strict=True)):
            n.append(t.count(b"\n") + 1)
            dropped.append(0)
            if hashes:
                own = t.split(b"\n")
                keyed = [(j, k) for j, x in enumerate(own) if (k := line_key(x, least)) is not None]
                out = np.isin(hashed([k for _, k in keyed])[0].view(np.int64), np.array(hashes, np.int64))
                lost = {j for (j, _), g in zip(keyed, out.tolist()) if g}
                texts[i], dropped[-1] = b"\n".join([x for j, x in enumerate(own) if j not in lost]), len(lost)
        yield b, texts, np.array(n, np.int64), np.array(dropped, np.int64)


def with_dropped(spark: SparkSession, docs: DataFrame, least: int, min_docs: int) -> tuple[DataFrame, str]:
    """(docs with a further column of dropped keys, its name, which no other has)."""
    name = "_gone" + "_" * max(map(len, docs.columns))
    marks = dropped_keys(spark, docs, least, min_docs).select(F.col("doc_id").alias(name + "i"), F.col("mark").alias(name + "m"), F.col("gone").alias(name))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == marks[name + "i"]) & (F.xxhash64(docs["text"]) == marks[name + "m"])
    return docs.join(marks, on, "left").drop(name + "i", name + "m"), name


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every document.

    A key (line without white space at its ends, A-Z lower-cased) of at least `least` code points that at least `min_docs`
    documents hold stays only in the smallest doc_id that holds it, there with all its lines. A null or empty text is one
    empty line. Rows that repeat a doc_id count as documents but share ownership, so they keep the same lines. Rows
    without a doc_id own nothing that a row with one holds. Other columns are not looked at. An empty table gives an empty
    result.
    """
    marked, gone = with_dropped(spark, pick(docs, "doc_id", "text"), least, min_docs)

    def run(batches):
        for b, texts, n, dropped in cleaned(batches, least, gone):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(n), pa.array(dropped), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return marked.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def replace_lines(spark: SparkSession, docs: DataFrame, least: int = 10, min_docs: int = 2) -> DataFrame:
    """The documents with their texts without the lines that dedup_lines drops; n_chars, if there, follows the text.

    A text that loses nothing stays as it is, a null one null. All other columns stay, whatever their names. Repeated rows
    stay repeated; an empty table gives an empty result.
    """
    marked, gone = with_dropped(spark, docs, least, min_docs)

    def run(batches):
        for b, texts, _, dropped in cleaned(batches, least, gone):
            b = b.drop_columns([gone])
            new = pa.array(texts, pa.binary()).cast(pa.string())
            i = b.schema.get_field_index("text")
            old = b.column(i)
            new = pc.if_else(pa.array(dropped > 0), new, old.cast(pa.string()))
            b = b.set_column(i, b.schema.field(i), new.cast(old.type))
            j = b.schema.get_field_index("n_chars")
            if j >= 0:
                count = pc.utf8_length(new).cast(b.column(j).type)
                b = b.set_column(j, b.schema.field(j), pc.if_else(pa.array(dropped > 0), count, b.column(j)))
            yield b

    return marked.mapInArrow(run, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {
    "op8_line_dedup": f"""
WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {SPACE})")} AS k FROM cut),
shared AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(shared.owner <> keyed.doc_id, FALSE) AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
