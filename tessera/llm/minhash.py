"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, each pair is verified, and a
join by parts of the sets that no pair alike can do without finds what the bands have missed among the documents that stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, join_hot, materialise, pick, raw_texts, ship, sift, slices
from .graph import components
from .simhash import SEED, without

WIDTH = 5  # words in a shingle
BANDS, ROWS = 24, 5  # a pair of similarity s shares a bucket with a chance of 1 - (1 - s ** ROWS) ** BANDS; 0.99993 at 0.8
TASK_SHINGLES = 2_000_000  # of a component that one task decides; larger ones are cut down by rounds first
SKETCH = 16  # words of 64 bits
SLICE = 2 << 20  # bytes of text that a worker takes at once
SAMPLE, OFTEN = 10_000, 3  # shingles that so many of about so many documents have come last among the keys of a set; nothing else hangs on them
_MULT, _ADD = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[1], [0]], np.uint64))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; one of all words if they are few, none without words."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    buf, h = b" ".join(words), xxhash.xxh3_64_intdigest
    if n <= WIDTH:
        return np.array([h(buf, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    return np.unique(np.array([h(buf[a:b], SEED) for a, b in zip((ends - lens)[: n - WIDTH + 1].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)], np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a set of shingles; none of an empty one."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _MULT + _ADD).min(axis=0))
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def least_part(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A fifth of a set and one more, in an order that all sets share: what is not in `often` (sorted) first, then by hash.

    Sets with a similarity of 0.8 or more have one of these in common: a set has at most a fifth that the other lacks, so
    the first that both have is behind so many at most, in either."""
    n = min(len(hashes), len(hashes) // 5 + 1)
    if not len(often):
        return hashes[:n]
    last = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
    return np.concatenate((hashes[~last][:n], hashes[last]))[:n]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words: each member of a set turns one bit over. Two sets' sketches differ in at most as many bits as there are
    members that only one of them has, and those are a ninth of both sizes at most where the sets are alike."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of sizes a and b with so many common members have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def repeats(sets: list[np.ndarray]) -> list[bool]:
    """For each set in order: whether it is alike to an earlier one that itself is no repeat."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    starts, first, gone = np.concatenate(([0], ends[:-1])), np.concatenate(([0], np.cumsum(sizes))), np.zeros(n, bool)
    for i in range(n):
        if not gone[i]:
            held = codes[first[i] : first[i + 1]]
            common = np.zeros(n, np.int64)
            for k in range(0, len(held), 256):
                some = held[k : k + 256]
                common += np.bincount(np.concatenate([owner[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]), minlength=n)
            gone[i + 1 :] |= alike(common, sizes[i], sizes)[i + 1 :]
    return gone.tolist()


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, n, sketch, buckets, rows) of each doc_id; of several texts the one that stays counts, which mark tells."""
    ship(docs.sparkSession)

    def run(batches):
        import xxhash

        for b in slices(batches, "text", SLICE):
            sets = [shingles(t) for t in raw_texts(column(b, "text"))]
            keys, found = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [buckets(s) for s in sets]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), column(b, "mark"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(sketch, sets)), pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "n", "sketch", "buckets"])

    each = pick(docs, "doc_id", "text").where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    each = each.mapInArrow(run, "doc_id long, mark long, key binary, n long, sketch array<long>, buckets array<long>")
    return each.groupBy("doc_id").agg(F.min(F.struct("mark", "key", "n", "sketch", "buckets")).alias("x"), F.count("*").alias("rows")).select("doc_id", "x.*", "rows")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of each of nodes(id, mark, ...). Of the other texts few are shuffled."""
    some = sift(pick(docs, "doc_id", "text"), "doc_id", nodes.select("id"))[0].withColumn("_mark", F.xxhash64("text"))
    return some.join(nodes, (some["doc_id"] == nodes["id"]) & (some["_mark"] == nodes["mark"])).drop("doc_id", "_mark", "mark")


def _decided(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): the repeats among nodes(id, mark, component), each component in order of id."""

    def run(batches):
        def close():
            return [i for i, again in zip(ids, repeats(sets)) if again] if len(ids) > 1 else []

        at, ids, sets = None, [], []
        for b in slices(batches, "text", SLICE):
            gone = []
            for c, i, t in zip(column(b, "component").to_pylist(), column(b, "id").to_pylist(), raw_texts(column(b, "text")), strict=True):
                if c != at:
                    gone += close()
                    at, ids, sets = c, [], []
                if not ids or ids[-1] != i:  # equal rows of one doc_id
                    ids.append(i)
                    sets.append(shingles(t))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["id"])
        yield pa.RecordBatch.from_arrays([pa.array(close(), pa.int64())], ["id"])

    dealt = _texts(docs, nodes).select("component", "id", "text").repartition("component").sortWithinPartitions("component", "id")
    return dealt.mapInArrow(run, "id long")


def _compared(docs: DataFrame, pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs(id, least) that are alike; the texts meet row by row, so no group is gathered."""

    def run(batches):
        for b in slices(batches, "text", SLICE):
            both = zip(map(shingles, raw_texts(column(b, "text"))), map(shingles, raw_texts(column(b, "other"))))
            ok = [bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in both]
            yield pa.RecordBatch.from_arrays([column(b, x).filter(pa.array(ok, pa.bool_())) for x in ("id", "least")], ["id", "least"])

    one = _texts(docs, pairs.join(marks, "id")).select("id", "least", "text")
    heads = pairs.select(F.col("least").alias("id")).distinct().join(marks, "id")
    other = _texts(docs, heads).select(F.col("id").alias("least"), F.col("text").alias("other")).dropDuplicates(["least"])
    return one.join(other, "least").select("id", "least", "text", "other").mapInArrow(run, "id long, least long").distinct()


def _often(docs: DataFrame) -> np.ndarray:
    """The shingles, sorted, that OFTEN or more of about SAMPLE documents have."""

    def run(batches):
        for b in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in raw_texts(column(b, "text"))]).view(np.int64))], ["hash"])

    some = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(max(1, docs.count()))) < SAMPLE).select("text")
    counted = some.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(counted.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))


def _doubtful(docs: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """(id, least): the pairs of docs (each doc_id once) that share a key of least_part(), without those whose sizes and
    places of it rule out a similarity of 0.8. No pair alike is missing. A key with many rows is split like any join's.
    With back(id), all pairs that one of these is in, and others only if they share a key with one."""
    docs = pick(docs, "doc_id", "text").where("doc_id is not null")
    often = _often(docs)

    def run(batches):
        for b in slices(batches, "text", SLICE):
            sets = [shingles(t) for t in raw_texts(column(b, "text"))]
            keys = [least_part(s, often) for s in sets]
            many = np.array([len(k) for k in keys], np.int64)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ids, n = column(b, "doc_id").cast(pa.int64()).to_numpy(), np.array([len(s) for s in sets], np.int64)
            # a set that meets another by a key has so many members left for both at most
            arrays = [np.concatenate(keys).view(np.int64), np.repeat(ids, many), np.repeat(n, many).astype(np.int32), (np.repeat(n, many) - at).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["key", "id", "n", "left"])

    rows = docs.mapInArrow(run, "key long, id long, n int, left int")
    if back is not None:
        keys = docs.join(back, docs["doc_id"] == back["id"], "left_semi").mapInArrow(run, "key long, id long, n int, left int")
        rows = rows.join(materialise(docs.sparkSession, keys.select("key").distinct(), "keys-back"), "key", "left_semi")
    one, other = rows.alias("one"), rows.alias("other").hint("merge")
    may = F.expr("one.key = other.key and other.id < one.id and 9L * least(one.left, other.left) >= 4L * (one.n + other.n)")
    return one.join(other, may).select(F.col("one.id").alias("id"), F.col("other.id").alias("least")).distinct()


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs(id, least) whose sketches(id, n, sketch) don't rule out that they are alike, so few texts meet."""
    other = sketches.select(F.col("id").alias("least"), F.col("n").alias("m"), F.col("sketch").alias("against"))
    apart = F.expr("aggregate(zip_with(sketch, against, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs.join(sketches, "id").join(other, "least").where(9 * apart <= F.col("n") + F.col("m")).select("id", "least")


def _alike_to_less(spark: SparkSession, docs: DataFrame, live: DataFrame, marks: DataFrame, task_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(id): of marks(id, mark, n), those that are alike to a smaller one that stays and is a candidate by live(id, bucket);
    and (id, component) of all that have a candidate. Components are decided each for itself."""
    gone, groups = [marks.where("false").select("id")], None
    while True:
        ends = live.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket", "least")
        live = materialise(spark, live.join(ends, "bucket"), "candidates")
        if live.isEmpty():
            break
        found = components(spark, live.select(F.col("id").alias("u"), F.col("least").alias("v")))
        nodes = materialise(spark, found.withColumnRenamed("node", "id").join(marks, "id"), "candidate-groups")
        groups = nodes.select("id", "component") if groups is None else groups
        large = nodes.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > task_shingles).select("component")
        gone.append(materialise(spark, _decided(docs, nodes.join(large, "component", "left_anti")), "similar"))
        live = live.join(nodes.join(large, "component", "left_semi").select("id"), "id", "left_semi")
        if live.isEmpty():
            break
        waiting = live.where("id > least").select("id").distinct()
        heads = live.where("id = least").select("id").distinct().join(waiting, "id", "left_anti")
        heads = materialise(spark, heads, "leaders")
        pairs = live.where("id > least").join(heads.withColumnRenamed("id", "least"), "least", "left_semi").select("id", "least").distinct()
        gone.append(materialise(spark, _compared(docs, materialise(spark, pairs, "pairs"), marks.select("id", "mark")).select("id").distinct(), "similar"))
        live = live.join(heads.unionByName(gone[-1]), "id", "left_anti").select("id", "bucket")
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out, marks.where("false").select("id", F.col("id").alias("component")) if groups is None else groups


def drop_similar(spark: SparkSession, docs: DataFrame, task_shingles: int = TASK_SHINGLES, linked: DataFrame | None = None) -> DataFrame:
    """The documents without those whose five-word shingles have a Jaccard similarity of 0.8 or more to those of a document
    of smaller doc_id that stays; the columns stay as they are.

    Sets that are equal need no candidates. Others are candidates where they share one of BANDS buckets, or a component of
    linked(doc_id, component_id), as another method finds them. As buckets miss a pair now and then, what stays is joined
    by parts of its sets that no pair alike can do without; pairs that are alike become candidates too, and it is decided
    anew where they are. Where no pair of documents that stay is alike, nothing was missed that changes which do. A connected
    component of candidates is decided by one task, in order of doc_id, from the texts. Of a component too large for that,
    documents that are the least of all their buckets stay, those alike to them go, and the rest is taken anew: each
    round settles the least document at least, and only rows of a document and its bucket are held. Texts without words
    are copies of each other. Rows of one doc_id count as copies, of which one stays. Rows without a doc_id stay.
    """
    each = materialise(spark, _signatures(docs), "shingles")
    reps = materialise(spark, each.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "shingle-keys")
    marked = join_hot(each.withColumnRenamed("n", "size"), reps, "key", each.count(), "inner").withColumnRenamed("size", "n").withColumn("copy", F.col("least") < F.col("doc_id"))
    marked = materialise(spark, marked.select(F.col("doc_id").alias("id"), "mark", "n", "copy", *[F.when(~F.col("copy"), F.col(x)).alias(x) for x in ("sketch", "buckets")]), "shingle-sets")
    copies = marked.where("copy").select("id")
    marks = marked.where("not copy").select("id", "mark", "n")
    live = marked.where("not copy").select("id", F.explode("buckets").alias("bucket"))
    if linked is not None:  # a component is one more bucket
        groups = linked.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64(F.lit("linked"), "component_id").alias("bucket")).distinct()
        live = live.unionByName(groups.join(marks.select("id"), "id", "left_semi"))
    again, back = each.where("rows > 1").select(F.col("doc_id").alias("id")), None
    gone, groups = _alike_to_less(spark, docs, live, marks, task_shingles)
    while True:
        kept = without(docs, copies.unionByName(gone), again)
        doubtful = _near(_doubtful(kept, back), marked.where("not copy").select("id", "n", "sketch"))
        missed = _compared(docs, materialise(spark, doubtful, "doubtful"), marks.select("id", "mark"))
        missed = materialise(spark, missed, "missed")
        if missed.isEmpty():
            return kept
        # only the components that these pairs are in are decided anew
        ends = missed.select(F.explode(F.array("id", "least")).alias("id")).distinct()
        near = groups.join(groups.join(ends, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id")
        near = materialise(spark, near.unionByName(ends).distinct(), "missed-groups")
        bucket = F.xxhash64(F.lit("missed"), "id", "least").alias("bucket")  # of two
        live = live.unionByName(missed.select("id", bucket)).unionByName(missed.select(F.col("least").alias("id"), bucket))
        before, (now, joined) = gone.join(near, "id", "left_semi"), _alike_to_less(spark, docs, live.join(near, "id", "left_semi"), marks, task_shingles)
        gone = materialise(spark, gone.join(near, "id", "left_anti").unionByName(now), "similar")
        groups = materialise(spark, groups.join(near, "id", "left_anti").unionByName(joined), "candidate-groups")
        back = materialise(spark, before.join(gone, "id", "left_anti"), "back")
        if back.isEmpty():  # none that was not held against the others
            return without(docs, copies.unionByName(gone), again)
