"""What the operators share: the shared folder, files in it, shipping this package, reading Arrow batches."""

from __future__ import annotations

import ctypes
import io
import json
import os
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000
SIFT_BITS = 1 << 25  # of a filter of ids: 4 MB
_WRITTEN: dict[str, list[str]] = {}
WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir. Where it is unset, a local session (as in
    tests) gets one of its own; a cluster is an error, since a folder of the driver's machine can't be seen by executors."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which clean() removes."""
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Removes all that the operators of this session have written to the shared folder: shards, packages and tables between
    steps. Results that are still to be computed read them, so write these first."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    path = scratch(spark, what)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialise() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            _remove(df.sparkSession, path)


def join_hot(rows: DataFrame, known: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with known(key, n, ...), which has each key once and how many of the `total` rows have it.

    A key that one row in HOT_SHARE has is hot. There are HOT_SHARE such keys at most, so they are broadcast, and their rows
    stay where they are; the others meet by a shuffle that no key dominates. known should be a table, as it is read thrice.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot, rest = known.where(F.col("n") >= least).drop("n"), known.where(F.col("n") < least).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _places(key: Column, bits: int) -> list[Column]:
    """The two places of a key in a filter of so many bits, a power of two."""
    h = F.xxhash64(F.lit("sift"), key.cast("long"))
    return [F.when(key.isNotNull(), x.bitwiseAND(F.lit(bits - 1))) for x in (h, F.shiftright(h, 32))]


def sift(rows: DataFrame, key: str, ids: DataFrame, most: int = SIFT_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, the rows whose key surely isn't), by a Bloom filter of the one column of ids, longs.

    A null key is among no ids. The filter is broadcast; it has 16 bits an id and `most` bits at most, so with many ids it
    lets more through. A join with ids must follow; it moves the first rows only, not the texts of all."""
    spark, at = rows.sparkSession, ids.columns[0]
    bits = min(most, 1 << max(10, (16 * ids.count()).bit_length()))
    held = ids.select(F.explode(F.array(*_places(F.col(at), bits))).alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    got, words = held.toArrow(), np.zeros(bits // 64, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    name = "_bits" + "_" * max(map(len, rows.columns))
    known = F.broadcast(spark.createDataFrame(pa.table({name: pa.array([words], pa.list_(pa.int64()))})))
    one, two = (F.getbit(F.get(known[name], F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _places(rows[key], bits))
    return rows.join(known, one & two, "left_semi"), rows.join(known, one & two, "left_anti")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session; a cluster needs no other installation of it.

    No setting of the session is changed. A batch is held by Spark and by the worker, so where workers have little memory,
    set spark.sql.execution.arrow.maxBytesPerBatch below Spark's default of 64 MB; the operators take a batch in slices."""
    sc = spark.sparkContext
    top = Path(__file__).resolve().parents[1]
    if getattr(sc, "_tessera_shipped", False) or not top.is_dir():
        return
    at = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._tessera_shipped = True


# ---- files ------------------------------------------------------------------------------------------------------------


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it. file:/x and file:///x both work."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Writes the byte strings to a file that appears whole or not at all; a task that runs again replaces it."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    at, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(at) as out:
        for x in parts:
            out.write(x)
            size += len(x)
    fs.move(at, path)
    return size


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def pack_arrays(head: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A header and named arrays as one byte string."""
    out, listed = io.BytesIO(), []
    for k, a in arrays.items():
        listed.append([k, a.dtype.str, int(a.size)])
    text = json.dumps(head | {"arrays": listed}).encode()
    text += b" " * (-len(text) % 8)
    out.write(b"TSRA" + len(text).to_bytes(4, "little") + text)
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        out.write(raw + b"\0" * (-len(raw) % 8))
    return out.getvalue()


def unpack_arrays(raw: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if raw[:4] != b"TSRA":
        raise ValueError("not an array file")
    n = int.from_bytes(raw[4:8], "little")
    head, at, arrays = json.loads(raw[8 : 8 + n]), 8 + n, {}
    for k, kind, size in head["arrays"]:
        dt = np.dtype(kind)
        arrays[k] = np.frombuffer(raw, dt, size, at)
        at += size * dt.itemsize
        at += -at % 8
    return head, arrays


class ByteCache:
    """Least recently used values up to a number of bytes."""

    every: list[ByteCache] = []

    def __init__(self, most: int):
        self.most, self.used, self.held, self.asked = most, 0, OrderedDict(), False
        self.every.append(self)

    def get(self, key, load):
        self.asked = True
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        value, size = load(key)
        self.held[key] = (value, size)
        self.used += size
        while self.used > self.most and len(self.held) > 1:
            self.used -= self.held.popitem(last=False)[1][1]
        return value


# ---- Arrow ------------------------------------------------------------------------------------------------------------


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def str_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def give_back() -> None:
    """What a worker need not hold when it goes on to tasks of other steps: values of caches that this task did not ask for,
    and memory that is free, which the allocators keep."""
    for cache in ByteCache.every:
        if not cache.asked:
            cache.held.clear()
            cache.used = 0
        cache.asked = False
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a longer row goes alone), which bounds a worker's memory; after
    the last of a task the worker gives back what it can."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array(pc.binary_length(column(b, text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group, start = np.cumsum(sizes) // most, 0
        cuts = np.flatnonzero(np.diff(group)) + 1
        for end in [*cuts.tolist(), b.num_rows]:
            yield b.slice(start, end - start)
            start = end
    give_back()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that others, of whatever name, can't clash."""
    return df.select(*[df[x] for x in names])
