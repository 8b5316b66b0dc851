"""Token ids in wavelet-matrix shards: one compressed file gives access, counting and occurrence lookup."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import column, filesystem, materialise, pick, scratch, ship, slices, str_texts, table, write_file

MAGIC = b"WVLT0001"
BLOCK = 1 << 18  # bits of a compressed block
SHARD_TOKENS = 1_000_000  # a shard closes with the document that reaches them
TOGETHER = 64  # chunks encoded as one text
_TOKENIZERS: dict[str, ChunkEncoder | WholeEncoder] = {}


def build_shard(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> list[bytes]:
    """The parts of a shard file: magic, length of the header, header, compressed directory and blocks.

    Plane k holds bit k, from the highest, of the ids in the order that the planes before left them in: stably, those with
    a 0 first. Each block of a plane is compressed for itself, and the header has its place and the ones before it.
    """
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    body, at, planes = [], 0, []

    def put(raw: bytes) -> list[int]:
        nonlocal at
        body.append(x := press(raw))
        at += len(x)
        return [at - len(x), len(x)]

    ids64 = np.array([0 if i is None else i for i in doc_ids], np.int64)
    directory = {"ids": put(ids64.tobytes()), "null": put(np.array([i is None for i in doc_ids], np.uint8).tobytes()), "counts": put(counts.astype(np.int64).tobytes())}
    for k in range(bits - 1, -1, -1):
        if k == 7:
            now = now.astype(np.uint8)  # the planes left are those of the last byte
        one = now & now.dtype.type(1 << k) != 0
        packed, blocks, ones = np.packbits(one, bitorder="little"), [], 0
        for i in range(0, len(now), BLOCK):
            blocks.append([*put(packed[i // 8 : (i + BLOCK) // 8].tobytes()), ones])
            ones += int(np.count_nonzero(one[i : i + BLOCK]))
        planes.append({"zeros": len(now) - ones, "blocks": blocks})
        now = np.concatenate((now.compress(~one), now.compress(one)))
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "bits": bits, "block": BLOCK, "directory": directory, "planes": planes}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *body]


class WaveletFile:
    """A shard, read by ranges: only the blocks that an answer needs are fetched and unpacked."""

    def __init__(self, uri: str, blocks_kept: int = 256):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        start = self.file.read_at(16, 0)
        if start[:8] != MAGIC:
            raise ValueError(f"{uri} is no wavelet-matrix file")
        n = int.from_bytes(start[8:16], "little")
        self.head = json.loads(self.file.read_at(n, 16))
        self.base, self.kept, self.most = 16 + n, {}, blocks_kept
        self.tokens, self.bits = self.head["tokens"], self.head["bits"]

    def _get(self, at: int, size: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.file.read_at(size, self.base + at))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        d = {k: self._get(*v) for k, v in self.head["directory"].items()}
        null = np.frombuffer(d["null"], np.uint8)
        return [None if z else i for i, z in zip(np.frombuffer(d["ids"], np.int64).tolist(), null.tolist(), strict=True)], np.frombuffer(d["counts"], np.int64)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, int]:
        if (plane, block) not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            at, size, ones = self.head["planes"][plane]["blocks"][block]
            bits = np.unpackbits(np.frombuffer(self._get(at, size), np.uint8), bitorder="little")
            self.kept[plane, block] = np.concatenate(([0], np.cumsum(bits, dtype=np.int32))), ones
        return self.kept[plane, block]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.tokens:
            return self.tokens - self.head["planes"][plane]["zeros"]
        sums, ones = self._block(plane, i // BLOCK)
        return ones + int(sums[i % BLOCK])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            before = self._ones(k, i)
            bit = self._ones(k, i + 1) - before
            value = value << 1 | bit
            i = self.head["planes"][k]["zeros"] + before if bit else i - before
        return value

    def rank(self, value: int, i: int) -> int:
        """How often an id stands before place i."""
        return self._range(value, i)[1]

    def count(self, value: int) -> int:
        return self.rank(value, self.tokens)

    def _range(self, value: int, end: int) -> tuple[int, int]:
        a, b = 0, min(end, self.tokens)
        if value >> self.bits or value < 0:
            return 0, 0
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            zeros = self.head["planes"][k]["zeros"]
            a, b = (zeros + x, zeros + y) if value >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b - a

    def select(self, value: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of an id."""
        start, n = self._range(value, self.tokens)
        if not 0 <= nth < n:
            raise IndexError(nth)
        i = start + nth
        for k in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - k) & 1
            want, low, high = (i - self.head["planes"][k]["zeros"] if one else i), 0, self.tokens
            while high - low > 1:  # the last place with `want` such bits before it
                mid = (low + high) // 2
                ones = self._ones(k, mid)
                if (ones if one else mid - ones) <= want:
                    low = mid
                else:
                    high = mid
            i = low
        return i

    def all(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        n = self.tokens
        now = np.zeros(n, np.uint8)
        for k in range(self.bits - 1, -1, -1):
            if k == self.bits - 9:
                now = now.astype(np.uint16 if self.bits <= 16 else np.uint32)
            plane = self.head["planes"][k]
            blocks = [np.frombuffer(self._get(at, size), np.uint8) for at, size, _ in plane["blocks"]]
            one = np.unpackbits(np.concatenate(blocks), count=n, bitorder="little").view(bool) if n else np.zeros(0, bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~one)] = now[: plane["zeros"]]
            before[np.flatnonzero(one)] = now[plane["zeros"] :] | now.dtype.type(1 << (self.bits - 1 - k))
            now = before
        return now

    def close(self):
        self.file.close()


class WholeEncoder:
    """Encodes each text as a whole, for tokenizers that can't be relied on to cut before a space."""

    def __init__(self, whole: Callable[[list[str]], list[bytes]], kind: str):
        self.encode, self.kind = whole, np.dtype(kind)


def cuts_at_spaces(file: dict) -> bool:
    """Whether a tokenizers file is plain byte-level BPE, where each word is encoded for itself with the space before it."""
    pre, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    own = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
    return bool(level and own and file.get("normalizer") is None and file["model"]["type"] == "BPE")


def tokenizer(path: str) -> ChunkEncoder | WholeEncoder:
    """Encodes by a tokenizers file as the library does by default, so a special token written out in a text gets its id; one
    for each worker process. Chunks are cut where a byte-level pre-tokenizer cuts; of any other file whole texts are encoded."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        kind, code = ("<u2", "H") if t.get_vocab_size() <= 1 << 16 else ("<u4", "I")

        spaced = np.zeros(t.get_vocab_size(), bool)
        spaced[[i for x, i in t.get_vocab().items() if x.startswith("\u0120")]] = True  # how byte-level BPE writes a space

        def whole(texts: list[str]) -> list[bytes]:
            return [array(code, x.ids).tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]

        def resolve(chunks: list[str]) -> list[bytes]:
            # chunks of a space and a word are encoded many at a time: each begins with the only token that begins with a space
            plain = [x[:1] == " " and x.rfind(" ") == 0 and not x[-1:].isspace() for x in chunks]
            words = [x for x, ok in zip(chunks, plain) if ok]
            lines = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
            ids = array(code)
            for x in t.encode_batch_fast(lines, add_special_tokens=False):
                ids.extend(x.ids)
            flat = np.frombuffer(ids, kind)
            cuts = [*(np.flatnonzero(spaced[flat]) * flat.itemsize).tolist(), flat.nbytes]
            if len(cuts) != len(words) + 1:
                raise ValueError(f"{path}: a tokenizer that doesn't begin a token with each space before a word")
            raw = flat.tobytes()
            several = map(raw.__getitem__, map(slice, cuts, cuts[1:]))
            rest = iter(whole([x for x, ok in zip(chunks, plain) if not ok]))
            return [next(several) if ok else next(rest) for ok in plain]

        file = json.loads(t.to_str())
        apart = tuple(x["content"] for x in file.get("added_tokens") or [])
        _TOKENIZERS[path] = ChunkEncoder(resolve, kind, apart=apart) if cuts_at_spaces(file) else WholeEncoder(whole, kind)
    return _TOKENIZERS[path]


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes documents and writes shards of ids in ascending doc_id order; (part, shard, path, first, tokens) of each.

    Rows without an id come first, rows of one id stand by their text. The documents are dealt by ranges of doc_id; each
    range writes its own shards, whole or not at all, under names that a repeated task takes again. A null text is an empty
    one, which has the end id only; repeated rows are documents of their own; other columns are not looked at; an empty
    table makes no shard.
    """
    ship(spark)
    at = scratch(spark, "wavelet")

    def run(batches):
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        encoder = tokenizer(tokenizer_path)
        held, ids, size = [], [], 0

        def flush():
            nonlocal shard, first, held, ids, size
            path = f"{at}/{part:06d}-{shard:06d}.wvlt"
            write_file(path, build_shard(np.frombuffer(b"".join(held), encoder.kind), ids, np.array([len(x) for x in held], np.int64) // encoder.kind.itemsize))
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, path, first, size)], ["part", "shard", "path", "first", "tokens"])
            shard, first, held, ids, size = shard + 1, first + size, [], [], 0
            return row

        end = np.array([end_id], encoder.kind).tobytes()
        for b in slices(batches, "text", 16 << 20):
            for i, x in zip(column(b, "doc_id").to_pylist(), encoder.encode(str_texts(column(b, "text"))), strict=True):
                held.append(x + end)
                ids.append(i)
                size += len(held[-1]) // len(end)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    dealt = pick(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(spark, dealt.mapInArrow(run, "part long, shard long, path string, first long, tokens long"), "wavelet-shards")


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the shard files alone; start counts all ids before it."""
    # one row for each range of doc_id, not for each document
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("tokens")).collect())
    offsets = dict(zip([p for p, _ in totals], accumulate([0, *[n for _, n in totals]]), strict=False))

    def run(batches):
        for b in batches:
            for part, path, first in zip(*[column(b, x).to_pylist() for x in ("part", "path", "first")], strict=True):
                f = WaveletFile(path)
                ids, counts = f.documents()
                raw = memoryview(f.all().astype("<u4").tobytes())
                f.close()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends - counts + first + offsets[part]), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of partitions of its own: the rows are few and small, and would be put together into one
    tasks = max(1, min(-(-shards.count() // 4), 4096))
    return shards.select("part", "path", "first").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(spark, write_shards(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op2_wavelet": op2_wavelet}
ORACLES: dict[str, str] = {}
