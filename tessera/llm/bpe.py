"""Byte-level BPE: a minimal perfect hash for pre-tokens that are tokens; the others merge many at a time by arrays, long ones by a
heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkEncoder
from .common import column, pick, ship, slices, str_texts, table
from .mph import PerfectHash

CHUNKS_KEPT = 400_000
SHORT = 48  # bytes of a pre-token that merges together with others
TOGETHER = 8192  # pre-tokens that merge together: some 100,000 bytes, whose arrays stay in the processor's cache
BLOCK = 1 << 17  # bytes of ids that are decoded together
NONE = 1 << 30  # in place of the rank of a pair that has none
_CODECS: dict[tuple, ByteBpe] = {}


class PairTable:
    """Ranks of pairs, by open addressing; looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several keys for one place the last gets it
            got = self.keys[at] == keys[left]
            self.ranks[at[got]] = ranks[left[got]]
            at, left = (at[~got] + 1) & (len(self.keys) - 1), left[~got]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, NONE where it has none."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit, on = held == keys[left], held >= 0
            out[left[hit]] = self.ranks[at[hit]]
            on &= ~hit
            at, left = at[on], left[on]
        return out


class ByteBpe:
    """Encodes and decodes by a table of ranks, as lines of base64 token and rank, and a pattern that cuts out pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.size = np.fromiter(map(len, self.token), np.int32, len(self.token))
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.find = regex.compile(pattern).findall
        # first tier: perfect hash of the tokens' hashes; at each number the rank, whose token is compared
        tokens = list(self.rank)
        keys = self._hash(tokens)
        self.mph = PerfectHash.build(keys)
        self.at = np.zeros(len(tokens), np.int64)
        self.at[self.mph.lookup(keys)] = [self.rank[t] for t in tokens]
        # second tier
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        rank = self.rank
        self.pair = {rank[t[:i]] << 20 | rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.bytes = np.array(self.byte, np.int64)
        self.pairs = PairTable(np.fromiter(self.pair, np.int64, len(self.pair)), np.fromiter(self.pair.values(), np.int64, len(self.pair)))
        self.encoder = ChunkEncoder(self.chunks, most=CHUNKS_KEPT)

    @staticmethod
    def _hash(tokens: list[bytes]) -> np.ndarray:
        import xxhash

        return np.array(list(map(xxhash.xxh64_intdigest, tokens)), np.uint64)

    def merge(self, raw: bytes) -> list[int]:
        """Ranks of a pre-token: of its neighbouring parts the pair of least rank merges first, the leftmost among equals.

        Parts are linked to the next and the one before; the heap holds rank and place of each pair, and what no longer
        holds at its place is skipped, so n bytes take O(n log n) steps.
        """
        n, pair = len(raw), self.pair.get
        ids = [self.byte[c] for c in raw]
        now = [pair(a << 20 | b) for a, b in zip(ids, ids[1:])]  # the rank of the pair that begins at each place
        heap = [r << 32 | i for i, r in enumerate(now) if r is not None]
        if not heap:
            return ids
        heapify(heap)
        now.append(None)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            if now[i] != r:
                continue
            j = nxt[i]
            k = nxt[i] = nxt[j]
            ids[i], ids[j], now[j] = r, None, None
            if k < n:
                prev[k] = i
                now[i] = s = pair(r << 20 | ids[k])
                if s is not None:
                    heappush(heap, s << 32 | i)
            else:
                now[i] = None
            p = prev[i]
            if p >= 0:
                now[p] = s = pair(ids[p] << 20 | r)
                if s is not None:
                    heappush(heap, s << 32 | p)
        return [x for x in ids if x is not None]

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, each as merge() has it.

        A round merges in every pre-token the pair that merge() would, all at once by arrays of the parts left; pre-tokens without
        a pair leave. So there are as many rounds as the longest has merges, and the arrays shrink from round to round.
        """
        if not tokens:
            return []
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        of = np.repeat(np.arange(len(tokens)), size)
        ids = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        rank = np.full(len(ids), NONE, np.int64)  # of the pair that begins at each part
        pairs = np.flatnonzero(of[:-1] == of[1:])
        rank[pairs] = self.pairs.lookup(ids[pairs] << 20 | ids[pairs + 1])
        done = []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            merges = least < NONE << 32
            at = least[merges] & 0xFFFFFFFF
            stays = np.repeat(merges, np.diff(first, append=len(ids)))
            if len(at) < len(first):
                done.append((of[~stays], ids[~stays]))
            ids[at] = rank[at]
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            of, ids, rank = of[stays], ids[stays], rank[stays]
            # the pairs with the part after and the part before are new
            rank[at] = NONE
            left = np.concatenate((at[:-1], at[-1:][at[-1:] + 1 < len(ids)]))
            left = left[of[left] == of[left + 1]]
            before = at[at > 0] - 1
            before = before[of[before] == of[before + 1]]
            changed = np.concatenate((left, before))
            rank[changed] = self.pairs.lookup(ids[changed] << 20 | ids[changed + 1])
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        ids = ids[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(of, minlength=len(tokens))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merged(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: short ones merge together, long ones each for itself."""
        out = []
        for at in range(0, len(tokens), TOGETHER):
            some = tokens[at : at + TOGETHER]
            short = iter(self.merge_many([t for t in some if len(t) <= SHORT]))
            out += [next(short) if len(t) <= SHORT else array("I", self.merge(t)).tobytes() for t in some]
        return out

    def pretokens(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of distinct pre-tokens."""
        if not tokens:
            return []
        at = self.mph.lookup(self._hash(tokens))
        ids = self.at[at].tolist()
        packed, table = self.packed, self.token
        out = [packed(i) if k >= 0 and table[i] == t else None for t, i, k in zip(tokens, ids, at.tolist(), strict=True)]
        merged = iter(self.merged([t for t, x in zip(tokens, out) if x is None]))
        return [next(merged) if x is None else x for x in out]

    @staticmethod
    def packed(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def chunks(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.find, chunks))
        distinct = list({t for x in found for t in x})
        known = dict(zip(distinct, self.pretokens([t.encode() for t in distinct]), strict=True))
        return [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return self.encoder.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids, some thousand at a time."""
        return b"".join(map(self._decoded, (packed[at : at + BLOCK] for at in range(0, len(packed), BLOCK))))

    def _decoded(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        size = self.size[ids]
        place = np.repeat(self.start[ids] - np.cumsum(size, dtype=np.int32) + size, size)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place].tobytes()


def codec(ranks: bytes, pattern: str) -> ByteBpe:
    """One for each worker process and table."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document; without `ids`, digests only.

    Null and empty texts have no ids. Whole texts of any length are encoded, a row for each that comes in. The rank file
    (a vocabulary, of a size that doesn't grow with the data) is read by the driver and sent to the executors once.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = codec(ranks.value, pattern)
        for b in slices(batches, "text", 2 << 20):
            packed = bpe.encode(str_texts(column(b, "text")))
            cols = [column(b, "doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in packed], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if ids:
                offsets = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                names.append("ids")
            cols += [pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in packed])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string")


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *default_ranks(), ids=False)


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
