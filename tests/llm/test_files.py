import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from tessera.llm import common, warc, wavelet

from .conftest import ODD


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())  # as it comes: special tokens in texts are special


# ---- wavelet matrix ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (7, 2), (1000, 50_000), (3000, 70_000), (600_000, 9)])
def test_a_shard_answers_from_its_file(tmp_path, n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    path = f"file://{tmp_path}/x.wvlt"
    common.write_file(path, wavelet.build_shard(ids, [3, None], np.array([n, 0])))
    f = wavelet.WaveletFile(path, blocks_kept=3)
    assert f.all().tolist() == ids.tolist() and f.documents()[0] == [3, None] and f.documents()[1].tolist() == [n, 0]
    rng = random.Random(1)
    for _ in range(20 if n else 0):
        i = rng.randrange(n)
        v = int(ids[i])
        at = np.flatnonzero(ids == v)
        assert f.access(i) == v and f.count(v) == len(at) and f.rank(v, i) == int((ids[:i] == v).sum())
        k = rng.randrange(len(at))
        assert f.select(v, k) == at[k]
    assert f.count(top + 5) == 0 and f.count(1 << 40) == 0
    for bad in (-1, n):
        with pytest.raises(IndexError):
            f.access(bad)
    with pytest.raises(IndexError):
        f.select(0, n + 1)
    common.write_file(path, [b"something else, long enough"])
    with pytest.raises(ValueError):
        wavelet.WaveletFile(path)


@pytest.mark.parametrize("shard_tokens", [40, 1_000_000])
def test_documents_come_back_from_shards(spark, clashing, library, shard_tokens):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    more = spark.createDataFrame([(1000 - i, " ".join(rng.choice(["alpha", "beta,", "the", "<|endoftext|>", "Ünï"]) for _ in range(i % 30))) for i in range(300)], "doc_id long, text string")
    docs = clashing.select("doc_id", "text").unionByName(more).withColumn("shard", F.lit(1))
    got = [tuple(r) for r in wavelet.read_shards(spark, wavelet.write_shards(spark, docs, tokenizer_path(), shard_tokens=shard_tokens)).collect()]
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ids_are_those_of_the_plain_call(library):
    rng = random.Random(12)
    parts = ["a", "word", " ", " ", "\n", "<|endoftext|>", "<|endof", "text|>", "é", "1", ".", ",", "'s", "\t", " 日本", "\xa0", "x,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert sum("<|endoftext|>" in t for t in texts) > 500
    encoder = wavelet.tokenizer(tokenizer_path())
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, texts = wavelet.tokenizer(path), ["Some words, and more  <|endoftext|> of it", "", "Ünï x"]
    assert isinstance(encoder, wavelet.WholeEncoder)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_no_documents(spark, empty_docs):
    assert wavelet.read_shards(spark, wavelet.write_shards(spark, empty_docs, tokenizer_path())).collect() == []


# ---- WARC in ZIP ------------------------------------------------------------------------------------------------------


def zip64(members):
    """A ZIP file whose sizes, offsets and counts are all in ZIP64 fields."""
    out, central = io.BytesIO(), []
    for name, body in members:
        at, n = out.tell(), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body))
        out.write(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra)) + n + extra + body)
        wide = struct.pack("<HHHHQQQ", 0x9999, 0, 1, 24, len(body), len(body), at)
        central.append(b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + n + wide)
    at = out.tell()
    out.write(b"".join(central))
    end = out.tell()
    out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), end - at, at))
    out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"abc")
    return out.getvalue()


def records():
    return [warc.record(1, "http://a/ü x\r\n", b"<p>one</p>", None), warc.record(2, None, b"<p>one</p>", 1), warc.record(None, "u", b"", None)]


def test_packages_with_and_without_zip64(tmp_path):
    rs = records()
    index = "\n".join(f"{sum(map(len, rs[:i]))} {len(r)}" for i, r in enumerate(rs)).encode()
    plain = warc.package(rs)
    assert zipfile.ZipFile(io.BytesIO(plain)).testzip() is None
    for raw in (plain, zip64([("archive/data.warc.gz", b"".join(rs)), ("indexes/index.txt", index)])):
        common.write_file(f"file://{tmp_path}/a.zip", [raw])
        z = warc.ZipPackage(f"file://{tmp_path}/a.zip")
        got = list(z.records())
        assert [h["warc-type"] for h, _ in got] == ["response", "revisit", "response"]
        assert got[0][1].endswith(b"\r\n\r\n<p>one</p>") and got[1][0]["warc-refers-to"] == "<urn:page:1>" and got[1][1].endswith(b"\r\n\r\n")
        assert z.read("archive/data.warc.gz", len(rs[0]), len(rs[1])) == rs[1]
        with pytest.raises(ValueError):
            z.read("archive/data.warc.gz", 0, 10**6)
        z.close()


def test_broken_packages(tmp_path):
    compressed = io.BytesIO()
    with zipfile.ZipFile(compressed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("indexes/index.txt", "0 1" * 100)
    for raw in (b"no zip" * 10, compressed.getvalue()):
        common.write_file(f"file://{tmp_path}/b.zip", [raw])
        with pytest.raises(ValueError):
            list(warc.ZipPackage(f"file://{tmp_path}/b.zip").records())
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(records()[0])[:-1])


def brute_pages(rows, least):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        last = max(same, default=None) if len(body) >= least else None
        to = last if last is not None and i != last else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_pages_come_back(spark, least):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "<p>other</p>"), (5, "u", "<p>other</p>"), (None, "u", "<p>é</p>"), (None, "u", "<p>alone</p>"), (None, "v", "<p>alone</p>"), (9, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, k string")
    got = [tuple(r) for r in warc.read_packages(warc.write_packages(spark, pages, least, package_bytes=2000)).collect()]
    assert sorted(got, key=str) == brute_pages(rows, least)
    assert warc.read_packages(warc.write_packages(spark, pages.where("false"))).collect() == []
