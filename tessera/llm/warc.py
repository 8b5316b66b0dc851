"""WARC records in ZIP packages: stored archive members and an index, read by ranges without extraction.

As is usual for WARC, each record is a gzip member of its own, so a record is one range of the stored archive member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import zipfile
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, filesystem, join_hot, materialise, pick, raw_texts, scratch, ship, slices, table, write_file

PACKAGE_BYTES = 32 << 20  # of records, from which a package closes
READ_BYTES = 4 << 20  # neighbouring records are fetched together up to this
PAGE = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, as a gzip member: a response with the payload, or a revisit with its HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = page if page is not None else f"none-{hashlib.sha1((url or '').encode() + payload).hexdigest()}"  # rows without an id are told apart
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{own}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def package(records: list[bytes]) -> bytes:
    """A ZIP file with one stored archive member and one stored index member (offset and length of each record)."""
    index, at = [], 0
    for r in records:
        index.append(f"{at} {len(r)}")
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, body in (("archive/data.warc.gz", b"".join(records)), ("indexes/index.txt", "\n".join(index).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


class ZipPackage:
    """Locates members of a ZIP file and reads ranges of stored ones."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.members = {name: rest for name, *rest in self._directory()}

    def _directory(self):
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.file.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no ZIP file")
        count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            locator = self.file.read_at(20, tail_at + end - 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            wide = self.file.read_at(56, int.from_bytes(locator[8:16], "little"))
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 directory end is missing")
            count, size, at = struct.unpack("<QQQ", wide[32:56])
        raw, i = self.file.read_at(size, at), 0
        for _ in range(count):
            if raw[i : i + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            flags, method = struct.unpack("<HH", raw[i + 8 : i + 12])
            packed, plain, n, m, k = struct.unpack("<IIHHH", raw[i + 20 : i + 34])
            offset = int.from_bytes(raw[i + 42 : i + 46], "little")
            name = raw[i + 46 : i + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, j = raw[i + 46 + n : i + 46 + n + m], 0
            while j + 4 <= len(extra):
                tag, length = struct.unpack("<HH", extra[j : j + 4])
                if tag == 1:  # the wide fields, in this order, of those that are full below
                    wide = [int.from_bytes(extra[x : x + 8], "little") for x in range(j + 4, j + 4 + length - 7, 8)]
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                j += 4 + length
            yield name, method, offset, packed
            i += 46 + n + m + k

    def data_at(self, name: str) -> tuple[int, int]:
        """(place, length) of a stored member's bytes."""
        method, offset, packed = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        local = self.file.read_at(30, offset)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a member's header is broken")
        n, m = struct.unpack("<HH", local[26:30])
        return offset + 30 + n + m, packed

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        at, length = self.data_at(name)
        size = length - start if size is None else size
        if start < 0 or start + size > length:
            raise ValueError("a range beyond the member")
        return self.file.read_at(size, at + start)

    def records(self):
        """(headers, block) of each record that the index lists, neighbouring ones fetched together."""
        index = [tuple(map(int, x.split())) for x in self.read("indexes/index.txt").decode().splitlines()]
        i = 0
        while i < len(index):
            j, start = i, index[i][0]
            while j < len(index) and (j == i or index[j][0] + index[j][1] - start <= READ_BYTES):
                j += 1
            raw = self.read("archive/data.warc.gz", start, index[j - 1][0] + index[j - 1][1] - start)
            for at, size in index[i:j]:
                yield parse(gzip.decompress(raw[at - start : at - start + size]))
            i = j

    def close(self):
        self.file.close()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return fields, rest[:size]


def write_packages(spark: SparkSession, pages: DataFrame, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each page to ZIP packages in the shared folder; (path, records).

    Of pages with equal payloads of at least `least` bytes, those with the largest page_id get a response, the others a
    revisit of it; smaller payloads all get responses. A null html is an empty payload, a null url an empty one. Rows
    without a page_id revisit like others; where no row of an equal payload has one, all get responses.
    """
    ship(spark)
    at = scratch(spark, "warc")
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    key = F.sha2(F.col("html").cast("binary"), 256)
    # only digests are grouped, with partial maxima
    found = rows.where(F.octet_length("html") >= least).groupBy(key.alias("k")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    found = materialise(spark, found, "payloads")
    total = int(found.agg(F.sum("n")).first()[0] or 0)
    both = join_hot(rows.withColumn("k", key), found.where("n > 1 and last is not null"), "k", total)
    joined = both.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last")).alias("refers_to"))

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            path = f"{at}/{part:06d}-{k:05d}.zip"
            write_file(path, [package(held)])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for b in slices(batches, "html", 8 << 20):
            for page, url, html, to in zip(column(b, "page_id").to_pylist(), column(b, "url").to_pylist(), raw_texts(column(b, "html")), column(b, "refers_to").to_pylist(), strict=True):
                held.append(record(page, url, html, to))
                size += len(held[-1])
                if size >= package_bytes:
                    yield flush()
                    k, held, size = k + 1, [], 0
        if held:
            yield flush()

    return materialise(spark, joined.mapInArrow(run, "path string, records long"), "warc-packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the packages."""

    def page(field: str | None) -> int | None:
        x = (field or "").strip("<>").removeprefix(PAGE)
        return int(x) if x.lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for path in column(b, "path").to_pylist():
                z, rows = ZipPackage(path), []
                for head, block in z.records():
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    named = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != named):
                        raise ValueError(f"{path}: a payload is damaged")
                    rows.append((page(head["warc-record-id"]), size, named, head["warc-type"], page(head.get("warc-refers-to"))))
                z.close()
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ship(packages.sparkSession)
    # a number of partitions of its own: the rows are few and small, and would be put together into one
    tasks = max(1, min(-(-packages.count() // 2), 4096))
    return packages.select("path").repartition(tasks).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(spark, table(spark, sf_dir, "pages")))


_NIBBLES = "('0x' || substr(h || '0', 5 * i // 4 + 1, 2))::INT"
QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html)) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_NIBBLES} >> (3 - 5 * i % 4)) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN last USING (html)"""
}
