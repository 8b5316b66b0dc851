"""Secret scans: patterns, and candidates that decode to what a private key or a signed token must look like.

Public keys and certificates have the same encodings and are no secrets: only what holds a private part is reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, pick, ship, slices, str_texts, table

#: In the order that spans of one start are listed in; the first three are patterns only.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# runs are maximal, so a least length in the pattern keeps just the matches that are long enough
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A line end inside a key: a real one, or one written out as in JSON and environment files; and what may lead the next line.
BREAK = r"(?:\r?\n[ \t]*|\\r\\n|\\n)"
BREAKS = re.compile(BREAK)
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,30}PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"[A-Za-z0-9-]+: .*")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{BREAK}[A-Za-z0-9+/_-]+)*")
#: Where in a run a key may begin: the first two characters of a DER sequence, or the header of an OpenSSH private key.
STARTS = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
HEX_CODE = re.compile(r"[0-9A-Fa-f]{64,}")
SSH_HEADER = b"openssh-key-v1\0"
KEY_BYTES = 1 << 16  # a private key has no more; those of 16,384 bits take 9 KB
DEPTH = 12


def decoded(text: str) -> bytes | None:
    """Base64, plain or for URLs, padded or not."""
    bare = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of each value from start to end, nested ones after theirs; None if a length doesn't fit."""
    out, at = [], start
    while at < end:
        if at + 2 > end or depth > DEPTH:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or not raw[at] or n == 1 and raw[at] < 0x80:
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        if tag & 0x20:
            inner = der_items(raw, at, at + size, depth + 1)
            if inner is None:
                return None
            out += inner
        at += size
    return out


def der_size(raw: bytes) -> int:
    """How many bytes a sequence takes in all, by its first ones; 0 if it can't be a private key's."""
    if len(raw) < 6 or raw[0] != 0x30:
        return 0
    at, size = 2, raw[1]
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 3:
            return 0
        size, at = int.from_bytes(raw[2 : 2 + n], "big"), 2 + n
    inner = raw[at : at + 3]  # a version or an algorithm comes first
    first = inner[:2] == b"\x02\x01" and inner[2:3] <= b"\x03" or inner[:1] == b"\x30"
    return at + size if first and 24 <= at + size <= KEY_BYTES else 0


def is_private_der(raw: bytes) -> bool:
    """One SEQUENCE over all bytes whose nested lengths fit and which is laid out as a private key: a version and five
    numbers or more (RSA and DSA), a version and an octet string (elliptic curves), a version, an algorithm and an octet string
    (PKCS 8), or an algorithm and an octet string (PKCS 8, encrypted)."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    items = der_items(raw, 0, len(raw))
    if not items or items[0][2] != len(raw):
        return False
    top, at = [], items[0][1]  # what stands directly in the sequence
    for tag, a, b in items[1:]:
        if a > at:
            top.append((tag, b - a, a, b))
            at = b
    tags = [x[0] for x in top]
    version = tags[:1] == [0x02] and top[0][1] == 1 and raw[top[0][2]] <= 3

    def algorithm(i: int) -> bool:
        return any(tag == 0x06 and top[i][2] <= a < top[i][3] for tag, a, _ in items)

    if version and len(tags) >= 6 and set(tags[:6]) == {0x02}:
        return top[1][1] >= 16
    if version and tags[1:2] == [0x04]:
        return top[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    if version and tags[1:3] == [0x30, 0x04]:
        return algorithm(1) and top[2][1] >= 16
    return tags == [0x30, 0x04] and algorithm(0) and top[1][1] >= 32


def is_private_ssh(raw: bytes) -> bool:
    """The header of an OpenSSH private key and, after it, fields whose lengths fit: cipher, key derivation, its options, the
    number of keys, a public key and the private part."""
    if not raw.startswith(SSH_HEADER):
        return False
    at, fields = len(SSH_HEADER), []
    for i in range(6):
        if i == 3:
            at += 4  # the number of keys is no field
            continue
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 > len(raw) or at + 4 + n > len(raw):
            return False
        fields.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return 0 < len(fields[0]) <= 40 and fields[0].isascii() and bool(fields[4])


def is_signed_token(head: str, body: str) -> bool:
    """A header that is a JSON object naming its algorithm, before a body that is a JSON object."""
    try:
        a, b = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(a, dict) and isinstance(a.get("alg"), str) and isinstance(b, dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns, leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pem_keys(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each armoured private key. Its line ends may be written out, and headers may come first; a body
    that these call encrypted can't be parsed, and counts if it decodes to whole blocks of a cipher."""
    out, begins = [], list(PEM_BEGIN.finditer(text))
    for m, after in zip(begins, [*[x.start() for x in begins[1:]], len(text)]):
        end = f"-----END {m[1]}-----"
        b = text.find(end, m.end(), after)
        if b < 0:
            continue
        lines = BREAKS.split(text[m.end() : b])
        headers = [x for x in lines if PEM_HEADER.fullmatch(x)]
        raw = decoded("".join(x for x in lines if not PEM_HEADER.fullmatch(x)))
        locked = any("ENCRYPTED" in x for x in headers)
        if raw and (is_private_der(raw) or is_private_ssh(raw) or locked and len(raw) >= 32 and len(raw) % 8 == 0):
            out.append((m.start(), KINDS.index("pem"), b + len(end)))
    return out


def keys_in(run: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each private key in a run of base64 without line ends; anything may stand before and after."""
    out, at = [], 0
    while m := STARTS.search(run, at):
        i, at = m.start(), m.start() + 1
        if run[i] == "M":
            size = der_size(decoded(run[i : i + 12]) or b"")
            n = -(-size * 4 // 3)  # characters that hold so many bytes
            if not size or i + n > len(run) or not is_private_der((decoded(run[i : i + n]) or b"")[:size]):
                continue
            kind = "der"
        else:
            n, kind = len(run) - i, "ssh"
            if not is_private_ssh(decoded(run[i : i + n // 4 * 4]) or b""):
                continue
        out.append((i, KINDS.index(kind), i + n))
        at = i + n
    return out


def run_keys(text: str, m: re.Match) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the text of each private key in one run, across the line ends in it."""
    pieces, at = [], m.start()
    for x in BREAKS.finditer(text, *m.span()):
        pieces.append((at, x.start()))
        at = x.end()
    pieces.append((at, m.end()))
    found = keys_in("".join(text[a:b] for a, b in pieces))
    if not found:
        return found
    firsts = list(accumulate((b - a for a, b in pieces), initial=0))

    def place(i: int) -> int:
        k = bisect_right(firsts, i) - 1
        return pieces[k][0] + i - firsts[k]

    out = []
    for a, kind, b in found:
        end = place(b - 1) + 1
        out.append((place(a), kind, end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))))
    return out


class Reported:
    """What is reported so far, and where: a later kind of candidate doesn't report the same place again."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []

    def add(self, found: list[tuple[int, int, int]]) -> None:
        """found: in order, without overlaps among themselves. So are those held, of which each is looked up by its start."""
        starts = [a for a, _, _ in self.spans]

        def free(a: int, b: int) -> bool:
            i = bisect_left(starts, b) - 1
            return i < 0 or self.spans[i][2] <= a

        self.spans = sorted(self.spans + [x for x in found if free(x[0], x[2])])


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes to a private key or a signed token."""
    out = Reported()
    if "-----BEGIN " in text:
        out.add(pem_keys(text))
    if "eyJ" in text:
        out.add([(m.start(), KINDS.index("jwt"), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])])
    out.add([x for m in RUN.finditer(text) for x in run_keys(text, m)])
    out.add([(m.start(), KINDS.index("der"), m.end()) for m in HEX_CODE.finditer(text) if is_private_der(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))])
    return out.spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    Spans are in code points, the end exclusive, by start and then kind. Those of the patterns all stay; confirmed private
    keys and signed tokens come on top, and may overlap them. Null and empty texts have none; whole texts are searched.
    Repeated rows appear as often as they come in; other columns are not looked at; an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            rows = []
            for t in str_texts(column(b, "text")):
                base = base_spans(t)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + confirmed_spans(t)))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
