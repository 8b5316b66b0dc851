"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, run over each text once."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteCache, column, materialise, pick, raw_texts, read_file, scratch, ship, slices, table, write_file

WINDOW = 10
CHUNK_CHARS = 4_000_000  # of windows in one automaton; larger benchmarks get several, of which a worker holds one
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NORMAL = bytes(c if c in WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
NO_ITEM = ""  # the id of items without one
_CACHE = ByteCache(1)


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, what belongs to no word a space; each byte stays where it is in the original."""
    return text.translate(NORMAL)


def windows(text: bytes, width: int = WINDOW) -> set[bytes]:
    words = normal(text).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def write_windows(spark: SparkSession, items: DataFrame, width: int = WINDOW, chunk: int = CHUNK_CHARS) -> list[str]:
    """Writes the windows of all items to files of at most about `chunk` characters in the shared folder; their paths.

    The items never come to the driver, so the benchmark may have any size; the paths are a few for each chunk.
    """
    ship(spark)
    at = scratch(spark, "windows")
    items = pick(items, "item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size * width // chunk))

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, {}, 0
        for b in batches:
            for i, t in zip(column(b, "item_id").to_pylist(), raw_texts(column(b, "text")), strict=True):
                for w in windows(t, width):
                    size += 0 if w in held else len(w)
                    held.setdefault(w.decode("latin-1"), set()).add(NO_ITEM if i is None else str(i))
                    if size >= chunk:
                        yield save(part, k, held)
                        k, held, size = k + 1, {}, 0
        if held:
            yield save(part, k, held)

    def save(part, k, held):
        path = f"{at}/{part:05d}-{k:05d}"
        write_file(path, [json.dumps({w: sorted(i) for w, i in sorted(held.items())}).encode()])
        return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    # a plain row shuffle, or none: any split of the items will do
    found = materialise(spark, (items.repartition(parts) if parts > 1 else items.coalesce(1)).mapInArrow(run, "path string"), "window-files")
    return sorted(r[0] for r in found.collect())


def automaton(path: str):
    import ahocorasick

    a = ahocorasick.Automaton()
    listed = json.loads(read_file(path))
    for w, items in listed.items():
        a.add_word(f" {w} ", (w.count(" ") + 1, items))
    if listed:
        a.make_automaton()
    return (a if listed else None), 1


def at_once(paths: list[str]) -> int:
    """Bytes of text that a worker scans together. It holds one automaton; where there are several, each is built again for
    every lot of texts, which is why that is as large as an Arrow batch then."""
    return 8 << 20 if len(paths) < 2 else 1 << 30


def scan(texts: list[bytes], paths: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(words, hit spans of words, items) of each text. A span is (first word, words); spans may overlap."""
    plain = [b" ".join(normal(t).split()).decode("latin-1") for t in texts]
    out = [(t.count(" ") + 1 if t else 0, [], set()) for t in plain]
    for p in paths:
        a = _CACHE.get(p, automaton)
        if a is None:
            continue
        for t, (_, spans, items) in zip(plain, out, strict=True):
            if found := list(a.iter(f" {t} ")) if t else []:
                ends = np.flatnonzero(np.frombuffer(f" {t} ".encode("latin-1"), np.uint8) == 32)
                for end, (n, ids) in found:
                    spans.append((int(np.searchsorted(ends, end)) - n, n))
                    items.update(ids)
    return out


def hit_words(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    hit = np.zeros(n + 1, np.int64)
    for a, m in spans:
        hit[a] += 1
        hit[a + m] -= 1
    return np.cumsum(hit)[:n] > 0


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text."""
    if not spans:
        return []
    words = [m.span() for m in re.finditer(rb"[^ ]+", normal(text))]
    out, hit = [], hit_words(len(words), spans)
    for i in np.flatnonzero(hit).tolist():
        if out and i and hit[i - 1]:
            out[-1][1] = words[i][1]
        else:
            out.append(list(words[i]))
    return [(len(text[:a].decode("utf-8", "replace")), len(text[:b].decode("utf-8", "replace"))) for a, b in out]


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of every document.

    An item's windows are its runs of `width` words, or all its words if it has fewer; one without words has none. A word
    of a document is hit if it lies in an occurrence of a window. spans are the runs of hit words in code points of the
    original. Null and empty texts have no words; items that share an id are one item, those without id share the id ''.
    Repeated rows appear as often as they come in; other columns are not looked at; an empty table gives an empty result, and
    no items contaminate nothing.
    """
    paths = write_windows(spark, items, width)
    together = at_once(paths)

    def run(batches):
        for b in slices(batches, "text", together):
            texts = raw_texts(column(b, "text"))
            found = scan(texts, paths)
            hits = [int(hit_words(n, s).sum()) if s else 0 for n, s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id").cast(pa.int64()), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                    pa.array([[{"start": x, "end": y} for x, y in original_spans(t, s)] for t, (_, s, _) in zip(texts, found, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([h > 0 for h in hits]),
                ], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, contaminated boolean")


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs; the columns stay as they are, whatever their names.

    Null and empty texts have no words and stay; repeated rows stay repeated, or all go. An empty table gives an empty result.
    """
    paths = write_windows(spark, items, width)
    together = at_once(paths)

    def run(batches):
        for b in slices(batches, "text", together):
            yield b.filter(pa.array([not s for _, s, _ in scan(raw_texts(column(b, "text")), paths)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {
    "op5_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS m FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
run AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
met AS (SELECT run.doc_id, run.i, run.m, win.item_id FROM run JOIN win ON win.m = run.m AND win.k = array_to_string(run.w[run.i:run.i + run.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""
}
