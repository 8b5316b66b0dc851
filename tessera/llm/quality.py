"""Quality rules: repeated substrings of a text from a suffix array of its words and the longest common prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import WORD_SPACE, column, pick, raw_texts, ship, slices, table

MIN_WORDS = 20
WINDOW = 8  # words of the windows of the base rule
MAX_REPEAT_PERCENT = 30
MIN_REPEAT = 16  # words from which a repeated substring counts
MAX_COVERED = 0.25  # of the words, inside repeated substrings
MAX_LONGEST = 150  # words of the longest repeated substring
SYMBOLS = b"#*$%&|<>"


class Suffixes:
    """Suffix array and longest common prefixes of many word sequences at once, by prefix doubling.

    codes: a number for each word; doc: for each word the sequence it is in, ascending. Suffixes end with their sequence,
    and only suffixes of one sequence share a prefix. A round sorts only the suffixes that are not yet told apart, and
    only the ranks of the last round are held. repeated[w] tells for each of the `windows` asked for whether the w words
    from a place stand elsewhere in its sequence too. Positions and ranks take 32 bits, so a call takes under 2**31 words.
    """

    def __init__(self, codes: np.ndarray, doc: np.ndarray, windows: tuple[int, ...] = ()):
        n = len(codes)
        self.n, self.codes = n, codes.astype(np.int32, copy=False)
        self.ends = np.searchsorted(doc, doc, side="right").astype(np.int32) if n else np.zeros(0, np.int32)
        self.repeated = {w: np.zeros(n, bool) for w in windows}
        key = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable").astype(np.int32)
        self.rank, step = np.empty(n, np.int32), 1
        if n:
            self.rank[order] = self._starts(key[order], np.int32(0), np.int32(0))
        del key
        active = self._tied(order)
        self._note(active, step)
        while len(active):
            key = self._pairs(active, step)
            by = np.argsort(key, kind="stable")
            order, key = active[by], key[by]
            del by
            base = self.rank[order]
            group = np.concatenate(([True], base[1:] != base[:-1]))
            start = np.maximum.accumulate(np.where(group, np.arange(len(order), dtype=np.int32), 0))
            new = self._starts(key, base, start)
            del key, base, group, start
            self.rank[order] = new
            step *= 2
            active = self._tied(order)
            self._note(active, step)
        self.sa = np.empty(n, np.int32)
        self.sa[self.rank] = np.arange(n, dtype=np.int32)

    def _pairs(self, at: np.ndarray, step: int) -> np.ndarray:
        """For each place its rank and that of the place `step` words on, as one number."""
        nxt = at + np.int32(step)
        second = np.where(nxt < self.ends[at], self.rank[np.minimum(nxt, self.n - 1)] + 1, 0)
        return self.rank[at].astype(np.int64) * (self.n + 1) + second

    @staticmethod
    def _starts(key: np.ndarray, base, start) -> np.ndarray:
        """The rank of each: that of its group's first, plus where in the group its own equal ones begin."""
        at = np.arange(len(key), dtype=np.int32)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        return base + np.maximum.accumulate(np.where(new, at, 0)) - start

    def _tied(self, order: np.ndarray) -> np.ndarray:
        """Of the positions in `order` (ascending rank), those whose rank is another's too."""
        if not len(order):
            return order
        r = self.rank[order]
        same = r[1:] == r[:-1]
        return order[np.concatenate((same, [False])) | np.concatenate(([False], same))]

    def _note(self, tied: np.ndarray, step: int) -> None:
        """Notes the repeated windows of step to under 2 * step words: places tied for their first and their last `step` words."""
        for w, out in self.repeated.items():
            if step <= w < 2 * step and len(tied):
                at = tied[tied + np.int64(w) <= self.ends[tied]]
                key = self._pairs(at, w - step)
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                out[at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]] = True

    def lcp(self, where: np.ndarray | None = None) -> np.ndarray:
        """For each place in the suffix array the words it shares with the place before; 0 where `where` (places in the
        words) is not set. Taken in the order of the words, where a prefix is at most one shorter than that of the word before,
        so all comparisons together are about as many as the words."""
        out, run = np.zeros(self.n, np.int32), 0
        codes, ends, rank, sa = (memoryview(np.ascontiguousarray(x)) for x in (self.codes, self.ends, self.rank, self.sa))
        last = -2
        for i in range(self.n) if where is None else map(int, np.flatnonzero(where).astype(np.int32)):
            run = max(run - 1, 0) if i == last + 1 else 0
            last, r = i, rank[i]
            if not r or ends[sa[r - 1]] != ends[i]:
                run = 0
                continue
            j = sa[r - 1]
            most = ends[i] - max(i, j)
            while run < most and codes[i + run] == codes[j + run]:
                run += 1
                if run % 64 == 0 and run + 4096 <= most:  # long equal stretches by whole arrays
                    while run + 4096 <= most and np.array_equal(self.codes[i + run : i + run + 4096], self.codes[j + run : j + run + 4096]):
                        run += 4096
            out[r] = run
        return out

    def deepest(self, where: np.ndarray | None = None) -> np.ndarray:
        """For each position the depth of the deepest common-prefix interval around its suffix: the longest repeat from there."""
        lcp, out = self.lcp(where), np.zeros(self.n, np.int32)
        if self.n:
            out[self.sa] = np.maximum(lcp, np.append(lcp[1:], 0))
        return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places the spans of one length cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + length, 1)
    return np.cumsum(edge, dtype=np.int32)[:n] > 0


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): a number for each word of all texts, and how many words each has."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]])
    return flat.filter(pa.array(real)).dictionary_encode().indices.to_numpy(), counts


def measure(texts: list[bytes], window: int = WINDOW, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """What the rules look at, for each text."""
    codes, counts = words_of(texts)
    window, least = np.int32(window), np.int32(least)
    n, docs = len(codes), len(texts)
    doc = np.repeat(np.arange(docs, dtype=np.int32), counts)
    suffixes = Suffixes(codes, doc, (window, least))
    out = {"n_words": counts.astype(np.int64)}
    at = np.flatnonzero(suffixes.repeated[window]).astype(np.int32)
    out["n_repeat_words"] = np.bincount(doc[covered(at, window, n)], minlength=docs)
    # maximal repeats of `least` words or more: their union is that of the repeated windows of so many words
    at = np.flatnonzero(suffixes.repeated[least]).astype(np.int32)
    out["n_covered_words"] = np.bincount(doc[covered(at, least, n)], minlength=docs)
    longest = np.zeros(docs, np.int64)
    if len(at):
        np.maximum.at(longest, doc[at], suffixes.deepest(suffixes.repeated[least])[at])
    out["longest_repeat"] = longest
    chars, symbols, dups = [], [], []
    for t in texts:
        solid = t.translate(None, WORD_SPACE)
        chars.append(len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace")))
        symbols.append(len(solid) - len(solid.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dups.append(len(lines) - len(set(lines)))
    return out | {"word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dups, np.int64)}


def judge(m: dict[str, np.ndarray], min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    repeats = (m["n_covered_words"] > max_covered * m["n_words"]) | (m["longest_repeat"] > max_longest)
    return m | {"base_failed": base, "kept": ~(base | repeats)}


def judged(batches, min_words: int):
    """Batches of about 4 MB of text with the verdicts on them."""
    for b in slices(batches, "text", 4 << 20):
        yield b, judge(measure(raw_texts(column(b, "text"))), min_words)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def quality(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Measures and verdict of every document, a row for each that comes in.

    base_failed: under `min_words` words, or over 30 % of the words in 8-word windows found twice or more. The suffix-array rule
    also rejects a text when over a quarter of its words lie in substrings of 16 words or more that the text repeats, or
    when the longest of these has over 150 words. A null or empty text has no words and fails. Repeats are looked for
    within a text only; whole texts are taken, of any length, with about 90 bytes of memory for each word. Repeated rows
    appear as often as they come in; other columns are not looked at; an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b, m in judged(batches, min_words):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), *[pa.array(m[k].astype(np.int64)) for k in COLUMNS], pa.array(m["base_failed"]), pa.array(m["kept"])], ["doc_id", *COLUMNS, "base_failed", "kept"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in COLUMNS)}, base_failed boolean, kept boolean")


def keep_good(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that the quality rules keep; the columns stay as they are, whatever their names.

    Null and empty texts have no words, so they go. Repeated rows are judged alike. An empty table gives an empty result.
    """
    ship(spark)

    def run(batches):
        for b, m in judged(batches, min_words):
            yield b.filter(pa.array(m["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict and what it rests on. How long the longest repeat is stays with quality(); whether it is too long is in `kept`."""
    return quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def _oracle() -> str:
    """SQL: a hash of each word and the words after it, for 1, 2, 4, ... words, from which windows of any width are compared.

    A text is rejected for repeats of MIN_REPEAT words by the words that windows of so many words cover, which are those of the
    maximal repeats, and for a repeat of over MAX_LONGEST words if it holds any window of one word more twice.
    """
    widths = {"base": WINDOW, "covered": MIN_REPEAT, "far": MAX_LONGEST + 1}
    steps, k = ["h1 AS (SELECT doc_id, pos, n, hash(word) AS k FROM cut)"], 1
    power = {name: 1 << (w.bit_length() - 1) for name, w in widths.items()}
    while k < max(power.values()):
        steps.append(f"h{2 * k} AS (SELECT doc_id, pos, n, hash(k, lead(k, {k}) OVER (PARTITION BY doc_id ORDER BY pos)) AS k FROM h{k})")
        k *= 2
    for name, w in widths.items():
        steps.append(f"{name}_at AS (SELECT doc_id, pos, n, hash(k, lead(k, {w - power[name]}) OVER (PARTITION BY doc_id ORDER BY pos)) AS k FROM h{power[name]})")
        steps.append(f"{name}_met AS (SELECT doc_id, pos, CASE WHEN pos + {w} - 1 <= n AND count(*) OVER (PARTITION BY doc_id, k, pos + {w} - 1 <= n) > 1 THEN 1 ELSE 0 END AS met FROM {name}_at)")
        steps.append(f"{name} AS (SELECT doc_id, sum(met) AS n FROM (SELECT doc_id, max(met) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS met FROM {name}_met) GROUP BY doc_id)")
    return rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM words),
{(", " + chr(10)).join(steps)},
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM words) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(covered.n, 0)::BIGINT AS n_covered_words, coalesce(far.n, 0) AS far
  FROM words LEFT JOIN base USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN far USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed, NOT (base_failed OR n_covered_words > {MAX_COVERED} * n_words OR far > 0) AS kept FROM b"""


QUERIES = {"op4_quality": op4_quality}
ORACLES = {"op4_quality": _oracle()}
