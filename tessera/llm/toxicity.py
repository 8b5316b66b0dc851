"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Gold labels only choose which stems become voters. What the model and the classifier learn from are the votes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialise, pick, raw_texts, ship, slices, str_texts, table
from .minhash import buckets, shingles

SAMPLE_ROWS = 20_000  # labelled rows that voters and models are fitted on, at most: those with the least hashes
STEMS = range(3, 11)  # letters of a stem, which stands for all words that begin with it
FAMILY = 4  # stems that share so many letters are one family, of which the most telling one becomes a voter
LEAST_RATIO = 6.0  # how much more often than in clean texts a mined stem stands in toxic ones
LEAST_G2 = 28.0  # log-likelihood ratio from which a stem is mined; by chance a stem reaches it once in ten million
CORRELATED = 0.1  # correlation of their votes from which toxic voters look for one kind of text
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Insults that a voter each looks for, whatever the labels hold.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb",
    "idiotin", "dummkopf", "trottel", "abschaum", "arschloch", "crétin", "imbécile", "connard", "ordure", "estúpido", "imbécil", "basura",
)
#: Patterns that a voter each takes for a toxic text, in lower case, after strings of which one is in each match.
PATTERNS = (
    ("you_are", ("you",), re.compile(r"\byou(?:'re| are| is)? (?:an? |all |such )?(?:idiot|moron|loser|scum|trash|clown|stupid|pathetic)")),
    ("hate", ("hate ", "despise "), re.compile(r"\b(?:hate|despise) (?:you|them|all)\b")),
    ("get_lost", ("shut up", "get lost", "go away", "drop dead"), re.compile(r"\b(?:shut up|get lost|go away|drop dead)\b")),
    ("masked", ("**", "##", "@@"), re.compile(r"\b[a-z](?:\*{2,}|#{2,}|@{2,})[a-z]*\b")),
)
#: Patterns that a voter each takes for a clean text, likewise.
CLEAN = (
    ("licence", ("licensed under", "licenced under", "copyright", "all rights reserved"), re.compile(r"\b(?:licen[cs]ed under|copyright|all rights reserved)\b")),
    ("contact", ("@", ") "), re.compile(r"@\w{1,63}\.\w|\(\d{3}\) \d{3}")),
    ("setting", (" = ",), re.compile(r" = [\"']")),
    ("table", (" | ",), re.compile(r" \| .{1,40} \| ")),
)


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def is_letter(c: str) -> bool:
    """What WORD takes."""
    return c.isalnum() and not c.isdecimal()


def stem_counts(words: set[str]) -> Counter:
    """How many distinct words begin with each stem."""
    return Counter(w[:n] for w in words for n in STEMS if len(w) >= n)


class Voters:
    """Voters of a lexicon (words; mined stems, which one word or two distinct ones must begin with) and of patterns.

    All but the CLEAN ones vote 'toxic' or abstain; those vote 'clean' or abstain. The last three columns count the
    toxic voters of the lexicon that agree; they are for the classifier and no voters of the label model.
    """

    def __init__(self, mined: list[tuple[str, int]]):
        self.mined, stems = mined, {s for s, _ in mined}
        lexicon = [w for w in LEXICON if w not in stems]
        self.names = [f"stem:{s}:{n}" for s, n in mined] + [f"word:{w}" for w in lexicon] + [f"pattern:{n}" for n, *_ in PATTERNS] + [f"clean:{n}" for n, *_ in CLEAN]
        self.toxic, self.count = len(self.names) - len(CLEAN), len(self.names)
        self.lexicon = lexicon
        self.columns, self._found = self.count + 3, None

    def __getstate__(self):
        return self.__dict__ | {"_found": None}  # each worker builds its own automaton

    def automaton(self):
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for i, s in enumerate([*(s for s, _ in self.mined), *self.lexicon]):
                self._found.add_word(s, (i, len(s)))
            self._found.make_automaton()
        return self._found

    def votes(self, text: str) -> list[int]:
        low, met = text.lower(), defaultdict(set)
        for last, (i, size) in self.automaton().iter(low):
            start, end = last + 1 - size, last + 1
            if start and is_letter(low[start - 1]):
                continue
            while end < len(low) and is_letter(low[end]):
                end += 1
            if i < len(self.mined) or end == last + 1:
                met[i].add(low[start:end])
        out = [i for i, words in met.items() if i >= len(self.mined) or len(words) >= self.mined[i][1]]
        signs, first = len(out), self.toxic - len(PATTERNS)
        out += [first + i for i, (_, parts, p) in enumerate(PATTERNS + CLEAN) if any(x in low for x in parts) and p.search(low)]
        return sorted(out + [self.count + i for i in range(min(3, signs))])


class LabelModel:
    """A generative model of votes: a text is clean or of one of several kinds of toxic text.

    Voters whose votes correlate look for one kind (insults of one language, say): what they share beyond a toxic text
    being toxic is its kind, so that their agreement is not counted as if they were independent, and the silence of voters
    for other kinds counts nothing against a text. Each toxic voter has a rate at which it fires on its kind and one on
    all other texts; each clean voter one on clean and one on toxic texts. Fitted by expectation maximisation from the votes
    alone, begun at each voter being believed; `weight` is what each row counts.
    """

    def __init__(self, toxic: int):
        self.toxic = toxic

    def fit(self, votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> LabelModel:
        x, wt = votes.astype(np.float64), weight.astype(np.float64)
        self.correlation = correlations(x, wt)
        group = connected(self.correlation[: self.toxic, : self.toxic] > CORRELATED)
        self.kind = np.unique(group, return_inverse=True)[1]
        kinds = int(self.kind.max(initial=-1)) + 1
        met = np.stack([x[:, : self.toxic][:, self.kind == k].sum(axis=1) for k in range(kinds)], axis=1)
        q = np.where(met > 0, 0.9 * met / np.maximum(met.sum(axis=1), 1)[:, None], 0.01 / kinds)
        q = np.hstack((1 - q.sum(axis=1)[:, None], q))
        for _ in range(rounds):
            mass = q * wt[:, None]
            self.share = (mass.sum(axis=0) + 0.1) / (mass.sum() + 0.1 * (kinds + 1))
            own = np.hstack((mass[:, 1:][:, self.kind], np.repeat(mass[:, :1], x.shape[1] - self.toxic, axis=1)))
            other = wt[:, None] - own
            self.fires = np.clip(((own * x).sum(axis=0) + 0.5) / (own.sum(axis=0) + 1), 1e-5, 1 - 1e-5)
            self.errs = np.clip(((other * x).sum(axis=0) + 0.01) / (other.sum(axis=0) + 1), 1e-5, 1 - 1e-5)
            new = self.kinds(x)
            moved, q = np.abs(new - q).max(initial=0), new
            if moved < 1e-4:
                break
        right = np.where(np.arange(x.shape[1]) < self.toxic, 1 - q[:, :1], q[:, :1]) * wt[:, None]
        self.accuracy = ((right * x).sum(axis=0) + 0.5) / (wt @ x + 1)
        return self

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each row to be clean (first column) or of each kind."""
        x = votes.astype(np.float64)
        gain = x * np.log(self.fires / self.errs) + (1 - x) * np.log((1 - self.fires) / (1 - self.errs))
        z = np.stack([gain[:, self.toxic :].sum(axis=1), *[gain[:, : self.toxic][:, self.kind == k].sum(axis=1) for k in range(len(self.share) - 1)]], axis=1) + np.log(self.share)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each row to be toxic."""
        return 1 - self.kinds(votes)[:, 0]


def correlations(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    mean = weight @ x / weight.sum()
    cov = (x * weight[:, None]).T @ x / weight.sum() - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(dev, dev)


def connected(near: np.ndarray) -> np.ndarray:
    """The least index that each one is connected to."""
    least = np.arange(len(near))
    while True:
        new = np.array([min(least[i], least[near[i]].min(initial=len(near))) for i in range(len(near))], dtype=least.dtype)
        if np.array_equal(new, least):
            return least
        least = new


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50, free: int = 0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last being the constant, by Newton steps. The last `free`
    columns, which sum up others, are held back far less."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[x.shape[1] - 1 - free :] = ridge / 25
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, weight) of at most `most` labelled documents of the training folds; equal texts of one label are one.

    A text weighs 1 / n if it shares a MinHash bucket of its five-word shingles with n - 1 others, so that a group of near
    copies counts about as one text and none is dropped.
    """
    ship(spark)
    ids = pick(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    # at most `most` pairs of two integers, so the broadcast has a bound
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    found = materialise(spark, found.distinct().withColumn("row", F.monotonically_increasing_id()), "toxicity-texts")

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array([buckets(shingles(t)) for t in raw_texts(column(b, "text"))], pa.list_(pa.int64()))], ["row", "buckets"])

    held = found.select("row", "text").mapInArrow(run, "row long, buckets array<long>").select("row", F.posexplode("buckets").alias("band", "bucket"))
    sizes = held.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    largest = held.join(sizes, ["band", "bucket"]).groupBy("row").agg(F.max("n").alias("n"))
    weight = (1 / F.coalesce("n", F.lit(1))).alias("weight")
    return materialise(spark, found.join(largest, "row", "left").select("text", "toxic", weight), "toxicity-sample")


def g2(bad: Column, good: Column, n_bad: float, n_good: float) -> Column:
    """Log-likelihood ratio of a stem standing in toxic and clean texts at different rates."""
    n, met = n_bad + n_good, bad + good
    part = lambda seen, meant: F.when(seen > 1e-9, seen * F.log(seen / meant)).otherwise(0.0)
    return 2 * (part(bad, met * n_bad / n) + part(good, met * n_good / n) + part(n_bad - bad, (n - met) * n_bad / n) + part(n_good - good, (n - met) * n_good / n))


def mine(sample: DataFrame) -> list[tuple[str, int]]:
    """(stem, words): stems that one distinct word, or two, of a text begin with far more often in toxic texts than in others.

    Of each family of stems the most telling one; all families that pass are taken.
    """
    n_bad, n_good = sample.agg(*[F.coalesce(F.sum(F.when(F.expr(c), F.col("weight"))), F.lit(0.0)) for c in ("toxic > 0", "toxic <= 0")]).first()
    if not n_bad or not n_good:
        return []

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            counts = defaultdict(lambda: [0.0, 0.0])
            for t, y, wt in zip(str_texts(column(b, "text")), column(b, "toxic").to_pylist(), column(b, "weight").to_pylist(), strict=True):
                for s, n in stem_counts(words_of(t)).items():
                    for k in range(1, min(n, 2) + 1):
                        counts[s, k][y > 0] += wt
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays([pa.array([s for (s, _), _ in rows], pa.string()), pa.array([k for (_, k), _ in rows], pa.int32()), pa.array([c[1] for _, c in rows], pa.float64()), pa.array([c[0] for _, c in rows], pa.float64())], ["stem", "words", "bad", "good"])

    counts = sample.mapInArrow(run, "stem string, words int, bad double, good double").groupBy("stem", "words").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = (F.col("bad") / n_bad) / ((F.col("good") + 0.5) / n_good)
    some = counts.where((F.col("bad") >= 3) & (ratio >= LEAST_RATIO)).withColumn("g2", F.round(g2(F.col("bad"), F.col("good"), n_bad, n_good), 6)).where(F.col("g2") >= LEAST_G2)
    best = F.max(F.struct("g2", F.length("stem").alias("size"), "stem", (-F.col("words")).alias("less"))).alias("x")
    found = sorted((r["x"] for r in some.groupBy(F.substring("stem", 1, FAMILY).alias("family")).agg(best).collect()), reverse=True)
    out: list[tuple[str, int]] = []
    for x in found:  # a stem shorter than a family's letters may begin another one
        if not any(x["stem"].startswith(s) or s.startswith(x["stem"]) for s, _ in out):
            out.append((x["stem"], -x["less"]))
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[Voters, np.ndarray]:
    """Voters and the classifier's weights. What comes to the driver is bounded by `most`: rows of votes, and mined stems,
    of which a sample of that size can only hold so many beyond chance."""
    ship(spark)
    sample = training_sample(spark, docs, labels, most)
    voters = Voters(mine(sample))

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([column(b, "weight"), pa.array([voters.votes(t) for t in str_texts(column(b, "text"))], pa.list_(pa.int32()))], ["weight", "votes"])

    rows = sample.select("text", "weight").mapInArrow(run, "weight double, votes array<int>").collect()
    x, weight = np.zeros((len(rows), voters.columns)), np.array([r["weight"] for r in rows])
    for i, r in enumerate(rows):
        x[i, r["votes"]] = 1
    if not x[:, : voters.toxic].any():
        # nothing to learn from: a word of the lexicon is taken for toxic
        w = np.zeros(voters.columns + 1)
        w[voters.count], w[-1] = 6.0, -4.0
        return voters, w
    votes = x[:, : voters.count]
    return voters, fit_linear(x, LabelModel(voters.toxic).fit(votes, weight).posterior(votes), weight, free=3)


def score(docs: DataFrame, voters: Voters, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    A null text is an empty one, and those have the score of a text without a vote. Repeated rows appear as often as they
    come in, a row without a doc_id too; other columns are not looked at. An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            ids = column(b, "doc_id").to_pylist()
            z = np.array([weights[v].sum() for v in (voters.votes(t) for t in str_texts(column(b, "text")))]) + weights[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array([not in_training(i) for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(spark, docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
