import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity

from .conftest import ODD


def test_folds():
    assert all(toxicity.in_training(i) == (zlib.crc32(str(i).encode()) % 3 != 1) for i in range(100))


def test_label_model_finds_kinds_and_accuracies():
    rng = np.random.default_rng(1)
    kind = rng.choice(3, 6000, p=[0.85, 0.1, 0.05])  # clean, and two kinds of toxic text with three voters each
    rates = [[0.005, 0.6, 0.005], [0.01, 0.5, 0.01], [0.02, 0.7, 0.02], [0.005, 0.005, 0.6], [0.01, 0.01, 0.5], [0.01, 0.01, 0.8], [0.3, 0.05, 0.05]]
    votes = np.stack([rng.random(6000) < np.array(r)[kind] for r in rates], axis=1).astype(float)  # the last one votes clean
    m = toxicity.LabelModel(6).fit(votes, np.ones(6000))
    assert m.kind.tolist() == [0, 0, 0, 1, 1, 1] and np.allclose(m.share, [0.85, 0.1, 0.05], atol=0.02)
    assert np.allclose(m.fires[:6], [0.6, 0.5, 0.7, 0.6, 0.5, 0.8], atol=0.08) and np.allclose(m.errs[:6], [0.005, 0.01, 0.02, 0.005, 0.01, 0.01], atol=0.006)
    truth = [((kind > 0) & (votes[:, j] > 0)).sum() / votes[:, j].sum() for j in range(6)] + [((kind == 0) & (votes[:, 6] > 0)).sum() / votes[:, 6].sum()]
    assert np.allclose(m.accuracy, truth, atol=0.1)
    p = m.posterior(votes)
    assert ((p > 0.5) == (kind > 0)).mean() > 0.94


def test_voters_for_other_kinds_count_nothing_against_a_text():
    """Twenty silent voters of one kind must not outweigh one of another, and a voter stated thrice is one sign."""
    rng = np.random.default_rng(2)
    kind = rng.choice(3, 5000, p=[0.9, 0.07, 0.03])
    many = [rng.random(5000) < np.where(kind == 1, 0.5, 0.001) for _ in range(20)]
    one = rng.random(5000) < np.where(kind == 2, 0.9, 0.002)
    other = rng.random(5000) < np.where(kind == 2, 0.6, 0.002)
    votes = np.stack([*many, one, other], axis=1).astype(float)
    p = toxicity.LabelModel(22).fit(votes, np.ones(5000)).posterior(votes)
    assert (p[(kind == 2) & one] > 0.5).mean() > 0.95 and (p[(kind == 0) & (votes.sum(axis=1) == 0)] < 0.1).all()


def test_gold_labels_are_no_input_of_the_label_model(spark):
    """Where a labelled text has no sign of its label, the posterior keeps its own mind."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    sample = toxicity.training_sample(spark, docs, labels, toxicity.SAMPLE_ROWS)
    voters = toxicity.Voters(toxicity.mine(sample))
    rows = sample.collect()
    x = np.zeros((len(rows), voters.columns))
    for i, r in enumerate(rows):
        x[i, voters.votes(r["text"])] = 1
    gold = np.array([r["toxic"] for r in rows])
    m = toxicity.LabelModel(voters.toxic).fit(x[:, : voters.count], np.array([r["weight"] for r in rows]))
    p = m.posterior(x[:, : voters.count])
    assert 0.9 < ((p > 0.5) == (gold > 0)).mean() < 1 and (p[gold > 0] < 0.3).any()
    fired = x[:, : voters.count].sum(axis=0) > 0
    assert fired.sum() >= 20 and fired[voters.toxic :].any()  # voters of both kinds
    assert len(set(m.kind[: len(voters.mined)])) > 1 and m.accuracy[: len(voters.mined)].min() > 0.5


def test_votes_are_those_of_the_words():
    rng = random.Random(3)
    voters = toxicity.Voters([("lowe", 2), ("tra", 1), ("idiot", 1)])
    parts = ["loweit", "loweis", "Lowe", "xlowe", "trash", "TRA", "tr", "idiots", "idiot", "scum", "scums", "²scum", "scum2", "é", " ", " ", ".", "_", "tratra", "İdiot", "you are trash", "** x", "a**b", "(123) 456", "copyright "]
    names = voters.names
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        words = toxicity.words_of(t)
        stems = [f"stem:{s}:{n}" for s, n in voters.mined if sum(w.startswith(s) for w in words) >= n]
        want = stems + [f"word:{w}" for w in toxicity.LEXICON if w in words and w != "idiot"]
        got = voters.votes(t)
        assert [names[i] for i in got if i < voters.toxic - len(toxicity.PATTERNS)] == sorted(want, key=names.index), t
        assert sum(i >= voters.count for i in got) == min(3, len(want))
        assert [n for n, _, p in toxicity.PATTERNS + toxicity.CLEAN if p.search(t.lower())] == [names[i].partition(":")[2] for i in got if voters.toxic - len(toxicity.PATTERNS) <= i < voters.count], t


def held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op6_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    hits = [(r["toxic"], r["predicted"]) for r in rows]
    return [hits.count(x) for x in ((1, 1), (1, 0), (0, 1), (0, 0))]


def test_held_out_accuracy(spark):
    tp, fn, fp, tn = held_out(spark, "/root/testdata/sf0.1")
    assert tp >= 0.9 * (tp + fn) and fp <= 0.01 * (fp + tn), (tp, fn, fp, tn)


def test_odd_rows(spark, clashing, empty_docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, 1, 1), (None, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        got = toxicity.score(clashing, *toxicity.fit(spark, clashing, some)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert toxicity.score(empty_docs, *toxicity.fit(spark, empty_docs, labels)).collect() == []


def test_scores_come_from_the_text_alone(spark, docs_of):
    rows = [(i, f"clean words number {i} here") for i in range(60)] + [(100 + i, f"text {i} you idiot and moron of note {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows], "doc_id long, quality int, toxic int")
    voters, weights = toxicity.fit(spark, docs_of(rows), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(rows), voters, weights).collect()}
    assert all(got[i]["predicted"] == int(i >= 100) for i, _ in rows)
    moved = docs_of([(i + 1000, t) for i, t in rows]).withColumn("lang", F.lit("xx"))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(moved, voters, weights).collect()}
    assert all(again[i + 1000] == got[i]["score"] for i, _ in rows)


def test_texts_that_share_a_word_all_stay_in_the_sample(spark, docs_of):
    common = min((f"w{x}" for x in "abcdefghijklmnop"), key=lambda w: zlib.crc32(w.encode()))
    rows = [(i, f"{common} note {'abcdefghij'[i // 10 % 10]}{'klmnopqrst'[i % 10]}") for i in range(90)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows)]  # real copies
    labels = spark.createDataFrame([(i, 1, int(i % 100 % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(spark, docs_of(rows), labels, 1000).collect()
    got = [(r["text"], r["toxic"]) for r in sample]
    assert all(r["weight"] == 1 for r in sample)
    assert sorted(got) == sorted({(t, int(i % 100 % 3 == 0)) for i, t in rows if toxicity.in_training(i)})


def test_near_copies_count_as_one_text_together(spark, docs_of):
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))
    rows = [(i, f"{long} end{'abcdefghij'[i % 10]}") for i in range(10)] + [(10 + i, f"another{'klmnopqrst'[i]} text{'klmnopqrst'[i]}") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r["text"]: r["weight"] for r in toxicity.training_sample(spark, docs_of(rows), labels, 1000).collect()}
    copies = [w for t, w in got.items() if t.startswith("word")]
    assert len(copies) > 3 and abs(sum(copies) - 1) < 1e-9 and all(w == 1 for t, w in got.items() if t.startswith("another"))


def test_very_long_text(spark, docs_of):
    rows = [(1, "clean words of a note " * 200_000), (2, "x" * 3_000_000), (3, "you idiot, moron " * 100_000)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(rows), *toxicity.fit(spark, docs_of(rows), labels)).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
