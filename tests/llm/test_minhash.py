import random

import pytest

from tessera.llm import common, minhash, simhash

import corpus_pipeline

from .conftest import ODD


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in ((t or "").encode().lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def brute(rows):
    kept = []
    for i, t in sorted(rows):
        if not any(jaccard(t, u) >= 0.8 for _, u in kept):
            kept.append((i, t))
    return [i for i, _ in kept]


def near(n, seed=4):
    """Texts, copies of them with one to four words changed, and a large group of changed copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(rng.randint(3, 150))] for _ in range(n)]
    out = []
    for i in range(3 * n):
        words = list(rng.choice(base) if i % 2 else base[0])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        out.append((i * 7 % 1009, " ".join(words)))
    return out


@pytest.mark.parametrize("task_shingles", [minhash.TASK_SHINGLES, 1200])
def test_the_stage_drops_what_is_similar_and_nothing_else(spark, docs_of, task_shingles):
    rows = near(24)
    got = sorted(r["doc_id"] for r in minhash.drop_similar(spark, docs_of(rows), task_shingles).collect())
    assert got == brute(rows)


def test_the_pipelines_stage_finds_near_copies_many_bits_apart(spark, docs_of):
    rows = near(60, seed=9)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == brute(rows)


def test_odd_rows_of_the_stage(spark, clashing, empty_docs):
    kept = minhash.drop_similar(spark, clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and None in ids and 1 in ids and not {2, 3} & set(ids) and len(ids) == len(ODD) - 3
    assert minhash.drop_similar(spark, empty_docs).collect() == []


def test_what_op1_links_is_a_candidate_too(spark, docs_of, monkeypatch):
    """Without any bucket the stage still finds near copies that op1 links, and keeps what it links that is not alike."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[::-1]))]
    import numpy as np

    monkeypatch.setattr(minhash, "buckets", lambda hashes: np.zeros(0, np.int64))
    linked = simhash.near_duplicates(spark, docs_of(rows))
    assert {r["doc_id"]: r["component_id"] for r in linked.collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == [1, 3]
    far = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, component_id long")
    assert sorted(r["doc_id"] for r in minhash.drop_similar(spark, docs_of(rows), linked=far).collect()) == [1, 3]


@pytest.mark.parametrize("missing", [1.0, 0.3])
def test_what_the_buckets_miss_is_found(spark, docs_of, monkeypatch, missing):
    """Without any bucket, and with a few for some documents only, the stage drops what is similar and nothing else."""
    import numpy as np

    whole = minhash.buckets
    monkeypatch.setattr(minhash, "buckets", lambda hashes: np.zeros(0, np.int64) if len(hashes) == 0 or int(hashes[0]) % 10 < 10 * missing else whole(hashes))
    rows = near(30, seed=21)
    assert sorted(r["doc_id"] for r in minhash.drop_similar(spark, docs_of(rows)).collect()) == brute(rows) != sorted({i for i, _ in rows})
    # 3 goes by 2 until 2 turns out to go by 1; then 3 is back
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[k : k + 104])) for i, k in ((1, 0), (2, 10), (3, 20))]
    assert brute(rows) == [1, 3]
    linked = spark.createDataFrame([(2, 2), (3, 2)], "doc_id long, component_id long")
    monkeypatch.setattr(minhash, "buckets", lambda hashes: np.zeros(0, np.int64))
    assert sorted(r["doc_id"] for r in minhash.drop_similar(spark, docs_of(rows), linked=linked).collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(3))
def test_sets_alike_share_a_key(seed):
    """However many shingles come last as common ones, and at the very border of 0.8."""
    import numpy as np

    rng = np.random.default_rng(seed)
    for _ in range(300):
        both = rng.integers(0, 1 << 64, int(rng.integers(1, 60)), np.uint64)
        one, two = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, int(rng.integers(0, len(both) // 8 + 2)), np.uint64)))) for _ in range(2))
        often = np.unique(rng.choice(np.concatenate((one, two)), int(rng.integers(0, len(one)))))
        if minhash.alike(len(np.intersect1d(one, two)), len(one), len(two)):
            assert len(np.intersect1d(minhash.least_part(one, often), minhash.least_part(two, often)))
            apart = np.bitwise_count((minhash.sketch(one) ^ minhash.sketch(two)).view(np.uint64)).sum()
            assert apart <= len(np.setxor1d(one, two)) and 9 * apart <= len(one) + len(two)
    assert len(minhash.least_part(np.zeros(0, np.uint64), often)) == 0


def test_texts_that_stay_are_not_shuffled(spark):
    """Only what may be among the ids meets them by a join, exactly; a small filter lets more through, and loses none."""
    docs = spark.range(-2000, 2000).selectExpr("nullif(id, 1000) as doc_id", "repeat('x', 100) as text", "id as _bits")
    gone, none = spark.range(0, 2000, 50), spark.range(0)
    for most in (1 << 25, 1024):
        some, rest = common.sift(docs, "doc_id", gone, most)
        ids = {r["doc_id"] for r in some.collect()}
        assert set(range(0, 2000, 50)) - {1000} <= ids and None not in ids and some.columns == docs.columns
        assert some.count() + rest.count() == 4000 and (len(ids) < 200 or most == 1024)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.without(docs, gone, none)
        shown = out._jdf.queryExecution().executedPlan().toString().splitlines()
        moved = [shown[i + 1] for i, x in enumerate(shown) if "Exchange hashpartitioning(doc_id" in x]
        assert len(moved) == 1 and "LeftSemi" in moved[0]
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id < 0 or doc_id % 50 != 0").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_worker_gives_back_what_other_steps_have_left():
    """Caches that a task did not ask for are empty after it; those that it asked for stay for the next."""
    import pyarrow as pa

    one, two = common.ByteCache(100), common.ByteCache(100)
    task = lambda: list(common.slices(iter([pa.RecordBatch.from_pydict({"text": ["a", None, "bc"]})]), "text", 2))
    one.get("a", lambda key: (key, 1))
    two.get("b", lambda key: (key, 1))
    assert sum(b.num_rows for b in task()) == 3 and one.held and two.held
    one.get("a", lambda key: (key, 1))
    task()
    assert one.held and not two.held and two.used == 0
