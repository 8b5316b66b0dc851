import os
import random
from itertools import combinations

import pytest
import xxhash

from tessera.llm import graph, simhash

from .conftest import ODD


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, f), (b, g) in combinations(pairs, 2):
        if (f ^ g).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i, _ in pairs}


def texts(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i * 7 % 1009, " ".join(words)))
    return out


def test_fingerprints_match_the_definition():
    for _, t in [*ODD, *texts(60)]:
        assert simhash.fingerprint((t or "").encode()) == brute_fp(t)


def test_the_ball_reaches_every_mask():
    assert len(simhash.ball(1)) == 65 and len(set(simhash.ball(2))) == 1 + 64 + 64 * 63 // 2


def test_components_match_brute_force(spark, docs_of):
    rows = texts(240)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark, docs_of(rows)).collect()}
    want = brute_components([(i, brute_fp(t)) for i, t in rows])
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(f == brute_fp(dict(rows)[i]) for i, (f, _) in got.items())


def test_links_two_bits_apart_are_found_and_three_are_not(spark):
    rng = random.Random(5)
    rows = [(i, rng.getrandbits(64)) for i in range(50)]
    rows += [(100 + i, f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for i, f in rows[:25]] + [(200 + i, f ^ 0b111) for i, f in rows[25:]]
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in dict((f, i) for i, f in rows).items() for f, i in [(i, f)]], "fp long, id long")
    got = {r["node"]: r["component"] for r in graph.components(spark, simhash.near_links(fps)).collect()}
    want = {k: v for k, v in brute_components(rows).items() if sum(x == v for x in brute_components(rows).values()) > 1}
    assert got == want


def test_what_is_written_can_be_removed(spark, docs_of):
    from tessera.llm import common

    common.clean(spark)
    out = simhash.near_duplicates(spark, docs_of(texts(30)))
    out.collect()
    folder = common.shared_folder(spark).removeprefix("file:").replace("///", "/").replace("//", "/")
    held = lambda: {p for p in os.listdir(f"{folder}/tessera")} if os.path.isdir(f"{folder}/tessera") else set()
    mine = {p.rpartition("/")[2] for p in common._WRITTEN[spark.sparkContext.applicationId]}
    assert mine & held() and sum(p.startswith("stars") for p in mine & held()) <= 1  # rounds take each other's place
    common.clean(spark)
    assert not mine & held()


def test_odd_rows(spark, odd_docs, clashing, empty_docs):
    for d in (odd_docs, clashing):
        got = simhash.near_duplicates(spark, d).collect()
        assert len(got) == len(ODD)
        by = {r["doc_id"]: r for r in got}
        assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1 and by[1]["fp"] == 0
        assert by[None]["component_id"] is None and by[4]["component_id"] == 4
    assert simhash.near_duplicates(spark, empty_docs).collect() == []
    kept = simhash.drop_near_duplicates(spark, clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and None in ids and 2 not in ids and 1 in ids
    assert simhash.drop_near_duplicates(spark, empty_docs).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (None, 3), (3, 4), (4, 3), (3, 4)]])
def test_components_of_graphs(spark, links):
    got = {r["node"]: r["component"] for r in graph.components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}
    for a, b in links:
        if a is not None and a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in parent:
        for a, b in links:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
