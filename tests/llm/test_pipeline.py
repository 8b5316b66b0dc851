"""The pipeline against a version of it in plain Python, and the registered queries."""

import base64
import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import bpe

from .conftest import ODD
from .test_minhash import brute as brute_similar
from .test_registered import brute_quality
from .test_text_operators import brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def brute(rows, items):
    """The stages in plain Python, none of them by the library: (doc_id, text) of what is left, by doc_id."""
    rows = [(i, t) for i, t in rows if brute_quality(t, least=1)[-1]]
    kept = {i: t for i, _, _, t in brute_lines(rows)}
    stay = set(brute_similar([(i, kept[i]) for i, _ in rows]))
    return sorted((i, kept[i]) for i, _ in rows if i in stay and not brute_hits(kept[i], items)[1])


def tokens(rows):
    import tiktoken

    path, pattern = bpe.default_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_pipeline_matches_plain_python(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == tokens(brute(docs, items)) and 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_stages_in_sequence_on_odd_rows(spark, clashing, tmp_path):
    """Nulls in any column, repeated rows, texts of a megabyte, clashing names: through all stages, each written and reread."""
    long = "\n".join(" ".join(f"w{(i * 7919 + j * j) % 100_003}" for j in range(40)) for i in range(3000))
    solid = " ".join(f"solid{i}" for i in range(40))
    more = [(70, long), (71, long), (72, solid), (72, solid), (73, f"{solid} more"), (None, solid), (74, " ".join(f"other{i}" for i in range(60)))]
    extra = spark.createDataFrame([(i, t, None, "s", None) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs, names = clashing.unionByName(extra, allowMissingColumns=True), None
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            names = names or docs.columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
    # of the long copies the lines stay in the first, and the second is left without words, which no longer meets any rule here
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_tokens"]) for r in docs.collect())
    ids = [i for _, i, _ in got]
    assert 70 in ids and 74 in ids and 72 in ids and ids.count(72) == 1 and len(ids) < len(ODD) + len(more)
    assert not {1, 2, 3, 9} & set(ids) and {4, 5, 8} <= set(ids) and ids.count(4) == 1 and items


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_queries_match_their_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11))
