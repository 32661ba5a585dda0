"""The pipeline against its stages' brute-force versions, and the queries' names."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from inkfold.llm import decontaminate, mixing, quality_rules

from .conftest import lowered
from .test_operators import distance, oracle


@pytest.fixture(scope="session")
def sf_dir(docs, spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{d}/documents.parquet")
    long = next(r[1] for i, r in enumerate(rows) if i % 10 > 5 and len((r[1] or "").split()) > 100)
    item = " ".join(long.split()[5:25])
    spark.createDataFrame([(1, item), (2, "no such passage stands in any text at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def similar(rows):
    """The first of each component of documents at Jaccard 0.8 of their five-word shingles, by all pairs."""
    sets = []
    for r in rows:
        w = lowered(r[1]).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(list(zip(rows, sets, strict=True)), 2):
        if len(x & y) >= 0.8 * len(x | y):
            up[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    return {find(r[0]) for r in rows}


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_tables(spark, docs, kind, tmp_path):
    """An empty table; null doc_ids and texts, repeated rows, and two rows that differ in their other columns alone."""
    import corpus_pipeline as P

    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    good = " ".join(f"word{i} stands here" for i in range(40))
    odd = [(None, None, None, None, None), (None, good, "en", "s", 1), (5, good + " again and more", "en", "s", 1), (5, good + " again and more", "fr", "t", 2), (6, " ".join(f"other{i} text too" for i in range(50)), None, None, None), (6, " ".join(f"other{i} text too" for i in range(50)), None, None, None)]
    (table.limit(0) if kind == "empty" else spark.createDataFrame(odd, table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert P.run(spark, str(tmp_path)).collect() == got
    if kind == "empty":
        assert got == []
    else:  # one of the copies of a text stays, the one with a doc_id; words are shared out over sources s or t, and null
        assert {r.doc_id for r in got} <= {5, 6} and 5 in {r.doc_id for r in got}
        assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = {r.doc_id: r for r in docs.collect()}
    kept = set(oracle(docs, quality_rules.ORACLE).query("kept").doc_id)
    rows = [tuple(base[d]) for d in kept]
    left = similar(rows)
    items = [decontaminate.split_words((r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d in left if not any(distance(m, decontaminate.split_words((base[d].text or "").encode())) <= len(m) // 5 for m in items)}
    assert len(clean) < len(left) < len(kept) < len(base)
    table = spark.createDataFrame([tuple(base[d]) for d in clean], docs.schema)
    copies = {int(r.doc_id): int(r.copies) for r in oracle(table, mixing.ORACLE).itertuples()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for d in sorted(copies):
        for _ in range(copies[d]):
            ids = np.array([*t.encode(base[d].text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = P.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()


def test_names():
    import __spark_entry__ as E

    found = [m for m in map(re.compile(r"op(\d+)_").match, E.queries()) if m]
    assert sorted(int(m[1]) for m in found) == list(range(1, 11)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())
