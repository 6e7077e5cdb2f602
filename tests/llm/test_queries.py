import pytest

import corpus_pipeline
from leakscan.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(QUERIES[name](spark, DATA), SQL[name])


def test_all_operators_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pipeline"}))
def test_query_covers_its_table(spark, name):
    of = "pages" if name == "op2_urls" else "documents"
    rows = QUERIES[name](spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/{of}.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        if k < 4:
            assert out.columns == columns
        if name == "near duplicates":
            fps = {i: brute.fingerprint(t) for i, t in before.items()}
            own = sorted(fps)
            root = brute.components(own, [(a, b) for i, a in enumerate(own) for b in own[:i] if (fps[a] ^ fps[b]).bit_count() <= 3])
            assert set(after) == {i for i in own if root[i] == i}
        elif name == "repeats":
            want = {i: before[i] if not lost else kept for i, _, lost, kept in brute.substring(sorted(before.items()))}
            assert after == want
        elif name == "contamination":
            assert set(after) == {r[0] for r in brute.contamination(before.items(), bench) if not r[-1]} and all(after[i] == before[i] for i in after)
        elif name == "pieces":
            assert after == before
        docs, before = out, after
