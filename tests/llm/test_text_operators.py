import random

import pytest
from pyspark.sql import functions as F

from leakscan.llm import common as C
from leakscan.llm import common, decontam, simhash, substring
from tests.llm import brute
from tests.llm.conftest import prose

key = lambda r: tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_substring(docs_df, odd_docs):
    out = substring.remove_repeats(docs_df)
    assert {"lang", "Score"} <= set(out.columns) and out.columns.count("n_words") == 1
    got = out.select("doc_id", "n_words", "n_removed", "kept_text").collect()
    # rows that share an id are versions of one document; here both rows of id 7 are equal
    same(got, brute.substring(odd_docs))


def test_substring_sketch_never_undercounts(spark, docs_df, odd_docs, monkeypatch):
    monkeypatch.setattr(substring, "MAX_BITS", substring.PIECE_BITS)  # a crowded sketch changes nothing
    got = substring.remove_repeats(docs_df).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    same(got, brute.substring(odd_docs))


def test_clean_keeps_untouched_texts(docs_df, odd_docs):
    out = substring.clean(docs_df.select("doc_id", "text", "lang", "source", "n_chars"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in out.collect() if r.doc_id in (3, 5, 7, 100)}
    assert got[3].text == "  \t\n " and got[5].text == dict(odd_docs)[5]
    assert got[7].text == "before it after it" and got[7].n_chars == 18


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring.remove_repeats(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert decontam.contamination(no_docs, items).count() == 0


def test_fingerprints(docs_df, odd_docs):
    got = simhash.fingerprints(docs_df).select("doc_id", "fp").collect()
    same([(r.doc_id, r.fp & (1 << 64) - 1) for r in got], [(i, brute.fingerprint(t)) for i, t in odd_docs])


@pytest.mark.parametrize("tree", [4, 1024])
def test_links(spark, tree):
    """All links within three bits, also where shards are dealt again and cut into several trees."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base[:12]:
        values |= {b ^ 1 << rng.randrange(20) ^ 1 << rng.randrange(64) for _ in range(25)}
    values |= {i for i in range(64)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(5)
    edges = [(r.a, r.b) for r in simhash.links(df, 3, tree).collect()]
    own = sorted(map(signed, values))
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 64 for a, b in edges)
    want = brute.components(own, [(a, b) for i, a in enumerate(own) for b in own[:i] if ((a ^ b) & mask).bit_count() <= 3])
    assert brute.components(own, edges) == want
    assert len(edges) < 60 * len(own)  # stars, not all pairs


def test_near_duplicates(docs_df, odd_docs):
    fps = {(i, t): brute.fingerprint(t) for i, t in odd_docs}
    own = sorted(set(fps.values()))
    root = brute.components(own, [(a, b) for i, a in enumerate(own) for b in own[:i] if (a ^ b).bit_count() <= 3])
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs_df).collect()]
    same(got, [(i, least.get(root[fps[i, t]])) for i, t in odd_docs])


def test_keep_one(docs_df):
    own = docs_df.select("doc_id", "text", "lang", "source", "n_chars")
    out = simhash.keep_one(own)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == own.columns and ids.count(7) == 1 and 1 in ids and 2 not in ids and 301 not in ids and 300 in ids


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5000, 5000)]
    df = spark.createDataFrame(chain, "a long, b long")
    nodes = {x for e in chain if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in common.components(df).collect()} == brute.components(nodes, [e for e in chain if e[0] != e[1]])
    assert common.components(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(i, prose(rng, n)) for i, n in enumerate([40, 13, 14, 5, 3, 1, 90, 25])] + [(50, None), (51, "?!"), (52, "W1 w2, W3: w4.")]


def test_contamination(spark, docs_df, odd_docs, items):
    rng = random.Random(4)
    text = dict(items)
    more = [(900 + k, f"{prose(rng, 20)} {' '.join(text[k % 3].upper().split()[j:])} , {prose(rng, 5 * j)}") for k, j in enumerate([0, 0, 1, 20, 27, 1, 2, 10, 26])]
    more += [(950, f"{text[0]} {text[0]}"), (951, f"a {text[4]}"), (952, "w1 w2 w3 w4"), (953, text[6][:200]), (954, f"{prose(rng, 2000)} {text[7]}")]
    rows = [*odd_docs, *more]
    own = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    out = decontam.contamination(own, bench)
    got = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256), "contaminated").collect()
    same(got, brute.contamination(rows, items))


def test_contamination_without_broadcast(spark, odd_docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "LISTED_ROWS", 0)  # a full bitmap only costs time
    rows = [*odd_docs, (900, dict(items)[6])]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same(got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256), "contaminated").collect(), brute.contamination(rows, items))


def test_lookup_with_hot_and_null_keys(spark):
    """A key that most rows hold, keys without a row in the table and null keys, against a plain left join."""
    rows = C.Scratch(spark).save(spark.createDataFrame([(i, 7 if i % 3 else (None if i % 2 else i)) for i in range(3000)], "id long, k long").repartition(3))
    table = C.Scratch(spark).save(spark.createDataFrame([(7, "hot"), (6, "six"), (12, None), (5000, "unused")], "k long, v string"))
    got = C.lookup(rows, table, "k")
    assert got.columns == ["id", "k", "v"] and sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(table, "k", "left").select("id", "k", "v").collect()))
    assert C.lookup(rows.limit(0), table, "k").count() == 0
