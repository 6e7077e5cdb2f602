"""Extra columns named like those an operator works with come back unchanged from what filters or edits documents."""

import time

import pytest

from leakscan.llm import decontam, quality, simhash, substring, warc

NAMES = [
    "_id", "_hash", "_row", "_gone", "_gone_hash", "_own", "_own_id", "_bad", "_meta0", "_label", "_labelled", "_first", "_root", "_n", "_w", "_x",
    "id", "key", "row", "row_key", "rest", "doc", "own", "owner", "none", "fp", "w", "x", "item", "hit_row", "text_hash", "component_id", "contaminated", "n_words", "n_removed", "kept_text",
    "score", "predicted", "prints", "item_ids", "n.hit", "a`b",
]
PASSAGE = " ".join(f"word{i}" for i in range(30))
ROWS = [(1, PASSAGE, 3), (2, f"{PASSAGE} and more of it follows here", 4), (3, "a short and clean text", 5), (4, None, None), (4, None, None), (None, "no id", 6), (5, " ".join(f"item{i}" for i in range(20)), 7)]
BENCH = [("b", " ".join(f"item{i}" for i in range(20)))]


@pytest.fixture(scope="module")
def docs(spark):
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    rows = [(i, t, c, *[f"{n} of {i}" for n in NAMES]) for i, t, c in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {quoted}").repartition(2)


def check(docs, out, texts=None, chars=False):
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES]
        if texts is not None:
            assert r.text in texts
        if chars:
            assert r.n_chars == len(r.text)


def test_keep_one(docs):
    out = simhash.keep_one(docs)
    check(docs, out, [t for _, t, _ in ROWS])
    assert sorted(out.select("doc_id").toPandas()["doc_id"].dropna().tolist()) == [1, 2, 3, 4, 5]


def test_clean(docs):
    out = substring.clean(docs)
    check(docs, out)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.count() == len(ROWS) and got[2] == ("and more of it follows here", 27) and got[1] == (PASSAGE, 3)


def test_remove_repeats(docs):
    out = substring.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")] + ["n_words", "n_removed", "kept_text"]
    for r in out.where("doc_id = 2").collect():
        assert (r.n_removed, r["_own"], r["rest"], r["a`b"]) == (30, "_own of 2", "rest of 2", "a`b of 2")


def test_keep_clean(spark, docs):
    out = decontam.keep_clean(docs, spark.createDataFrame(BENCH, "item_id string, text string"))
    check(docs, out, [t for _, t, _ in ROWS])
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "2", "3", "4", "4", "None"])


def test_classify_and_keep_good(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    for r in out.collect():
        assert all(r[n] == f"{n} of {r.doc_id}" for n in NAMES if n not in ("score", "predicted")) and 0 <= r.score <= 1
    check(docs, quality.keep_good(docs, labels), [t for _, t, _ in ROWS])


def test_archive_reader_is_linear():
    body = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 40, "0" * 64) for i in range(16_000)]
    packer = warc.zstandard.ZstdCompressor(level=1)
    data = [packer.compress(x) for x in body]
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert list(warc.frames(b"".join(data[:n]))) == body[:n]
        took.append(time.perf_counter() - began)
    assert took[1] < 3 and took[1] < 12 * took[0]


def test_records_longer_than_a_part():
    big = bytes(range(256)) * 2000
    packer = warc.zstandard.ZstdCompressor(level=1)
    import os

    body = [os.urandom(warc.PART_BYTES * 3), b"", big, os.urandom(warc.PART_BYTES)]
    assert list(warc.frames(b"".join(packer.compress(x) for x in body))) == body
    with pytest.raises(warc.BadArchive, match="cut"):
        list(warc.frames(packer.compress(body[0])[:-5]))
