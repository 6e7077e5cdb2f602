"""The ids of a text's N best segmentations, against all segmentations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from leakscan.llm import pieces
from leakscan.llm.queries import PIECES, op4_pieces
from tests.llm import brute


def encoded(spark, texts, vocabulary):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r for r in pieces.encode(df, vocabulary).withColumn("n_best", pieces.n_best()).collect()}


def test_lists_equal_brute_force_without_ties(spark):
    rng = random.Random(7)
    names = {a + b + c for a in "▁ab." for b in ["", "a", "b"] for c in ["", "b"]}
    v = pieces.Vocabulary({p: (i, -rng.uniform(1, 6)) for i, p in enumerate(sorted(names))}, None)
    texts = ["".join(rng.choice("ab .") for _ in range(rng.randrange(1, 10))) for _ in range(60)]
    for k, r in encoded(spark, texts, v).items():
        every = brute.segmentations(v, pieces.Encoder(v).marked(texts[k]))
        # a text whose parts repeat has equal scores: then the lists are any of those
        want = every[: len(r.n_best)]
        assert len(r.n_best) == min(4, len(every)) and r.n_best[0] == r.ids
        assert r.scores == pytest.approx([s for s, _ in want])
        assert len({tuple(x) for x in r.n_best}) == len(r.n_best)
        score = {i: s for s, i in every}
        assert [score[tuple(x)] for x in r.n_best] == pytest.approx(r.scores)
        if len({round(s, 9) for s, _ in every[:5]}) == len(every[:5]):
            assert [tuple(x) for x in r.n_best] == [i for _, i in want]


def test_lists_of_odd_texts(spark):
    v = pieces.Vocabulary.load(PIECES)
    texts = [None, "", "a", "the cat", "été \U0001f600 dé", "ab.\ncd", "the the the", "x" * 3000, '"the".']
    for k, r in encoded(spark, texts, PIECES).items():
        assert r.n_best[0] == r.ids and len(r.n_best) == len(r.scores) == len({tuple(x) for x in r.n_best})
        assert all(v.decode(x) == (texts[k] or "") for x in r.n_best)
        for ids, score in zip(r.n_best, r.scores, strict=True):
            plain = [i for i in ids if i not in v.byte_of]
            if len(plain) == len(ids):
                assert sum(v.pieces[v.names[i]][1] for i in ids) == pytest.approx(score)
    assert encoded(spark, [None], PIECES)[0].n_best == [[]]


def test_ties_have_one_rule(spark):
    """Of equal scores the longer last piece goes first, whether the unit is searched alone, with others or as a part of a text."""
    names = ["a", "b", "c", "aa", "ab", "bb", "abb", "aab", "▁", "▁a", "▁aa"]
    v = pieces.Vocabulary({p: (i, -1.0 * len(p)) for i, p in enumerate(names)}, None)
    texts = ["aab", "abb", "aabb", "a ab", "aab abb", "ab" * 20, "aabbab"]
    got = encoded(spark, texts, v)
    for k, t in enumerate(texts):
        unit = pieces.Encoder(v).marked(t)
        if " " not in t:
            assert tuple(got[k].ids) == pieces.search(v, unit, 1)[0][0][1] == pieces.search(v, unit, 4)[0][0][1], t
        assert got[k].n_best[0] == got[k].ids
        ends = [len(v.names[x[-1]]) for x in got[k].n_best]
        assert ends[0] == max(len(n) for n in names if unit.endswith(n))


def test_units_searched_together_equal_the_single_search(spark):
    v = pieces.Vocabulary.load(PIECES)
    rng = random.Random(5)
    letters = [c for c in v.pieces if len(c) == 1][:400]
    units = [pieces.BLANK + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 31))) for _ in range(300)] + ["▁the", "▁", "▁" + "ab" * 15]
    e = pieces.Encoder(v)
    e.text_of = units
    e._solve(units)
    for k, u in enumerate(units):
        ((best, ids),), then = pieces.search(v, u, 1)
        assert (e.score[k], tuple(e.ids[e.begin[k] : e.begin[k] + e.size[k]]), e.gap[k]) == (best, ids, best - then), u


def test_marker_in_a_text(spark):
    """A U+2581 of the text is spelled by its bytes and comes back."""
    texts = ["a▁b", "▁", "▁▁ x ▁y", "▁a", " ▁", "a ▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = pieces.decode(pieces.encode(df, PIECES), PIECES).withColumn("n_best", pieces.n_best()).collect()
    v = pieces.Vocabulary.load(PIECES)
    assert [r.decoded for r in sorted(out, key=lambda r: r.k)] == texts
    assert all(v.decode(x) == r.text for r in out for x in r.n_best)


def test_vocabulary_with_a_marker_inside_a_piece_is_refused():
    with pytest.raises(ValueError, match="marker inside"):
        pieces.Vocabulary({"a": (0, -1.0), "a▁b": (1, -2.0)}, None)


def test_op4_digests_all_lists(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, ""), (3, "a b"), (4, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op4_pieces(spark, str(tmp_path)).collect()}
    want = pieces.encode(docs, PIECES).withColumn("changes", F.to_json("changes")).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert all(got[r.doc_id].ids_sha256 == sha(",".join(map(str, r.ids))) and got[r.doc_id].changes_sha256 == sha(r.changes) and got[r.doc_id].round_trip for r in want)
