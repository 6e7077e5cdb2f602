"""keep_one where rows repeat a doc_id with other texts."""

import random

from leakscan.llm import simhash
from tests.llm.conftest import prose


def test_one_row_of_every_group_stays(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 80, 10**6) for _ in range(3))
    copies = {a: a.upper(), b: b.upper(), c: c.upper()}  # equal fingerprints
    rows = [
        (1, a), (1, b), (5, copies[a]), (6, copies[b]),  # both groups are led by id 1
        (7, c), (3, copies[c]), (7, prose(random.Random(12), 80, 10**6)),  # id 7 is smallest in one group and not in another
        (8, None), (8, ""), (9, "x y"), (9, "x y"), (None, a), (None, "alone"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    want = [(1, a), (1, b), (3, copies[c]), rows[6], (9, "x y"), (None, a), (None, "alone")]
    blank = [x for x in got if x[0] == 8]
    assert len(blank) == 1 and not blank[0][1]
    assert sorted((x for x in got if x[0] != 8), key=repr) == sorted(want, key=repr)
