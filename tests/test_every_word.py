"""Queries over words of any alphabet, against brute force in Python."""

import re

from leakscan.functions import fixed
from leakscan.queries import QUERIES

WORDS = """
été Straße FUSSGÄNGER mañana_Key clé-secrète çà_token example été-example dummyé ÉDUMMY your_clé_token my-token-é <clé> [schlüssel] {contraseña} <a ééééééééé éééééééé ééééééé
ñññññññññ test-é test_abc passwordé PASSWORD123 nullé null ſtub STUB Key İstanbul ıx ﬁn ŉ ΑΣ 中文 \U0001f600 \U0001f600ab fixture é your token ééabc abcé aß_B ab_cd --- éé
""".split(" ")
WORDS = [w for part in WORDS for w in part.strip("\n").split("\n") if w]


def factor(word):
    space = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
    out = 1.0
    for _, p, f in fixed.PLACEHOLDERS:
        p = p.replace(r"[-_\s]", f"[-_{space}]").replace(r"\s", f"[{space}]").replace(r"\z", r"\Z")
        if re.search(p, word, re.ASCII):
            out = min(out, f)
    return out


def run(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[::2])), (2, "\n".join(WORDS[1::2])), (3, None)], "doc_id long, text string").write.parquet(path)
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}


def test_placeholders_of_every_word(spark, tmp_path):
    assert run(spark, tmp_path, "f5_a11_placeholders_every_word") == {w: (factor(w),) for w in WORDS}


def test_names_of_every_word(spark, tmp_path):
    slug = lambda w: re.sub("[^a-z0-9]+", "-", w.lower()).strip("-")
    segment = lambda w: re.sub("[^A-Z0-9]+", "_", w.upper()).strip("_")
    assert run(spark, tmp_path, "p18_p19_names_every_word") == {w: (slug(w), segment(w)) for w in WORDS}
