import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from leakscan.llm import vectors, warc
from tests.llm import brute


def _vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    n = 1000
    for b in base[:8]:
        for _ in range(12):
            rows.append((n, (b * 3 + rng.normal(size=8) * rng.choice([0.02, 0.3, 0.5])).tolist()))
            n += 1
    rows += [(2000 + i, base[0].tolist()) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] + [1.0] * 7), (3003, [None] + [1.0] * 7), (3004, []), (3005, [float("inf")] * 8), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (0, base[0].tolist())]
    return rows


def _want(rows, threshold):
    own = dict(rows)
    ok = {i: np.array(v, float) for i, v in own.items() if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if len(a) == len(b) else -1
    linked = [(a, b) for a in ok for b in ok if a < b and cos(ok[a], ok[b]) >= threshold]
    root = brute.components(own, linked)
    n = {i: sum(i in e for e in linked) for i in own}
    return {i: (n[i], root[i], root[i] == i) for i in own}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_near_vectors(spark, chunk):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, kept int").repartition(3)
    got = vectors.near_vectors(df, 0.95, chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: tuple(r)[1:] for r in got.collect()} == _want(rows, 0.95)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


PAGE = "<html>" + "é payload " * 30


def _pages():
    rng = random.Random(1)
    rows = [(5, "http://a/1", PAGE), (3, "http://a/2", PAGE), (9, None, PAGE), (1, "http://b", "short"), (2, "http://c", "short"), (4, "u", None), (6, "u", ""), (None, "v", PAGE), (3, "http://a/2", PAGE)]
    rows += [(100 + i, f"http://x/{i}", "".join(rng.choice("abc <>\n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    return rows + [(500, "http://long", "z" * 3_000_000), (501, "crlf\r\nX: y", "a\r\n\r\nb" * 50)]


def test_warc(spark, tmp_path):
    rows = _pages()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string").repartition(3)
    warc.write(pages, str(tmp_path / "w"))
    out = warc.read(spark, str(tmp_path / "w"))
    got = sorted(map(repr, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and i != first[h]
        want.append(repr(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").limit(0).schema and (i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)))
    strip = lambda s: s[s.index("(") :]
    assert [strip(g).replace("page_id=", "").replace("payload_bytes=", "").replace("payload_digest=", "").replace("record_type=", "").replace("refers_to=", "") for g in got] == sorted(want)
    texts = {r.page_id: r.payload for r in out.where("record_type = 'response'").collect()}
    assert texts[500] == b"z" * 3_000_000 and texts[501].decode() == "a\r\n\r\nb" * 50


def test_archives_are_plain_zstandard(spark, tmp_path):
    warc.write(spark.createDataFrame([r for r in _pages() if r[0] is not None], "page_id long, url string, html string"), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*.txt")).read_bytes()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY
    size = struct.unpack("<I", data[4:8])[0]
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with own.stream_reader(data, read_across_frames=True) as r:
        assert r.read(9) == b"WARC/1.1\r"


def test_empty_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def _good():
    return warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest())


def _archive(*records, dictionary=b""):
    lead = struct.pack("<II", warc.DICTIONARY, len(dictionary)) + dictionary
    return lead + b"".join(zstandard.compress(r) for r in records)


def test_dictionary_may_be_compressed():
    words = [b"a page about %d things " % i * 9 for i in range(300)]
    d = zstandard.train_dictionary(4096, words)
    frame = zstandard.ZstdCompressor(dict_data=d).compress(_good())
    for lead in (d.as_bytes(), zstandard.compress(d.as_bytes())):
        assert list(warc.frames(struct.pack("<II", warc.DICTIONARY, len(lead)) + lead + frame)) == [_good()]


@pytest.mark.parametrize(
    "data",
    [_archive(_good())[:-3], b"\x00" * 20, _archive(_good())[:9], struct.pack("<II", 0x184D2A50, 0) + zstandard.compress(_good()), _archive(_good()) + b"junkjunk", struct.pack("<II", warc.DICTIONARY, 99)],
)
def test_bad_archives(data):
    with pytest.raises(warc.BadArchive):
        list(warc.frames(data))


@pytest.mark.parametrize(
    "change",
    [(b"WARC/1.1", b"WARC/9.1"), (b"payload\r\n\r\n", b"paylord\r\n\r\n"), (b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), (b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Type: response", b"no colon"), (b"payload\r\n\r\n", b"payload\r\n\r\n\r\n")],
)
def test_bad_records(change):
    assert warc.parse(_good())["payload"] == b"payload"
    bad = _good().replace(*change)
    assert bad != _good()
    with pytest.raises(warc.BadArchive):
        warc.parse(bad)
