"""Keyed stream state: sightings over several runs, scans that replace one another, suppressions that time out."""

import datetime as dt
import time

import pytest

from leakscan.sources.state import scratch, shared_folder, written
from leakscan.streaming import memory as M

T0 = dt.datetime(2024, 1, 1)
HOUR = 3600_000


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, tmp_path):
    """put(rows, schema) adds a file to a folder that a stream reads; run(make, mode) takes what is new and returns all that came out."""

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, schema, out_schema, mode="append", one_batch=False):
        M.run_once(make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"), mode, one_batch)
        return sorted(map(tuple, spark.read.schema(out_schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()), key=repr)

    return put, run


SEEN = "file_uri string, suppression_key string, at timestamp"


def test_sightings_go_on_after_a_restart(feed):
    put, run = feed
    ms = lambda h: int((at(h) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    go = lambda: run(lambda s: M.sightings(s, quiet=10 * HOUR, late=HOUR), SEEN, M.SIGHTING)
    put([("/a", "k", at(0)), ("/a", "k", at(4)), ("/a", "l", at(1)), (None, None, at(2)), ("/a", "k", None)], SEEN)
    first = go()
    assert first == sorted([("/a", "k", "new", ms(0), ms(0), 1), ("/a", "l", "new", ms(1), ms(1), 1), (None, None, "new", ms(2), ms(2), 1)], key=repr)
    # known since the first run; /a l is quiet too long by then, and the watermark ends the null key
    put([("/a", "k", at(12)), ("/b", "k", at(12)), ("/a", "l", at(13.5))], SEEN)
    second = [x for x in go() if x not in first]
    assert second == sorted([("/b", "k", "new", ms(12), ms(12), 1), ("/a", "l", "expired", ms(1), ms(1), 1), ("/a", "l", "new", ms(13.5), ms(13.5), 1), (None, None, "expired", ms(2), ms(2), 1)], key=repr)
    put([("/c", "k", at(40))], SEEN)
    third = [x for x in go() if x not in first and x not in second]
    assert third == sorted([("/c", "k", "new", ms(40), ms(40), 1), ("/a", "k", "expired", ms(0), ms(12), 3), ("/b", "k", "expired", ms(12), ms(12), 1), ("/a", "l", "expired", ms(13.5), ms(13.5), 1)], key=repr)


def test_a_scan_replaces_the_files_last(feed):
    put, run = feed
    go = lambda: run(M.scan_changes, SEEN, M.CHANGE, "update")
    put([("/a", "k", at(0)), ("/a", "l", at(0)), ("/a", "l", at(1)), ("/a", "m", at(1)), ("/b", None, at(0)), ("/a", "k", None)], SEEN)
    assert go() == sorted([("/a", at(0), "k", "new"), ("/a", at(0), "l", "new"), ("/a", at(1), "k", "gone"), ("/a", at(1), "m", "new")], key=repr)
    put([("/a", None, at(3)), ("/b", "k", at(3)), ("/a", "z", at(0.5))], SEEN)  # the last comes too late
    assert [x for x in go() if x[1] == at(3)] == sorted([("/a", at(3), "l", "gone"), ("/a", at(3), "m", "gone"), ("/b", at(3), "k", "new")], key=repr)
    assert len(go()) == 7


EDIT = "suppression_key string, file_uri string, at timestamp, kind string"


def test_suppressions_time_out(feed):
    put, run = feed
    go = lambda: [x[:2] for x in run(lambda s: M.unsuppressed(s, ttl=20_000), EDIT, M.PASSED, one_batch=True)]
    put([("k", None, at(0), "suppress"), ("k", "/a", at(0), "finding"), ("l", "/a", at(0), None)], EDIT)
    assert go() == [("l", "/a")]
    began = time.time()
    put([("k", "/b", at(1), "finding")], EDIT)
    assert time.time() - began > 15 or go() == [("l", "/a")]
    time.sleep(max(0.0, 22 - (time.time() - began)))
    put([("k", "/c", at(2), "finding"), ("l", None, at(2), "suppress"), ("l", None, at(3), "resume"), ("l", "/d", at(3), "finding")], EDIT)
    assert set(go()) >= {("l", "/a"), ("k", "/c"), ("l", "/d")}


def test_the_sessions_provider_comes_back(spark):
    before = spark.conf.get(M._PROVIDER)
    with M.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(M._PROVIDER)
    assert spark.conf.get(M._PROVIDER) == before


def test_scratch_tables_go(spark):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: len(fs.listStatus(folder))
    kept = written(spark.range(3))
    before = count()
    with scratch(spark):
        written(spark.range(5))
        assert written(spark.range(4)).count() == 4 and count() == before + 2
    assert count() == before and kept.count() == 3


def test_state_is_written_once_a_key_and_batch():
    """However often a key expires, or a file is scanned, within a batch."""
    from types import SimpleNamespace as N

    calls = []
    value = lambda: N(get=lambda: None, update=lambda v: calls.append(("value", v)))
    s = M._Sightings(10)
    s.state, s.handle = value(), N(registerTimer=lambda at: calls.append(("timer", at)))
    assert len(list(s.handleInputRows(("f", "k"), [N(at_ms=100 * i) for i in range(5)], None))) == 9
    assert calls == [("value", (400, 400, 1)), ("timer", 410)]
    calls.clear()
    p = M._LastScan()
    p.scanned, p.held = value(), N(iterator=lambda: iter(()), keys=lambda: iter(()), updateValue=lambda k, v: calls.append((k, v)), removeKey=lambda k: calls.append((k, None)))
    rows = [N(at_us=i, at=i, suppression_key=f"k{i % 2}") for i in range(6)]
    assert len(list(p.handleInputRows(("f",), rows, None))) == 11
    assert calls == [(("k1",), (5,)), ("value", (5,))]
