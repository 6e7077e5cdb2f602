import time

import pytest
from pyspark.sql import functions as F

from leakscan.plans.scan import Scanner
from leakscan.sources.state import Conflict, StateStore
from leakscan.streaming.progress import ScanRun

SECRET = 't = "ghp_' + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2" + '"\n'
SCHEMA = "file_uri string, content string"


def test_a_scan_is_cancelled_and_goes_on(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(f"/{i}.py", SECRET + "x = 1\n" * i)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scanner = Scanner.default(spark)
    start = lambda: ScanRun(scanner, files, str(tmp_path / "out"), str(tmp_path / "ck"), ["file_uri", "severity"])
    run, began = start(), time.time()
    while not run.progress["batches"] and time.time() - began < 100:
        time.sleep(0.05)
    done = run.cancel()
    assert 1 <= done["files"] == done["batches"] < 5 and done["lines"] >= 2 * done["files"] and done["findings"] == done["files"]
    assert not run.query.isActive and run.wait() == done
    rest = start().wait()
    assert done["files"] + rest["files"] >= 5  # a batch that was cut is run again
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.file_uri for r in found.collect()) == [f"/{i}.py" for i in range(5)]


def test_one_of_two_writers_fails(spark, tmp_path):
    a, b = StateStore(spark, str(tmp_path / "s")), StateStore(spark, str(tmp_path / "s"))
    assert a.commit("t", spark.range(1), None) == 0
    read = b.versions("t")[-1]
    assert a.commit("t", spark.range(2), read) == 1
    with pytest.raises(Conflict):
        b.commit("t", spark.range(3), read)
    # both passed the first look, and one is renamed first
    b.versions = lambda key: [0]
    with pytest.raises(Conflict, match="another"):
        b.commit("t", spark.range(3), 0)
    assert a.load("t", "id long").agg(F.count("*")).first()[0] == 2 and a.versions("t") == [0, 1]
    assert a.commit("t", spark.range(4), 1) == 2
