import datetime as dt

import pytest

from leakscan.operators import suppress
from leakscan.plans.scan import Scanner
from leakscan.sources.state import StateStore
from leakscan.streaming import scan as ST

SCHEMA = "file_uri string, ts timestamp, content string, changed_lines array<int>"
T0 = dt.datetime(2024, 1, 1, 12)
SECRET = 't = "ghp_' + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2" + '"\n'


def edit(uri, ms, content, changed=None):
    return (uri, T0 + dt.timedelta(milliseconds=ms), content, changed)


@pytest.fixture(scope="module")
def scanner(spark):
    return Scanner.default(spark)


def test_state_store(spark, tmp_path):
    s = StateStore(spark, str(tmp_path / "s"))
    assert not s.has("t") and s.load("t", "a int").count() == 0
    s.save("t", spark.createDataFrame([(1,)], "a int"))
    s.save("t", spark.createDataFrame([(1,), (2,)], "a int"))
    assert s.load("t", "a int").count() == 2 and s.load("t", "a int", before=1).count() == 1 and s.versions("t") == [0, 1]
    s.delete("t")
    assert not s.has("t")
    s.clear()


def test_debounce(spark):
    rows = [edit("/a", 0, "1"), edit("/a", 200, "2"), edit("/b", 250, "b"), edit("/a", 400, "3"), edit("/a", 2000, "4")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.content for r in ST.debounce(df).collect()) == ["3", "4", "b"]
    assert sorted(r.content for r in ST.debounce(df, one_timer=True).collect()) == ["3", "4"]


def test_stream_of_edits(spark, scanner, tmp_path):
    src, state = tmp_path / "in", StateStore(spark, str(tmp_path / "state"))
    run = lambda: ST.start(spark.readStream.schema(SCHEMA).parquet(str(src)), scanner, state, str(tmp_path / "ck")).awaitTermination()
    put = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    put(edit("/a.py", 0, "x = 1\n"), edit("/a.py", 100, SECRET), edit("/b.py", 0, SECRET))
    run()
    assert sorted(r.file_uri for r in ST.results(state).collect()) == ["/a.py", "/b.py"] and state.load("new", ST.RESULT).count() == 2
    put(edit("/a.py", 5000, SECRET), edit("/b.py", 5000, "clean\n"))
    run()
    assert [r.file_uri for r in ST.results(state).collect()] == ["/a.py"] and state.load("new", ST.RESULT).count() == 0


def test_repeated_batch_changes_nothing(spark, scanner, tmp_path):
    state = StateStore(spark, str(tmp_path / "state"))
    files = spark.createDataFrame([edit("/a.py", 0, SECRET)], SCHEMA)
    for _ in range(2):
        ST.merge_batch(scanner, state, files, 0)
    assert state.load("new", ST.RESULT).count() == 1 and ST.results(state).count() == 1


def test_guards(spark):
    rows = [edit("/a", 0, "1"), edit("file:///b", 0, "1", [2]), edit("untitled:c", 0, "1"), edit("C:\\d", 0, "1"), edit("/e", 0, "1", []), edit(None, 0, "1")]
    assert sorted(r.file_uri for r in ST.guarded(spark.createDataFrame(rows, SCHEMA)).collect()) == ["/a", "C:\\d", "file:///b"]


def test_debounced_stream(spark, scanner, tmp_path):
    src, state = tmp_path / "in", StateStore(spark, str(tmp_path / "state"))
    rows = [edit("/a.py", 0, SECRET), edit("/a.py", 100, "x = 1\n"), edit("/b.py", 0, "x = 1\n"), edit("/b.py", 200, SECRET), edit("/c.py", 60_000, SECRET)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src))
    ST.start(spark.readStream.schema(SCHEMA).parquet(str(src)), scanner, state, str(tmp_path / "ck"), gap="300 milliseconds").awaitTermination()
    # /c.py's burst is not over before the watermark passes it
    assert [r.file_uri for r in ST.results(state).collect()] == ["/b.py"]


def test_bases_and_pruning(spark, scanner, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT", 2)
    state = StateStore(spark, str(tmp_path / "state"))
    texts = [("/a.py", SECRET), ("/b.py", SECRET), ("/a.py", "clean\n"), ("/c.py", SECRET), ("/c.py", SECRET)]
    seen = []
    for n, (uri, text) in enumerate(texts):
        for _ in range(2 if n in (1, 3) else 1):  # a batch that is run again, after its base was written
            ST.merge_batch(scanner, state, spark.createDataFrame([edit(uri, n, text)], SCHEMA), n)
        seen.append((sorted(r.file_uri for r in ST.results(state).collect()), state.load("new", ST.RESULT).count()))
    assert seen == [(["/a.py"], 1), (["/a.py", "/b.py"], 1), (["/b.py"], 0), (["/b.py", "/c.py"], 1), (["/b.py", "/c.py"], 0)]
    assert state.versions("base") == [2, 4] and state.versions("scans") == [2, 3, 4]


def test_rows_without_a_uri_are_one_file(spark, scanner, tmp_path):
    state = StateStore(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    ST.merge_batch(scanner, state, batch(edit(None, 0, SECRET), edit("/a", 0, SECRET)), 0)
    assert sorted(str(r.file_uri) for r in ST.results(state).collect()) == ["/a", "None"]
    ST.merge_batch(scanner, state, batch(edit(None, 5, SECRET)), 1)  # nothing new
    assert state.read("new", [1], ST.RESULT).count() == 0 and ST.results(state).count() == 2
    ST.merge_batch(scanner, state, batch(edit(None, 9, "x = 1\n")), 2)
    assert [r.file_uri for r in ST.results(state).collect()] == ["/a"]


def test_replaced_rows_without_a_uri(spark):
    rows = spark.createDataFrame([(None, 1), ("/a", 2), ("/b", 3)], "file_uri string, uri int")
    scanned = spark.createDataFrame([(None,), ("/b",), (None,)], "file_uri string")
    fresh = spark.createDataFrame([(None, 9)], "file_uri string, uri int")
    assert sorted(r.uri for r in suppress.replace_files(rows, scanned, fresh).collect()) == [2, 9]
