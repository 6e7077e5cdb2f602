import os
import subprocess

import pytest

from leakscan.operators import ignores
from leakscan.plans.scan import Scanner
from leakscan.sources import repository
from leakscan.sources.files import MOST_BYTES


def git(root, *words):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *words], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    git(str(tmp_path), "init", "-q")
    return tmp_path


def contents(spark, root):
    return {r.file_uri.removeprefix(f"{root}/"): r.content for r in repository.staged(spark, str(root)).collect()}


def test_staged_files(spark, repo, monkeypatch):
    assert contents(spark, repo) == {}  # no commit, nothing staged
    monkeypatch.setattr(repository, "FILES_A_TASK", 2)
    for name, text in {"same.py": "a = 1\n", "old.py": "b = 1\n", "gone.py": "c = 1\n", "moved.py": "d = 1\n" * 20}.items():
        (repo / name).write_text(text)
    git(repo, "add", "-A")
    assert sorted(contents(spark, repo)) == ["gone.py", "moved.py", "old.py", "same.py"]  # no commit yet: all are added
    git(repo, "commit", "-qm", "first")
    git(repo, "gc", "-q")  # objects are packed
    (repo / "old.py").write_text("b = 2\n")
    (repo / "dir é").mkdir()
    (repo / "dir é/new one.py").write_text("é = 1\r\n")
    (repo / "empty.py").write_text("")
    (repo / "binary.bin").write_bytes(b"\xff\x00\n\xfe")
    (repo / "large.txt").write_bytes(b"x" * (MOST_BYTES + 1))
    (repo / "edge.txt").write_bytes(b"y" * MOST_BYTES)
    git(repo, "add", "-A")
    git(repo, "rm", "-q", "--cached", "gone.py")
    git(repo, "mv", "moved.py", "elsewhere.py")
    (repo / "old.py").write_text("b = 3  # not staged\n")
    (repo / "untracked.py").write_text("e = 1\n")
    got = contents(spark, repo)
    assert sorted(got) == ["binary.bin", "dir é/new one.py", "edge.txt", "empty.py", "old.py"]
    assert (got["old.py"], got["dir é/new one.py"], got["empty.py"], len(got["edge.txt"])) == ("b = 2\n", "é = 1\r\n", "", MOST_BYTES)


def test_staged_credentials_are_found(spark, repo):
    token = "ghp_" + "aZ3kQ9xW7vB2nM5cL8rT1yU4oP6sD0fG3hJk"
    (repo / "app.py").write_text(f'token = "{token}"\n')
    git(repo, "add", "app.py")
    (repo / "app.py").write_text("token = None\n")  # the index counts, not the folder
    found = Scanner.default(spark).findings(repository.staged(spark, str(repo))).select("file_uri", "line_no", "value").collect()
    assert [tuple(r) for r in found] == [(f"{repo}/app.py", 0, token)]


def test_not_a_repository_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="git"):
        repository.staged(spark, str(tmp_path / "none")).collect()


def test_ignore_files(spark, tmp_path, monkeypatch):
    texts = {"": "*.log\r\n# note\nbuild/\n", "a": "!keep.log\n", "a/b/c": "*.key", "d": "", "e f": "\xe9.txt\n"}
    for folder, text in texts.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_bytes(text.encode())
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/.gitignore").write_text("*")
    (tmp_path / "linked").symlink_to(tmp_path / "a")
    (tmp_path / "g/.gitignore").mkdir(parents=True)  # a folder of that name is no ignore file
    for first in (64, 2, 1):
        monkeypatch.setattr(repository, "FOLDERS_FIRST", first)
        rows = repository.ignore_files(spark, str(tmp_path)).collect()
        assert len(rows) == len(texts) and {r.dir: r.text for r in rows} == texts
        assert all(r.length == len(texts[r.dir].encode()) and r.mtime == (tmp_path / r.dir / ".gitignore").stat().st_mtime_ns for r in rows)


def test_only_changed_ignore_files_are_read_again(spark, tmp_path):
    for folder in "same longer touched gone".split():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / ".gitignore").write_text("one\n")
        os.utime(tmp_path / folder / ".gitignore", ns=(10**18, 10**18))
    marked = [(r.dir, r.mtime, r.length, "kept") for r in repository.ignore_files(spark, str(tmp_path)).collect()]
    known = spark.createDataFrame(marked + marked[:1], "dir string, mtime long, length long, text string")  # a repeated row adds none
    (tmp_path / "longer/.gitignore").write_text("one\ntwo\n")
    os.utime(tmp_path / "longer/.gitignore", ns=(10**18, 10**18))
    os.utime(tmp_path / "touched/.gitignore", ns=(10**18, 10**18 + 1))
    (tmp_path / "gone/.gitignore").unlink()
    (tmp_path / "new").mkdir()
    (tmp_path / "new/.gitignore").write_text("three\n")
    rows = repository.ignore_files(spark, str(tmp_path), known).collect()
    assert len(rows) == 4 and {r.dir: r.text for r in rows} == {"same": "kept", "longer": "one\ntwo\n", "touched": "one\n", "new": "three\n"}


def test_files_that_ignore_files_leave_out(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\nbuild/\n")
    (tmp_path / "a/.gitignore").write_text("!keep.log\n")
    rules = ignores.rules_of(repository.ignore_files(spark, str(tmp_path)))
    want = {f"{tmp_path}/x.log": True, f"file:{tmp_path}/a/keep.log": False, f"{tmp_path}/a/other.log": True, f"{tmp_path}/build/x.py": True, f"{tmp_path}/x.py": False, "/elsewhere/x.log": False, f"{tmp_path}x.log": False, None: False}
    files = spark.createDataFrame([(u, 1, "p") for u in want] * 2, "file_uri string, hit int, path string")  # names that clash, repeated rows
    out = ignores.ignored(files, str(tmp_path), rules).collect()
    assert len(out) == 2 * len(want) and {r.file_uri: r.ignored for r in out} == want and {(r.hit, r.path) for r in out} == {(1, "p")}
    odd = spark.createDataFrame([(None, "*.a"), ("/b/", None), ("c", "")], "dir string, text string")
    assert [(r.dir, r.depth, r.ord) for r in ignores.rules_of(odd).collect()] == [("", 0, 0)]
