import re

import pytest

from leakscan.functions import dialect as D
from leakscan.plans import config as K


@pytest.mark.parametrize(
    "source, n",
    [("a(b)(?:c)(?P<d>e)", 2), (r"\((a)", 1), ("[(]x", 0), ("(?i)(a)(?=b)(?<!c)", 1), ("(?<name>x)", 1)],
)
def test_groups(source, n):
    assert D.groups(source) == n


def test_rule_regex():
    assert D.rule_regex("(?i)abc$") == r"(?iu)abc\z"
    assert D.rule_regex("a(?-i)b") == "ab" and D.rule_regex("(?i:a)b").startswith("(?iu)(?:a)b")
    assert D.rule_regex("(?P<key_ops>x)") == "(x)" and D.rule_regex("(?s:.)+") == D.ascii_words(r"[\s\S]") + "+"
    assert D.rule_regex(r"x\z") == "xz" and D.rule_regex("[[:alnum:]]{2}") == r"[\[:alnum:]]{2}"
    assert D.rule_regex("a{b") == r"a\{b" and D.rule_regex("a{2,3}b{4}c{5,}") == "a{2,3}b{4}c{5,}"
    assert D.rule_regex("[$]$") == r"[$]\z"


def test_globs():
    hit = lambda g, p: bool(re.search(D.glob_regex(g), p))
    assert hit("**/dist/**", "/a/DIST/b.js") and not hit("**/dist/**", "dist/a.js")
    assert hit("**/yarn.lock", "/a/yarn.lock.bak") and hit("**/*.min.js", "/x/y.min.js") and not hit("**/*.min.js", "/x/y.js")


def _ignored(pattern, path):
    r = D.ignore_rule(pattern)
    return bool(re.search(r["pattern"].replace(r"\z", r"\Z"), path))


def test_ignore_rules():
    assert D.ignore_rule("") is None and D.ignore_rule("# x") is None and D.ignore_rule("!") is None and D.ignore_rule("/") is None
    assert _ignored("*.log", "a/b.log") and not _ignored("/b.log", "a/b.log") and _ignored("a/*.log", "a/b.log") and not _ignored("a/*.log", "a/c/b.log")
    assert _ignored("a/**/z", "a/z") and _ignored("a/**/z", "a/b/c/z") and _ignored("**/z", "q/z") and _ignored("a?c", "x/abc") and not _ignored("a?c", "a/c")
    assert D.ignore_rule("!keep/")["negated"] and D.ignore_rule("!keep/")["dir_only"] and _ignored(r"\*x", "*x")


# --- configuration ------------------------------------------------------------------------------


def test_defaults_where_a_file_is_no_configuration(tmp_path):
    assert K.load() == K.DEFAULTS == K.load(tmp_path / "absent.json")
    for text in ("{", "[]", '{"version": 2}', '{"detection": {"minimumConfidenceToWarn": 7}}', '{"ignore": {"paths": "x"}}'):
        (tmp_path / "c.json").write_text(text)
        assert K.load(tmp_path / "c.json") == K.DEFAULTS


def test_merge(tmp_path):
    (tmp_path / "c.json").write_text('{"detection": {"weights": {"regex": 0.5}}, "ignore": {"stopwords": ["abc"], "patterns": ["x+", "("], "useDefaultStopwords": false}}')
    c = K.load(tmp_path / "c.json")
    assert c["detection"]["weights"] == {**K.DEFAULTS["detection"]["weights"], "regex": 0.5} and c["detection"]["debounceMs"] == 300
    assert K.stopwords(c) == ["abc"] and K.patterns(c) == ["x+"]


def test_validation():
    assert K.validate({"version": 1}) == ([], [])
    errors, warnings = K.validate({"detection": {"weights": {"regex": 0.9}, "debounceMs": -1}, "git": {"blockCommitOnHigh": 1}, "customRules": [{"id": "a", "regex": "("}]})
    assert len(errors) == 3 and len(warnings) == 1
