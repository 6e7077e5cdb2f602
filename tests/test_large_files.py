"""Files over the size limit of staged ones are part of a workspace and are scanned."""

from leakscan.plans.scan import Scanner
from leakscan.sources import files as S


def test_large_file_of_a_workspace_is_scanned(spark, tmp_path):
    rules = {"rules": [{"id": "acme-token", "description": "Acme", "regex": r"(acme_[0-9a-zA-Z]{20})", "entropy": 3.0, "secretGroup": 1, "keywords": ["acme_"]}]}
    line, at = "x = 1  # nothing to see on this line of the file\n", 230_000
    text = line * at + 'const paymentToken = "acme_aB3dE5fG7hJ9kL1mN2pQ";\n'
    assert len(text) > S.MOST_BYTES
    (tmp_path / "large.ts").write_text(text)
    found = Scanner.default(spark, rules=rules).findings(S.workspace(spark, str(tmp_path))).select("file_uri", "line_no", "rule_id").collect()
    assert [(r.file_uri.rsplit("/", 1)[1], r.line_no, r.rule_id) for r in found] == [("large.ts", at, "acme-token")]
