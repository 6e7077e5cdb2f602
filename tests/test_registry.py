import json

from leakscan.operators import registry as R


def test_group_files(spark, tmp_path):
    (tmp_path / "aws.json").write_text(json.dumps({"name": "AWS", "keywords": ["aws_key", "awsKey"]}, indent=1))
    (tmp_path / "my-group.json").write_text(json.dumps({"name": "My group", "keywords": []}))
    (tmp_path / "notes.txt").write_text("no group")
    folder = str(tmp_path)
    assert sorted(r.slug for r in R.group_files(spark, folder).collect()) == ["aws", "my-group"]
    assert R.group_exists(spark, folder, "aws") and not R.group_exists(spark, folder, "notes")
    assert sorted(map(tuple, R.load_group(spark, folder, "aws").collect())) == [("awsKey", "AWS"), ("aws_key", "AWS")]
    assert R.load_group(spark, folder, "my-group").count() == 0 and R.load_group(spark, folder, "absent").count() == 0


def test_assistants(spark):
    known = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), (None, "N")], "id string, name string")
    extensions = spark.createDataFrame([("a", True), ("a", False), ("b", None), ("x", True), (None, True)], "id string, is_active boolean")
    rows = {r.name: (r.installed, r.active) for r in R.installed_assistants(known, extensions).collect()}
    assert rows == {"A": (True, True), "B": (True, False), "C": (False, False), "N": (False, False)}
    assert [r.id for r in R.active_assistants(known, extensions).collect()] == ["a"]
