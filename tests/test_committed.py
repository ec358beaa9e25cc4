"""Documents written with a commit: versions, failing tasks, and the tracker that is read back."""

import json

import pytest

from ledgerlens.sinks import committed, workbooks
from ledgerlens.sources import texts
from ledgerlens.sources import workbooks as reader


def _names(path):
    return sorted(p.name for p in path.iterdir())


def test_versions_go_on(spark, tmp_path):
    docs = spark.createDataFrame([("A", "one"), ("B", "two"), ("A", "three")], "name string, content string").repartition(3)
    committed.save(docs, str(tmp_path), "IRL")
    committed.save(docs.where("name = 'B'"), str(tmp_path), "IRL")
    assert _names(tmp_path) == ["A_IRL_v1.txt", "A_IRL_v2.txt", "B_IRL_v1.txt", "B_IRL_v2.txt", "version_tracker.json"]
    assert {(tmp_path / f"A_IRL_v{k}.txt").read_text() for k in (1, 2)} == {"one", "three"}
    assert {r.name: r.version for r in committed.tracker(spark, str(tmp_path)).collect()} == {"A": 2, "B": 2}
    # a tracker that is lost or broken gives no number twice
    (tmp_path / "version_tracker.json").write_text("{broken")
    committed.save(docs.where("name = 'B'"), f"file://{tmp_path}", "IRL")
    assert json.loads((tmp_path / "version_tracker.json").read_text()) == {"A": 2, "B": 3}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    committed.save(spark.createDataFrame([("A", "one")], "name string, content string"), str(tmp_path), "SOW")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    rows = spark.range(0, 40, 1, 8).selectExpr("concat('N', id) AS name", "if(id = 33, cast(raise_error('lost') AS string), 'text') AS content")
    with pytest.raises(Exception, match="lost"):
        committed.save(rows, str(tmp_path), "SOW")
    with pytest.raises(Exception, match="no name for a file"):
        committed.save(spark.createDataFrame([("A", "x"), ("../up", "y")], "name string, content string"), str(tmp_path), "SOW")
    # a task that was still running may leave what no reader looks at, until the next commit
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.name != "_pending"} == before
    committed.save(rows.where("id < 8"), str(tmp_path), "SOW")
    assert len(_names(tmp_path)) == 10 and not list(tmp_path.glob("_pending*"))


def test_workbooks_are_written_and_found(spark, tmp_path):
    cells = spark.createDataFrame([("Acme", "s", 0, 0, "x", "text")], reader.CELLS)
    for _ in range(2):
        committed.save(workbooks.workbooks(cells).selectExpr("path AS name", "content"), str(tmp_path), "IRL", "xlsx")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path)).selectExpr("'Acme' AS name", "path", "content")
    latest = texts.latest_file(files.select("name", "path"), "name").first()
    assert latest.version == 2 and latest.path.endswith("Acme_IRL_v2.xlsx")
    assert [r.value for r in reader.workbook_cells(files.where(files.path == latest.path)).collect()] == ["x"]


def test_what_can_not_be_written(spark, tmp_path):
    with pytest.raises(Exception, match="name and a content"):
        committed.save(spark.range(1), str(tmp_path), "IRL")
    committed.register(spark)
    with pytest.raises(Exception, match="only added"):
        spark.createDataFrame([("A", "x")], "name string, content string").write.format("documents").mode("overwrite").save(str(tmp_path))
    (tmp_path / "new").mkdir()
    assert committed.tracker(spark, str(tmp_path / "new")).count() == 0
