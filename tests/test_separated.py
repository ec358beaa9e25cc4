"""Separated values against Python's reader: records over line ends, cells of many sizes, files in many splits, bad files."""

import csv
import io
import random

import pytest

from ledgerlens.errors import FileReadError
from ledgerlens.sources import readers, separated, texts


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _cell(rng, sep):
    return "".join(rng.choice(["a", "bé", '"', sep, "\n", "\r\n", "'", " ", "7", "  "]) for _ in range(rng.randrange(6)))


@pytest.mark.parametrize(("sep", "encoding", "end"), [(",", "utf-8", "\n"), (";", "windows-1252", "\r\n"), ("\t", "utf-16", "\n"), ("|", "utf-8-sig", "\r\n")])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, sep, encoding, end):
    rng = random.Random(hash(end) % 7 + len(sep + encoding))
    rows = [["one", "two", "three"], *[[f"k{k}", _cell(rng, sep), _cell(rng, sep)] for k in range(400)]]
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    for r in rows:
        writer.writerow(r)
        if rng.random() < 0.1:
            out.write(end)  # blank lines are no records
    (tmp_path / "x y.csv").write_bytes(out.getvalue().encode(encoding))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = sorted((r.row_no, r.cells, r.error) for r in separated.records(spark, str(tmp_path)).collect())
    assert got == [(k, r, None) for k, r in enumerate(rows)]
    whole = list(separated.whole_rows((tmp_path / "x y.csv").read_bytes()))
    assert whole == [(r, None) for r in rows]


def test_folder_of_all_kinds(spark, tmp_path, small_splits):
    files = {
        "a.csv": b'x,y\n1,"two\nlines"\n5" disk,7\n1,2,3\nlast,"\xc3\xa9"\n', "b.csv": "n;v\r\ncafé;1\r\n".encode("cp1252"), "c.csv": b"", "d.csv": b"only words\n  more  \n\n",
        "e.csv": b'p|q\n1|"open\n2|x\n3|y\n', "f.csv": b"a;b,c\n1;2,3\n", "g.csv": b"\n\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = {
        "a.csv": [(0, ["x", "y"], 0), (1, ["1", "two\nlines"], 0), (2, ['5" disk', "7"], 0), (2, ["1", "2", "3"], 1), (3, ["last", "é"], 0)], "b.csv": [(0, ["n", "v"], 0), (1, ["café", "1"], 0)],
        "d.csv": [(0, ["only words"], 0), (1, ["more"], 0)], "e.csv": [(0, ["p", "q"], 0), (0, ["1", "open"], 1), (1, ["2", "x"], 0), (2, ["3", "y"], 0)], "f.csv": [(0, ["a;b", "c"], 0), (1, ["1;2", "3"], 0)],
    }
    got: dict = {}
    for r in separated.records(spark, str(tmp_path)).collect():
        got.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.row_no, r.cells, int(r.error is not None)))
    assert {k: sorted(v, key=lambda r: (r[0], -r[2] if k == "x" else r[2], r[1])) for k, v in got.items()} == {k: sorted(v, key=lambda r: (r[0], r[2], r[1])) for k, v in want.items()}
    facts = {r.file_path.rsplit("/", 1)[1]: (r.encoding, r.sep, r.width) for r in separated.file_facts(spark, str(tmp_path)).collect()}
    assert facts["b.csv"] == ("windows-1252", ";", 2) and facts["d.csv"] == ("utf-8", None, 1) and facts["f.csv"][1] == ","
    # the same, of contents at hand
    in_task = {(r.file_path, r.row_idx, r.col_idx, r.value) for r in readers.cells(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    by_split = {(r.file_path.rsplit("/", 1)[1], r.row_idx, r.col_idx, r.value) for r in separated.cells(spark, str(tmp_path)).collect()}
    assert in_task == by_split and ("a.csv", 2, None, "BadRecord: 3 cells, the first record has 2") in in_task


def test_facts_joined_by_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "a.csv").write_text('x,y\n' + "".join(f'{k},"l\n{k}"\n' for k in range(300)))
    want = sorted((r.row_no, r.cells) for r in separated.records(spark, str(tmp_path)).collect())
    monkeypatch.setattr(separated, "FILES", 0)
    assert sorted((r.row_no, r.cells) for r in separated.records(spark, str(tmp_path)).collect()) == want and len(want) == 301


def test_very_long_cells(spark, tmp_path):
    long = "x" * 5_000_000 + "\n" + "y" * 5_000_000
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,short\n')
    assert {(r.row_no, r.cells[1]) for r in separated.records(spark, str(tmp_path)).collect()} == {(0, "v"), (1, long), (2, "short")}
    files = spark.createDataFrame([("a.csv", (tmp_path / "a.csv").read_bytes()), ("b.csv", None), ("c.csv", b"p,q\n1,2\n")], "path string, content binary")
    status = {r.file_path: (r.status, r.n_cells) for r in readers.file_status(readers.cells(files)).collect()}
    assert status == {"a.csv": ("success", 6), "b.csv": ("error", 0), "c.csv": ("success", 4)}


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2\n3;4;5\n")
    (tmp_path / "b.csv").write_text('k,v\n7,"y\nz"\n')
    assert sorted(map(tuple, texts.separated(spark, str(tmp_path)).collect())) == [("1", "x"), ("2", None), ("7", "y\nz")]
    (tmp_path / "none").mkdir()
    assert texts.separated(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileReadError):
        readers.folder(spark, str(tmp_path / "gone"))


def test_rows_numbered_as_written(spark):
    df = spark.range(1000).repartition(7).selectExpr("cast(id as string) as a", "if(id % 3 = 0, null, 'x') as b")
    cells = texts.as_cells(df, "f").collect()
    rows = sorted({r.row_idx for r in cells if r.col_idx == 0})
    assert rows == list(range(1001)) and sum(r.col_idx == 1 for r in cells) == 1 + 666
