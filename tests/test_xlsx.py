"""The data source of workbooks: rows, pushed filters, ranges, and files that are broken."""

import io
import zipfile

import pyarrow as pa
import pytest

from ledgerlens.errors import ConfigurationError
from ledgerlens.sinks import workbooks as sink
from ledgerlens.sources import texts, workbooks, xlsx

CELLS = workbooks.CELLS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    xlsx.register(spark)
    top = tmp_path_factory.mktemp("books")
    cells = [(f"b{k}", s, r, c, f"{k}{s}{r}{c}", "text") for k in range(3) for s in ("one", "two") for r in range(6) for c in range(4)]
    for path, content in sink.workbooks(spark.createDataFrame(cells, CELLS)).collect():
        (top / f"{path}.xlsx").write_bytes(content)
    (top / "notes.txt").write_text("no workbook")
    return top


def test_rows_are_those_of_the_reader_of_contents(spark, folder):
    got = spark.read.format("xlsx").load(str(folder))
    want = workbooks.workbook_cells(workbooks.listing(spark, str(folder)))
    bare = lambda df: sorted((r.file_path.rsplit("/", 1)[1], *tuple(r)[1:]) for r in df.collect())
    assert bare(got) == bare(want) and got.count() == 3 * 2 * 24 and got.rdd.getNumPartitions() == 3


def test_filters_are_pushed(spark, folder):
    df = spark.read.format("xlsx").load(str(folder)).where("sheet_name = 'two' and row_idx >= 4 and col_idx < 2 and value <> '0two40'")
    assert sorted(r.value for r in df.collect()) == sorted(f"{k}two{r}{c}" for k in range(3) for r in (4, 5) for c in (0, 1) if (k, r, c) != (0, 4, 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") :].splitlines()[0] if "Filter" in plan else ""
    assert "0two40" in kept and "= two)" not in kept and ">= 4" not in kept and "< 2" not in kept


def test_sheets_that_are_not_asked_for_stay_zipped(spark, folder, tmp_path):
    whole = zipfile.ZipFile(folder / "b0.xlsx")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in whole.namelist():
            z.writestr(n, b"<broken" if n.endswith("sheet1.xml") else whole.read(n))
    (tmp_path / "half.xlsx").write_bytes(out.getvalue())
    df = spark.read.format("xlsx").load(str(tmp_path))
    assert df.where("sheet_name in ('two', 'three')").count() == 24 and df.where("sheet_name is null").first().vtype == "error"
    assert spark.read.format("xlsx").option("sheet", "two").option("range", "B2:C3").load(str(tmp_path)).count() == 4


def test_ranges_and_options(spark, folder, tmp_path):
    assert xlsx.range_bounds("b:AA") == {"row_idx": (0, 1 << 31), "col_idx": (1, 26)} and xlsx.range_bounds("C3") == {"row_idx": (2, 2), "col_idx": (2, 2)}
    with pytest.raises(ConfigurationError):
        xlsx.range_bounds("3:4")
    one = spark.read.format("xlsx").option("range", "A1").load(str(folder / "b1.xlsx"))
    assert sorted(r.value for r in one.collect()) == ["1one00", "1two00"]
    (tmp_path / "bad one.xlsx").write_bytes(b"PK no")
    assert [r.vtype for r in spark.read.format("xlsx").load(f"file://{tmp_path}").collect()] == ["error"]
    with pytest.raises(Exception, match="no such folder"):
        spark.read.format("xlsx").load(str(tmp_path / "gone")).count()


def test_many_small_workbooks_share_batches(spark):
    # a call, a frame and a batch for each file made 900,000 small files too slow
    cells = [(f"f{k}.xlsx", s, r, c, f"{k}-{r}-{c}", "text") for k in range(300) for s in ("b", "a") for r in (3, 0) for c in (1, 0)]
    made = sink.workbooks(spark.createDataFrame(cells, CELLS).repartition(7))
    assert made.count() == 300
    found = workbooks.workbook_cells(made.coalesce(1))
    assert sorted(map(tuple, found.collect())) == sorted(cells)
    assert found.select("file_path").distinct().count() == 300
    batches = list(workbooks.cell_batches(iter([pa.record_batch({"path": [str(k) for k in range(99)], "content": [b""] * 99})]), lambda p, c: [(p, "s", 0, 0, "v", "text")]))
    assert [b.num_rows for b in batches] == [99]


def test_request_values_makes_cells_once(spark):
    cells = spark.createDataFrame([("f", "s", 0, 0, "Listing", "text"), ("f", "s", 2, 0, " Section ", "text"), ("f", "s", 2, 1, "Requirement", "text"), ("f", "s", 3, 1, "a", "text"), ("f", "s", 3, 2, "lost", "text"), ("f", "s", 5, 0, "b", "text"),
                                   ("f", "t", 0, 0, "none", "text"), ("f", None, None, None, "broken", "error")], CELLS)
    found = texts.request_values(cells.mapInArrow(lambda batches: batches, CELLS))
    assert sorted(map(tuple, found.collect())) == [("f", "s", 1, "Requirement", "a"), ("f", "s", 3, "Section", "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
