"""Workbooks made and read again, and regions of grids against a flood fill."""

import random

from ledgerlens.operators import grid
from ledgerlens.sinks import workbooks as sink
from ledgerlens.sources import texts, workbooks

CELLS = "file_path string, sheet_name string, row_idx int, col_idx int, value string, vtype string"


def _grid(spark, rows, name="f", sheet="s", at=(0, 0)):
    kind = lambda v: "number" if isinstance(v, (int, float)) else "text"
    cells = [(name, sheet, at[0] + r, at[1] + c, str(v), kind(v)) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(cells, CELLS)


TABLE = [["Company", "Revenue", "Expenses", "Profit"], ["Alpha <&> Co", 10, 4, 6], ["Beta", 20, 9, 11]]


def test_workbook_round_trip(spark):
    cells = _grid(spark, TABLE).unionAll(_grid(spark, [["a", " b "], [None, 2.5]], sheet="t", at=(4, 27))).unionAll(_grid(spark, [["x"]], name="g"))
    back = workbooks.workbook_cells(sink.workbooks(cells))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_no_workbook_gives_an_error_row(spark):
    files = spark.createDataFrame([("a", b"plain"), ("b", None)], "path string, content binary")
    assert {(r["file_path"], r["vtype"]) for r in workbooks.workbook_cells(files).collect()} == {("a", "error"), ("b", "error")}


def test_regions_match_a_flood_fill(spark):
    rng = random.Random(5)
    spots = {(r, c) for r in range(25) for c in range(25) if rng.random() < 0.45}
    cells = spark.createDataFrame([("f", "s", r, c, "v", "text") for r, c in spots] + [("f", "s", 40, 40, "  ", "text")], CELLS)
    want, seen = [], set()
    for spot in sorted(spots):
        if spot in seen:
            continue
        todo, own = [spot], {spot}
        while todo:
            r, c = todo.pop()
            new = ({(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & spots) - own
            own |= new
            todo += new
        seen |= own
        if len(own) > 1:
            rows, cols = [x[0] for x in own], [x[1] for x in own]
            want.append((len(want), min(rows), max(rows), min(cols), max(cols), len(own)))
    assert sorted(tuple(r)[2:] for r in grid.regions(cells).collect()) == want


def test_structures(spark):
    cells = (
        _grid(spark, TABLE, at=(3, 2)).unionAll(_grid(spark, [["Name:", "x"], ["Id:", "y"]], name="kv")).unionAll(_grid(spark, [["lonely"]], name="one"))
        .unionAll(_grid(spark, [[" "]], name="blank"))
    )
    got = {r["file_path"]: r["structure"] for r in grid.structures(cells).collect()}
    assert got["f"] == "structured" and got["one"] == "unknown" and got["blank"] == "unknown"
    inside = grid.region_cells(cells, grid.regions(cells))
    header = {r["file_path"]: r for r in grid.tables(inside).collect()}["f"]
    assert header["header_row"] == 3 and round(header["score"], 4) == 0.9375 and header["fill"] == 1.0
    values = {(r["row_no"], r["column"]): r["value"] for r in grid.table_values(inside, grid.tables(inside)).collect() if r["file_path"] == "f"}
    assert values[2, "Profit"] == "11" and len(values) == 8


def test_empty_grid(spark):
    assert grid.structures(spark.createDataFrame([], CELLS)).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    assert [tuple(r) for r in texts.separated(spark, str(tmp_path / "a.csv")).collect()] == [("1", "2")]
    maps = spark.createDataFrame([('{"a": "b", "c": "d"}',), ("broken",), (None,)], "j string")
    assert sorted(map(tuple, texts.requirements(maps, "j").collect())) == [("a", "b"), ("c", "d")]
    files = spark.createDataFrame([("n", "p/n_v2.xlsx"), ("n", "p/n_v10.xlsx"), ("m", "p/m.xlsx")], "name string, path string")
    assert {r["name"]: (r["path"], r["version"]) for r in texts.latest_file(files, "name").collect()} == {"n": ("p/n_v10.xlsx", 10), "m": ("p/m.xlsx", 0)}


def _flood(spots):
    """[(min_row, max_row, min_col, max_col, area)] of regions of two cells at least, in the order of their first cells."""
    want, seen = [], set()
    for spot in sorted(spots):
        if spot in seen:
            continue
        todo, own = [spot], {spot}
        while todo:
            r, c = todo.pop()
            new = ({(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & spots) - own
            own |= new
            todo += new
        seen |= own
        if len(own) > 1:
            rows, cols = [x[0] for x in own], [x[1] for x in own]
            want.append((min(rows), max(rows), min(cols), max(cols), len(own)))
    return want


def test_regions_of_a_large_sheet_are_united_by_joins(spark, monkeypatch):
    monkeypatch.setattr(grid, "STRIP", 8)
    rng = random.Random(9)
    # noise, a snake of one long path, a full table over many strips, and one of each sheet small enough for a task
    noise = {(r, c) for r in range(40) for c in range(40) if rng.random() < 0.5}
    snake = {(2 * k, c) for k in range(12) for c in range(20)} | {(2 * k + 1, 19 if k % 2 == 0 else 0) for k in range(11)}
    full = {(r, c) for r in range(100) for c in range(3, 6)} | {(60, 2), (60, 7)}
    sheets = {"noise": noise, "snake": snake, "full": full, "small": {(0, 0), (0, 1), (5, 5)}}
    cells = spark.createDataFrame([("f", name, r, c, "v", "text") for name, spots in sheets.items() for r, c in spots] * 2, CELLS)
    for limit in (12, 10**6):
        got: dict = {}
        for r in grid.regions(cells, limit).collect():
            got.setdefault(r.sheet_name, []).append(tuple(r)[2:])
        for name, spots in sheets.items():
            assert sorted(got[name]) == [(k, *x) for k, x in enumerate(_flood(spots))], (name, limit)


def test_components_of_paths_and_keys(spark):
    from ledgerlens.operators.components import components

    edges = [("a", k, k + 1) for k in range(200)] + [("b", 5, 3), ("b", 3, 9), ("b", 7, 7), ("c", 10, 1)] + [("d", 1000 - k, 0) for k in range(50)]
    got = {(r.k, r.node): r.root for r in components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()}
    assert len(got) == 201 + 3 + 2 + 51 and all(got["a", k] == 0 for k in range(201)) and got["b", 9] == 3 and got["c", 10] == 1 and got["d", 990] == 0
    assert components(spark.createDataFrame([], "k string, a long, b long"), ["k"]).collect() == []


def test_cells_meet_regions_by_tiles(spark):
    # ten thousand regions of two cells in one sheet
    spots = [(3 * (k // 100), 3 * (k % 100)) for k in range(10_000)]
    cells = spark.createDataFrame([("f", "s", r, c + d, "v", "text") for r, c in spots for d in (0, 1)], CELLS)
    found = grid.regions(cells)
    inside = grid.region_cells(cells, found)
    assert inside.count() == 20_000 and inside.select("region_id").distinct().count() == 10_000
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "tile_row" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    # a box that goes over many tiles, and cells on its edges
    box = spark.createDataFrame([("f", "s", 7, 60, 130, 15, 32)], "file_path string, sheet_name string, region_id int, min_row int, max_row int, min_col int, max_col int")
    want = sum(60 <= r <= 130 and 15 <= c + d <= 32 for r, c in spots for d in (0, 1))
    assert grid.region_cells(cells, box).count() == want > 100
