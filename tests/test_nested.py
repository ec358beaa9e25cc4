"""Nested results: objects of any depth, trees of regions, rows of tables, and results of files, read by path."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import grid, keyvalue, nested
from ledgerlens.sinks import reports

ROWS = "doc int, path array<string>, value string, pos long"


def _nested(spark, rows, depth=None):
    at = spark.createDataFrame(rows, ROWS).withColumn("value", nested.variant(F.col("value")))
    return {r.doc: r.tree.toPython() for r in nested.nested(at, ["doc"], depth).collect()}


def _by_hand(rows):
    """The same objects by plain dictionaries, a path at a time."""
    docs, last = {}, {}
    for doc, path, value, pos in rows:
        docs.setdefault(doc, {})
        if path:
            key = (doc, tuple(path))
            if pos is None:
                last.setdefault(key, None)
            elif last.get(key) is None or last[key][0] <= pos:
                last[key] = (pos, value)
    inner = {(d, p[:i]) for d, p in last for i in range(1, len(p))} | {(r[0], tuple(r[1])) for r in rows if r[1] and r[3] is None}
    for (doc, path), held in last.items():
        at = docs[doc]
        for name in path[:-1]:
            at = at.setdefault(name, {})
        if (doc, path) in inner:
            at = at.setdefault(path[-1], {})
            if held is not None:
                at["_value"] = held[1]
        else:
            at[path[-1]] = held[1]
    return docs


def test_objects_of_any_depth(spark):
    import random

    random.seed(5)
    rows = [(d, [random.choice("abc") for _ in range(random.randint(1, 6))], random.choice(["x", "y", None]), p if random.random() < 0.8 else None) for d in range(30) for p in range(25)]
    rows += [(90, [], "lost", 1), (91, None, "lost", 1), (92, ["a b", "c.d", "'"], "q", 1), (92, ["a b", "c.d", "'"], "p", 0), (93, ["e"], None, None)]
    assert _nested(spark, rows) == _by_hand(rows) == _nested(spark, rows, 9)
    assert _nested(spark, []) == {}
    with pytest.raises(Exception, match="a path of 3 names"):
        _nested(spark, [(1, ["a", "b", "c"], "x", 1)], 2)


def test_rows_of_a_document_move_once(spark):
    at = spark.createDataFrame([(1, ["a", "b"], "x", 1)], ROWS).withColumn("value", nested.variant(F.col("value")))
    plan = nested.nested(at, ["doc"], 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


CELLS = "file_path string, sheet_name string, row_idx int, col_idx int, value string, vtype string"


def _cells(spark):
    grids = {
        "two": {(0, 4): "CLIENT DETAILS", (1, 4): "Name: abc", (1, 5): "more", (2, 4): "loose", (2, 5): "words", (9, 0): "Name: B x", (10, 0): "Id:", (10, 1): "7"},
        "mixed": {(0, 0): "Item", (0, 1): "Amount", (1, 0): "a", (1, 1): "1", (2, 0): "b", (2, 1): "2", (6, 5): "Total: 3", (6, 6): "units"},
        "words": {(3, 3): "word"},
    }
    rows = [("f", s, r, c, v, "number" if v.isdigit() else "text") for s, g in grids.items() for (r, c), v in g.items()]
    return spark.createDataFrame(rows, CELLS)


def test_regions_are_read_by_themselves(spark):
    cells = _cells(spark)
    found = grid.region_types(cells)
    kinds = grid.structures(cells, found=found)
    assert {r.sheet_name: (r.structure, r.mixed) for r in kinds.collect()} == {"two": ("unstructured", False), "mixed": ("structured", True), "words": ("unknown", False)}
    keys = nested.region_keys(cells, found, kinds.where("structure <> 'structured'"))
    trees = nested.key_trees(keys, grid.SHEET)
    got = {r.sheet_name: r.tree.toPython() for r in trees.collect()}
    # a section may start in its region's first columns, wherever these are in the sheet
    assert got["two"]["Region_1"] == {"CLIENT DETAILS": {"Name": "abc more", "_content": ["loose words"]}}
    assert got["two"]["Region_2"] == {"Name": "B x", "Id": "7"}
    assert got["mixed"] == {"Region_1": {"Total": "3 units"}} and got["words"] == {"_content": ["word"]}
    read = trees.where("sheet_name = 'two'").select(F.variant_get("tree", "$.Region_1['CLIENT DETAILS'].Name", "string").alias("n"), F.try_variant_get("tree", "$.Region_3", "string").alias("none")).first()
    assert (read.n, read.none) == ("abc more", None)
    assert nested.region_keys(cells.limit(0), found.limit(0)).count() == 0


def test_a_key_named_like_a_header(spark):
    rows = [("Other: 1", 0), ("2. Other", 1), ("last: x", 2), ("words", 3), ("PART TWO", 4), ("a: b", 5), ("2. Other", 6), ("again", 7)]
    cells = spark.createDataFrame([(1, r, 0, v) for v, r in rows], "doc int, row_idx int, col_idx int, value string")
    got = nested.key_trees(keyvalue.tree(cells, ["doc"]), ["doc"]).first().tree.toPython()
    assert got == {"Other": {"_value": "1", "last": "x", "_content": ["words", "again"]}, "PART TWO": {"a": "b"}}


def test_records_are_typed(spark):
    values = spark.createDataFrame(
        [("f", "s", c, r, v) for c, vs in {"n": ["1", "2.0", "x", None, "1e30"], "x": ["1.5", "NaN", " 2 ", "inf", ""], "b": ["Yes", "no", "maybe", "TRUE", "N/A"], "t": ["007", "", "a", "b", None], "u": ["1"]}.items() for r, v in enumerate(vs, 1)] + [("f", "s", "n", 0, None)],
        "file_path string, sheet_name string, column_name string, row_no int, value string")
    columns = spark.createDataFrame([("f", "s", c, k) for c, k in [("n", "integer"), ("x", "float"), ("b", "boolean"), ("t", "text")]], "file_path string, sheet_name string, column_name string, data_type string")
    got = {r.row_no: r.record.toPython() for r in nested.records(values, columns).collect()}
    assert got[1] == {"n": 1, "x": 1.5, "b": True, "t": "007", "u": "1"} and isinstance(got[1]["n"], int)
    assert got[2] == {"n": 2, "x": "NaN", "b": False, "t": None} and got[3] == {"n": "x", "x": 2.0, "b": "maybe", "t": "a"}
    assert got[4]["n"] is None and got[4]["b"] is True and got[4]["x"] == "inf" and got[5] == {"n": 1e30, "x": None, "b": None, "t": None}
    assert 0 not in got


def test_json_keeps_nulls(spark):
    at = spark.createDataFrame([(1, ["a", "b"], None, 1), (1, ["a", "c"], "x", 1)], ROWS).withColumn("value", nested.variant(F.col("value")))
    lines = reports.result_json(nested.nested(at, ["doc"]), "tree").collect()
    assert [r.value for r in lines] == ['{"a":{"b":null,"c":"x"}}']
