"""Odd inputs: nulls, empty tables, ties and clashing names, for operators that the catalog's queries show on clean ones."""

import random
import statistics

import pytest

from ledgerlens.functions import cleaning, dates, entities, scope, terms
from ledgerlens.operators import compare, keyvalue, metadata, profile, requests
from ledgerlens.sinks import reports
from ledgerlens.sources import readers, texts, workbooks
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("a=b:c", ("a=b", "c")), ("a = b", ("a", "b")), ("key:", ("key", None)), ("no pair", ("no pair", None)), (":x", ("", "x")), ("l1:x\ny", ("l1", "x\ny")),
])
def test_pairs_split_at_the_first_colon(spark, text, want):
    x = F.lit(text)
    assert (one(spark, keyvalue.pair_key(x)), one(spark, keyvalue.pair_value(x))) == want


def test_period_kinds(spark):
    got = [tuple(p) for p in one(spark, terms.period_mentions(F.lit("FY2024, 3 years, Q2-2023 and may")))]
    assert [(k, r) for k, _, r in got] == [("year", "2023"), ("quarter", "2 2023"), ("month", "may"), ("fiscal_year", "2024"), ("multi_year", "3")]
    assert one(spark, F.size(terms.period_mentions(F.lit("")))) == 0


def test_cells_lose_control_characters(spark):
    assert one(spark, cleaning.clean_cell(F.lit(" a\tb\x00  c \n"))) == "ab c"
    assert one(spark, cleaning.clean_cell(F.lit(" none "))) is None


@pytest.mark.parametrize("text, want", [
    ("Q1-2024", "2024-02-01"), ("2024-Q4", "2024-11-01"), ("31/02/2023", "2023-02-28"), ("Jan-99", "1999-01-01"), ("5 may 24", "2024-05-05"), ("100000", None), ("44927", "2023-01-01"), ("", None), ("13/13/2020", None),
])
def test_lenient_dates(spark, text, want):
    got = one(spark, dates.lenient_date(F.lit(text)))
    assert (got and str(got.date())) == want


def test_medians_and_moments(spark):
    r = random.Random(4)
    for values in ([3.0], [1.0, 2.0], [r.random() for _ in range(2001)], [5.0] * 400 + [1.0] * 401, [r.randrange(9) * 1.0 for _ in range(1000)], [None, 2.0, None, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        (row,) = profile.numeric_profile(df, ["v"]).collect()
        real = [v for v in values if v is not None]
        assert row["median_value"] == pytest.approx(statistics.median(real)) and row["non_null"] == len(real) and row["nulls"] == len(values) - len(real)
        assert row["std_value"] == pytest.approx(statistics.stdev(real) if len(real) > 1 else 0.0, abs=1e-4)
    (row,) = profile.numeric_profile(spark.createDataFrame([], "v double"), ["v"]).collect()
    assert (row["non_null"], row["median_value"], row["std_value"]) == (0, None, 0.0)


def test_types_of_odd_columns(spark):
    df = spark.createDataFrame([("Yes", "1.5", None, " "), ("YES", "x", None, "2024-01-02"), ("no", "2", None, "3/4/2024")] * 5, "a string, b string, c string, d string")
    got = {r["column_name"]: r["inferred_type"] for r in profile.infer_types(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "boolean", "b": "categorical", "c": "unknown", "d": "date"}
    assert {r["inferred_type"] for r in profile.infer_types(df.limit(0), ["a"]).collect()} == {"unknown"}


def test_names_that_clash(spark):
    names = F.array(*[F.lit(x) for x in ("x", "x", "x_1", "x")])
    assert one(spark, compare.unique_names(names)) == ["x", "x_1", "x_1_1", "x_2"]
    df = spark.createDataFrame([("x", 1, 7, 9), ("x", 2, 8, 9)], "n string, o int, k int, hit int")
    assert sorted((r.unique_name, r.k) for r in compare.numbered_duplicates(df, "n", ["o"], []).collect()) == [("x", 7), ("x_1", 8)]
    got = compare.coverage(df.withColumnRenamed("n", "key"), spark.createDataFrame([(" X",)], "key string"), "key").collect()
    assert [(r.hit, r.present) for r in got] == [(9, True), (9, True)]
    assert compare.coverage_ratio(compare.coverage(df.limit(0), df, "n")).first()["coverage"] == 1.0


def test_tree_of_odd_cells(spark):
    cells = [(1, 0, 0, None), (1, 0, 1, " "), (1, 1, 0, "k:"), (1, 1, 1, "- item"), (1, 1, 2, "• a"), (1, 1, 3, "v"), (2, 0, 0, "only text")]
    df = spark.createDataFrame(cells, "doc int, row_idx int, col_idx int, value string")
    got = sorted((r.doc, r.key, r.value) for r in keyvalue.tree(df, ["doc"]).collect())
    assert got == [(1, "k", "- item"), (1, "• a", "v"), (2, "_content", "only text")]
    assert keyvalue.tree(df.limit(0), ["doc"]).count() == 0


def test_requests_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no numbers"), (4, "1.\n2. real\n(z) lost"), (5, "3. a (Priority: High) b")], "doc int, text string")
    got = [(r.doc, r.id, r.info_request, r.priority) for r in requests.requests(df, "doc", "text").collect()]
    assert got == [(4, "2", "real", "Low"), (5, "3", "a b", "High")]
    assert requests.scope_sections(df, "doc", "text").count() == 0


def test_entities_of_odd_texts(spark):
    assert one(spark, entities.extract_entities(F.lit(None).cast("string"))) == []
    assert one(spark, entities.company_of_scope(F.lit(""))) == "Target Company"
    df = spark.createDataFrame([(None,), ("x",)], "value string")
    assert metadata.entity_analysis(df, []).first()["entity_count"] is None
    assert [tuple(r)[:2] for r in metadata.date_analysis(df, []).collect()] == [(2, 0)]


def test_verdicts(spark):
    got = one(spark, scope.readable_verdict(F.lit('x {"a": {"b": 1}} y')))
    assert (got["source"], got["verdict"]) == ("part", '{"a": {"b": 1}}')
    assert one(spark, scope.readable_verdict(F.lit("{not json}")))["source"] == "fallback"


def test_readers_fall_back_and_tell(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("name;key\nx;1\n")
    (tmp_path / "b.xlsx").write_bytes(b"\x00\x01\xff")
    (tmp_path / "c.csv").write_bytes("näme|k\né|2\n".encode("cp1252"))
    files = workbooks.listing(spark, str(tmp_path), "*")
    cells = readers.cells(files)
    got = {r.file_path.rsplit("/", 1)[1]: (r.status, r.n_cells) for r in readers.file_status(cells).collect()}
    assert got == {"a.xlsx": ("success", 4), "b.xlsx": ("error", 0), "c.csv": ("success", 4)}
    assert {r.value for r in cells.where("vtype = 'number'").collect()} == {"1", "2"}
    assert {r.value for r in cells.where("file_path like '%c.csv'").collect()} == {"näme", "k", "é", "2"}
    assert readers.cells(files.limit(0)).count() == 0


def test_tables_as_cells(spark):
    df = spark.createDataFrame([(f"r{k}", str(k)) for k in range(20)], "a string, b string").repartition(3)
    got = texts.as_cells(df, "f").collect()
    assert {(r.row_idx, r.col_idx) for r in got} == {(r, c) for r in range(21) for c in range(2)}
    assert {r.value for r in got if not r.row_idx} == {"a", "b"}
    by_row = {}
    for r in got:
        by_row.setdefault(r.row_idx, []).append((r.col_idx, r.value))
    assert all(dict(v)[0] == "r" + dict(v)[1] for k, v in by_row.items() if k)


def test_merged_cells_and_formulas(spark):
    import io
    import zipfile

    from ledgerlens.sinks.workbooks import _book
    import pandas as pd

    book = _book(pd.DataFrame([("s", 0, 0, "t", "text"), ("s", 3, 2, "5", "number")], columns=["sheet_name", "row_idx", "col_idx", "value", "vtype"]))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            part = a.read(n).decode()
            if n.endswith("sheet1.xml"):
                part = part.replace("<v>5</v>", "<f>2+3</f><v>5</v>").replace("</sheetData>", '</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells>')
            b.writestr(n, part)
    df = spark.createDataFrame([("f", bytearray(out.getvalue())), ("g", bytearray(b"no"))], "path string, content binary")
    (row,) = workbooks.sheet_facts(df).collect()
    assert (row.n_rows, row.n_cols, row.has_formulas, [tuple(m) for m in row.merged]) == (4, 3, True, [("A1:C1", 0, 0, 0, 2)])


def test_reports_escape(spark):
    df = spark.createDataFrame([("<f>", "success", "a&b", "structured")], "file_name string, status string, sheet_name string, structure string")
    html = reports.file_report(df).first()["html"]
    assert "&lt;f&gt;" in html and "a&amp;b" in html and "<f>" not in html


def test_names_meet_by_rare_words(spark):
    import itertools
    import random

    from ledgerlens.functions.entities import related_pairs

    rng = random.Random(2)
    names = {" ".join(rng.sample(["limited", "alpha", "beta", "gamma", "delta", "omega", "steel", "works", "north"], rng.randrange(1, 6))).title() for _ in range(60)} | {"Limited", " Alpha  beta "}
    got = {tuple(r) for r in related_pairs(spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "n string"), "n").collect()}
    words = {n: set(n.lower().split()) for n in names}
    assert got == {(a, b) for a, b in itertools.permutations(names, 2) if len(words[a] & words[b]) / len(words[a]) > 0.3}
    # a word that all names have brings no pairs together
    many = spark.range(3000).selectExpr("concat('Limited A', id, ' B', id, ' C', id) AS n")
    assert related_pairs(many, "n").count() == 0


@pytest.mark.parametrize("text", ["12  March  2024", "due 12  March  2024", "due 12 March 2024"])
def test_dates_with_several_blanks(spark, text):
    assert str(spark.createDataFrame([(text,)], "v string").select(dates.lenient_date(F.col("v")).cast("date")).first()[0]) == "2024-03-12"


def _tasks_and_moves(df):
    """Partitions of a result, and exchanges of its plan as it is before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return df.rdd.getNumPartitions(), plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_requests_move_once_and_are_dealt_to_all_tasks(spark):
    text = "lost\n**A**\nafter\n1. (a) first\n12\n(b) second\n(g) no\n2.\nGenerates x\n**B**\n3) goes on\n7. last (Priority: Low)\n\n**C** more"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1. x\n1. y")], "doc int, text string").coalesce(1)
    found = requests.requests(df, "doc", "text")
    got = sorted((r.doc, r.ord, r.id, r.info_request) for r in found.collect())
    assert got == [(1, 1.0, "1", "(a) first\n12\n(b) second\nGenerates x"), (1, 2.0, "7", "last"), (4, 1.0, "1", "x"), (4, 2.0, "1", "y")]
    # no window over lines: one exchange that deals texts, here a task a document though the input has one
    assert _tasks_and_moves(found) == (4, 1)
    sections = spark.createDataFrame([(1, 5, "Tax matters"), (1, 2, "Revenue"), (1, 9, "Cash"), (2, 1, "Tax")], "doc int, ord int, name string")
    headed = requests.with_headers(found, sections, "doc")
    assert sorted((r.doc, r.ord, r.info_request) for r in headed.collect() if r.id == "") == [(1, 0.5, "**REVENUE ANALYSIS**"), (1, 1.5, "**TAX MATTERS**")]
    assert _tasks_and_moves(headed) == (8, 2)
    assert _tasks_and_moves(requests.in_sections(headed, "doc")) == (8, 2)
    assert _tasks_and_moves(requests.section_sheet(headed, "doc")) == (8, 2)


def test_tree_moves_cells_once(spark):
    cells = spark.createDataFrame([(1, 0, 0, "x:"), (1, 0, 1, "y:"), (1, 0, 2, "z"), (1, 1, 0, "ALL SALES"), (1, 2, 0, "Net Sales"), (1, 3, 0, "k: 1"), (1, 4, 0, "ALL COSTS"), (1, 5, 0, "k: 2")], "doc int, row_idx int, col_idx int, value string").coalesce(1)
    found = keyvalue.tree(cells, ["doc"])
    got = sorted(((r.section, r.subsection, r.key, r.value) for r in found.collect()), key=repr)
    assert got == sorted([(None, None, "x", None), (None, None, "y", "z"), ("ALL SALES", None, None, None), ("ALL SALES", "Net Sales", None, None), ("ALL SALES", "Net Sales", "k", "1"), ("ALL COSTS", None, None, None), ("ALL COSTS", None, "k", "2")], key=repr)
    assert _tasks_and_moves(found) == (8, 1)


def test_requirement_rows_are_dealt_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(1, k, "Section", f"s{k}") for k in range(9)] + [(1, k, "Requirement", f"r{k}") for k in range(9)], "doc int, row_no int, column string, value string").coalesce(1)
    found = texts.requirement_rows(rows, ["doc"])
    assert sorted((r.id, r.section, r.requirement) for r in found.collect()) == [(str(k), f"s{k}", f"r{k}") for k in range(9)]
    assert _tasks_and_moves(found) == (8, 1)


def test_customers_are_dealt_before_they_are_unpacked(spark):
    """Else the task that reads a file holds all cells of it until they are moved."""
    from ledgerlens.plans import sheets

    for q, moves in ((sheets.src_requirement_rows, 2), (sheets.kv_tree, 1)):
        found = q(spark, "/root/testdata/sf0.001")
        assert found.count() and _tasks_and_moves(found) == (8, moves)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        # children stand below
        assert "Exchange hashpartitioning(c_custkey" in plan.rpartition("Generate ")[2]


def test_requirements_of_one_file_are_searched_by_all_tasks(spark):
    from ledgerlens.plans import texts as plans

    for q in (plans.req_complexity, plans.req_periods, plans.req_entities):
        assert _tasks_and_moves(q(spark, "/root/testdata/sf0.001"))[0] == 8
