"""Workbooks of the old format: every kind of cell, texts over the ends of records, short and long streams, broken files."""

import datetime
import random
import struct

import pytest

from ledgerlens.plans.old_books import _record, compound, old_book
from ledgerlens.sources import old_workbooks, readers

SHEETS = {"First one": [(0, 0, "Näme"), (0, 1, "n"), (1, 0, "😀 x"), (1, 1, 7), (2, 1, -2.5), (3, 0, datetime.date(2024, 2, 29)), (3, 1, True)], "Empty": [], "B": [(65535, 255, "last"), (0, 0, "Näme")]}
WANT = [
    ("First one", 0, 0, "Näme", "text"), ("First one", 0, 1, "n", "text"), ("First one", 1, 0, "😀 x", "text"), ("First one", 1, 1, "7", "number"), ("First one", 2, 1, "-2.5", "number"),
    ("First one", 3, 0, "2024-02-29T00:00:00", "date"), ("First one", 3, 1, "True", "boolean"), ("B", 65535, 255, "last", "text"), ("B", 0, 0, "Näme", "text"),
]


def test_short_and_long_streams():
    assert len(old_book(SHEETS)) < 4096 and list(old_workbooks.book_cells(old_book(SHEETS))) == WANT
    many = {"s": [(r, c, f"text {r * c}") for r in range(300) for c in range(20)]}
    assert list(old_workbooks.book_cells(old_book(many))) == [("s", r, c, f"text {r * c}", "text") for r in range(300) for c in range(20)]


@pytest.mark.parametrize("room", [16, 17, 23, 64])
def test_texts_over_the_ends_of_records(room):
    random.seed(room)
    texts = ["".join(random.choice("abé漢😀") for _ in range(random.randint(0, 60))) for _ in range(80)]
    cells = [(i, 0, t) for i, t in enumerate(texts)]
    assert [c[3] for c in old_workbooks.book_cells(old_book({"s": cells}, room))] == texts


def test_widths_and_runs_of_shared_texts():
    # narrow letters that go on as wide ones, with runs and spoken text behind them that are cut too
    first = struct.pack("<II", 2, 2) + struct.pack("<HBHI", 6, 4 | 8, 2, 5) + b"abc"
    second = b"\x01" + "déf".encode("utf-16-le") + b"r" * 3
    third = b"r" * 5 + b"spoke" + struct.pack("<HB", 2, 0) + b"ok"
    assert old_workbooks._strings([first, second, third]) == ["abcdéf", "ok"]


def test_numbers_in_four_bytes_and_formulas():
    short = lambda v, hundredth: (v << 2 & 0xFFFFFFFF) | 2 | hundredth
    upper = struct.unpack("<II", struct.pack("<d", 0.75))[1]
    extra = _record(0x27E, struct.pack("<HHHI", 0, 0, 0, short(-12345, 1))) + _record(0xBD, struct.pack("<HHHIHIH", 1, 2, 0, short(9, 0), 0, upper & 0xFFFFFFFC, 3))
    extra += _record(0x06, struct.pack("<HHHd", 2, 0, 0, 1.5) + bytes(8)) + _record(0x06, struct.pack("<HHH", 2, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + _record(0x207, struct.pack("<HB", 2, 0) + b"hi")
    extra += _record(0x06, struct.pack("<HHH", 2, 2, 0) + b"\1\0\1\0\0\0\xff\xff" + bytes(8)) + _record(0x06, struct.pack("<HHH", 2, 3, 0) + b"\2\0\7\0\0\0\xff\xff" + bytes(8)) + _record(0x06, struct.pack("<HHH", 2, 4, 0) + b"\3\0\0\0\0\0\xff\xff" + bytes(8))
    # a chart in the sheet has cells of its own
    extra += _record(0x809, struct.pack("<HHHHII", 0x600, 0x20, 0, 0, 0, 0)) + _record(0x203, struct.pack("<HHHd", 9, 9, 0, 1.0)) + _record(0x0A) + _record(0x205, struct.pack("<HHHBB", 3, 0, 0, 42, 1))
    assert [c[1:] for c in old_workbooks.book_cells(old_book({"s": []}, extra=extra))] == [
        (0, 0, "-123.45", "number"), (1, 2, "9", "number"), (1, 3, "0.75", "number"), (2, 0, "1.5", "number"), (2, 1, "hi", "text"), (2, 2, "True", "boolean"), (2, 3, "ERROR: 7", "error"), (3, 0, "ERROR: 42", "error"),
    ]


def test_broken_files_end():
    whole = old_book({"s": [(r, 0, f"t{r}") for r in range(900)]})
    random.seed(1)
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(20):
            bad[random.randrange(len(bad))] = random.randrange(256)
        for broken in (bytes(bad), whole[: random.randrange(len(whole))]):
            try:
                list(old_workbooks.book_cells(broken))
            except ValueError:
                pass
    with pytest.raises(ValueError, match="password"):
        list(old_workbooks.book_cells(compound(_record(0x809, struct.pack("<HH", 0x600, 5)) + _record(0x2F, b"\0\0"))))
    with pytest.raises(ValueError, match="without a workbook"):
        list(old_workbooks.book_cells(old_book({"s": []}).replace("Workbook".encode("utf-16-le"), "Workshop".encode("utf-16-le"))))


def test_files_by_what_they_hold(spark):
    book = old_book(SHEETS)
    files = [("a.xls", book), ("b.xlsx", book), ("c.xls", book[:700]), ("d.xls", b"a,b\n1,2\n"), ("e.xls", None)]
    found = readers.cells(spark.createDataFrame(files, "path string, content binary")).cache()
    for path in ("a.xls", "b.xlsx"):
        assert [tuple(r)[1:] for r in found.where(f"file_path = '{path}'").collect()] == WANT
    status = {r.file_path: (r.status, r.n_sheets) for r in readers.file_status(found).collect()}
    assert status["a.xls"] == ("success", 2) and all(status[p][0] == "error" for p in ("c.xls", "d.xls", "e.xls"))
