"""Workbooks of the old format as test queries need them: shared texts, numbers, dates and truth values, as small as the format allows."""

from __future__ import annotations

import datetime
import struct

FREE, END, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def _record(kind: int, data: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def _shared(texts: list[str], room: int) -> bytes:
    """All texts in a record and those that continue it; a text may be cut anywhere."""
    parts, now = [], struct.pack("<II", len(texts), len(texts))
    for t in texts:
        data = t.encode("utf-16-le")
        if room - len(now) < 5:
            parts, now = [*parts, now], b""
        now += struct.pack("<HB", len(data) // 2, 1)
        while data:
            fits = (room - len(now)) // 2 * 2
            now, data = now + data[:fits], data[fits:]
            if data:
                parts, now = [*parts, now], b"\x01"
    return b"".join(_record(0x3C if i else 0xFC, p) for i, p in enumerate([*parts, now]))


def _cell(row: int, col: int, value, texts: dict[str, int]) -> bytes:
    if isinstance(value, bool):
        return _record(0x205, struct.pack("<HHHBB", row, col, 0, value, 0))
    if isinstance(value, str):
        return _record(0xFD, struct.pack("<HHHI", row, col, 0, texts.setdefault(value, len(texts))))
    if isinstance(value, datetime.date):
        return _record(0x203, struct.pack("<HHHd", row, col, 1, (value - datetime.date(1899, 12, 30)).days))
    return _record(0x203, struct.pack("<HHHd", row, col, 0, value))


def old_book(sheets: dict[str, list[tuple]], room: int = 8224, extra: bytes = b"") -> bytes:
    """A workbook of sheets with (row, column, value) cells. ``extra`` are records put before the first sheet's cells."""
    texts: dict[str, int] = {}
    begin = lambda kind: _record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    bodies = [begin(0x10) + (b"" if i else extra) + b"".join(_cell(*c, texts) for c in cells) + _record(0x0A) for i, cells in enumerate(sheets.values())]
    styles = b"".join(_record(0xE0, struct.pack("<HH16x", 0, f)) for f in (0, 14))
    names = [n.encode("utf-16-le") for n in sheets]
    head, shared = begin(0x05) + styles, _shared(list(texts), room)
    at = len(head) + sum(12 + len(n) for n in names) + len(shared) + 4
    bounds = b""
    for name, body in zip(names, bodies):
        bounds += _record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name) // 2, 1) + name)
        at += len(body)
    return compound(head + bounds + shared + _record(0x0A) + b"".join(bodies))


def compound(stream: bytes) -> bytes:
    """A compound file with one stream, which is in small sectors if it is short."""
    small = len(stream) < 4096
    sectors, chain = [], []

    def put(data: bytes) -> int:
        first = len(sectors)
        sectors.extend(data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512))
        chain.extend([*range(first + 1, len(sectors)), END])
        return first

    start = put(stream)
    mini = put(struct.pack("<128I", *[*range(1, (len(stream) + 63) // 64), END, *[FREE] * (128 - (len(stream) + 63) // 64)])) if small else END
    entry = lambda name, kind, at, size, child: struct.pack("<64sHBBIII36xIQ", name.encode("utf-16-le"), 2 * len(name) + 2, kind, 1, FREE, FREE, child, at, size)
    root = put(entry("Root Entry", 5, start if small else END, len(stream) if small else 0, 1) + entry("Workbook", 2, 0 if small else start, len(stream), FREE))
    n = 1
    while 128 * n < len(chain) + n:
        n += 1
    if n > 109:
        raise ValueError("a workbook that is too large for a test")
    first = len(sectors)
    table = [*chain, *[TABLE] * n]
    table += [FREE] * (128 * n - len(table))
    sectors += [struct.pack("<128I", *table[i : i + 128]) for i in range(0, len(table), 128)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n, root, 0, 4096, mini, int(small), END, 0)
    return head + struct.pack("<109I", *range(first, first + n), *[FREE] * (109 - n)) + b"".join(sectors)
