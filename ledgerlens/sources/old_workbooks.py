"""Workbooks of the old binary format (xls) as cells: a compound file of sector chains holds one stream of records.

A file has at most 65,536 rows and 256 columns a sheet, so one task reads it; files are what Spark spreads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ledgerlens.sources.workbooks import DATE_FORMATS, is_date_code, moment

# Fixed values of the file format: the first bytes, what ends a chain of sectors, and numbers of records.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR = 0xFFFFFFFA
SHORT_STREAM = ("workbook", "book")
BOF, EOF, CONTINUE, SHEET, STRINGS, FORMAT, STYLE, EPOCH, LOCKED = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x41E, 0xE0, 0x22, 0x2F
NUMBER, SHORT, SHORTS, TEXT, RICH_TEXT, SHARED_TEXT, FLAG, FORMULA, RESULT = 0x203, 0x27E, 0xBD, 0x204, 0xD6, 0xFD, 0x205, 0x06, 0x207
WORKSHEET, CURRENT_VERSION, DAYS_TO_1904 = 0, 0x600, 1462


def is_old(content) -> bool:
    """Whether a file is a compound file, by its first bytes."""
    return isinstance(content, bytes) and content.startswith(MAGIC)


class _Sectors:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes):
        self.content = content
        shift, self.mini_shift = struct.unpack_from("<HH", content, 30)
        if not (7 <= shift <= 20 and 4 <= self.mini_shift < shift):
            raise ValueError("no such size of sectors")
        self.size = 1 << shift
        root, _, self.cutoff, mini, _, more, n_more = struct.unpack_from("<7I", content, 48)
        tables = list(struct.unpack_from("<109I", content, 76))
        for _ in range(n_more):
            if more >= LAST_SECTOR:
                break
            *found, more = self._numbers(self._sector(more))
            tables += found
        self.next = [n for t in tables if t < LAST_SECTOR for n in self._numbers(self._sector(t))]
        entries = self._chain(root)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        self.mini_next = self._numbers(self._chain(mini)) if mini < LAST_SECTOR else []
        start, length = struct.unpack_from("<II", self.entries[0], 116)
        self.mini = self._chain(start)[:length] if start < LAST_SECTOR else b""

    def _sector(self, n: int) -> bytes:
        return self.content[(n + 1) * self.size : (n + 2) * self.size]

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def _walk(self, start: int, follows: list[int]) -> Iterator[int]:
        for _ in range(len(follows) + 1):
            if start >= LAST_SECTOR:
                return
            yield start
            start = follows[start]
        raise ValueError("a chain of sectors has no end")

    def _chain(self, start: int) -> bytes:
        return b"".join(self._sector(n) for n in self._walk(start, self.next))

    def stream(self, names: tuple[str, ...]) -> bytes:
        for e in self.entries:
            length = struct.unpack_from("<H", e, 64)[0]
            if e[66] == 2 and e[: max(0, min(64, length) - 2)].decode("utf-16-le", "replace").lower() in names:
                start, size = struct.unpack_from("<II", e, 116)
                if size >= self.cutoff:
                    return self._chain(start)[:size]
                step = 1 << self.mini_shift
                return b"".join(self.mini[n * step : (n + 1) * step] for n in self._walk(start, self.mini_next))[:size]
        raise ValueError("a compound file without a workbook")


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + length]
        at += 4 + length


def _text(data: bytes, wide_length: bool, current: bool) -> str:
    """A text within one record; before the current version a byte is a character."""
    n, at = (struct.unpack_from("<H", data)[0], 2) if wide_length else (data[0], 1)
    if not current:
        return data[at : at + n].decode("cp1252", "replace")
    return data[at + 1 : at + 1 + n * (1 + (data[at] & 1))].decode("utf-16-le" if data[at] & 1 else "latin-1", "replace")


def _strings(parts: list[bytes]) -> list[str]:
    """The shared texts, which go over the ends of records: the characters that follow have their own width."""
    out, part, at = [], 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n > 0:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            piece = parts[part][at : at + n]
            at, n, got = at + len(piece), n - len(piece), got + piece
        return got

    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        spoken = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, pieces = flags & 1, []
        while n > 0:
            if at >= len(parts[part]):
                part, at, wide = part + 1, 1, parts[part + 1][0] & 1
            here = min(n, (len(parts[part]) - at) >> wide)
            pieces.append(parts[part][at : at + (here << wide)].decode("utf-16-le" if wide else "latin-1", "surrogatepass"))
            at, n = at + (here << wide), n - here
            if not here and at < len(parts[part]):
                raise ValueError("half a character at the end of a record")
        # a character of two units may be cut by a record's end
        out.append("".join(pieces).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"))
        take(4 * runs + spoken)
    return out


def _short(packed: int) -> float:
    """A number in four bytes: whole, or the upper part of a double; of either maybe a hundredth."""
    if packed & 2:
        value = float((packed - (1 << 32) if packed >> 31 else packed) >> 2)
    else:
        value = struct.unpack("<d", struct.pack("<II", 0, packed & 0xFFFFFFFC))[0]
    return value / 100 if packed & 1 else value


def _number(value: float) -> str:
    return str(int(value)) if value == value and abs(value) < 2.0**53 and value == int(value) else repr(value)


def _globals(stream: bytes):
    """(sheets, texts, styles that are dates, days to add, whether texts have widths)."""
    sheets, styles, dated, days, current, parts, last = [], [], set(DATE_FORMATS), 0, True, [], None
    for kind, data in _records(stream):
        if kind == BOF:
            current = struct.unpack_from("<H", data)[0] >= CURRENT_VERSION
        elif kind == LOCKED:
            raise ValueError("a workbook that is locked by a password")
        elif kind == SHEET and data[5] == WORKSHEET:
            sheets.append((struct.unpack_from("<I", data)[0], _text(data[6:], False, current)))
        elif kind == FORMAT:
            number, code = struct.unpack_from("<H", data)[0], _text(data[2:], current, current)
            (dated.add if is_date_code(code) else dated.discard)(number)
        elif kind == STYLE:
            styles.append(struct.unpack_from("<H", data, 2)[0])
        elif kind == EPOCH:
            days = DAYS_TO_1904 * (struct.unpack_from("<H", data)[0] == 1)
        elif kind == STRINGS or (kind == CONTINUE and last == STRINGS):
            parts.append(data)
        elif kind == EOF:
            break
        last = STRINGS if kind == CONTINUE and last == STRINGS else kind
    return sheets, _strings(parts) if parts else [], [s in dated for s in styles], days, current


def _cells(stream: bytes, at: int, texts: list[str], dated: list[bool], days: int, current: bool) -> Iterator[tuple[int, int, str, str]]:
    asked, depth = None, 0

    def number(style: int, value: float) -> tuple[str, str]:
        if style < len(dated) and dated[style]:
            return moment(value + days).isoformat(), "date"
        return _number(value), "number"

    flag = lambda value, is_error: (f"ERROR: {value}", "error") if is_error else (str(bool(value)), "boolean")
    for kind, data in _records(stream, at):
        # charts within a sheet are parts of their own
        depth += (kind == BOF) - (kind == EOF)
        if depth == 0:
            return
        if depth > 1 or kind not in (NUMBER, SHORT, SHORTS, TEXT, RICH_TEXT, SHARED_TEXT, FLAG, FORMULA, RESULT):
            continue
        if kind == RESULT:
            if asked:
                yield *asked, _text(data, True, current), "text"
            asked = None
            continue
        row, col, style = struct.unpack_from("<HHH", data)
        if kind == NUMBER:
            yield row, col, *number(style, struct.unpack_from("<d", data, 6)[0])
        elif kind == SHORT:
            yield row, col, *number(style, _short(struct.unpack_from("<I", data, 6)[0]))
        elif kind == SHORTS:
            for k, (s, packed) in enumerate(struct.iter_unpack("<HI", data[4:-2])):
                yield row, col + k, *number(s, _short(packed))
        elif kind in (TEXT, RICH_TEXT):
            yield row, col, _text(data[6:], True, current), "text"
        elif kind == SHARED_TEXT:
            yield row, col, texts[struct.unpack_from("<I", data, 6)[0]], "text"
        elif kind == FLAG:
            yield row, col, *flag(data[6], data[7])
        elif data[12:14] != b"\xff\xff":
            yield row, col, *number(style, struct.unpack_from("<d", data, 6)[0])
        elif data[6] == 0:
            asked = (row, col)
        elif data[6] in (1, 2):
            yield row, col, *flag(data[8], data[6] == 2)


def book_cells(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, value, kind) of an old workbook's cells, formulas by the result that was saved.

    Dates are ISO text, truth values ``True`` and ``False``, an error is ``ERROR:`` with its number. What is no such workbook, is broken, or is
    locked raises ``ValueError``, after the cells before it.
    """
    try:
        stream = _Sectors(content).stream(SHORT_STREAM)
        sheets, *rest = _globals(stream)
        for at, name in sheets:
            for cell in _cells(stream, at, *rest):
                yield name, *cell
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"a broken workbook: {e}") from e
