"""Whole-document formats parsed in Python, one file at a time on the executors.

Each parser takes a file's bytes and options and yields records as plain dicts.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree


def _plain(v):
    """Dates as ISO text, inside too."""
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime.date | datetime.time | datetime.datetime) else v


def yaml(data: bytes, options: dict) -> Iterator[dict]:
    """Every document; one whose root is a list gives its elements."""
    import yaml as library

    for doc in library.safe_load_all(data.decode()):
        for record in doc if isinstance(doc, list) else [] if doc is None else [doc]:
            yield _plain(record) if isinstance(record, dict) else {"value": _plain(record)}


def toml(data: bytes, options: dict) -> Iterator[dict]:
    import tomllib

    yield _plain(tomllib.loads(data.decode()))


def markdown(data: bytes, options: dict) -> Iterator[dict]:
    """A front-matter record, then the content; with structure=true headings, code blocks and text."""
    text = data.decode()
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|\Z)", text, re.S)
    if m:
        import yaml as library

        yield {"type": "frontmatter"} | _plain(library.safe_load(m[1]) or {})
        text = text[m.end() :]
    if options.get("structure") not in ("true", True):
        yield {"type": "content", "content": text.strip()}
        return
    code, language, buffer = None, "", []

    def flush():
        body = "\n".join(buffer).strip()
        buffer.clear()
        return [{"type": "text", "content": body}] if body else []

    for line in text.split("\n"):
        if code is not None:
            if line.startswith("```"):
                yield {"type": "code", "language": language, "content": "\n".join(code)}
                code = None
            else:
                code.append(line)
        elif line.startswith("```"):
            yield from flush()
            code, language = [], line[3:].strip()
        elif h := re.match(r"(#{1,6})\s+(.*)", line):
            yield from flush()
            yield {"type": "heading", "level": len(h[1]), "content": h[2].strip()}
        else:
            buffer.append(line)
    yield from flush()
    if code is not None:
        yield {"type": "code", "language": language, "content": "\n".join(code)}


def cell(text: str):
    """A table cell's value: number, boolean, null for nothing, else text."""
    t = text.strip()
    if t == "":
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    return float(t) if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", t) else t


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.text = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            self.rows[-1][-1].append("".join(self.text).strip())
            self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def table(data: bytes, options: dict) -> Iterator[dict]:
    """Pipe, grid, box-drawn and HTML tables; the first row names the columns."""
    text = data.decode()
    if re.search(r"<table", text, re.I):
        parser = _Tables()
        parser.feed(text)
        tables = parser.rows
    else:
        lines = [line.strip() for line in text.split("\n")]
        rows = [[c.strip() for c in re.split(r"[|│┃║]", line.strip("|│┃║"))] for line in lines if re.match(r"[|│┃║]", line) or ("|" in line and not re.match(r"[+\-|:= ]+\Z", line))]
        tables = [[r for r in rows if not all(re.fullmatch(r":?-{2,}:?", c) for c in r)]]
    for rows in tables:
        if rows:
            names = [h or f"Column_{k + 1}" for k, h in enumerate(rows[0])]
            for r in rows[1:]:
                yield {n: cell(r[k]) if k < len(r) else None for k, n in enumerate(names)}


def _as_dict(e: ElementTree.Element):
    """An element as nested values: attributes with @, text beside others as #text, repeated children as a list; only text as text."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for c in e:
        value = _as_dict(c)
        if c.tag in out:
            out[c.tag] = [*(out[c.tag] if isinstance(out[c.tag], list) else [out[c.tag]]), value]
        else:
            out[c.tag] = value
    text = (e.text or "").strip()
    if not out:
        return text or None
    return out | ({"#text": text} if text else {})


def xml(data: bytes, options: dict) -> Iterator[dict]:
    """flatten (default): a record for each element; tree: one nested record; xmltodict: one record by tags; coverage: lines of a Cobertura report."""
    root = ElementTree.fromstring(data)
    mode = options.get("mode", "flatten")
    if mode == "tree":

        def nested(e):
            return {"tag": e.tag} | ({"attributes": dict(e.attrib)} if e.attrib else {}) | ({"text": e.text.strip()} if e.text and e.text.strip() else {}) | ({"children": [nested(c) for c in e]} if len(e) else {})

        yield nested(root)
    elif mode == "xmltodict":
        yield {root.tag: _as_dict(root)}
    elif mode == "coverage":
        for cls in root.iter("class"):
            for line in cls.iter("line"):
                yield {"file": cls.get("filename"), "class": cls.get("name"), "line": int(line.get("number", 0)), "hits": int(line.get("hits", 0)), "branch": line.get("branch") == "true"}
    else:

        def walk(e, path):
            here = f"{path}/{e.tag}"
            yield {"path": here, "tag": e.tag, "attributes": dict(e.attrib), "text": (e.text or "").strip(), "_children_count": len(e)}
            for c in e:
                yield from walk(c, here)

        yield from walk(root, "")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def cell_range(text: str | None) -> tuple[int, int, int, int]:
    """A1:D10, A:D or 1:5 as first row, first column, last row, last column; open ends are very large."""
    far = 1 << 30
    if not text:
        return 1, 1, far, far
    m = re.fullmatch(r"([A-Za-z]*)(\d*)(?::([A-Za-z]*)(\d*))?", text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    single = ":" not in text
    c1, r1 = column_number(m[1]) if m[1] else 1, int(m[2] or 1)
    c2 = c1 if single else column_number(m[3]) if m[3] else far
    r2 = r1 if single else int(m[4]) if m[4] else far
    return r1, c1, r2, c2


class Workbook:
    """Cells of a spreadsheet, from the zip's XML parts."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        self.shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = [(s.get("name"), place(targets[s.get(f"{_REL}id")])) for s in book.iter(f"{_NS}sheet")]
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        root = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_NS}numFmt")}
        found = set()
        xfs = root.find(f"{_NS}cellXfs")
        for k, xf in enumerate(xfs if xfs is not None else []):
            n = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, ""))
            if 14 <= n <= 22 or 45 <= n <= 47 or re.search(r"[ymdhs]", code, re.I):
                found.add(k)
        return found

    def sheet(self, which: str | None) -> str:
        if which is None:
            return self.sheets[0][1]
        for name, part in self.sheets:
            if name == which:
                return part
        if which.isdigit() and int(which) < len(self.sheets):
            return self.sheets[int(which)][1]
        raise ValueError(f"no sheet {which!r}")

    def cells(self, part: str) -> Iterator[dict]:
        """row, col, ref, type (s, n, b, d, f), value, formula."""
        for c in self._xml(part).iter(f"{_NS}c"):
            ref = c.get("r")
            m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
            kind, v, f = c.get("t", "n"), c.find(f"{_NS}v"), c.find(f"{_NS}f")
            raw = v.text if v is not None else None
            if kind == "inlineStr":
                raw, kind = "".join(t.text or "" for t in c.iter(f"{_NS}t")), "str"
            if raw is None and f is None:
                continue
            value: object = raw
            shown = "s"
            if kind == "s":
                value = self.shared[int(raw)]
            elif kind == "b":
                value, shown = raw == "1", "b"
            elif kind == "n" and raw is not None:
                x = float(raw)
                value, shown = (int(x) if x.is_integer() and "." not in raw else x), "n"
                if int(c.get("s", 0)) in self.dates:
                    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=x)
                    value, shown = (moment.date() if x.is_integer() else moment.replace(microsecond=0)).isoformat(), "d"
            yield {"row": int(m[2]), "col": column_number(m[1]), "ref": ref, "type": "f" if f is not None else shown, "value": value, "formula": f"={f.text}" if f is not None and f.text else None}

    def merged(self, part: str) -> list[tuple[int, int, int, int]]:
        return [cell_range(m.get("ref")) for m in self._xml(part).iter(f"{_NS}mergeCell")]


def xlsx(data: bytes, options: dict) -> Iterator[dict]:
    """mode simple (default), stats, raw or table."""
    book = Workbook(data)
    mode = options.get("mode", "simple")
    if mode == "stats":
        for k, (name, part) in enumerate(book.sheets):
            cells = list(book.cells(part))
            yield {"sheet": name, "index": k, "rows": max((c["row"] for c in cells), default=0), "columns": max((c["col"] for c in cells), default=0), "cells": len(cells), "merged": len(book.merged(part))}
        return
    part = book.sheet(options.get("sheet"))
    r1, c1, r2, c2 = cell_range(options.get("range"))
    cells = [c for c in book.cells(part) if r1 <= c["row"] <= r2 and c1 <= c["col"] <= c2]
    if mode == "raw":
        for c in cells:
            yield {k: str(v) if k == "value" and v is not None else v for k, v in c.items()}
        return
    grid = {(c["row"], c["col"]): c["value"] for c in cells}
    if options.get("merge_strategy") == "fill":
        for a, b, x, y in book.merged(part):
            for r in range(a, x + 1):
                for k in range(b, y + 1):
                    grid.setdefault((r, k), grid.get((a, b)))
    if not grid:
        return
    rows, columns = sorted({r for r, _ in grid}), range(min(c for _, c in grid), max(c for _, c in grid) + 1)
    if mode == "table" and options.get("header_col"):
        head = column_number(options["header_col"])
        for k in columns:
            if k > head:
                yield {str(grid.get((r, head)) or f"Column_{r}"): grid.get((r, k)) for r in rows}
        return
    first = int(options.get("header_row") or 0) or rows[0] + int(options.get("skip_rows") or 0)
    names = [str(grid.get((first, k)) if grid.get((first, k)) is not None else f"Column_{i + 1}") for i, k in enumerate(columns)]
    for r in range(first + 1, rows[-1] + 1):
        record = {n: grid.get((r, k)) for n, k in zip(names, columns, strict=True)}
        if any(v is not None for v in record.values()):
            yield record


def lcov(data: bytes, options: dict) -> Iterator[dict]:
    """Raw coverage facts: kind file, function, line or branch, with the file and line numbers."""
    file, starts = "", {}
    for line in data.decode().splitlines():
        tag, _, rest = line.partition(":")
        p = rest.split(",")
        if tag == "SF":
            file, starts = rest, {}
        elif tag == "FN":
            end = int(p[1]) if len(p) > 2 and p[1].isdigit() else None
            starts[p[-1]] = (int(p[0]), end)
        elif tag == "FNDA":
            s, e = starts.get(p[1], (None, None))
            yield {"kind": "function", "file": file, "name": p[1], "line": s, "end": e, "hits": int(p[0])}
        elif tag == "DA":
            yield {"kind": "line", "file": file, "name": None, "line": int(p[0]), "end": None, "hits": int(p[1])}
        elif tag == "BRDA":
            yield {"kind": "branch", "file": file, "name": f"{p[1]}.{p[2]}", "line": int(p[0]), "end": None, "hits": 0 if p[3] == "-" else int(p[3])}


PARSERS = {"yaml": yaml, "toml": toml, "markdown": markdown, "table": table, "xml": xml, "xlsx": xlsx, "lcov": lcov}


def records(name: str, data: bytes, options: dict) -> list[str]:
    """A file's records as JSON text."""
    return [json.dumps(r, ensure_ascii=False) for r in PARSERS[name](data, options)]
