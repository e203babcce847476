"""Addresses: [protocol://]path[~format][?parameters], @namespace/name, -, and globs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

#: Compression suffixes, format names by extension.
COMPRESSION = {"gz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd"}
FORMATS = {
    "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "csv", "txt": "csv", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xlsx": "xlsx", "xlsm": "xlsx",
    "xml": "xml", "md": "markdown", "markdown": "markdown", "table": "table", "html": "table", "lcov": "lcov", "info": "lcov", "parquet": "parquet", "orc": "orc", "text": "text",
}


@dataclass(frozen=True)
class Address:
    raw: str
    kind: str  # file, glob, url, profile, stdin
    path: str
    protocol: str | None = None
    format: str | None = None
    compression: str | None = None
    params: dict[str, str] = field(default_factory=dict)


def parse_address(text: str) -> Address:
    """The parts of an address; ValueError if it has no path."""
    raw, rest = text, text.strip()
    if not rest:
        raise ValueError("an address must not be empty")
    protocol = None
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", rest):
        protocol = m[1].lower()
    params: dict[str, str] = {}
    glob_question = protocol is None and not rest.startswith("@") and not re.search(r"\?[^/?*\[]*=", rest)
    if "?" in rest and not glob_question and protocol not in ("http", "https"):
        rest, _, query = rest.partition("?")
        params = dict(parse_qsl(query, keep_blank_values=True))
    fmt = None
    if m := re.search(r"~([A-Za-z0-9_.]+)\Z", rest):
        fmt, rest = FORMATS.get(m[1], m[1]), rest[: m.start()]
    if rest.startswith("@"):
        if "/" not in rest[1:]:
            raise ValueError(f"a profile is @namespace/name: {raw!r}")
        return Address(raw, "profile", rest[1:], None, fmt, None, params)
    if rest in ("-", "stdin"):
        return Address(raw, "stdin", "-", None, fmt or "jsonl", None, params)
    bare = rest.split("?")[0] if protocol in ("http", "https") else rest
    compression = None
    name = bare.rsplit("/", 1)[-1]
    if m := re.search(r"\.([A-Za-z0-9]{1,10})\Z", name):
        if m[1].lower() in COMPRESSION:
            compression, name = COMPRESSION[m[1].lower()], name[: m.start()]
            m = re.search(r"\.([A-Za-z0-9]{1,10})\Z", name)
        if m and fmt is None:
            fmt = FORMATS.get(m[1].lower())
    kind = "url" if protocol in ("http", "https") else "glob" if re.search(r"[*?\[{]", rest) else "file"
    return Address(raw, kind, rest, protocol, fmt or ("json" if kind == "url" else None), compression, params)
