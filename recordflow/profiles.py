"""Saved sources: <root>/<namespace>/<name>.json or .sql, with _meta.json on the way.

A profile is the deep merge of the _meta.json files from the root down and its own
file, with ${VAR} and ${VAR:-default} filled in.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def substitute(value, env: dict[str, str] | None = None):
    """${VAR} and ${VAR:-default} in every string; an unset variable without default is empty."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] or ""), value) if isinstance(value, str) else value


def deep_merge(a: dict, b: dict) -> dict:
    """b over a; objects are merged, all else is replaced."""
    return a | {k: deep_merge(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}


class Profiles:
    """Profiles of several roots; earlier roots win."""

    def __init__(self, *roots: str):
        self.roots = [Path(r) for r in roots]

    def find(self, name: str) -> Path:
        parts = Path(name)
        if parts.is_absolute() or ".." in parts.parts:
            raise ValueError(f"not a profile name: {name!r}")
        for root in self.roots:
            for ending in (".json", ".sql"):
                p = root / f"{name}{ending}"
                if p.is_file():
                    return p
        raise FileNotFoundError(f"no profile {name!r}")

    def load(self, name: str, env: dict[str, str] | None = None) -> dict:
        """The merged settings; a SQL profile's text is under ``sql``."""
        p = self.find(name)
        root = next(r for r in self.roots if r in p.parents)
        out: dict = {}
        for folder in [root, *(root.joinpath(*p.relative_to(root).parts[:k]) for k in range(1, len(p.relative_to(root).parts)))]:
            meta = folder / "_meta.json"
            if meta.is_file():
                out = deep_merge(out, json.loads(meta.read_text()))
        out = deep_merge(out, json.loads(p.read_text()) if p.suffix == ".json" else {"sql": p.read_text()})
        return substitute(out, env)

    def names(self) -> list[dict]:
        """name, type, description and parameters of every profile."""
        seen: dict[str, dict] = {}
        for root in self.roots:
            for p in sorted([*root.rglob("*.json"), *root.rglob("*.sql")]):
                name = str(p.relative_to(root).with_suffix(""))
                if p.name == "_meta.json" or name in seen:
                    continue
                own = self.load(name)
                text = own.get("sql", "")
                comment = re.findall(r"^--\s*(.*)$", text, re.M)
                seen[name] = {"name": name, "type": "sql" if text else "file" if "pattern" in own else "http", "description": own.get("description") or (comment[0] if comment else ""), "params": sql_parameters(text)}
        return sorted(seen.values(), key=lambda x: x["name"])


def sql_parameters(text: str) -> list[str]:
    """Names of :p and $p markers, in order of appearance, outside strings and comments."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*", " ", text)
    return list(dict.fromkeys(re.findall(r"(?<![:\w])[:$]([A-Za-z_]\w*)", bare)))


def run_sql(spark, text: str, params: dict[str, str] | None = None, limit: int | None = None):
    """A SQL text with its parameters bound as text; missing ones are NULL, so optional filters fall away."""
    names = sql_parameters(text)
    marked = re.sub(r"('(?:[^']|'')*'|--[^\n]*)|(?<![\w$])\$([A-Za-z_]\w*)", lambda m: m[1] or f":{m[2]}", text.rstrip().rstrip(";"))
    out = spark.sql(marked, args={n: (params or {}).get(n) for n in names})
    return out.limit(limit) if limit is not None else out
