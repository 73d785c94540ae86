"""JSON-LD blocks to nodes, errors and diagnostics.

A block is a JSON text.  Lists are flattened, graphs are entered with the context they inherit, an
envelope that holds only a context, an id and a graph is no node.  Numbers such as NaN are no JSON.
NULL blocks are ignored.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.schema import FACTS

def _strict(constant: str) -> Any:
    raise ValueError(f"{constant} is not JSON")


def _filled(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def good_context(value: Any) -> bool:
    if isinstance(value, list):
        return bool(value) and all(v is None or _filled(v) or isinstance(v, dict) for v in value)
    return _filled(value) or isinstance(value, dict)


def good_type(value: Any) -> bool:
    return bool(value) and all(map(_filled, value)) if isinstance(value, list) else _filled(value)


def _truthy(value: Any) -> bool:
    """Empty lists and objects are true here, as in the contract."""
    return isinstance(value, (list, dict)) or bool(value)


class Facts:
    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.errors: list[str] = []
        self.diagnostics: list[dict] = []
        self.blocks = 0

    def read(self, source: str, line: int = 1) -> None:
        self.blocks += 1
        self.line = line
        try:
            value = json.loads(source, parse_constant=_strict)
        except (ValueError, RecursionError):
            self.errors.append(f"block {self.blocks}: not valid JSON")
            self._report("not valid JSON", "$", "warning", "syntax")
            return
        # a stack instead of recursion: documents nest as deep as they like
        stack: list[tuple[Any, str, Any, bool]] = [(value, "$", None, False)]
        while stack:
            stack.extend(reversed(self._visit(*stack.pop())))

    def _report(self, message: str, path: str, severity: str = "critical", kind: str = "structure") -> None:
        self.diagnostics.append({"message": message, "severity": severity, "kind": kind, "line": self.line, "block": self.blocks, "path": path})

    def _visit(self, value: Any, path: str, inherited: Any, known: bool) -> list[tuple[Any, str, Any, bool]]:
        if isinstance(value, list):
            following = []
            for i, item in enumerate(value):
                if isinstance(item, list):
                    self._report("nested list where an object is expected", f"{path}[{i}]", kind="root" if path == "$" else "structure")
                following.append((item, f"{path}[{i}]", inherited, known))
            return following
        if not isinstance(value, dict):
            if value is not None:
                self.nodes.append({"is_object": False, "has_context": False, "has_type": False, "types": [], "has_author": False, "has_date": False})
            self.errors.append(f"block {self.blocks} {path}: an object is expected")
            at_root = path == "$" or (path.startswith("$[") and path.count("[") == 1 and "." not in path)
            self._report("an object is expected", path, kind="root" if at_root else "structure")
            return []
        has_context = "@context" in value or known
        context = value.get("@context") if "@context" in value else inherited
        entity = "@graph" not in value or any(k not in ("@context", "@id", "@graph") for k in value)
        if entity:
            kind = value.get("@type")
            missing = [name for name, v in (("@context", context), ("@type", kind)) if not _truthy(v)]
            self.nodes.append({
                "is_object": True,
                "has_context": _truthy(context),
                "has_type": _truthy(kind),
                "types": [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else [],
                "has_author": _truthy(value.get("author")),
                "has_date": _truthy(value.get("datePublished")),
            })
            if missing:
                self._report("missing " + ", ".join(missing), path, "warning")
            if has_context and context is not None and context != "" and not good_context(context):
                self._report("@context has no usable form", f"{path}.@context")
            if kind is not None and kind != "" and not good_type(kind):
                self._report("@type has no usable form", f"{path}.@type")
        elif has_context and context is not None and not good_context(context):
            self._report("@context has no usable form", f"{path}.@context")
        return [(value["@graph"], f"{path}.@graph", context, has_context)] if "@graph" in value else []

    def row(self) -> tuple:
        return self.nodes, self.errors, self.diagnostics, self.blocks


@F.pandas_udf(FACTS)
def json_ld_facts(blocks: pd.Series) -> pd.DataFrame:
    """Facts of an array of JSON texts."""
    rows = []
    for texts in blocks:
        facts = Facts()
        for text in texts if texts is not None else ():
            if text is not None:
                facts.read(text)
        rows.append(facts.row())
    return pd.DataFrame(rows, columns=["nodes", "errors", "diagnostics", "block_count"])


def diagnostic_text(d: Column) -> Column:
    return F.format_string("Line %d, block %d, %s: %s", d["line"], d["block"], d["path"], d["message"])
