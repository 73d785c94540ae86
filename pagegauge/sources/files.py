"""Pages from directories: listing on the driver, reading in parallel.

``scan`` lists HTML and Markdown files the way a readiness scan does (directories that start with a
dot or are named ``node_modules`` are left out, links are followed); ``scan_build`` the way a build
audit does (links and all dot entries left out, HTML only, sorted, an empty set is an error).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: files larger than this are not read (a fixed bound of the contract; responses have none)
MAX_BYTES = 5 * 1024 * 1024
PAGES = (".html", ".htm", ".md", ".mdx")
BUILT = (".html", ".htm")


def scan(root: str) -> list[str]:
    found: list[str] = []
    for folder, folders, names in os.walk(root, followlinks=True):
        # a link to a folder above would lead round in a circle
        above = os.path.realpath(folder)
        inside = lambda f: (above + os.sep).startswith(os.path.realpath(os.path.join(folder, f)) + os.sep)  # noqa: B023, E731
        folders[:] = [f for f in folders if not f.startswith(".") and f != "node_modules" and not inside(f)]
        found.extend(os.path.join(folder, n) for n in names if n.lower().endswith(PAGES))
    return found


def scan_build(root: str) -> list[str]:
    if os.path.islink(root):
        raise ValueError("a link is no audit target")
    found: list[str] = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f != "node_modules" and not os.path.islink(os.path.join(folder, f)))
        found.extend(os.path.join(folder, n) for n in names if not n.startswith(".") and n.lower().endswith(BUILT) and not os.path.islink(os.path.join(folder, n)))
    if not found:
        raise ValueError("no HTML files to audit")
    return sorted(found)


def single_page(path: str, built: bool = False) -> list[str]:
    """One file to scan, or to audit as a build; a folder, a link or another kind of file is an error."""
    kinds = BUILT if built else PAGES
    if not path.lower().endswith(kinds):
        raise ValueError(f"unsupported file type: {path}")
    if os.path.islink(path) and built or not os.path.isfile(path):
        raise ValueError(f"not a regular file: {path}")
    return [path]


def read_pages(spark: SparkSession, paths: list[str], per_task: int = 200) -> DataFrame:
    """(path, format, content); a file that is missing, too large or of another kind is an error, naming the path."""
    for path in paths:
        if not path.lower().endswith(PAGES):
            raise ValueError(f"unsupported file type: {path}")
    tasks = max(1, min(len(paths), -(-len(paths) // per_task)))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                if os.path.getsize(path) > MAX_BYTES:
                    raise ValueError(f"file too large: {path}")
                with open(path, encoding="utf-8", errors="replace", newline="") as file:
                    rows.append((path, "markdown" if path.lower().endswith((".md", ".mdx")) else "html", file.read()))
            yield pd.DataFrame(rows, columns=["path", "format", "content"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(read, "path string, format string, content string")
