"""The ledger as three JSON files in a folder: queries, observations, experiments."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
PARTS = {
    "queries": "keyword: string, targetPath: string, priority: string, status: string, nextReviewDate: string",
    "observations": (
        "id: string, observedAt: string, source: string, keyword: string, targetPath: string, position: double, clicks: double, impressions: double, "
        "window: struct<startDate: string, endDate: string>, segment: struct<country: string, device: string, searchType: string>"
    ),
    "experiments": "keyword: string, targetPath: string, status: string, nextReviewDate: string, actions: array<string>, reviews: array<string>",
}


def create_ledger(folder: str) -> None:
    """An empty ledger; a file that is there already is an error and stays as it is."""
    paths = {part: os.path.join(folder, f"{part}.json") for part in PARTS}
    for path in paths.values():
        if os.path.exists(path):
            raise FileExistsError(path)
    os.makedirs(folder, exist_ok=True)
    for part, path in paths.items():
        with open(path, "x", encoding="utf-8") as file:
            json.dump({"version": VERSION, part: []}, file)


def read_ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts as tables; a file of another version or without its list is an error."""
    found = {}
    for part, fields in PARTS.items():
        whole = spark.read.schema(f"version string, {part} array<struct<{fields}>>").option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/{part}.json")
        heads = whole.select("version", F.col(part).isNotNull().alias("listed")).limit(2).collect()  # one document
        if len(heads) != 1 or heads[0]["version"] != VERSION or not heads[0]["listed"]:
            raise ValueError(f"no {part} of version {VERSION} in {folder}")
        found[part] = whole.select(F.explode(part).alias("x")).select("x.*")
    return found


def save_ledger(parts: dict[str, DataFrame], folder: str) -> None:
    """The parts in files beside each other, each replaced only when it is whole."""
    for part in PARTS:
        target = os.path.join(folder, f"{part}.json")
        with open(f"{target}.new", "w", encoding="utf-8") as file:
            file.write(json.dumps({"version": VERSION})[:-1] + f', "{part}": [')
            for i, row in enumerate(parts[part].toJSON().toLocalIterator()):
                file.write(("," if i else "") + row)
            file.write("]}")
        os.replace(f"{target}.new", target)
