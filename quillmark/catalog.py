"""Where the datasets of a work folder lie, and reading of whole-table folders."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str) -> None:
    """Temporary views of all tables of a folder."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def slug(topic: str, most: int = 40) -> str:
    """A topic as a folder's name; `functions.specs.slug` is the same for columns."""
    name = re.sub(r"\s+", "_", re.sub(r'[\\/:*?"<>|]', "", topic.strip()))
    return name[:most].strip("_") or "untitled"


@dataclass(frozen=True)
class WorkPaths:
    """Canonical places below a work folder; any path Spark can open."""

    root: str

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def facts(self) -> str:
        return self._at("facts.jsonl")

    @property
    def evidence(self) -> str:
        return self._at("evidence.jsonl")

    @property
    def report(self) -> str:
        return self._at("report.md")

    @property
    def manifest(self) -> str:
        return self._at("manifest.json")

    @property
    def sources(self) -> str:
        return self._at("_sources")

    @property
    def captures(self) -> str:
        return self._at("_captures")

    @property
    def images(self) -> str:
        return self._at("_images")

    @property
    def gates(self) -> str:
        return self._at("audit/gates.jsonl")

    @property
    def fetch_log(self) -> str:
        return self._at("audit/fetch-log.jsonl")

    @property
    def search_log(self) -> str:
        return self._at("audit/search-log.jsonl")

    @property
    def claim_review(self) -> str:
        return self._at("audit/claim-review.jsonl")

    @property
    def universe(self) -> str:
        return self._at("audit/universe.md")
