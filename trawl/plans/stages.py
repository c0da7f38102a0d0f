"""A plan of stages whose tables are kept in one folder: what is there isn't made again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trawl.sources.io import exists


@dataclass(frozen=True)
class Stage:
    """name of the table, make(spark, tables of needs by name), needs: earlier stages."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


def pending(spark: SparkSession, stages: list[Stage], root: str) -> list[str]:
    """Names of the stages whose tables aren't written whole yet."""
    return [s.name for s in stages if not exists(spark, f"{root}/{s.name}/_SUCCESS")]


def run_stages(spark: SparkSession, stages: list[Stage], root: str, dry: bool = False) -> list[tuple[str, str]]:
    """(name, outcome) of each stage in order: kept, made, planned (if dry), skipped (after one it needs failed), or failed with the error."""
    todo, lost, out = set(pending(spark, stages, root)), set(), []
    for s in stages:
        if s.name not in todo:
            outcome = "kept"
        elif dry:
            outcome = "planned"
        elif lost & set(s.needs):
            outcome = "skipped"
        else:
            try:
                tables = {n: spark.read.parquet(f"{root}/{n}") for n in s.needs}
                s.make(spark, tables).write.mode("overwrite").parquet(f"{root}/{s.name}")
                outcome = "made"
            except Exception as e:  # a stage may fail in any way; the report says how
                outcome = f"failed: {e}"
        if outcome == "skipped" or outcome.startswith("failed"):
            lost.add(s.name)
        out.append((s.name, outcome))
    return out
