"""Graphs, labels, jump tables and histories kept as Parquet or JSON lines, each under the name of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a table of each kind has at least.
KINDS = {
    "nodes": ("id", "x", "y"),
    "edges": ("src", "dst", "wt"),
    "arc_flags": ("source", "first", "flags"),
    "boxes": ("source", "first", "x1", "y1", "x2", "y2"),
    "flags_and_boxes": ("source", "first", "flags", "x1", "y1", "x2", "y2"),
    "closure": ("source", "first", "flags", "x1", "y1", "x2", "y2", "id1", "id2", "rank1", "rank2"),
    "first_moves": ("source", "run_start", "run_end", "move"),
    "jumps": ("x", "y", "dir", "steps", "dead_end"),
    "corner_edges": ("src", "dst", "wt", "first", "last"),
}


def _checked(df: DataFrame, kind: str) -> DataFrame:
    missing = [c for c in KINDS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"a table of {kind} lacks {', '.join(missing)}")
    return df


def save(df: DataFrame, path: str, kind: str) -> None:
    """Write a table of a kind under ``path``, in place of one of that kind there."""
    _checked(df, kind).write.mode("overwrite").parquet(f"{path}/{kind}")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return _checked(spark.read.parquet(f"{path}/{kind}"), kind)


def save_history(moves: DataFrame, path: str) -> None:
    """Moves of units (unit, t, x, y) as JSON lines, in order of unit and time."""
    moves.select("unit", "t", "x", "y").repartitionByRange("unit", "t").sortWithinPartitions("unit", "t").write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("unit bigint, t bigint, x double, y double").json(path).where(F.col("unit").isNotNull())
