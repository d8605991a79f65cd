"""Upkeep of reference tables by whole-table set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def refresh(old: DataFrame, new: DataFrame, key: str, owned: str = "owned") -> DataFrame:
    """Upsert by key; rows this refresh owns but no longer produces disappear, foreign rows stay."""
    foreign = old.where(~old[owned]).join(new.select(key), key, "left_anti")
    return new.unionByName(foreign)


def replace_snapshot(old: DataFrame, snapshot: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """The new snapshot with locally observed columns carried over; rows absent from it are gone."""
    return snapshot.join(old.select(key, *keep), key, "left")
