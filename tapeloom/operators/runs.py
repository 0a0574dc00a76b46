"""Record-once run store and record selection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AlreadyRecorded(ValueError):
    """A run with this configuration is there."""


def canonical(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


def config_hash(config_json: Column) -> Column:
    """16 hex digits of the canonical JSON text."""
    return F.substring(F.sha2(config_json, 256), 1, 16)


def unrecorded(new: DataFrame, store: DataFrame) -> DataFrame:
    """Runs whose hash the store lacks; of equal new hashes the first saved stays."""
    first = new.groupBy("config_hash").agg(F.min_by(F.struct(*[c for c in new.columns if c != "config_hash"]), "saved_at").alias("r"))
    return first.select("config_hash", "r.*").select(*new.columns).join(store.select("config_hash"), "config_hash", "left_anti")


def record(new: DataFrame, store: DataFrame, path: str, strict: bool = False) -> DataFrame:
    """Append what is new to ``path``; with ``strict``, refuse if any is there."""
    if strict and not new.join(store, "config_hash", "left_semi").isEmpty():
        raise AlreadyRecorded("a run of this configuration is recorded")
    fresh = unrecorded(new, store)
    fresh.write.mode("append").parquet(path)
    return fresh


def pick(store: DataFrame, strategy: str, **match: str) -> DataFrame:
    """The one record of ``strategy`` whose config has the given values."""
    found = store.filter(F.get_json_object("config", "$.strategy") == strategy)
    for key, value in match.items():
        found = found.filter(F.get_json_object("config", f"$.{key}") == str(value))
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{n if n < 2 else 'several'} records of {strategy}")
    return found
