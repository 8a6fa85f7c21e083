"""Where queries are registered, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, which only a local session can share."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
