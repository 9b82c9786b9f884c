"""What the jobs share: the command line, the config file and the log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_config(path: str | Path, known: dict[str, Any]) -> dict[str, Any]:
    """The settings of a JSON file over those of `known`; a setting that `known` hasn't is an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return {**known, **given}


def command_line(run: Callable[..., Any], doc: str, config: Path, known: dict[str, Any], paths: tuple[str, ...], arguments: list[str] | None = None) -> None:
    """Read the paths and the config file, make a session, run the job, end the session."""
    parser = argparse.ArgumentParser(description=doc)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path or URI that Spark reaches")
    parser.add_argument("--config", default=str(config), help="a JSON file of settings")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    settings = load_config(given.config, known)
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(given, name) for name in paths], **settings)
    finally:
        spark.stop()


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet rows below `path`; none if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
