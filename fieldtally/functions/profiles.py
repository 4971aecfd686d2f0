"""Requirement profiles: what a survey asks for, by method, group and record type.

A profile is data: rows of (profile, level, level_value, field, requirement). The built-in ones are
a table beside this module; a project adds or replaces rows in its own.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONFIG_SCHEMA = "profile string, level string, level_value string, field string, requirement string"
FALLBACK = "optional"

#: Fixed values, one row a line.
REQUIREMENTS = Path(__file__).with_name("requirements.csv")
STANDARD_ID, MINIMAL_ID = "linea-base-fauna", "minimo"


def builtin_rows() -> list[tuple[str, str, str, str, str]]:
    lines = [line for line in REQUIREMENTS.read_text(encoding="utf8").splitlines() if not line.startswith("#")]
    return [tuple(r) for r in list(csv.reader(lines))[1:]]


def builtin_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(builtin_rows(), CONFIG_SCHEMA)
