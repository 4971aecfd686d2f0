"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["line_dedup", "quality_rules", "url_filters", "toxicity", "class_lm", "jaccard_join", "decontamination", "substring_dedup", "packing", "token_files",
           "conversation_repair", "piece_codec", "filter_audit"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        module = import_module(f"fieldtally.llm.{name}")
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and "_" in k and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"fieldtally.llm.{name}"), "SQL", {})
    return found
