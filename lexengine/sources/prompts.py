"""Prompt files, tool catalogues and stamps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import TOOLS

#: Fixed value: what stands in for a prompt that isn't there.
DEFAULT_PROMPT = "You are an assistant."


def load_prompt(path: str) -> str:
    """A prompt file on the driver, read anew at each call; a default where it is missing."""
    file = Path(path)
    return file.read_text(encoding="utf-8").strip() if file.exists() else DEFAULT_PROMPT


def safe_name(name: Column | str) -> Column:
    """Whether a file name stays within its folder."""
    c = F.col(name) if isinstance(name, str) else name
    return ~(F.contains(c, F.lit("..")) | F.contains(c, F.lit("/")))


def tool_table(spark: SparkSession, tools: tuple = TOOLS) -> DataFrame:
    """n, name, params (name, type, default) and description of the tools."""
    rows = [(i, t["name"], [(p["name"], p["type"], None if "default" not in p else str(p["default"]).lower()) for p in t["params"]], t["description"]) for i, t in enumerate(tools)]
    return spark.createDataFrame(rows, "n int, name string, params array<struct<name: string, type: string, default: string>>, description string")


def function_format(tools: DataFrame) -> DataFrame:
    """Tools as function-calling JSON."""
    properties = F.map_from_entries(F.transform("params", lambda p: F.struct(p["name"], F.struct(p["type"].alias("type"), p["default"].alias("default")))))
    required = F.transform(F.filter("params", lambda p: p["default"].isNull()), lambda p: p["name"])
    parameters = F.struct(F.lit("object").alias("type"), properties.alias("properties"), required.alias("required"))
    return tools.select("n", F.to_json(F.struct(F.lit("function").alias("type"), F.struct("name", "description", parameters.alias("parameters")).alias("function"))).alias("tool"))


def stamp(ts: Column | str) -> Column:
    """A timestamp as it stands in file names."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyyMMdd_HHmmss")
