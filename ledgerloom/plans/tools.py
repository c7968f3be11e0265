"""Calls of tools that a model proposes as JSON: checked against the list of tools, and turned into a tool's arguments.
Nothing is executed here; a callable that takes the checked rows may."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

PROPOSAL = "script string, operation string, reason string"


def flags(args: Column) -> Column:
    """Flags of a map from names to variants, by name: null and false give none, true a bare flag, others a value."""
    def flag(entry: Column) -> Column:
        kind = F.schema_of_variant(entry["value"])
        name = F.concat(F.lit("--"), F.replace(entry["key"], F.lit("_"), F.lit("-")))
        value = F.try_variant_get(entry["value"], "$", "string")
        off = entry["value"].isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (value == "false"))
        return F.when(off, F.array().cast("array<string>")).when(kind == "BOOLEAN", F.array(name)).otherwise(F.array(name, value))

    return F.flatten(F.transform(F.array_sort(F.map_entries(args), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), flag))


def checked(proposals: DataFrame, raw: str = "raw", tools: dict[str, list[str]] = rules.TOOLS) -> DataFrame:
    """Adds script, operation, command (operation and flags, null if refused) and error ('' if none) to JSON proposals.

    Refused are a script or operation that isn't listed, no operation, and arguments that aren't an object; arguments
    that are missing or empty are none."""
    text = F.col(raw)
    call = F.from_json(text, PROPOSAL)
    rows = proposals.withColumns({"script": F.coalesce(call["script"], F.lit("")), "operation": F.coalesce(call["operation"], F.lit("")), "__args": F.coalesce(F.get_json_object(text, "$.args"), F.lit(""))})
    listed = F.create_map(*(x for k, v in tools.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    operations = F.try_element_at(listed, F.col("script"))
    nothing = F.col("__args").isin("", "[]", "{}", "0", "false")
    error = (
        F.when(F.try_parse_json(text).isNull(), "not JSON")
        .when(operations.isNull(), F.concat(F.lit("unsupported script: "), F.col("script")))
        .when(F.col("operation") == "", "missing operation")
        .when(~F.array_contains(operations, F.col("operation")), F.concat(F.lit("unsupported operation: "), F.col("operation")))
        .when(~nothing & ~F.startswith("__args", F.lit("{")), "args must be an object")
        .otherwise("")
    )
    args = F.when(~nothing, F.from_json("__args", "map<string, variant>"))
    command = F.concat(F.array("operation"), F.coalesce(flags(args), F.array().cast("array<string>")))
    return rows.withColumn("error", error).withColumn("command", F.when(F.col("error") == "", command)).drop("__args")
