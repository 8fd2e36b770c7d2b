"""SQL names for the scalar functions, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wlanlake import spec
from wlanlake.functions import cells


def _table(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name -> (arguments, result type, SQL body)."""
    label = cells.strip("x")
    return {
        "wl_numbers": ("x string", "array<double>", cells.parse_multi("x")),
        "wl_number": ("x string", "double", cells.first_number("x")),
        "wl_present": ("x string", "int", cells.present("x")),
        "wl_mac": ("x string", "string", cells.norm_mac("x")),
        "wl_label": (
            "x string",
            "string",
            f"coalesce(if({label} in ({_list(spec.CLASSES)}), {label}, null), "
            f"try_element_at({_table(spec.LABEL_ALIASES)}, lower({label})))",
        ),
        "wl_front_key": ("x string", "string", "regexp_replace(lower(x), '[^a-z0-9_]', '')"),
        "wl_severity": (
            "x string",
            "string",
            f"coalesce(try_element_at({_table(spec.SEVERITY_OF)}, x), 'info')",
        ),
        "wl_channel": (
            "f int",
            "int",
            "case when f = 2484 then 14 when f between 2412 and 2472 then (f - 2407) div 5 "
            "when f between 4910 and 4980 then (f - 4000) div 5 "
            "when f between 5000 and 5925 then (f - 5000) div 5 "
            "when f between 5955 and 7115 then (f - 5950) div 5 end",
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    made = definitions()
    for name, (args, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(made)
