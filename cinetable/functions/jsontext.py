"""JSON in string columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetable.plans.columns import col


def safe_json(text: Column) -> Column:
    """The text as a variant, null where it is null, blank or no JSON."""
    return F.try_parse_json(F.when(F.trim(text) != "", text))


def json_field(text: Column, path: str) -> Column:
    """A field as a string; null where the text doesn't parse."""
    return F.try_variant_get(safe_json(text), path, "string")


Path = str | tuple[str, ...]


def json_paths(df: DataFrame, text: str) -> list[tuple[str, ...]]:
    """The keys on the way to every value that is no object, sorted. Aggregated on the executors; the
    result has one row per distinct path. Runs one job."""
    objects = df.select(safe_json(F.when(col(text).rlike(r"^\s*\{"), col(text))).alias("_v")).where("_v is not null")
    found = objects.agg(F.schema_of_variant_agg("_v")).first()[0]
    return sorted(_paths(found or "VOID"))


_OBJECT = re.compile(r"`(?:[^`]|``)*`|OBJECT(?=<)")


def _paths(schema: str) -> list[tuple[str, ...]]:
    """Paths of a variant's schema text, which is a type text but for the name of objects."""

    def below(kind: T.DataType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        if not isinstance(kind, T.StructType):
            return [path] if path else []
        return [found for field in kind for found in below(field.dataType, (*path, field.name))]

    return below(T.DataType.fromDDL(_OBJECT.sub(lambda m: "STRUCT" if m[0] == "OBJECT" else m[0], schema)), ())


def flatten_json(df: DataFrame, text: str, *, prefix: str = "extra", paths: Sequence[Path] | None = None) -> DataFrame:
    """``df`` with a string column ``prefix.path`` for every path of the objects in ``text``.

    ``paths`` (keys, or keys joined by dots) saves the discovery pass, a job that runs while the plan is
    built. Text that is no object gives nulls."""
    parsed = df.withColumn("_variant", safe_json(col(text)))
    for path in paths if paths is not None else json_paths(df, text):
        keys = path.split(".") if isinstance(path, str) else path
        steps = "$" + "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in keys)
        parsed = parsed.withColumn(f"{prefix}.{'.'.join(keys)}", F.try_variant_get("_variant", steps, "string"))
    return parsed.drop("_variant")


def counts_json(counts: Column) -> Column:
    """A map as compact JSON."""
    return F.to_json(counts)
