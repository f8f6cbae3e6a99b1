"""Name rules as Spark column expressions (plus the same rule for one string).

``sanitize_name`` turns a dataset name into a SQL-safe view name:
lower-case, blanks and hyphens become ``_``, anything outside
``[a-z0-9_]`` is dropped, and a leading digit gets a ``t_`` prefix.

``column_key`` is the knowledge-base key of a column name: lower-case,
outer whitespace removed, inner spaces become ``_``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT_ALLOWED = re.compile(r"[^a-z0-9_]")


def col_ref(name: str) -> Column:
    """A column by its exact name (dots, blanks and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def sanitize_name(name: str) -> str:
    """Driver-side form, used for view names (one string per dataset)."""
    s = _NOT_ALLOWED.sub("", name.lower().replace(" ", "_").replace("-", "_"))
    return "t_" + s if s[:1].isdigit() else s


def sanitize_col(c: Column | str) -> Column:
    """Column form of :func:`sanitize_name`, runs inside codegen."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.translate(F.lower(c), " -", "__"), "[^a-z0-9_]", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column of ``df`` by the name rule (batch renaming)."""
    return df.toDF(*[sanitize_name(c) for c in df.columns])


# Java's \s: the blanks column_key_col trims (Python's strip() trims more)
_OUTER_BLANKS = re.compile(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$")


def column_key(name: str) -> str:
    """Driver-side form of :func:`column_key_col` (equal for ASCII names)."""
    return _OUTER_BLANKS.sub("", name.lower()).replace(" ", "_")


def column_key_col(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.translate(trimmed, " ", "_")
