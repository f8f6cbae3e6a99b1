"""Semantic type and auto description of a column, from its name and type.

Both are column expressions over a *columns* frame (one row per column with
``column_name`` and ``data_type`` = Spark simple type string), so a catalog
with any number of datasets is typed in one distributed pass.  Arguments
are the names of those columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name rules, checked in this order, first hit wins.
# Each entry: (semantic type, substrings of the lower-case column name).
NAME_RULES = [
    ("email", ["email"]),
    ("phone", ["phone", "tel"]),
    ("datetime", ["date", "time"]),
    ("identifier", ["id"]),
    ("name", ["name"]),
    ("address", ["address", "street"]),
    ("postal_code", ["zip", "postal"]),
    ("currency", ["amount", "price", "cost"]),
    ("percentage", ["percent", "rate"]),
]

# Description templates by semantic type ({} = readable name).
DESCRIPTION_TEMPLATES = {
    "email": "Email address - {}",
    "phone": "Phone number - {}",
    "identifier": "Unique identifier - {}",
    "currency": "Monetary amount - {}",
    "datetime": "Date/time value - {}",
}

NUMERIC_TYPE_PATTERN = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
DATETIME_TYPE_PATTERN = r"^(date|timestamp|timestamp_ntz)$"


def sql_ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """A Python string as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _semantic_sql(n: str, t: str) -> str:
    low, typ = f"lower({n})", f"lower({t})"
    whens = []
    for sem, words in NAME_RULES:
        cond = " OR ".join(f"instr({low}, {sql_str(w)}) > 0" for w in words)
        whens.append(f"WHEN {cond} THEN {sql_str(sem)}")
    whens += [f"WHEN {typ} RLIKE {sql_str(NUMERIC_TYPE_PATTERN)} THEN 'numeric'",
              f"WHEN {typ} RLIKE {sql_str(DATETIME_TYPE_PATTERN)} THEN 'datetime'",
              f"WHEN {typ} = 'boolean' THEN 'boolean'"]
    return "CASE " + " ".join(whens) + " ELSE 'text' END"


def _readable_sql(n: str) -> str:
    return f"initcap(translate({n}, '_-', '  '))"


def _description_sql(n: str, t: str, sem: str) -> str:
    r = _readable_sql(n)
    whens = [f"WHEN {sql_str(k)} THEN concat({sql_str(tmpl.split('{}')[0])}, {r})"
             for k, tmpl in DESCRIPTION_TEMPLATES.items()]
    return f"CASE {sem} " + " ".join(whens) + f" ELSE concat({r}, ' (', {t}, ')') END"


# The rules are written as SQL text and parsed once: one call into the JVM
# per expression instead of one per function (the same Catalyst tree).

def semantic_type(column_name: str = "column_name", data_type: str = "data_type") -> Column:
    """Semantic type from the columns named ``column_name`` (a column's
    name) and ``data_type`` (its Spark simple type string)."""
    return F.expr(_semantic_sql(sql_ident(column_name), sql_ident(data_type)))


def readable_name(column_name: str = "column_name") -> Column:
    return F.expr(_readable_sql(sql_ident(column_name)))


def auto_description(column_name: str = "column_name", data_type: str = "data_type",
                     sem: str | None = None) -> Column:
    """Description template by semantic type (``sem``: a column holding it;
    computed from name and type when not given)."""
    n, t = sql_ident(column_name), sql_ident(data_type)
    s = sql_ident(sem) if sem is not None else f"({_semantic_sql(n, t)})"
    return F.expr(_description_sql(n, t, s))
