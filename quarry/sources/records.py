"""Record payloads: envelopes (S4), bookkeeping fields (S4b), mixed columns (K4).

A column of JSON documents (one per row, e.g. API responses stored as text)
becomes one row per record, entirely inside Spark:

* a top-level array: each element is a record;
* an object: the first of the envelope keys below whose value is an array
  supplies the records; with none, the object itself is the one record;
* anything else (a scalar, invalid JSON) goes to the rejects frame.

Documents are parsed to VARIANT, so no schema is needed to find the
records; fields are then read with ``try_variant_get`` against a declared
record schema (or one inferred with ``schema_of_variant_agg``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.nulls import FLOAT_TYPES
from quarry.functions.names import col_ref

# Envelope keys, tried in this order.
ENVELOPE_KEYS = ["data", "results", "items", "records"]


def _path(field: str) -> str:
    return "$." + field


def record_array(doc: Column) -> Column:
    """array<variant> of the document's records, or NULL when it has none."""
    v = F.try_parse_json(doc)
    as_list = lambda path: F.try_variant_get(v, path, "array<variant>")
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return F.coalesce(
        as_list("$"),
        *[as_list(_path(k)) for k in ENVELOPE_KEYS],
        F.when(is_object, F.array(v)),
    )


def unwrap_records(df: DataFrame, doc_col: str, schema: T.StructType | str | None = None,
                   keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(records, rejects)``.

    ``records`` has the ``keep`` columns, ``record_pos`` and either the
    declared ``schema`` fields or, without one, the fields of a schema
    inferred over all records in one distributed aggregate.
    """
    keep = list(keep or [c for c in df.columns if c != doc_col])
    staged = df.select(*keep, F.col(doc_col).alias("_doc"),
                       record_array(F.col(doc_col)).alias("_recs"))
    rejects = staged.where(F.col("_recs").isNull()).select(*keep, F.col("_doc").alias(doc_col))
    exploded = staged.where(F.col("_recs").isNotNull()).select(
        *keep, F.posexplode("_recs").alias("record_pos", "_rec"))
    if schema is None:
        ddl = exploded.agg(F.schema_of_variant_agg("_rec")).first()[0] or "STRUCT<>"
        ddl = re.sub(r"\bOBJECT<", "STRUCT<", ddl)
    elif isinstance(schema, T.StructType):
        ddl = schema.simpleString()
    else:
        ddl = schema if schema.strip().lower().startswith("struct<") else f"struct<{schema}>"
    if not ddl.strip().lower().startswith("struct<"):
        # records are scalars or lists, not objects: one ``value`` column
        return exploded.select(*keep, "record_pos",
                               F.try_variant_get("_rec", "$", ddl).alias("value")), rejects
    rec = F.try_variant_get("_rec", "$", ddl).alias("_r")
    return exploded.select(*keep, "record_pos", rec).select(*keep, "record_pos", "_r.*"), rejects


def drop_envelope_fields(df: DataFrame, fields=("attributes",), struct_col: str | None = None
                         ) -> DataFrame:
    """Remove bookkeeping fields (e.g. ``attributes``) from records."""
    if struct_col:
        st = df.schema[struct_col].dataType
        present = [f for f in fields if f in st.fieldNames()]
        return df.withColumn(struct_col, F.col(struct_col).dropFields(*present)) if present else df
    return df.drop(*[f for f in fields if f in df.columns])


_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def coerce_mixed_types(df: DataFrame, target: str = "csv") -> DataFrame:
    """Make every column writable to ``target``.

    Spark columns always have one type, so "mixed" values only arise as
    nested or VARIANT data.  For CSV those become JSON text; for every
    target float NaN becomes NULL (as the reference stores it).
    """
    out = []
    for f in df.schema.fields:
        c = col_ref(f.name)
        if target == "csv" and isinstance(f.dataType, _NESTED):
            c = F.to_json(c)
        elif isinstance(f.dataType, FLOAT_TYPES):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)
