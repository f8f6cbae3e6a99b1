"""NaN handling: Spark keeps NaN and NULL apart, query results do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from quarry.functions.names import col_ref

FLOAT_TYPES = (T.FloatType, T.DoubleType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn float NaN into NULL in every top-level float/double column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            out.append(F.nanvl(col_ref(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(col_ref(f.name))
    return df.select(*out)


def is_missing(name: str, dtype: T.DataType):
    """NULL, or NaN for float columns (the profile's notion of missing)."""
    c = col_ref(name)
    if isinstance(dtype, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()
