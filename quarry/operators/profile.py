"""Column profiling and curation.

``profile_columns`` makes one row per column of a table:

* counts over the **full** data in a single aggregate pass (one scan; each
  task pre-aggregates, the shuffle carries one partial row per task):
  missing values (NULL, and NaN in float columns), distinct values
  (a HyperLogLog sketch of value hashes by default, ~1.6 % error; exact
  ``count_distinct`` on request, which plans an Expand of rows × columns), min / max / mean of numeric
  columns with NaN treated as missing;
* sample values from a bounded, seeded sample: the ``sample_size`` rows with
  the smallest ``xxhash64`` of the row (a per-task top-k, never a sort or a
  collect of the table), the first non-null values of each column as text;
* semantic type and auto description from the column's name and type;
* the knowledge overlay: verified description and meaning by column key.

The per-table aggregate row is turned into per-column rows with ``inline``
inside Spark; only a plan, never data, is built on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import col_ref, column_key, column_key_col
from quarry.functions.nulls import FLOAT_TYPES
from quarry.functions.semantic import auto_description, semantic_type, sql_ident, sql_str

SAMPLE_SIZE = 1000
SAMPLES_SHOWN = 5
ANNOTATION_SAMPLES = 10
DEFAULT_AI_CONFIDENCE = 0.7
HLL_LG_K = 12  # 4,096 sketch slots: ~1.6 % relative error, a few KB per column

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def _q(name: str):
    return col_ref(name)


def _needs_text(dt: T.DataType) -> bool:
    """Maps and variants (anywhere in a type) can be neither hashed nor
    grouped in Spark: such columns are hashed and counted by their JSON text."""
    if isinstance(dt, (T.MapType, T.VariantType)):
        return True
    if isinstance(dt, T.ArrayType):
        return _needs_text(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_needs_text(f.dataType) for f in dt.fields)
    return False


def _hashable(f: T.StructField):
    return F.to_json(_q(f.name)) if _needs_text(f.dataType) else _q(f.name)


def profile_table(df: DataFrame) -> DataFrame:
    """Row count and column count (P1), one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))


def column_frame(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name``, ``data_type`` (Spark simple type)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def sample_rows(df: DataFrame, n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Seeded sample of at most ``n`` rows (P6): smallest row hashes win.

    Planned as TakeOrderedAndProject: each task keeps its own top ``n`` and
    only those are merged, so memory and shuffle stay O(n × tasks).
    """
    h = F.xxhash64(F.lit(seed), *[_hashable(f) for f in df.schema.fields])
    return df.withColumn("_h", h).orderBy("_h").limit(n)


def _stats_sql(i: int, f: T.StructField, exact_distinct: bool) -> str:
    """One column's statistics as a ``named_struct`` aggregate, in SQL text
    (parsed once: one JVM call per column instead of one per function)."""
    c = sql_ident(f.name)
    is_float = isinstance(f.dataType, FLOAT_TYPES)
    clean = f"nanvl({c}, CAST(NULL AS {f.dataType.simpleString()}))" if is_float else c
    missing = f"({c} IS NULL OR isnan({c}))" if is_float else f"{c} IS NULL"
    if _needs_text(f.dataType):  # distinct values by JSON text
        clean = f"to_json({c})"
    # approximate distinct: a DataSketches HLL (lgK 12, ~1.6 % error) of the
    # values' 64-bit hashes; NULL/NaN are not hashed (xxhash64(NULL) is not NULL)
    distinct = (f"count(DISTINCT {clean})" if exact_distinct else
                f"hll_sketch_estimate(hll_sketch_agg(CASE WHEN {clean} IS NOT NULL "
                f"THEN xxhash64({clean}) END, {HLL_LG_K}))")
    num = f"CAST({clean} AS DOUBLE)"
    numeric = isinstance(f.dataType, _NUMERIC)
    none = "CAST(NULL AS DOUBLE)"
    return (f"named_struct('ordinal', {i}, 'column_name', {sql_str(f.name)}, "
            f"'data_type', {sql_str(f.dataType.simpleString())}, "
            f"'null_count', count_if({missing}), "
            f"'unique_values', CAST({distinct} AS BIGINT), "
            f"'min', {f'min({num})' if numeric else none}, "
            f"'max', {f'max({num})' if numeric else none}, "
            f"'mean', {f'avg({num})' if numeric else none})")


_STATS_DDL = ("row_count bigint, ordinal int, column_name string, data_type string, "
              "null_count bigint, unique_values bigint, min double, max double, mean double")


def column_stats(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """P2, P3, P5 for every column in one aggregate; one row per column.

    The column's position and type ride in the aggregate as literals, so
    the per-column rows need no join with a column list.
    """
    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], _STATS_DDL)
    agg = df.agg(F.count(F.lit(1)).alias("row_count"),
                 F.expr("array(" + ", ".join(_stats_sql(i, f, exact_distinct)
                                             for i, f in enumerate(fields)) + ")").alias("s"))
    return agg.select("row_count", F.inline("s"))


def stats_observation(df: DataFrame) -> list:
    """The same statistics as aggregate expressions for ``DataFrame.observe``,
    so a write computes them in passing (no second scan of the data)."""
    return [F.count(F.lit(1)).alias("row_count")] + [
        F.expr(_stats_sql(i, f, False)).alias(f"_c{i}") for i, f in enumerate(df.schema.fields)]


def stats_from_observed(spark, observed: dict, n_columns: int) -> DataFrame:
    """Per-column stats frame from an observed metrics row (one small row
    per column, built from driver-side metrics, not from data)."""
    rows = []
    for i in range(n_columns):
        c = observed[f"_c{i}"]
        rows.append((observed["row_count"], c["ordinal"], c["column_name"], c["data_type"],
                     c["null_count"], c["unique_values"], c["min"], c["max"], c["mean"]))
    return spark.createDataFrame(rows, _STATS_DDL)


def column_samples(df: DataFrame, sample_size: int = SAMPLE_SIZE, seed: int = 42,
                   k: int = ANNOTATION_SAMPLES) -> DataFrame:
    """First ``k`` non-null values (as text) of each column in the sample."""
    s = sample_rows(df, sample_size, seed)
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, samples array<string>")
    # per column: its non-null values as text, in sample (hash) order
    per_col = [f"named_struct('column_name', {sql_str(c)}, 'samples', slice(transform(array_sort("
               f"collect_list(CASE WHEN {sql_ident(c)} IS NOT NULL THEN named_struct('h', _h, "
               f"'v', CAST({sql_ident(c)} AS STRING)) END)), x -> x.v), 1, {int(k)}))"
               for c in df.columns]
    return s.agg(F.expr("array(" + ", ".join(per_col) + ")").alias("a")).select(F.inline("a"))


def profile_columns(df: DataFrame, knowledge: DataFrame | None = None,
                    exact_distinct: bool = False, sample_size: int = SAMPLE_SIZE,
                    seed: int = 42, with_samples: bool = True,
                    stats: DataFrame | None = None) -> DataFrame:
    """Full per-column profile (P1-P10) of ``df``.  ``stats`` may carry
    statistics already observed while the data was written.

    Every frame joined here has one row per column of ``df`` (samples), or
    is cut down to the keys of those columns (knowledge), so its size is
    bounded by the schema width and it is broadcast: the only exchange is
    the aggregate's own.
    """
    prof = stats if stats is not None else column_stats(df, exact_distinct)
    if with_samples:
        prof = prof.join(F.broadcast(column_samples(df, sample_size, seed)), "column_name",
                         "left")
    else:
        prof = prof.withColumn("samples", F.lit(None).cast("array<string>"))
    sem = semantic_type("column_name", "data_type")
    prof = (prof
            .withColumn("semantic_type", sem)
            .withColumn("null_percentage",
                        F.when(F.col("row_count") > 0,
                               F.round(F.col("null_count") * 100.0 / F.col("row_count"), 2))
                        .otherwise(F.lit(0.0)))
            .withColumn("sample_values", F.slice("samples", 1, SAMPLES_SHOWN))
            .withColumn("auto_description",
                        auto_description("column_name", "data_type", "semantic_type"))
            .withColumn("column_key", column_key_col("column_name")))
    # booleans are typed "boolean" and get no min / max / mean
    # One row per column: ordered inside one partition (no range-partition
    # sampling job and no exchange, as a global orderBy would plan).
    return (apply_knowledge(prof, knowledge, keys=df.columns)
            .coalesce(1).sortWithinPartitions("ordinal"))


_KNOWLEDGE_EMPTY = ("column_key string, description string, business_meaning string, "
                    "verified_at timestamp")


def apply_knowledge(profile: DataFrame, knowledge: DataFrame | None,
                    keys: list[str] | None = None) -> DataFrame:
    """Overlay verified column knowledge by column key (P10).

    ``keys``: the column names the profile can hold (known on the driver for
    one table's profile).  Knowledge is then cut to those keys before the
    join, which bounds it by the schema width, and broadcast.  Without
    ``keys`` (profiles of a whole catalog) it is a plain left join planned
    by Spark (AQE broadcasts whichever side turns out small).
    """
    cols = ("description", "business_meaning", "verified_at", "human_verified", "needs_review")
    base = profile.drop(*[c for c in cols if c in profile.columns])
    if knowledge is None:
        return (base.withColumn("description", F.lit(None).cast("string"))
                .withColumn("business_meaning", F.lit(None).cast("string"))
                .withColumn("verified_at", F.lit(None).cast("timestamp"))
                .withColumn("human_verified", F.lit(False))
                .withColumn("needs_review", F.lit(True)))
    k = knowledge.select("column_key", F.col("description").alias("_kd"),
                         F.col("business_meaning").alias("_kb"),
                         F.col("verified_at").alias("_kv"))
    if keys is not None and all(c.isascii() for c in keys):
        # same rule as column_key_col for ASCII names (lower, trim, blanks)
        wanted = sorted({column_key(c) for c in keys})
        k = F.broadcast(k.where(F.col("column_key").isin(wanted)))
    hit = F.col("_kd").isNotNull()
    return (base.join(k, "column_key", "left")
            .withColumn("description", F.col("_kd"))
            .withColumn("business_meaning", F.col("_kb"))
            .withColumn("verified_at", F.col("_kv"))
            .withColumn("human_verified", hit)
            .withColumn("needs_review", ~hit)
            .drop("_kd", "_kb", "_kv"))


def review_count(profile: DataFrame) -> DataFrame:
    """Columns needing review, per dataset if the profile has one (P10)."""
    keys = [c for c in ("dataset_id",) if c in profile.columns]
    return profile.groupBy(*keys).agg(F.count_if("needs_review").alias("columns_needing_review"))


def pending_reviews(profiles: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Columns still needing review across all profiles (P12).  Knowledge is
    re-applied at read time, so an approval shows at once."""
    return apply_knowledge(profiles, knowledge).where("needs_review").select(
        *[c for c in ("dataset_id",) if c in profiles.columns],
        "column_name", "data_type", "semantic_type", "auto_description", "sample_values")


def annotation_inputs(profile: DataFrame) -> DataFrame:
    """What an annotator sees for each column needing review."""
    return profile.where("needs_review").select(
        "column_name", "data_type", "semantic_type",
        F.slice("samples", 1, ANNOTATION_SAMPLES).alias("sample_values"),
        "null_percentage", "unique_values")


ANNOTATION_SCHEMA = ("map<string, struct<description: string, business_meaning: string, "
                     "use_cases: string, quality_notes: string, confidence: double>>")


def parse_annotations(text) -> "F.Column":
    """Annotation text -> map of column -> fields.

    The text is JSON, or JSON inside a Markdown code fence (optionally
    tagged ``json``); anything else gives an empty map.
    """
    text = F.col(text) if isinstance(text, str) else text
    whole = F.from_json(text, ANNOTATION_SCHEMA)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1),
                         ANNOTATION_SCHEMA)
    return F.coalesce(whole, fenced, F.create_map().cast(ANNOTATION_SCHEMA))


def merge_annotations(profile: DataFrame, annotations: DataFrame) -> DataFrame:
    """Set ``ai_*`` fields on every column named in the annotations.

    ``annotations`` has a map column ``annotations`` (from
    :func:`parse_annotations`); confidence defaults to 0.7.  Of several
    answers for a column the one with the highest ``seq`` wins if there is
    such a column, and of equal ones the greatest by its JSON text.
    """
    seq = [F.col("seq")] if "seq" in annotations.columns else []
    a = (annotations.select(*seq, F.explode("annotations").alias("column_name", "a"))
         .groupBy("column_name").agg(F.max_by("a", F.struct(*seq, F.to_json("a").alias("_j"))).alias("a")))
    out = profile.join(a, "column_name", "left")
    return (out.withColumn("ai_description", F.col("a.description"))
            .withColumn("ai_business_meaning", F.col("a.business_meaning"))
            .withColumn("ai_use_cases", F.col("a.use_cases"))
            .withColumn("ai_quality_notes", F.col("a.quality_notes"))
            .withColumn("ai_confidence",
                        F.when(F.col("a").isNotNull(),
                               F.coalesce(F.col("a.confidence"), F.lit(DEFAULT_AI_CONFIDENCE))))
            .drop("a"))
