"""Profiling and curation (P1-P16), incl. the literal frames of FIXTURES C."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from quarry.operators.profile import (annotation_inputs, apply_knowledge, column_frame,
                                      merge_annotations, parse_annotations, pending_reviews,
                                      profile_columns, profile_table, sample_rows)
from quarry.functions.semantic import semantic_type


def _cols(spark, pairs):
    return spark.createDataFrame(pairs, "column_name string, data_type string")


def test_semantic_types_first_rule_wins_and_traps(spark):
    pairs = [("user_email", "string", "email"), ("telephone", "string", "phone"),
             ("hotel", "string", "phone"), ("update_id", "bigint", "datetime"),
             ("width", "int", "identifier"), ("full_name", "string", "name"),
             ("street", "string", "address"), ("zip_code", "string", "postal_code"),
             ("unit_price", "double", "currency"), ("tax_rate", "double", "percentage"),
             ("qty", "int", "numeric"), ("seen", "timestamp", "datetime"),
             ("flag", "boolean", "boolean"), ("note", "string", "text"),
             ("amount_cents", "decimal(10,2)", "currency"), ("x", "decimal(10,2)", "numeric")]
    df = _cols(spark, [(n, t) for n, t, _ in pairs])
    got = [r[0] for r in df.select(semantic_type("column_name", "data_type")).collect()]
    assert got == [s for _, _, s in pairs]


def test_auto_description(spark):
    df = spark.createDataFrame([(1, "a@b", 2.5, "x")], "user_id int, email string, price double, note_text string")
    p = {r.column_name: r.auto_description for r in profile_columns(df, with_samples=False).collect()}
    assert p == {"user_id": "Unique identifier - User Id", "email": "Email address - Email",
                 "price": "Monetary amount - Price", "note_text": "Note Text (string)"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = profile_columns(df).collect()[0]
    assert r.null_count == 2 and r.null_percentage == round(200 / 3, 2)
    assert r.min == 1.0 and r.max == 1.0 and r.mean == 1.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    rows = profile_columns(df).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.null_percentage == 0.0 and r.min is None and r.mean is None
        assert r.sample_values == [] or r.sample_values is None
    assert profile_table(df).first().asDict() == {"row_count": 0, "column_count": 3}


def test_boolean_has_no_numeric_stats(spark):
    df = spark.createDataFrame([(True,), (False,)], "flag boolean")
    r = profile_columns(df).first()
    assert r.semantic_type == "boolean" and r.min is None


@pytest.mark.parametrize("exact", [False, True])
def test_map_and_variant_columns_profile_by_json_text(spark, exact):
    # maps and variants cannot be hashed or grouped: counted by JSON text
    df = spark.sql("""SELECT id, map('a', id % 7) AS m, array(map('k', id % 3)) AS am,
        CASE WHEN id % 5 = 0 THEN NULL ELSE parse_json(concat('{"k":', id % 4, '}')) END AS v
        FROM range(50)""")
    got = {r["column_name"]: r for r in profile_columns(df, exact_distinct=exact).collect()}
    assert [got[c]["unique_values"] for c in ("m", "am", "v")] == [7, 3, 4]
    assert got["v"]["null_count"] == 10 and got["m"]["null_count"] == 0
    assert all(len(got[c]["sample_values"]) == 5 for c in ("m", "am", "v"))


def test_samples_bounded_and_seeded(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert sample_rows(li, 100).count() == 100
    a = profile_columns(li, sample_size=200).collect()
    b = profile_columns(li, sample_size=200).collect()
    assert [r.sample_values for r in a] == [r.sample_values for r in b]
    assert all(len(r.sample_values) == 5 for r in a)
    assert a[0].row_count == li.count()


def test_single_scan_no_expand(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    from quarry.operators.profile import column_stats
    plan = column_stats(li)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def _knowledge(spark, rows):
    return spark.createDataFrame(rows, "column_key string, description string, "
                                       "business_meaning string, verified_at timestamp")


def test_knowledge_overlay_and_review(spark):
    df = spark.createDataFrame([("a@b", 1)], "` Email ` string, other int")
    k = _knowledge(spark, [("email", "Email address of the user", "Primary contact", None)])
    prof = profile_columns(df, k, with_samples=False).collect()
    e, o = prof
    assert e.description == "Email address of the user" and e.human_verified and not e.needs_review
    assert o.description is None and o.needs_review and not o.human_verified
    pend = pending_reviews(profile_columns(df, with_samples=False), k).collect()
    assert [r.column_name for r in pend] == ["other"]


@pytest.mark.parametrize("text,expected", [
    ('{"col1": {"description": "d", "confidence": 0.9}}', {"col1"}),
    ('Here:\n```json\n{"col1": {"description": "d"}}\n```\nthanks', {"col1"}),
    ("not json at all", set()),
])
def test_parse_annotations(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    m = df.select(parse_annotations("t").alias("m")).first().m
    assert set(m.keys()) == expected


def test_merge_annotations_default_confidence(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    prof = profile_columns(df, with_samples=False)
    ann = spark.createDataFrame(
        [('{"name": {"description": "Person name", "use_cases": ["a", "b"]}}',)], "t string")
    out = {r.column_name: r for r in merge_annotations(
        prof, ann.select(parse_annotations("t").alias("annotations"))).collect()}
    assert out["name"].ai_description == "Person name" and out["name"].ai_confidence == 0.7
    assert out["id"].ai_description is None and out["id"].ai_confidence is None
    # no annotations: profile unchanged
    none = spark.createDataFrame([("nothing",)], "t string").select(
        parse_annotations("t").alias("annotations"))
    assert merge_annotations(prof, none).where("ai_description IS NOT NULL").count() == 0


def test_annotation_inputs(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id int, name string")
    rows = annotation_inputs(profile_columns(df)).collect()
    assert {r.column_name for r in rows} == {"id", "name"}
    assert all(len(r.sample_values) == 10 for r in rows)


def test_column_frame(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert [tuple(r) for r in column_frame(df).collect()] == [(0, "a", "int"), (1, "b", "string")]


def test_profile_odd_column_names(spark):
    # names are quoted into SQL text: backticks, quotes, blanks, backslashes
    names = ["a`b", "it's", "x y", "back\\slash", "Email Address"]
    df = spark.createDataFrame([(1, "p", None, 2.5, "a@b"), (None, "q", 3.0, float("nan"), None)],
                               T.StructType([T.StructField(n, t) for n, t in zip(
                                   names, [T.IntegerType(), T.StringType(), T.DoubleType(),
                                           T.DoubleType(), T.StringType()])]))
    rows = {r.column_name: r for r in profile_columns(df, sample_size=10).collect()}
    assert list(rows) == names
    assert rows["a`b"].null_count == 1 and rows["a`b"].max == 1.0
    assert sorted(rows["it's"].sample_values) == ["p", "q"]
    assert rows["back\\slash"].null_count == 1 and rows["back\\slash"].mean == 2.5
    assert rows["x y"].column_key == "x_y"
    assert rows["Email Address"].semantic_type == "email"
