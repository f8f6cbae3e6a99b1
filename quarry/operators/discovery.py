"""Discovery: keyword search over datasets (D1, D2) and join-key
suggestions between two column lists (D3, D4).

Search scores every dataset in one pass of column expressions: the query's
words (a handful, known on the driver) are a literal array, each dataset's
words come from ``regexp_extract_all``.  Column hits come from a columns
frame (one row per dataset column), reduced per dataset before the join.

Join suggestions never form all column pairs: candidate pairs come from
equi-joins — equal lower-case names; one cleaned name equal to a substring
of the other (each name contributes its O(len²) substrings, names being
short); and the id-name rule, which pairs only id-shaped names.  The rule is
then evaluated exactly on the candidates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score steps and caps.
NAME_WEIGHT, SOURCE_WEIGHT, COLUMN_WEIGHT, SCORE_CAP = 0.5, 0.3, 0.1, 1.0
EXACT_CONF, SIMILAR_CONF, IDENT_BONUS, KEEP_ABOVE = 0.95, 0.75, 0.1, 0.5

_WORD = re.compile(r"\w+")


def query_words(query: str) -> list[str]:
    return sorted(set(_WORD.findall(query.lower())))


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))),
                                                 F.lit(r"(?U)\w+"), 0))


def dataset_search(datasets: DataFrame, query: str, columns: DataFrame | None = None,
                   id_col: str = "id", name_col: str = "name", url_col: str = "source_url",
                   source_query_col: str | None = "source_query") -> DataFrame:
    """Score every dataset against ``query``.

    +0.5 per query word among the name's words; +0.3 per query word among
    the words of the source url, or of the source query when there is no
    url; +0.1 per column whose lower name contains a query word; capped at
    1.0.  ``columns`` has ``dataset_id`` and ``column_name``.
    """
    qw = query_words(query)
    qlit = F.array(*[F.lit(w) for w in qw]) if qw else F.array().cast("array<string>")
    src = F.col(url_col)
    if source_query_col and source_query_col in datasets.columns:
        src = F.when(F.coalesce(F.col(url_col), F.lit("")) != "", F.col(url_col)) \
            .otherwise(F.col(source_query_col))
    d = (datasets
         .withColumn("_nm", F.array_intersect(words(F.col(name_col)), qlit))
         .withColumn("_sm", F.array_intersect(words(src), qlit)))
    if columns is not None:
        hit = F.exists(qlit, lambda w: F.instr(F.lower(F.col("column_name")), w) > 0)
        per = (columns.where(hit).groupBy(F.col("dataset_id").alias("_did"))
               .agg(F.count(F.lit(1)).alias("_nc"), F.collect_set("column_name").alias("_cm")))
        d = d.join(per, d[id_col] == per["_did"], "left").drop("_did")
    else:
        d = d.withColumn("_nc", F.lit(0)).withColumn("_cm", F.array().cast("array<string>"))
    nc = F.coalesce(F.col("_nc"), F.lit(0))
    raw = (F.size("_nm") * F.lit(NAME_WEIGHT) + F.size("_sm") * F.lit(SOURCE_WEIGHT)
           + nc * F.lit(COLUMN_WEIGHT))
    matched = F.array_sort(F.array_distinct(F.concat(
        "_nm", "_sm", F.coalesce(F.col("_cm"), F.array().cast("array<string>")))))
    return (d.withColumn("confidence", F.round(F.least(raw, F.lit(SCORE_CAP)), 2))
            .withColumn("reason", F.when(F.size(matched) > 0,
                                         F.concat(F.lit("Matched keywords: "),
                                                  F.array_join(matched, ", ")))
                        .otherwise(F.lit("Low relevance")))
            .drop("_nm", "_sm", "_nc", "_cm"))


def dataset_search_topk(scored: DataFrame, k: int = 5, id_col: str = "id",
                        created_col: str = "created_at") -> DataFrame:
    """Positive scores, best first, ties by creation time then id."""
    return (scored.where(F.col("confidence") > 0)
            .orderBy(F.col("confidence").desc(), F.col(created_col).asc_nulls_last(),
                     F.col(id_col).asc()).limit(k))


def _clean(n: Column) -> Column:
    return F.regexp_replace(n, r"[_\-\s]", "")


def names_similar(n1: Column, n2: Column) -> Column:
    """The similarity rule on two lower-case names."""
    c1, c2 = _clean(n1), _clean(n2)
    contains = (F.instr(c2, c1) > 0) | (F.instr(c1, c2) > 0) | (c1 == "") | (c2 == "")
    id_rule = ((n1.rlike("id$") | n1.rlike("^id")) & n2.rlike("id$"))
    return contains | id_rule


def _substrings(s: Column) -> Column:
    """All substrings of ``s`` (with the empty one), as a distinct array."""
    n = F.length(s)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.transform(F.sequence(i, n), lambda j: F.substring(s, i + 1, j - i)))))


def join_suggestions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Suggest join keys between two column lists (D3).

    ``left`` / ``right`` have ``column_name`` and ``semantic_type`` (and an
    optional ``ordinal`` for a stable order).  Returns ``left_column``,
    ``right_column``, ``confidence``, ``reason``, best first.
    """
    def prep(df, side):
        o = F.col("ordinal") if "ordinal" in df.columns else F.monotonically_increasing_id()
        n = F.lower(F.col("column_name"))
        return df.select(F.col("column_name").alias(f"{side}_column"),
                         F.col("semantic_type").alias(f"{side}_sem"),
                         o.alias(f"{side}_ord"), n.alias(f"{side}_n"),
                         _clean(n).alias(f"{side}_c"))
    L, R = prep(left, "l"), prep(right, "r")
    lk = L.select("l_ord", "l_n", "l_c")
    rk = R.select("r_ord", "r_n", "r_c")
    exact = lk.join(rk, lk.l_n == rk.r_n).select("l_ord", "r_ord")
    l_in_r = lk.join(rk.select("r_ord", F.explode(_substrings(F.col("r_c"))).alias("_s")),
                     F.col("l_c") == F.col("_s")).select("l_ord", "r_ord")
    r_in_l = rk.join(lk.select("l_ord", F.explode(_substrings(F.col("l_c"))).alias("_s")),
                     F.col("r_c") == F.col("_s")).select("l_ord", "r_ord")
    lid = lk.where(F.col("l_n").rlike("id$") | F.col("l_n").rlike("^id")) \
        .select("l_ord", F.lit("id").alias("_t"))
    rid = rk.where(F.col("r_n").rlike("id$")).select("r_ord", F.lit("id").alias("_t"))
    by_id = lid.join(rid, "_t").select("l_ord", "r_ord")
    pairs = exact.unionByName(l_in_r).unionByName(r_in_l).unionByName(by_id).distinct()
    p = pairs.join(L, "l_ord").join(R, "r_ord")
    same = F.col("l_n") == F.col("r_n")
    sim = names_similar(F.col("l_n"), F.col("r_n"))
    both_id = (F.col("l_sem") == "identifier") & (F.col("r_sem") == "identifier")
    base = F.when(same, F.lit(EXACT_CONF)).when(sim, F.lit(SIMILAR_CONF)).otherwise(F.lit(0.0))
    conf = base + F.when(both_id, F.lit(IDENT_BONUS)).otherwise(F.lit(0.0))
    reason1 = F.when(same, F.lit("Exact name match")).when(
        sim, F.concat(F.lit("Name similarity: "), F.col("l_n"), F.lit(" <-> "), F.col("r_n")))
    reason = F.concat_ws("; ", reason1, F.when(both_id, F.lit("Both are identifiers")))
    return (p.withColumn("_conf", conf).where(F.col("_conf") > KEEP_ABOVE)
            .select("l_column", "r_column",
                    F.round(F.least(F.col("_conf"), F.lit(SCORE_CAP)), 2).alias("confidence"),
                    reason.alias("reason"), "l_ord", "r_ord")
            .orderBy(F.col("confidence").desc(), "l_ord", "r_ord")
            .withColumnRenamed("l_column", "left_column")
            .withColumnRenamed("r_column", "right_column")
            .drop("l_ord", "r_ord"))
