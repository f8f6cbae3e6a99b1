"""Language identification by fusing evidence with Bayes' rule.

For each document the posterior of a language is, up to a constant,

    likelihood of the text ^ TEMPER * P(declared language | language)
        * P(address suffix | language) * prior of its host

* *Text*: character trigrams (lower-cased, hashed to 2^15 cells) under a
  multinomial per language, fitted on a bounded, hash-chosen sample of rows
  with a declared language (``SAMPLE`` of each language, documented).  Every
  code that ``FIT_ROWS`` rows declare has one, whatever its share.
* *Declared markup language* (``lang`` of the html element, or a label
  column) and *address suffix*: how often each goes with each language, over
  all documents, weighted by the text's posterior, smoothed.
* *Host priors*: smoothed hierarchically, host to its domain, domain to its
  suffix, suffix to the corpus; each level is one grouped sum over all
  documents (combined before the shuffle, so a hot host is no matter).

A document is *rejected* if nothing in it speaks for any language: it has
fewer than ``LEAST`` trigrams, or they are no likelier under the best
language than under none (each cell as likely as any other); fewer than
``SHORT`` trigrams don't outweigh a known declared language.  A document of
``LEAST`` trigrams whose declared code has no model (too few rows or no
letters in its sample) is accepted under that code, with confidence 0: no
likelihood can speak for or against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BATCH_ROWS, batch_rows, row_key, small_batches, staged, text_or_empty, without

CELLS = 1 << 15
SAMPLE = 400  # rows of each language, about, that the text model is fitted on
FIT_ROWS = 2  # a declared code of fewer rows has no text model; its documents keep it
TEMPER = 0.25  # neighbouring trigrams overlap and repeat: their evidence is worth less than its count
SMOOTH = 20.0  # documents' worth of the parent's prior at each level
LEAST = 3
SHORT = 50  # a text of fewer trigrams proves nothing against a declared language
NO_LANGUAGE = "und"
UNNAMED = ("und", "mis", "mul", "zxx")  # codes that name no language


def _cells(text: str) -> np.ndarray:
    """Trigram cells of a text's letters and blanks; everything else is a blank."""
    s = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def declared_code(col: str | Column) -> Column:
    """The primary subtag of a declared language, lower-case; null if none."""
    c = F.col(col) if isinstance(col, str) else col
    code = F.lower(F.regexp_extract(F.trim(c.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code != "", code)


def markup_language(html: str | Column) -> Column:
    """The language an html page's root element declares."""
    c = F.col(html) if isinstance(html, str) else html
    tag = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<html\b([^>]*)>", 1)
    return F.regexp_extract(tag, r"""(?i)\blang\s*=\s*["']?\s*([A-Za-z][A-Za-z0-9_-]*)""", 1)


def url_host(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def fit_text(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of every cell under each) from the bounded
    sample: counts are summed in Spark, one row per language comes back."""
    declared = texts.filter(F.col("code").isNotNull() & ~F.col("code").isin(*UNNAMED))
    sizes = {r["code"]: r["n"] for r in declared.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") >= FIT_ROWS).collect()}
    kept = sorted(sizes)
    if not kept:
        return [], np.zeros((0, CELLS), np.float32)
    share = F.create_map(*[x for k in kept for x in (F.lit(k), F.lit(min(1.0, SAMPLE / sizes[k])))])
    chosen = F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(1 << 20)) < share[F.col("code")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches, "text"):
            for code, text in zip(b.column("code").to_pylist(), b.column("text").to_pylist()):
                sums[code] = sums.get(code, 0) + np.bincount(_cells(text), minlength=CELLS).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["code", "counts"])

    def total_up(p: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, np.float32) for x in p["counts"])
        return pd.DataFrame({"code": [p["code"].iloc[0]], "counts": [v.tobytes()]})

    sample = texts.filter(F.col("code").isin(kept) & chosen).select("code", "text")
    with batch_rows(texts.sparkSession, BATCH_ROWS):
        rows = sample.mapInArrow(count, "code string, counts binary").groupBy("code").applyInPandas(total_up, "code string, counts binary").collect()
    found = {r["code"]: np.frombuffer(r["counts"], np.float32).astype(np.float64) for r in rows}
    kept = [k for k in kept if k in found and found[k].sum() > 0]
    logs = [np.log((found[k] + 0.1) / (found[k].sum() + 0.1 * CELLS)) for k in kept]
    return kept, np.array(logs, np.float32).reshape(len(kept), CELLS)


def _soft(v: np.ndarray) -> np.ndarray:
    v = np.exp(v - v.max())
    return v / v.sum()


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, language (``und`` if rejected), confidence (its
    posterior), text_language (by the text alone), accepted, and _key (of id,
    text, declared language and host).

    ``declared`` and ``host`` are columns of ``docs``; a null one is no
    evidence.  A null, empty or letterless text with no known declared
    language is rejected; with one, the other evidence decides.  If no
    language is declared anywhere there is nothing to learn from: all rows
    are rejected.  Repeated rows get equal results."""
    none = F.lit(None).cast("string")
    code = declared_code(declared) if declared is not None else none
    site = F.lower((host if host is not None else none).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), code.alias("code"), site.alias("host"),
                       row_key(F.col(id_col), F.col(text_col), code, site).alias("_key"))
    languages, logs = fit_text(rows)
    n = len(languages)
    kinds = "doc_id long, _key string, code string, host string, n_grams long, gain double, scores array<double>"
    model = docs.sparkSession.sparkContext.broadcast(logs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = -np.log(CELLS)
        for b in small_batches(batches, "text"):
            counts, gains, scores = [], [], []
            for text in b.column("text").to_pylist():
                cells = _cells(text)
                v = model.value[:, cells].sum(axis=1, dtype=np.float64) if n else np.zeros(0)
                counts.append(len(cells))
                gains.append(float(v.max() / len(cells) - nothing) if n and len(cells) else 0.0)
                scores.append((v * TEMPER).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), b.column("code"), b.column("host"), pa.array(counts, pa.int64()),
                                              pa.array(gains, pa.float64()), pa.array(scores, pa.list_(pa.float64()))],
                                             ["doc_id", "_key", "code", "host", "n_grams", "gain", "scores"])

    with batch_rows(docs.sparkSession, BATCH_ROWS):
        scored = staged(rows.mapInArrow(score, kinds), "language-scores")
    shape = "doc_id long, _key string, language string, confidence double, text_language string, accepted boolean"
    if not n:
        told = F.coalesce((F.col("n_grams") >= LEAST) & ~F.col("code").isin(*UNNAMED), F.lit(False))
        return scored.select("doc_id", "_key", F.when(told, F.col("code")).otherwise(NO_LANGUAGE).alias("language"), F.lit(0.0).alias("confidence"),
                             F.lit(NO_LANGUAGE).alias("text_language"), (told & F.col("code").isin(keep) if keep is not None else told).alias("accepted"))

    # grouped sums of the text's posteriors, over all documents
    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [_soft(np.array(s)).tolist() for s in b.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("code"), b.column("host"), pa.array(p, pa.list_(pa.float64()))], ["code", "host", "p"])

    soft = scored.filter(f"n_grams >= {LEAST}").select("code", "host", "scores").mapInArrow(posterior, "code string, host string, p array<double>")
    columns = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(n)]
    cells = staged(soft.groupBy("code", "host").agg(*columns), "language-cells")
    parts = F.split("host", r"\.")
    suffix, domain = F.element_at(parts, -1), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    cells = cells.withColumn("suffix", F.when(F.size(parts) > 1, suffix)).withColumn("domain", domain)
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    vector = lambda r: np.array([r[f"p{i}"] or 0.0 for i in range(n)])
    top = cells.agg(*sums).first()
    world = vector(top) + 1.0
    world = world / world.sum()

    array = lambda prefix: F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(n)])

    def likelihood(key: str) -> DataFrame:
        """(key, log P(value | language), less its greatest) of every value, staged."""
        seen = cells.filter(F.col(key).isNotNull()).groupBy(key).agg(*sums)
        top = seen.agg(F.count("*").alias("k"), *sums).first()
        whole = np.log(vector(top) + 0.5 * max(1, top["k"]))
        logs = F.zip_with(array("p"), F.array(*[F.lit(float(w)) for w in whole]), lambda c, w: F.log(c + 0.5) - w)
        seen = seen.select(F.col(key).alias(f"_{key}"), logs.alias("l"))
        return staged(seen.select(f"_{key}", F.transform("l", lambda x: x - F.array_max("l")).alias(f"by_{key}")), f"language-by-{key}")

    said, ended = likelihood("code"), likelihood("suffix")

    # host priors: a row per host, smoothed towards domain, suffix and corpus
    smooth = lambda own, parent: F.transform(F.zip_with(own, parent, lambda c, q: c + SMOOTH * q),
                                             lambda x: x / (F.aggregate(own, F.lit(0.0), lambda a, c: a + c) + SMOOTH))
    whole = F.array(*[F.lit(float(w)) for w in world])
    named = cells.filter("host is not null")
    hosts = named.groupBy("host", "domain", "suffix").agg(*sums).select("host", "domain", "suffix", array("p").alias("own"))
    ends = staged(named.filter("suffix is not null").groupBy("suffix").agg(*sums).select("suffix", smooth(array("p"), whole).alias("up2")), "language-suffixes")
    domains = named.groupBy("domain", "suffix").agg(*sums).select("domain", "suffix", array("p").alias("own1"))
    domains = domains.join(ends, "suffix", "left").select("domain", smooth(F.col("own1"), F.coalesce("up2", whole)).alias("up1"))
    hosts = hosts.join(staged(domains, "language-domains"), "domain").join(ended, F.col("suffix") == F.col("_suffix"), "left")
    hosts = staged(hosts.select(F.col("host").alias("_host"), smooth(F.col("own"), F.col("up1")).alias("prior"), "by_suffix"), "language-hosts")

    known = {*languages, *UNNAMED}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, sure, alone, fine = [], [], [], []
            for r in b.select(["code", "host", "n_grams", "gain", "scores", "prior", "by_code", "by_suffix"]).to_pylist():
                text = np.array(r["scores"])
                v = text + np.log(np.array(r["prior"] or world))
                for evidence in (r["by_code"], r["by_suffix"]):
                    if evidence is not None:
                        v = v + evidence
                p = _soft(v)
                i = int(p.argmax())
                alone.append(languages[int(text.argmax())] if r["n_grams"] >= LEAST else NO_LANGUAGE)
                if r["n_grams"] >= LEAST and r["code"] is not None and r["code"] not in known:
                    ok, name, p = True, r["code"], np.zeros(n)  # declared, and no model to tell it by
                else:
                    ok, name = (r["n_grams"] >= LEAST and r["gain"] > 0) or (r["n_grams"] < SHORT and r["code"] in languages), languages[i]
                best.append(name if ok else NO_LANGUAGE)
                sure.append(float(p[i]) if ok else 0.0)
                fine.append(bool(ok and (keep is None or name in keep)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), pa.array(best, pa.string()), pa.array(sure, pa.float64()),
                                              pa.array(alone, pa.string()), pa.array(fine, pa.bool_())],
                                             ["doc_id", "_key", "language", "confidence", "text_language", "accepted"])

    joined = scored.join(hosts, F.col("host") == F.col("_host"), "left").join(said, F.col("code") == F.col("_code"), "left").drop("_host", "_code")
    return joined.mapInArrow(fuse, shape)


def accepted_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None,
                       keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known (and one of ``keep``), unchanged."""
    found = identify(docs, id_col=id_col, text_col=text_col, declared=declared, host=host, keep=keep)
    gone = staged(found.filter("not accepted").select("_key").distinct(), "language-rejected")
    none = F.lit(None).cast("string")
    code = declared_code(declared) if declared is not None else none
    site = F.lower((host if host is not None else none).cast("string"))
    return without(docs, row_key(F.col(id_col), F.col(text_col), code, site), gone)
