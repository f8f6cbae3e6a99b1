"""Session settings and shared-storage helpers.

Everything here reads what the cluster already configured and only fills
gaps, so the same code runs in tests (``local[*]``) and on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings a query session needs for the dialect contract in README.md.
QUERY_SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # DuckDB-style "quoted identifiers" are identifiers, not strings.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}

# Defaults that matter at scale; applied only when building a session here.
BUILDER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a SparkSession with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BUILDER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Only a local-mode session (tests) with neither set gets a folder of its
    own; on a cluster a machine-local folder would be lost with its
    executor, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - older conf API
        d = None
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    base = shared_dir(spark)
    return "/".join([base, "quarry", *parts, uuid.uuid4().hex])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, limit: int | None = None) -> list[str]:
    """Data files under a snapshot directory on any Hadoop file system
    (``file:``, ``s3a:``, ``hdfs:`` ...); Spark's hidden files are skipped.
    A listing of names only (at most ``limit``): no data passes through
    the driver."""
    return count_files(spark, path, limit)[1]


def count_files(spark: SparkSession, path: str, keep: int | None = None) -> tuple[int, list[str]]:
    """Number of data files under ``path`` and the first ``keep`` names
    (all when ``keep`` is None), in sorted order when all are kept."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return 0, []
    n, out = 0, []
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().startswith(("_", ".")):
            continue
        n += 1
        if keep is None or len(out) < keep:
            out.append(f.toString())
    return n, sorted(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` (any Hadoop URI: file:, s3a:, hdfs:, ...) exist?"""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any Hadoop file system."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file whole or not at all; False if it is there
    already (its content is left alone).  The text is written beside it and
    then takes the name: by a hard link on local disks and a rename that
    refuses to replace elsewhere, so of two writers one wins."""
    jvm = spark.sparkContext._jvm
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    tmp = "/".join([*tmp.split("/")[:-1], "." + tmp.split("/")[-1]])  # hidden from readers of the folder
    write_text(spark, tmp, text)
    (src, fs), (dst, _) = _fs(spark, tmp), _fs(spark, path)
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(dst), local(src))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            kinds = spark.sparkContext._gateway.new_array(rename, 1)
            kinds[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(src), fs.makeQualified(dst), kinds)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        if fs.exists(src):
            fs.delete(src, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, None where there is no such file."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    src = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
    finally:
        src.close()


def query_session(spark: SparkSession) -> SparkSession:
    """An isolated session (own temp views) with the query dialect settings."""
    s = spark.newSession()
    for k, v in QUERY_SESSION_CONF.items():
        s.conf.set(k, v)
    return s
