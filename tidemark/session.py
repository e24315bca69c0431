"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: UTC keeps calendar fields and epoch casts independent of the host;
#: AQE coalesces small shuffles and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: temporary folders of local sessions, by application id
_LOCAL_ROOTS: dict[str, str] = {}
#: scratch paths handed out, by application id
_HANDED_OUT: dict[str, list[str]] = {}

# The keys a caller has to give.
S3_KEYS = ("endpoint_url", "access_key", "secret_key")


def s3a_conf(s3: Mapping[str, str] | None) -> dict[str, str]:
    """Hadoop S3A settings, or nothing unless all three keys are given."""
    if not s3 or any(k not in s3 for k in S3_KEYS):
        return {}
    # Names of the S3A settings.
    return {
        "spark.hadoop.fs.s3a.endpoint": s3["endpoint_url"],
        "spark.hadoop.fs.s3a.access.key": s3["access_key"],
        "spark.hadoop.fs.s3a.secret.key": s3["secret_key"],
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        "spark.hadoop.fs.s3a.path.style.access": "true",
        "spark.hadoop.fs.s3a.connection.ssl.enabled": "true",
    }


def session_builder(app: str = "tidemark", s3: Mapping[str, str] | None = None):
    """A session builder; master and sizing are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**BASE_CONF, **s3a_conf(s3)}.items():
        builder = builder.config(key, value)
    return builder


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    do without, and then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_root`."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; returns how many.

    For the end of a job: frames that still read them stop working.
    """
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Later stages then start from files: a lost executor costs one re-read,
    and values tied to physical layout stay what they were when written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
