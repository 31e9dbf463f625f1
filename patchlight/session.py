"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "patchlight") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that the session names. A session on one machine that names none (tests, a laptop) gets one of
    its own; on a cluster this is an error, since executors would not see it."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        named = _OWN.setdefault(sc.applicationId, sc.getCheckpointDir() or tempfile.mkdtemp(prefix="patchlight-ckpt-"))
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one, for tables and files that a job writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    Only where the session names none (tests, a laptop) is a scratch folder set.
    """
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
