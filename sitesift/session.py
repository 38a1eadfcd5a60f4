"""Session helpers: recommended settings and a reliable checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  All per-page work is keyed by ``page_id``;
# with co-partitioning on a subset of the join keys allowed, joins keyed by
# ``(page_id, x)`` reuse the one ``page_id`` partitioning of the node table
# instead of shuffling it again.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles a method of more than 8,000 bytes: a fused stage that needs a longer one is run operator by
    # operator instead of being interpreted row by row
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings above to an existing session."""
    for k, v in RECOMMENDED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sitesift") -> SparkSession:
    """A local session for tests and the bench (UI off, no server)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.sql.session.timeZone", "UTC")
        # no call site for every column: plans of hundreds of expressions are built several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session.  Where it is unset, a local session (tests, bench) uses a folder in its warehouse; on a cluster
    that folder may be one machine's own, so it is an error.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the session's checkpoint folder.

    Keeps the output partitioning and ordering, so later per-page joins and
    windows on the result need no new shuffle; survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # persisted first, so writing the checkpoint reads the cached blocks
    # instead of running the plan a second time
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round-robin over ``spark.sql.shuffle.partitions`` tasks, before a step that costs much a row.

    A compact table is read as one split or joined in a few coalesced partitions, however many cores there are; the number of
    tasks is given, so adaptive execution does not coalesce them again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _hashed_by(df: DataFrame, key: str, n: int) -> bool:
    """Whether the planned output is already hash-partitioned by ``key`` into ``n`` parts."""
    try:
        p = df._jdf.queryExecution().executedPlan().outputPartitioning().toString()
    except Exception:
        return False
    return p.startswith(f"hashpartitioning({key}#") and p.endswith(f", {n})") and "," not in p[len("hashpartitioning("):].split(")")[0].rsplit(",", 1)[0]


def materialize(df: DataFrame, tag: str = "t", key: str = "page_id") -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` under the checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, survives executor loss, and unlike
    a checkpoint the read-back keeps a ``key`` hash partitioning, so later
    joins, windows and aggregates keyed by ``key`` (first) need no shuffle.
    Rows are hash-partitioned by ``key`` first (unless they already are),
    so every task writes one bucket file.  Without ``key`` it falls back to
    a reliable checkpoint.
    """
    if key not in df.columns:
        return cut_lineage(df)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not _hashed_by(df, key, n):
        df = df.repartition(n, key)
    sort_cols = [key, "node_id"] if "node_id" in df.columns else None
    name = f"sitesift_{tag}_{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    w = df.write.bucketBy(n, key)
    if sort_cols:
        w = w.sortBy(*sort_cols)
    w.option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)
