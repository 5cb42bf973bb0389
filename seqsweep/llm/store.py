"""Written intermediate tables and connected components.

Tables go to the folder that the session names in spark.checkpoint.dir, which all executors share. Only where it is
unset and Spark runs on one machine (tests) a folder of the machine is set; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="seqsweep-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut of the lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that no result still reads."""
    spark, path = df.sparkSession, df._written_at
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the graph with edges (a, b): component is the smallest node that can be reached.

    Each round hooks every node to the smallest component of its neighbours, carries that over to the node that
    stood for its old component, and then shortens chains, so the number of rounds is logarithmic in practice.
    Nothing is collected but the number of changes. An empty edge table gives an empty result.
    """
    edges = edges.select("a", "b").distinct()
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        hook = near.join(label, "node").where("seen < component").select("component", "seen").groupBy(F.col("component").alias("node")).agg(F.min("seen").alias("seen"))
        low = near.unionByName(hook).groupBy("node").agg(F.min("seen").alias("seen"))
        step = label.join(low, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        step = written(step, "step")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = written(step.join(up, "component", "left").select("node", "was", F.least("component", "top").alias("component")), "labels")
        discard(label)
        discard(step)
        label = new.select("node", "component")
        label._written_at = new._written_at
        if not new.where("was <> component").limit(1).count():
            discard(both)
            return label
    raise RuntimeError("components did not settle")
