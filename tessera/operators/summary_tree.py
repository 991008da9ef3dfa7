"""Summary tree: soft clusters of embeddings, summarised level by level."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens
from tessera.operators.mixture import soft_members
from tessera.operators.storage import cut


def cluster_count(n: int) -> int:
    return max(2, min(max(2, n // 10), n - 1))


def soft_clusters(items: DataFrame, *, n_clusters: int | None = None, dims: int = 2, threshold: float = 0.1, seed: int = 42) -> DataFrame:
    """items: id, embedding -> cluster, id, p: every cluster an item belongs to with at least the threshold. PCA and the mixture are
    fitted over all rows."""
    n = items.count()
    v = items.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    reduced = PCA(k=dims, inputCol="v", outputCol="features").fit(v).transform(v).select("id", "features")
    return cut(soft_members(reduced, n_clusters or cluster_count(n), threshold=threshold, seed=seed))


def assign(proba: DataFrame, threshold: float = 0.1) -> DataFrame:
    """proba: id, p (array) -> cluster, id, p."""
    return proba.select("id", F.posexplode("p").alias("cluster", "p")).filter(F.col("p") >= threshold).select("cluster", "id", "p")


def fallback_summary(texts) -> F.Column:
    """First five texts, 200 characters each."""
    return F.substring(F.array_join(F.transform(F.slice(texts, 1, 5), lambda t: F.substring(t, 1, 200)), " "), 1, 1000)


def summarise(members: DataFrame, items: DataFrame) -> DataFrame:
    """members: cluster, id; items: id, text, embedding, source_ids -> a row a cluster: text, token_count, source_ids (of all members, in
    order) and the mean embedding. A cluster's summary reads five texts, so only the first five are gathered."""
    from pyspark.sql import Window as W

    rows = members.select("cluster", "id").join(items, "id")
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("cluster").orderBy("id"))).filter("_n <= 5")
    texts = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("t")).select("cluster", fallback_summary(F.transform("t", lambda x: x["text"])).alias("text"))
    sources = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", "source_ids"))).alias("s")).select("cluster", F.flatten(F.transform("s", lambda x: x["source_ids"])).alias("source_ids"))
    mean = rows.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"))
    mean = mean.select("cluster", F.transform("e", lambda x: x["x"].cast("float")).alias("embedding"))
    return texts.join(sources, "cluster").join(mean, "cluster").withColumn("token_count", count_tokens(F.col("text")))


def build_tree(leaves: DataFrame, levels: int = 3) -> DataFrame:
    """leaves: id, text, embedding -> level, cluster, text, token_count, source_ids of all summaries. A level is built while the one
    below has four items at least."""
    items = leaves.select("id", "text", F.col("embedding").cast("array<float>").alias("embedding"), F.array("id").alias("source_ids"))
    out = None
    for level in range(1, levels + 1):
        if items.limit(4).count() < 4:
            break
        s = cut(summarise(soft_clusters(items), items).withColumn("level", F.lit(level)))
        out = s if out is None else out.unionByName(s)
        items = s.select(F.col("cluster").cast("long").alias("id"), "text", "embedding", "source_ids")
    return out
