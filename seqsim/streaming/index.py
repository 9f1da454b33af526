"""New sequences against a stored index, and an index that grows with what arrives: extensions of the batch search to
Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqsim.operators.neighbors import distinct_pairs, distinct_seqs, once, variants, verified
from seqsim.sources.storage import discarded, saved


def write_index(useqs: DataFrame, path: str, distance: int, measure: str = "levenshtein", files: int | None = None) -> None:
    """The hashed variants of the distinct sequences, nulls left out, as a table sorted by key within files that hold key ranges, so
    that a lookup skips files and row groups."""
    keys = variants(distinct_seqs(useqs), distance, measure)
    (keys.repartitionByRange(files, "key") if files else keys.repartitionByRange("key")).sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def lookup(queries: DataFrame, index: DataFrame, distance: int, measure: str = "levenshtein") -> DataFrame:
    """(seq_q, seq_i, dist) of query sequences and those of an index written for this distance and measure."""
    q = variants(distinct_seqs(queries), distance, measure).withColumnRenamed("seq", "seq_q")
    met = q.join(index.select("key", F.col("seq").alias("seq_i")), "key")
    near = once(verified(met.where("seq_q != seq_i"), "seq_q", "seq_i", distance, measure, "key"), "seq_q", "seq_i", distance, measure)
    equal = met.where("seq_q = seq_i").select("seq_q", "seq_i", F.lit(0).alias("dist")).distinct()
    return near.unionByName(equal)


def neighbors_stream(stream: DataFrame, index_path: str, out_path: str, checkpoint: str, distance: int, measure: str = "levenshtein", once: bool = True) -> StreamingQuery:
    """Starts a query that writes the neighbours of each micro-batch of `stream` (seq) as one folder of out_path, so
    that a batch that is run again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        index = batch.sparkSession.read.parquet(index_path)
        lookup(batch, index, distance, measure).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def add_batch(batch: DataFrame, number: int, index_path: str, out_path: str, distance: int, measure: str = "levenshtein") -> None:
    """Writes the pairs (seq_a, seq_b, dist) that the batch's sequences, those not in the index yet, make with each other and
    with the index, and adds them to the index.

    Both go to folders of the batch's number, and only batches of smaller numbers are read; so a batch that is run again,
    whatever was written of it before, reads and writes the same.
    """
    spark, parts = batch.sparkSession, {"key": "key bigint, seq string", "seq": "seq string"}
    held = {k: spark.read.schema(f"{v}, batch bigint").parquet(f"{index_path}/{k}").where(F.col("batch") < number) if known(spark, f"{index_path}/{k}") else spark.createDataFrame([], v) for k, v in parts.items()}
    new = saved(batch.select("seq").where("seq is not null").distinct().join(held["seq"].select("seq"), "seq", "left_anti"))
    across = lookup(new, held["key"], distance, measure).select(F.least("seq_q", "seq_i").alias("seq_a"), F.greatest("seq_q", "seq_i").alias("seq_b"), "dist")
    distinct_pairs(new, distance, measure).unionByName(across).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
    variants(new, distance, measure).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{index_path}/key/batch={number}")
    new.write.mode("overwrite").parquet(f"{index_path}/seq/batch={number}")
    discarded(new)


def known(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def growing_index_stream(stream: DataFrame, index_path: str, out_path: str, checkpoint: str, distance: int, measure: str = "levenshtein", once: bool = True) -> StreamingQuery:
    """Starts a query that adds each micro-batch of `stream` (seq) by add_batch: whatever the batches, all pairs of distinct
    sequences that have arrived are written, each once."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, index_path, out_path, distance, measure)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sequence files (one column with a header) as they arrive."""
    return spark.readStream.schema("seq string").option("header", True).csv(path)
