"""Second pass over cases whose speech or frames arrive later: a stream of texts, a table of cases.

Both tables lie in the shared folder as Parquet in buckets by a hash of the case.  A micro-batch reads and replaces the buckets of its own cases only (dynamic partition
overwrite), and scores those cases anew from all their texts.  A text is told by its case, kind and number and the last one sent counts, so a batch that is
sent again, or that failed half-way, changes nothing that it would not have changed the first time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.session import materialise, tables_freed

#: A text that arrives: kind ``speech`` or ``frame``, its number within the case, when it is heard or seen, when it was sent.
ARRIVAL = "case_id long, kind string, no long, time_s double, text string, sent long"


def bucket_of(case_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(buckets)).cast("int")


class CaseStore:
    """Cases and the texts that they were scored from, under one folder.

    ``score(texts, touched)`` gives the rows of the cases in ``touched`` (case_id) from all texts of these cases; its columns are those of the case table.
    """

    def __init__(self, spark: SparkSession, folder: str, score: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.folder, self.score, self.buckets = spark, folder.rstrip("/"), score, buckets

    def _read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets (partition pruning); empty before the first write."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        found = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{name}")
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write whole buckets; those without rows here stay as they are.

        The rows are written aside first: they may come from the buckets that they replace.
        """
        aside = materialise(rows.repartition("bucket"))
        aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    @property
    def cases(self) -> DataFrame:
        return self._read("cases", self._case_schema()).drop("bucket")

    def _case_schema(self) -> str:
        none = self.spark.createDataFrame([], ARRIVAL).drop("sent")
        shape = self.score(none, self.spark.createDataFrame([], "case_id long")).schema
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)

    def fill(self, touched: DataFrame) -> None:
        """Score the cases in ``touched`` from the texts at hand and put them into the table."""
        touched = materialise(touched.select("case_id").distinct().withColumn("bucket", bucket_of("case_id", self.buckets)))
        numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # the number of buckets at most
        if not numbers:
            return
        texts = self._read("texts", ARRIVAL, numbers).join(touched.select("case_id"), "case_id", "left_semi").drop("bucket", "sent")
        fresh = materialise(self.score(texts, touched.select("case_id")))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
        others = self._read("cases", schema, numbers).join(touched.select("case_id"), "case_id", "left_anti")
        self._replace("cases", others.unionByName(fresh.withColumn("bucket", bucket_of("case_id", self.buckets))))

    def take(self, batch: DataFrame, batch_id: int = 0) -> None:
        """One micro-batch of ARRIVAL rows: its texts go in, its cases are scored again."""
        with tables_freed():
            new = materialise(batch.where("case_id is not null").select(*[c.split()[0] for c in ARRIVAL.split(", ")]).withColumn("bucket", bucket_of("case_id", self.buckets)))
            numbers = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # the number of buckets at most
            if not numbers:
                return
            last = Window.partitionBy("case_id", "kind", "no").orderBy(F.desc("sent"), F.desc("text"))
            both = self._read("texts", ARRIVAL, numbers).unionByName(new).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
            self._replace("texts", both)
            self.fill(new)

    def follow(self, arrivals: DataFrame, checkpoint: str | None = None, **trigger: object) -> StreamingQuery:
        """Take every micro-batch of a stream of ARRIVAL rows; by default what is there, then stop."""
        where = checkpoint or f"{self.folder}/progress-{uuid.uuid4().hex}"
        return arrivals.writeStream.foreachBatch(self.take).option("checkpointLocation", where).trigger(**(trigger or {"availableNow": True})).start()
