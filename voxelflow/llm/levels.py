"""An incremental index: immutable sorted runs that are merge-joined with each new batch.

A run is a table in the shared folder, bucketed by one key column and sorted by
all of them inside each bucket, one file a bucket.  A new batch is dealt into
the same buckets, once; the runs are joined to it where they lie, by sort-merge
joins that neither shuffle nor sort them.  What the batch has and no run has
becomes a run of its own; as in a binary counter, runs of equal rank melt into
one of the next, bucket by bucket.

An entry equal in its key columns and ``sig`` to an earlier one covers equal
windows.  Windows can only be equal between entries of one key; where a key has
entries of several sigs, one entry of each is opened: first into bands of
windows that have all but a few units in common, which are held against each
other in the same way, and only then into single windows (``settle``).  Buckets and run sizes only steer the plan:
a plan that cannot use them shuffles, and gives the same result.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import N_BITS, PLACE, PLACES_SQL, START, Spans, opened_bands, told_apart
from .common import FREE_SHUFFLES, fresh, settings, workspace

#: Join on more columns than the bucket column, in the order that the files have, whenever a table is bucketed.
AS_BUCKETED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def as_bucketed(spark: SparkSession):
    return settings(spark, AS_BUCKETED)


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


class Index:
    """What both indexes share; a subclass names its key columns and makes entries.

    ``both`` marks every one of equal windows, else all but the first; earlier
    batches come before later ones, then doc_id, sub and start count.
    """

    #: Name and type of the key columns; the first is the bucket column.
    KEYS: list[tuple[str, str]]
    both: bool
    #: Windows of a band.
    band: int

    def __init__(self, spark: SparkSession, name: str, spans: Spans, window: int, gram: int, buckets: int | None = None):
        if window - gram + 1 >= 1 << N_BITS:
            raise ValueError(f"a gram must have at least {window - (1 << N_BITS) + 2} units")
        self.spark, self.spans, self.window, self.gram = spark, spans, window, gram
        self.ws = workspace(spark, name)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = [k for k, _ in self.KEYS]
        self.group = [*self.keys, "sig"]
        self.runs: dict[int, str] = {}  # level: table
        self.texts: list[DataFrame] = []  # of each batch: born, doc_id, sub, text
        self.marks: list[DataFrame] = []
        self.details: list[DataFrame] = []
        self.settled: DataFrame | None = None  # what the last batch of ``add_batch`` has changed

    def entries(self, docs: DataFrame) -> DataFrame:
        """The key columns, sig, place and more, for rows of born, doc_id, sub and text."""
        raise NotImplementedError

    def table(self, level: int) -> DataFrame:
        return self.spark.table(self.runs[level])

    def store(self, df: DataFrame) -> str:
        """A bucketed and sorted table in the shared folder, one file a bucket."""
        name = f"run_{uuid.uuid4().hex}"
        with settings(self.spark, AS_BUCKETED | FREE_SHUFFLES):
            df.write.format("parquet").option("path", f"{self.ws.root}/{name}").option("compression", "zstd").bucketBy(self.buckets, self.keys[0]).sortBy(*self.group).saveAsTable(name)
        self.ws.tables.append(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.ws.drop(name)

    def told(self, rows: DataFrame, runs: dict[int, str], group: list[str], kept: tuple = ()) -> DataFrame:
        """Entries with ``marked``: a repetition; ``new``: the first of all; ``rep``: the entry of a run that they repeat."""
        order = Window.partitionBy(*group).orderBy(*PLACE)
        place = F.struct(*PLACE)
        rows = rows.withColumn("nth", F.dense_rank().over(order)).withColumn("row", F.row_number().over(order))
        if self.both:
            rows = rows.withColumn("after", F.lead(place).over(order))
        for level in runs:
            rows = rows.join(self.table(level).select(*group, F.struct(*PLACE).alias(f"rep{level}")), group, "left")
        reps = [F.col(f"rep{level}") for level in runs]
        rep = F.coalesce(*reps) if reps else F.lit(None).cast("struct<born:int,doc_id:long,sub:long,at:long>")
        marked = (F.col("nth") > 1) | rep.isNotNull()
        if self.both:
            marked = marked | (F.size("more") > 0) | F.coalesce(F.col("after") != place, F.lit(False))
        first = F.col("row") == 1
        return rows.select(*group, *PLACE, *kept, "more", marked.alias("marked"), (first & rep.isNull()).alias("new"), F.when(first, rep).alias("rep"))

    def marked(self, told: DataFrame) -> list[DataFrame]:
        """Places that repeat."""
        found = [told.where("marked").select(*PLACE), told.select(F.explode("more").alias("m")).select("m.*")]
        return found + [told.where("rep is not null").select("rep.*")] * self.both

    def batch_plan(self, docs: DataFrame) -> DataFrame:
        """Entries of a batch, dealt once, beside what the runs have of them."""
        return self.told(self.entries(docs).repartition(self.buckets, self.keys[0]), self.runs, self.group)

    def add(self, docs: DataFrame, keep: bool = True) -> None:
        """A batch of (born, doc_id, sub, text); without ``keep`` it is compared, and not put into the index."""
        self.texts.append(docs)
        name = self.store(self.batch_plan(docs))
        told = self.spark.table(name)
        self.marks.append(self.ws.write(union(self.marked(told)), self.ws.name("marks")))
        new = told.where("new").select(*self.group, *PLACE)
        known = new.groupBy(*self.keys).agg((F.count("*") > 1).alias("several"))
        for level in self.runs:
            known = known.join(self.table(level).select(*self.keys).distinct().withColumn(f"in{level}", F.lit(True)), self.keys, "left")
        several = functools.reduce(lambda a, b: a | b, [F.col(f"in{level}").isNotNull() for level in self.runs], F.col("several"))
        opened = [new.join(known.where(several), self.keys, "left_semi")]
        opened += [self.table(level).join(new, self.keys, "left_semi") for level in self.runs]
        with as_bucketed(self.spark):
            self.details.append(self.ws.write(union([part.select(*PLACE) for part in opened]), self.ws.name("details")))
        if keep:
            level = next(i for i in range(64) if i not in self.runs)
            run, melted = None, [i for i in sorted(self.runs) if i < level]
            for i in melted:
                both = self.melted(new if run is None else self.spark.table(run), self.table(i))
                before, run = run, self.store(both)
                for name in (before, self.runs.pop(i)):
                    if name:
                        self.forget(name)
            self.runs[level] = run or self.store(new)
        self.forget(name)

    def melted(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Two runs as one.  They have no entry in common: a full join merges them, bucket by bucket, in order."""
        one, two = (x.select(*self.group, F.struct(*PLACE).alias(n)) for x, n in ((one, "p1"), (two, "p2")))
        return one.join(two, self.group, "full").select(*self.group, F.coalesce("p1", "p2").alias("p")).select(*self.group, "p.*")

    def settle(self) -> DataFrame:
        """born, doc_id, sub and ``found``, a list of (start, length), of what repeats since the last call."""
        detail = union(self.details).groupBy("born", "doc_id", "sub").agg(F.collect_list(F.struct("at")).alias("found"))
        texts = union(self.texts).join(detail, ["born", "doc_id", "sub"]).select("born", "doc_id", "sub", "text", "found")
        pair = ["key", "sig"]
        bands = texts.mapInArrow(opened_bands(self.spans, self.window, self.band), f"key long, windows array<long>, sig long, born int, doc_id long, sub long, at long, {PLACES_SQL}")
        told = self.ws.write(self.told(bands, {}, pair, ("windows",)), self.ws.name("bands"))
        new = told.where("new")
        several = new.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        single = new.join(several, "key", "left_semi").select("key", F.posexplode("windows").alias("i", "sig"), *PLACE, F.expr("slice(more, 1, 0)").alias("more"))
        single = single.withColumn("at", F.shiftleft(F.shiftright("at", START) + F.col("i"), START) + 1).drop("i")
        marks = [*self.marks, *self.marked(told), *self.marked(self.ws.write(self.told(single, {}, pair), self.ws.name("windows")))]
        self.marks, self.details = [], []
        at = F.col("at")
        runs = F.struct(F.shiftright(at, START).alias("start"), (at.bitwiseAND((1 << N_BITS) - 1) + self.window - 1).alias("length"))
        return union(marks).groupBy("born", "doc_id", "sub").agg(F.collect_list(runs).alias("found"))

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text and more) with a last column ``found``: what of them repeats, in themselves or earlier batches.

        The batch is put into the index.  Ids may come again: earlier batches come first, whatever their ids.
        What the batch makes removable in earlier ones is in ``changes``.
        """
        sub, key, born = fresh(docs, "row_sub"), fresh(docs, "row_key"), len(self.texts)
        whole = told_apart(docs, self.ws, key, sub)
        self.add(whole.select(F.lit(born).alias("born"), F.col(key).alias("doc_id"), F.col(sub).alias("sub"), F.col("text").cast("string").alias("text")))
        self.settled = self.ws.write(self.settle(), self.ws.name("settled"))
        found = self.settled.where(F.col("born") == born).select(F.col("doc_id").alias(key), F.col("sub").alias(sub), F.col("found").alias(fresh(docs, "found")))
        return whole.join(found, [key, sub], "left").drop(key, sub)

    def changes(self) -> DataFrame:
        """batch (from 0), doc_id, text and ``found`` of documents of earlier batches: what repeats since the last batch was added.

        Where only later places go, an earlier batch never changes; where all go, these are
        the places that were the only one of their string so far, and some told before.
        """
        if self.settled is None or not self.both:
            return self.spark.createDataFrame([], "batch int, doc_id long, text string, found array<struct<start:long,length:long>>")
        earlier = self.settled.where(F.col("born") < len(self.texts) - 1)
        rows = union(self.texts).join(earlier, ["born", "doc_id", "sub"])
        return rows.select(F.col("born").alias("batch"), F.nullif(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), "text", "found")


def marked_runs(index: Index, docs: DataFrame, batches: int, runs: str = "found") -> DataFrame:
    """``docs`` with a last column ``runs`` of (start, length): windows that repeat; null where none do.

    Batches are ranges of ascending doc_id; the last is compared and not kept.
    """
    key, sub, born = fresh(docs, "row_key"), fresh(docs, "row_sub"), fresh(docs, "row_born")
    whole = told_apart(docs, index.ws, key, sub)
    known = whole.where(F.col(key) > F.lit(-(1 << 63)))
    bounds = known.select(F.percentile_approx(key, [(i + 1) / batches for i in range(batches - 1)], 1000).alias("p")).first()["p"] if batches > 1 else None
    edges = [None, *sorted(set(bounds or [])), None]
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + (F.col(key) > edge).cast("int")
    whole = whole.withColumn(born, number)
    for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = whole if low is None else whole.where(F.col(key) > low)
        part = part if high is None else part.where(F.col(key) <= high)
        index.add(part.select(F.lit(b).alias("born"), F.col(key).alias("doc_id"), F.col(sub).alias("sub"), F.col("text").cast("string").alias("text")), keep=high is not None)
    index.texts = [whole.select(F.col(born).alias("born"), F.col(key).alias("doc_id"), F.col(sub).alias("sub"), F.col("text").cast("string").alias("text"))]
    found = index.settle().select(F.col("born").alias(born), F.col("doc_id").alias(key), F.col("sub").alias(sub), F.col("found").alias(runs))
    out = whole.join(found, [born, key, sub], "left").drop(born, key, sub)
    for name in index.runs.values():  # the result does not read them
        index.forget(name)
    index.runs.clear()
    return out
