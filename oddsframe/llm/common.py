"""Helpers shared by the training-data operators: scratch tables, connected components, small expressions."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, so that a batch of texts has a few MB.
BATCH_ROWS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='oddsframe-')}"
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, urlparse(found).path, True)
    return found.rstrip("/")


#: Scratch tables that this process has written.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. Cuts the lineage; survives lost executors."""
    bounded_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """Where the list of scratch tables ends now."""
    return len(_written)


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch tables written since a mark, once results that read them are stored; how many there were."""
    n = len(_written) - since
    while len(_written) > since:
        delete_table(spark, _written.pop())
    return n


def delete_table(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fraction_of(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: BATCH_ROWS rows, whatever the session had if that is less."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if not 0 < int(now) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose texts (null: empty) pass the test that make() gives; made once a task."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for b in batches:
            yield b.filter(pa.array(test([t or "" for t in b.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Rows of one key that may stay together in a join, and keys that are dealt to several parts, at most.
TOGETHER, MOST_HOT = 1_000, 50_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """(__key, __parts) of the keys that spread_join deals to several parts, or None. rows is read twice: it should be a table."""
    total = rows.count()
    if total <= TOGETHER:
        return None
    most = max(TOGETHER, total // MOST_HOT)
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = materialise(counts.select("__key", F.ceil(F.col("__n") / most).cast("int").alias("__parts")), "hot")
    return None if hot.isEmpty() else hot


_COUNT = object()


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot=_COUNT) -> DataFrame:
    """left joined to right, which has one row a key, with the rows of a hot key dealt to parts that each get right's row.

    Keys are hot beyond TOGETHER rows, or a MOST_HOT-th part of all rows if that is more: so there are fewer than MOST_HOT of them, and the list of them
    that is broadcast is bounded. hot: what hot_keys said of the same keys, where left isn't a table."""
    hot = hot_keys(left, key) if hot is _COUNT else hot
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    others = [c for c in left.columns if c != key] or [key]
    part = F.coalesce(F.pmod(F.xxhash64(*others), F.col("__parts")), F.lit(0)).cast("int")
    many = left.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", part).drop("__key", "__parts")
    each = right.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__key", "__parts")
    return many.join(each, [key, "__part"], how).drop("__part")


#: Rows, and bytes of keys, of a table that attach broadcasts at most.
ATTACHED_ROWS, ATTACHED_BYTES = 50_000, 8 << 20


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, a table of one row a key. facts goes to all tasks if its rows are few and its keys short; else the rows are shuffled,
    those of a hot key dealt to several parts. A row without facts has null ones."""
    n, long = facts.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    return rows.join(F.broadcast(facts), key, "left") if n <= ATTACHED_ROWS and (long or 0) <= ATTACHED_BYTES else spread_join(rows, facts, key, "left")


#: Bits of a sieve a value, and in all, at most (32 MB).
SIEVE_BITS, SIEVE_MOST = 16, 28


def sieve_of(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for each value of the column, and for few others: two bits of a table for each value.

    The table's parts are made on the executors; the whole, 32 MB at most, is broadcast. With more values than it has room for it lets more through."""
    width = min(SIEVE_MOST, max(16, math.ceil(math.log2(max(1, values.count()) * SIEVE_BITS))))
    places = lambda v: [F.pmod(F.xxhash64(v, F.lit(k)), F.lit(1 << width)) for k in (1, 2)]

    def part(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, dtype=bool)
        bits[rows["place"].to_numpy() & 0xFFFF] = True
        return pa.table({"part": rows["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = values.select(F.explode(F.array(*places(F.col(column)))).alias("place")).distinct().withColumn("part", F.shiftright("place", 16).cast("int"))
    table = np.zeros((1 << (width - 16), 1 << 13), dtype=np.uint8)
    for r in at.groupBy("part").applyInArrow(part, "part int, bits binary").toLocalIterator():
        table[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(table.ravel())

    @F.arrow_udf("boolean")
    def passes(one: pa.Array, two: pa.Array) -> pa.Array:
        bit = lambda p: shared.value[p >> 3] >> (p & 7) & 1
        return pa.array(bit(one.to_numpy()) & bit(two.to_numpy()) != 0)

    return lambda v: passes(*places(v))


def without(rows: DataFrame, gone: DataFrame, column: str, on: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """rows without those that match a row of gone (an anti-join). Rows whose value of the column passes no sieve of gone's stay where they are; the others
    alone, and null ones, are shuffled."""
    bounded_batches(rows.sparkSession)
    may = F.coalesce(sieve_of(gone, column)(F.col(column).cast(gone.schema[column].dataType)), F.lit(True)) | F.col(column).isNull()
    marked = rows.withColumn("__may", may)
    rest = marked.where("__may").drop("__may")
    return marked.where("not __may").drop("__may").unionByName(rest.join(gone, on(rest, gone), "left_anti"))


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b: long). Returns (node, component), component the least node.

    Alternates large-star and small-star steps, each a minimum by key and a join that adaptive execution
    can split when a node has very many links; O(log n) rounds in practice. Lineage is cut every round by a table in
    the shared folder. Nodes without links aren't returned. Null ends are dropped.
    """
    pairs = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("b", F.lit(1 << 20)))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        # large star: the larger neighbours of a node go to its least neighbour
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        pairs = materialise(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())
