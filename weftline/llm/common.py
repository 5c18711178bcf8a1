"""What the training-data operators share: input columns, scratch tables, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one operator's caches hold in a worker, and what an entry takes beside its characters.
CACHE_BYTES, ENTRY_BYTES = 112 << 20, 170
_owners: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def cached_by(name: str, clear: Callable[[], None]) -> None:
    """Name an owner of caches in the worker; clear() empties them."""
    _owners[name] = clear


def enter(name: str) -> None:
    """A task of an owner begins: workers are used again by later stages, so the caches of all other owners go."""
    if _owner != [name]:
        for other, clear in _owners.items():
            if other != name:
                clear()
        _owner[:] = [name]
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that is free but that the worker still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task(owner: str):
    """For what mapInArrow runs in a task of an owner. An executor keeps more workers than it has cores and takes them in
    turn, so each one that a task comes to drops the caches of other owners, and gives back what is free when it ends."""

    def of(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @functools.wraps(run)
        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter(owner)
            yield from run(batches)
            give_back()

        return inside

    return of


class Cache:
    """A dictionary by strings (kept) that is emptied before it holds more than CACHE_BYTES."""

    def __init__(self) -> None:
        self.kept: dict[str, object] = {}
        self.held = 0

    def make_room(self, new: set[str] | list[str]) -> bool:
        """Count new entries in; whether all others had to go for them."""
        more = sum(map(len, new)) + ENTRY_BYTES * len(new)
        full = self.held + more > CACHE_BYTES and len(self.kept) > 0
        if full:
            self.clear()
        self.held += more
        return full

    def clear(self) -> None:
        self.kept.clear()
        self.held = 0


#: Rows and bytes of one Arrow batch; whole texts are long, so few rows.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts have no length limit, so rows alone bound nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, so other columns can't clash; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row for each doc_id, and None; where doc_ids repeat, numbers in their place, and what they stand for.

    Numbers ascend with (doc_id, text), and the second table has them as doc_id beside own_id and text. Rows that are
    alike in both are one row. Rows without a doc_id are left out.
    """
    one = id_text(docs).where("doc_id is not null")
    if one.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return one, None
    rows = one.distinct().orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("own_id"), "text")
    rows = materialize(rows, "numbered")
    return rows.select("doc_id", "text"), rows


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as double underscores) while a block runs."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the cluster names none, a local session gets a temporary folder; a real cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, made, True)
    root = f"file://{made}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


@contextlib.contextmanager
def noting(paths: list[str]):
    """Scratch tables that the block makes are put down in paths, so that they can be dropped once what was made of them is written."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


#: Rows of a scratch table for each of its files, where the caller knows how many rows it has at most.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """df, of about so many rows, with a task for FILE_ROWS of them, but two for each core at least: to open a file for
    every shuffle partition takes longer than the rows of a small table. Partitions stay as they are where they are fewer."""
    return df if rows is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: any executor can read it again."""
    path = scratch(df.sparkSession, name)
    few_files(df, rows).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the scratch table that df reads, once what was made of it is written."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """Connected components of undirected edges (a, b: long; about so many rows) as (node, root), root the least node.

    Each round links every node's neighbours to the least of them (large star, then small star), which ends in
    a logarithmic number of rounds on long chains and in one or two on stars; edges that are stars of their least
    nodes are done, which one aggregation by nodes tells. Rounds are Parquet tables in the shared folder; nothing but
    whether they are done reaches the driver. No neighbourhood is collected: minima are aggregated before the shuffle, so a hub
    with most of the edges costs one partial row for each task.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = scratch(spark, name)
    few_files(e, rows).write.parquet(path)
    e = spark.read.schema(e.schema).parquet(path)
    while not are_stars(e):
        # of a node's neighbours and itself the least: only edges to smaller nodes can tell
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        large = e.join(least, e["v"] == least["at"], "left").select("u", F.coalesce("m", "v").alias("v"))
        # every node now has smaller neighbours only; all of them and the node go to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        at = scratch(spark, name)
        few_files(new, rows).write.parquet(at)
        old, path = path, at
        e = spark.read.schema(new.schema).parquet(at)
        drop_path(spark, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v: u > v) are stars of their least nodes: no u has two v, and none is a v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("lo"))
    return seen.where("ups > 1 or (ups > 0 and lo = 0)").isEmpty()


#: A Bloom filter keeps rows of keys met once from the shuffle. It has a fixed size; where more keys recur than it tells
#: apart, it lets more rows through, and the join after it decides as before.
BLOOM = {
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1t",
    "spark__sql__optimizer__runtime__bloomFilter__expectedNumItems": "4000000",
    "spark__sql__optimizer__runtime__bloomFilter__maxNumBits": str(1 << 26),
}

#: What a query shuffled is deleted when it ends, not when the driver happens to collect its garbage. For queries that
#: run once, as those of scratch tables do: a DataFrame that is run again would have to shuffle again.
DROP_SHUFFLES = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}

#: Ids that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 200_000


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents that ids (doc_id, a table that is read again) names, as a scratch table.

    Few ids are broadcast after counting them, so that the texts aren't shuffled; many are joined by doc_id.
    """
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(docs.join(side, "doc_id", "left_semi").select("doc_id", "text"), "texts")


def keep_rows(docs: DataFrame, prepare) -> DataFrame:
    """docs, all columns as they are, without the rows that a test rejects.

    prepare() is called once in each task and returns the test: Arrow batch to booleans, in the batch's order.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        test = prepare()
        for b in batches:
            yield b.filter(pa.array(test(b), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
