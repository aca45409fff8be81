"""What the operators share: shared-folder tables, Arrow mapping, components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 2_000_000

_holder: list[tuple[str, Callable[[], object]]] = []


def holding(name: str, forget: Callable[[], object]) -> None:
    """Say that a worker's operator now keeps words in memory; what another one has kept is let go.

    Workers are used again by later stages, and each has room for one store.
    """
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((name, forget))


@functools.cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU library: there is nothing to give back
        return None


def trim() -> None:
    """Give memory that is free within this worker back to the machine; workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc()(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (a local test run, one machine) a folder
    of this machine is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"glimmer-{os.getpid()}")
    return f"file://{own}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what was computed once survives the loss of executors and
    isn't computed again by the several plans that read it.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` made; only when what was computed from them is a table itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(
    df: DataFrame,
    rows: Callable[[dict[str, list]], Iterable[dict[str, list]]],
    schema: str,
    weight: str | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``rows`` to column slices of each partition.

    ``rows`` takes the columns of a slice as lists (binary for the column named
    ``weight``, whose length bounds a slice) and yields columns of the output.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, weight, slice_bytes):
                columns = {}
                for name, values in zip(part.schema.names, part.columns, strict=True):
                    columns[name] = (values.cast(pa.binary()) if name == weight else values).to_pylist()
                for made in rows(columns):
                    arrays = [pa.array(made[f.name], f.type) for f in out]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
            trim()

    return df.mapInArrow(over, schema)


def arrow_beside(
    df: DataFrame, column: str, rows: Callable[[list[bytes | None]], dict[str, list]], schema: str, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``df`` with the columns of ``schema`` behind its own, which are carried along as they are, under ``c0``, ``c1`` ...

    ``rows`` takes a slice of ``column`` as UTF-8 (null: None) and returns the new
    columns.  No name of a column of ``df`` can clash with one of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    at = df.columns.index(column)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    added = StructType.fromDDL(schema)
    whole = StructType([*numbered.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}", slice_bytes):
                made = rows(part.column(at).cast(pa.binary()).to_pylist())
                arrays = [*part.columns, *(pa.array(made[f.name], f.type) for f in arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=whole.names)
            trim()

    return numbered.mapInArrow(over, whole)


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns ``c0``, ``c1`` ... that :func:`arrow_beside` carried along, under their own names."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def slices(batch: pa.RecordBatch, weight: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of the column ``weight``; one row at least."""
    if weight is None or not batch.num_rows:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` dealt out by ``key``, which has ``n`` values of about equal work, so that few of them share a task.

    Small groups by bytes would else be put together, however long their work.
    """
    return df.repartition(max(1, min(4 * n, max(n, 10_000))), key)


def state_of(df: DataFrame) -> tuple:
    """Row count and order-free checksum, to see whether a table still changes."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long nodes ``a``, ``b``.

    Alternating large-star and small-star rounds; each round is a table in the
    shared folder, nothing but a count and a checksum comes to the driver.
    Every step is a combinable aggregate or an equi-join, so that a hub's edges
    can be split over tasks.  Returns ``node, root`` for all nodes that have an
    edge, root the least node of the component.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = state_of(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        state, before = state_of(now), state
        if state == before:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def sampled(df: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of ``df`` at most, by a hash of the id: the same rows wherever they lie."""
    n = df.count()
    if n <= most:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(span)) < int(most / n * span))


def held_out(id_col: str, folds: int, fold: int):
    """Whether the CRC-32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text) % folds == fold
