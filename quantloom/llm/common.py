"""What the text operators share: tables, shared-folder checkpoints, bounded samples, Arrow maps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one step of a Python loop takes from an Arrow batch; bounds what long texts cost.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder that spark.checkpoint.dir names.

    A folder of our own is used only where that setting is absent in a local run, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; an error names the missing setting on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def crc_bucket(column: str, n: int):
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n))


def doc_key(column: str = "doc_id"):
    """An id as text, whatever its type; a null id is told apart from all texts."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def held_out_second(scored: DataFrame, held, added: int = 2) -> DataFrame:
    """Put held_out before the last ``added`` columns; it replaces an input column of that name."""
    names = [c for c in scored.columns if c.lower() != "held_out"]
    columns = [F.col(f"`{c}`") for c in names]
    return scored.select(*columns[:-added], held.alias("held_out"), *columns[-added:])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns (whatever their case) that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_bytes(
    df: DataFrame,
    fields: list[T.StructField],
    rows: Callable[[], Callable[[list[bytes | None]], list[list]]],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from the UTF-8 bytes of each text.

    ``rows()`` is called once per partition and returns a function from a list of texts to one list
    of values for each of ``fields``. ``keep`` names the input columns of the result (all by
    default); those named like a new field are dropped.
    """
    names = [f.name for f in fields]
    kept = without(df.select([F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]), names)
    out = T.StructType([*kept.schema.fields, *fields])
    carried = kept.columns
    # names of our own, so that none can clash
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").cast("binary").alias("bytes"))
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = step(part.column(len(carried)).to_pylist())
                columns = [part.column(i) for i in range(len(carried))]
                columns += [pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *names])

    return given.mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, keep) -> DataFrame:
    """Texts of at most ``per_class`` labelled documents per class, chosen by a hash of doc_id.

    Only ids are ranked; the texts come from one join against that bounded list of ids. Of the texts of
    one doc_id, the least counts, so that repeated ids don't widen the sample.
    """
    ids = labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).alias("y")
    )
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
