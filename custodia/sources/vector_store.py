"""A table of vectors with metadata: load in batches, merge, delete, dimension check.

The store is immutable snapshots: each operation yields the next snapshot, to be written
partitioned by namespace. Loads leave a row per batch next to the vectors, below ``_loads``."""

import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from custodia import constants as C
from custodia.functions.text import vector_key, vector_metadata
from custodia.session import materialize, union

BUCKETS = 64  # of a namespace
LOADS = "_loads"  # folder of a store that readers of the vectors skip
ERROR_CHARS = 500  # of a failed batch's message


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("vector_id", vector_key())


def latest_per_key(df: DataFrame, version="version") -> DataFrame:
    """The newest row per vector_id. Combines before the shuffle: a key with many copies is cheap."""
    others = [c for c in df.columns if c != "vector_id"]
    return df.groupBy("vector_id").agg(F.max_by(F.struct(*others), version).alias("d")).select(
        "vector_id", "d.*"
    )


def upsert(store: DataFrame, changes: DataFrame, version="version") -> DataFrame:
    """The store with the changes merged in by vector_id; the newest change of a key wins."""
    new = latest_per_key(changes, version)
    return union(store.join(new.select("vector_id"), "vector_id", "left_anti"), new)


def write_store(store: DataFrame, path: str, buckets=BUCKETS) -> None:
    """A store that ``merge_into`` can change in place: partitioned by namespace and key bucket."""
    _bucketed(store, buckets).write.mode("errorifexists").partitionBy("namespace", "bucket").parquet(path)


def _bucketed(df, buckets):
    return df.withColumn("bucket", F.pmod(F.xxhash64("vector_id"), F.lit(buckets)).cast("int"))


def merge_into(changes: DataFrame, path: str, version="version", buckets=BUCKETS) -> None:
    """Upsert into a written store: only the partitions that a change falls into are read and rewritten.

    A key that changes its namespace is another key, as the key holds the namespace."""
    spark = changes.sparkSession
    new = materialize(_bucketed(changes, buckets), "changes")
    touched = new.select("namespace", "bucket").distinct()  # at most one row per partition of the store
    store = spark.read.parquet(path).join(F.broadcast(touched), ["namespace", "bucket"], "left_semi")
    merged = materialize(upsert(store, new.select(store.columns), version), "merged")
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("namespace", "bucket").parquet(path)


def delete_ids(store: DataFrame, ids: DataFrame, namespace: str, key="id") -> DataFrame:
    """Without the given document ids of one namespace."""
    gone = ids.select(F.concat_ws("_", F.col(key), F.lit(namespace)).alias("vector_id"))
    return store.join(gone, "vector_id", "left_anti")


def delete_namespace(store: DataFrame, namespace: str) -> DataFrame:
    return store.filter(~F.col("namespace").eqNullSafe(namespace))


def ensure_dimension(df: DataFrame, dim: int, vector="embedding"):
    """(usable rows, quarantined rows): a vector is usable when it is present and ``dim`` long."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    return df.filter(fits), df.filter(~fits)


def embed_batches(documents: DataFrame, embed, dim=None, batch=C.UPSERT_BATCH, position=None,
                  content="content") -> DataFrame:
    """The documents with ``embedding``, and a row with ``load`` for every batch of them.

    ``embed`` maps a pandas Series of at most ``batch`` texts to as many vectors (of length ``dim``). When it
    raises, or returns anything else, the whole batch fails: its documents are left out, its row says why, and
    the load goes on. Batches are runs of documents where they lie; with ``position``, a column of whole numbers
    from 0, they are the documents of the same hundred, wherever those lie (texts are shuffled). The text
    itself is not kept."""
    rows = documents
    if position is not None:
        rows = rows.withColumn("_batch", F.floor(F.col(position) / batch)).repartition("_batch").sortWithinPartitions("_batch", position)
    else:
        rows = rows.withColumn("_batch", F.lit(None).cast("long"))
    kept = [f for f in rows.schema.fields if f.name not in (content, "_batch")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    schema = schema.add("embedding", T.ArrayType(T.FloatType())).add("load", from_arrow_type(_LOAD))
    names = [f.name for f in kept]

    def vectors_of(texts):
        vectors = [[float(x) for x in v] for v in embed(texts)]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
        if wrong := {len(v) for v in vectors if dim is not None and len(v) != dim}:
            raise ValueError(f"vectors of length {min(wrong)}, not {dim}")
        return vectors

    def loaded(parts):
        """One batch: its documents with their vectors, or none, and its row."""
        some = pa.Table.from_batches(parts)
        texts = pd.Series(some[content].to_pylist(), dtype=object)
        began, error, vectors = time.perf_counter(), None, []
        try:
            vectors = vectors_of(texts)
        except Exception as e:  # whatever the model raises concerns this batch alone
            error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        status = {"batch": some["_batch"][0].as_py(), "documents": len(texts), "failed": error is not None,
                  "error": error, "seconds": time.perf_counter() - began}
        done = some.select(names).slice(0, len(vectors))
        n = len(vectors)
        columns = [pa.concat_arrays([*c.chunks, pa.nulls(1, c.type)]) for c in done.columns]
        columns.append(pa.array([*vectors, None], pa.list_(pa.float32())))
        columns.append(pa.array([None] * n + [status], _LOAD))
        return pa.RecordBatch.from_arrays(columns, [*names, "embedding", "load"])

    def run(batches):
        waiting, size, number = [], 0, None
        for block in batches:
            numbers, at = block.column(block.schema.names.index("_batch")).to_pylist(), 0
            for i in range(block.num_rows + 1):
                full = size + i - at == batch and position is None
                if i == block.num_rows or full or (size + i - at and numbers[i] != number):
                    if i > at:
                        waiting.append(block.slice(at, i - at))
                        size, at = size + i - at, i
                    if size and (i < block.num_rows or full):
                        yield loaded(waiting)
                        waiting, size = [], 0
                if i < block.num_rows:
                    number = numbers[i]
        if size:
            yield loaded(waiting)

    return rows.mapInArrow(run, schema)


_LOAD = pa.struct([("batch", pa.int64()), ("documents", pa.int64()), ("failed", pa.bool_()),
                   ("error", pa.string()), ("seconds", pa.float64())])


def load_into(documents: DataFrame, path: str, embed, namespace: str, dim=None, batch=C.UPSERT_BATCH, position=None,
              version=1, load_id="1", buckets=BUCKETS) -> DataFrame:
    """Embed the documents batch by batch and merge them into a written store; returns the rows of the batches.

    ``documents`` have id, title, domain, classification, author, date and content. The model is called once:
    what it returned is written before anything is merged. A load that is repeated under its ``load_id``
    replaces its rows, and its vectors replace themselves."""
    spark = documents.sparkSession
    position_col = [position] if position and position != "id" else []
    asked = documents.select("id", *vector_metadata(), *position_col, "content")
    done = materialize(embed_batches(asked, embed, dim, batch, position).drop(*position_col), "embedded")
    vectors = done.filter(F.col("load").isNull()).drop("load")
    vectors = vectors.withColumns({"namespace": F.lit(namespace), "version": F.lit(version)})
    merge_into(with_key(vectors), path, buckets=buckets)
    loads = done.select("load.*", F.lit(load_id).alias("load_id")).filter(F.col("documents").isNotNull())
    writer = loads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id")
    writer.parquet(f"{path}/{LOADS}")
    return loads_of(spark, path).filter(F.col("load_id") == load_id)


def loads_of(spark, path: str) -> DataFrame:
    """The batches of all loads of a store: load_id, batch, documents, failed, error, seconds."""
    return spark.read.schema("batch long, documents long, failed boolean, error string, seconds double, load_id string").parquet(
        f"{path}/{LOADS}")


def write_snapshot(store: DataFrame, path: str) -> None:
    store.write.mode("errorifexists").partitionBy("namespace").parquet(path)
