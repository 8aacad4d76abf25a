"""Helpers shared by the operators: tables, word tables of Arrow batches, small numpy tools."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20  # text handled at once inside a task
SPACE = "\\x20\\x09-\\x0D"
_WHITE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_WHITE_LOWER = bytes(b + 32 if 65 <= b <= 90 else _WHITE[b] for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def white_table(lower=False) -> bytes:
    """Byte map for words parted by ASCII white space, A-Z lower-cased on demand."""
    return _WHITE_LOWER if lower else _WHITE


def alnum_table() -> bytes:
    """Byte map for lower-cased words of ASCII letters, digits and all other code points."""
    word = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in word else 32 for b in range(256))


def string_array(column) -> pa.Array:
    """An Arrow text column as one string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def blocks(batch: pa.RecordBatch, column: str, size=BLOCK_BYTES):
    """Slices of a batch with about ``size`` bytes of text each, at least a row."""
    if not batch.num_rows:
        return
    lengths = pc.binary_length(string_array(batch.column(column))).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def split_words(texts: pa.Array, byte_map: bytes):
    """All words of the texts in one array, and the offsets of each text's words in it.

    The byte map turns what parts words into a space; it must keep bytes above 127."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]].tobytes()
    mapped = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data.translate(byte_map))
    )
    lists = pc.ascii_split_whitespace(mapped)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return flat.filter(pa.array(full)), before[ends]


def shingles(words: pa.Array, offsets: np.ndarray, k: int):
    """Each text's runs of ``k`` words joined by spaces (all words if fewer), and their offsets."""
    encoded = words.cast(pa.binary())
    text = b" ".join(encoded.to_pylist())
    lengths = pc.binary_length(encoded).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.diff(offsets)
    made = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], made)
    last = first + np.repeat(np.minimum(counts, k), made) - 1
    pieces = [text[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return pieces, at


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of ``n`` indexes by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column="text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def run_arrow(df: DataFrame, function, schema, column="text"):
    """Apply ``function`` to blocks of bounded text bytes inside tasks."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, column):
                yield function(block)

    return df.mapInArrow(run, schema)
