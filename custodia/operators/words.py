"""Words of many texts at a time, in tasks: what ``tfidf.tokens`` finds, by arrays instead of a pattern.

Which code points belong to words is asked from Spark's own patterns once, so that both agree on every script."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

WORD_POINTS = r"[\p{L}\p{N}_]+"
LEAST_POINTS = 2  # of a word
_BYTES_PER_STEP = 2 << 20
_SURROGATES = range(0xD800, 0xE000)


@functools.cache
def _asked(_application: str) -> bytes:
    spark = SparkSession.getActiveSession()
    points = [p for p in range(0x110000) if p not in _SURROGATES]
    parts = [("".join(map(chr, points[a : a + 8192])),) for a in range(0, len(points), 8192)]
    found = spark.createDataFrame(parts, "t string").select(F.array_join(F.regexp_extract_all("t", F.lit(WORD_POINTS), F.lit(0)), ""))
    belongs = np.zeros(0x110000, bool)
    for (text,) in found.collect():
        belongs[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = True
    return np.packbits(belongs).tobytes()


class Splitter:
    """Lists of the words of texts in lower case; ``stops`` are left out."""

    def __init__(self, spark: SparkSession, stops=()):
        self.bits, self.stops = _asked(spark.sparkContext.applicationId), sorted(set(stops))
        self._belongs = None

    def __getstate__(self):
        return {**self.__dict__, "_belongs": None}

    def lists(self, batches, column: int):
        """The batches with the column of texts turned into lists."""
        for batch in batches:
            texts = batch.column(column)
            ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + _BYTES_PER_STEP, side="right")))
                part = batch.slice(at, to - at)
                yield part.set_column(column, batch.schema.names[column], self.words(part.column(column)))
                at = to

    def words(self, texts: pa.Array) -> pa.Array:
        if self._belongs is None:
            self._belongs = np.unpackbits(np.frombuffer(self.bits, np.uint8)).astype(bool)
            self._single = bytes(self._belongs[:0x80]) + bytes(0x80)
        pieces = _pieces(texts)
        ends = np.cumsum([len(piece) for piece in pieces], dtype=np.int64)
        data = bytearray().join(pieces)
        raw, inside = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(self._single), bool)
        single = data.isascii()
        if not single:
            _mark_longer(raw, inside, self._belongs)
        # a word ends with its text, whatever the next one starts with
        cut = np.zeros(len(raw) + 1, bool)
        cut[np.r_[0, ends]] = True
        starts = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
        stops = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
        size = points = stops - starts
        if not single:
            before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            points = before[stops] - before[starts]
        short = points < LEAST_POINTS
        for a in range(int(size[short].max(initial=0))):
            inside[starts[short & (size > a)] + a] = False
        starts, size = starts[~short], size[~short]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
        row = np.searchsorted(ends, starts, side="right")
        if self.stops:
            codes = flat.indices.to_numpy()
            stop = pa.compute.is_in(flat.dictionary, value_set=pa.array(self.stops, pa.string()))
            kept = ~stop.to_numpy(zero_copy_only=False)[codes]
            flat = pa.DictionaryArray.from_arrays(pa.array(codes[kept]), flat.dictionary)
            row = row[kept]
        counts = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(np.bincount(row, minlength=len(texts)), out=counts[1:])
        return pa.ListArray.from_arrays(pa.array(counts), flat)


def _pieces(texts) -> list[bytes]:
    """The texts in UTF-8, nulls empty; what is no UTF-8 is replaced, as Spark's patterns read it."""
    pieces = [piece or b"" for piece in texts.cast(pa.binary()).to_pylist()]
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        pieces = [piece.decode("utf-8", "replace").encode() for piece in pieces]
    return pieces


def _mark_longer(raw, inside, belongs):
    """Marks all bytes of the code points of two to four bytes that belong to words."""
    at = np.flatnonzero(raw >= 0xC0)
    lead = raw[at].astype(np.int64)
    more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x3F >> more)
    for i in (1, 2, 3):
        some = more >= i
        point[some] = point[some] << 6 | raw[at[some] + i] & 0x3F
    at, more = at[belongs[point]], more[belongs[point]]
    inside[at] = True
    for i in (1, 2, 3):
        inside[at[more >= i] + i] = True
