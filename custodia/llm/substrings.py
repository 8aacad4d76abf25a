"""Removal of repeated passages with fixed-block anchors.

A window is ``words`` consecutive words; it is repeated if the same words start in a document with a
smaller id. Blocks of b = (words + 1) / 2 words at every b-th position of every document are the
index: any window covers one of them whole. Two rounds find the repeats:

1. Anchors. Every rolling window of b words probes the index. A probe is a hit if its words are an
   indexed block and occur in two documents or more. Only short hashes travel, once per chunk of
   documents, sorted and delta-packed; a few bits per probe come back.
2. Extension. Around the hits, a window all of whose b-word parts occur in several documents may be
   an exact repeat: its 64-bit hash travels with the smallest id that has it in the chunk, and the
   smallest id of all comes back. The windows confirmed in this way join to the maximal repeats.

Short hashes that collide only cost a wasted second round. However many documents share a passage,
a chunk sends it once; no pair of documents is ever formed. Documents are packed into compressed
chunks of bounded size once, and it is these that meet the answers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm import common
from custodia.session import materialize

CHUNK_BYTES = 8 << 20  # of text in a chunk
BUCKET_BYTES = 16 << 20  # of text whose hashes meet in a task
LEAST_BUCKETS = 16
_PROBE_BITS = 46  # of a block's hash; two flags follow
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, of the golden ratio and a prime
_MANY, _INDEXED = 2, 1
_LAST = np.iinfo(np.int64).max  # stands for a missing id


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_any(values: np.ndarray) -> bytes:
    """64-bit numbers in any order."""
    return zstandard.ZstdCompressor(1).compress(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_any(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _rolling(hashes: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes."""
    n = max(0, len(hashes) - k + 1)
    total, factor = np.zeros(n, np.uint64), np.uint64(multiplier)
    for i in range(k):
        total = total * factor + hashes[i : i + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)  # spreads the low bits to the high ones
    return total ^ (total >> np.uint64(32))


class Chunk:
    """The words of a chunk of documents and their hashes."""

    def __init__(self, data: bytes, words: int):
        table = pa.ipc.open_stream(data).read_all()
        self.rows = table
        self.ids = pc.fill_null(table.column("_id"), _LAST).to_numpy()
        self.flat, self.offsets = common.split_words(common.string_array(table.column("_text")), common.white_table())
        coded = self.flat.dictionary_encode()
        known = np.fromiter(
            map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary)
        )
        self.hashes = known[coded.indices.to_numpy(zero_copy_only=False)]
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        self.block = (words + 1) // 2
        self.words = words

    def starts(self, k):
        """Where ``k`` words of one document start."""
        n = max(0, len(self.hashes) - k + 1)
        return np.flatnonzero(self.owner[:n] == self.owner[k - 1 : k - 1 + n])

    def probes(self):
        """Starts and short hashes of all rolling blocks."""
        at = self.starts(self.block)
        return at, _rolling(self.hashes, self.block, _MULTIPLIERS[0])[at] >> np.uint64(64 - _PROBE_BITS)

    def windows(self):
        at = self.starts(self.words)
        return at, _rolling(self.hashes, self.words, _MULTIPLIERS[1])[at]


def _groups(values):
    """Starts of the runs of equal sorted values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _bucket_cuts(values, bits, buckets):
    """Non-empty buckets of sorted hashes of ``bits`` bits, with their range."""
    edges = [-(-(i << bits) // buckets) for i in range(1, buckets)]
    cuts = np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]])
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        yield bucket, int(cuts[bucket]), int(cuts[bucket + 1])


def _distinct_probes(chunk):
    """The chunk's distinct short hashes with their flags in the two lowest bits."""
    at, short = chunk.probes()
    order = np.argsort(short)
    short, at = short[order], at[order]
    first = _groups(short)
    if not len(first):
        return short
    doc = chunk.ids[chunk.owner[at]]
    many = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
    indexed = np.maximum.reduceat(((at - chunk.offsets[chunk.owner[at]]) % chunk.block == 0).astype(np.uint64), first)
    return short[first] << np.uint64(2) | many.astype(np.uint64) * np.uint64(_MANY) | indexed


def _pack_chunks(batches):
    """Rows of (chunk, data): documents in compressed Arrow streams."""
    part, number = TaskContext.get().partitionId(), 0
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for block in common.blocks(batch, "_text", CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=options) as writer:
                writer.write_batch(block)
            yield pa.record_batch(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["chunk", "data"],
            )
            number += 1


_SENT = "bucket int, chunk long, data binary"
_IDS_SENT = f"{_SENT}, ids binary"


def _table(columns, schema_names):
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "ids": pa.binary()}
    return pa.table([pa.array([r[i] for r in columns], kinds[n]) for i, n in enumerate(schema_names)], schema_names)


def _send_probes(words, buckets):
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist()):
                values = _distinct_probes(Chunk(data, words))
                sent = [
                    (bucket, name, _pack(values[a:b])) for bucket, a, b in _bucket_cuts(values, _PROBE_BITS + 2, buckets)
                ]
                yield from _table(sent, ["bucket", "chunk", "data"]).to_batches()

    return run


def _answer_probes(group: pa.Table) -> pa.Table:
    """For each hash a chunk has sent: occurs in several documents, and is an indexed block."""
    sent = [_unpack(d) for d in group.column("data").to_pylist()]
    values = np.concatenate(sent)
    order = np.argsort(values)
    hashes = values[order] >> np.uint64(2)
    first = _groups(hashes)
    count = np.diff(np.append(first, len(hashes)))
    flags = values[order] & np.uint64(3)
    many = (count > 1) | (np.maximum.reduceat(flags & np.uint64(_MANY), first) > 0)
    indexed = np.maximum.reduceat(flags & np.uint64(_INDEXED), first) > 0
    answer = np.empty((2, len(values)), bool)
    answer[:, order] = np.repeat([many, many & indexed], count, axis=1)
    ends = np.cumsum([len(s) for s in sent])
    packed = [np.packbits(answer[:, e - len(s) : e], axis=1).tobytes() for s, e in zip(sent, ends)]
    rows = zip(group.column("bucket").to_pylist(), group.column("chunk").to_pylist(), packed)
    return _table(list(rows), ["bucket", "chunk", "data"])


def _candidates(chunk, answers, buckets):
    """Starts and hashes of the windows around hits."""
    values = _distinct_probes(chunk)
    flags = np.zeros((2, len(values)), bool)
    for bucket, a, b in _bucket_cuts(values, _PROBE_BITS + 2, buckets):
        rows = np.frombuffer(answers[bucket], np.uint8).reshape(2, -1)
        flags[:, a:b] = np.unpackbits(rows, axis=1, count=b - a)
    probe_at, short = chunk.probes()
    place = np.searchsorted(values >> np.uint64(2), short)
    found = np.zeros((2, len(chunk.hashes) + 1), np.int32)
    found[:, probe_at] = flags[:, place]
    total = np.concatenate([np.zeros((2, 1), np.int32), np.cumsum(found, axis=1, dtype=np.int32)], axis=1)
    at, hashes = chunk.windows()
    parts = chunk.words - chunk.block + 1
    inside = total[:, at + parts] - total[:, at]
    keep = (inside[0] == parts) & (inside[1] > 0)
    return at[keep], hashes[keep]


def _send_windows(words, buckets):
    def run(key, chunks: pa.Table, answered: pa.Table) -> pa.Table:
        sent = []
        answers = dict(zip(answered.column("bucket").to_pylist(), answered.column("data").to_pylist()))
        for data in chunks.column("data").to_pylist():
            chunk = Chunk(data, words)
            at, hashes = _candidates(chunk, answers, buckets)
            order = np.argsort(hashes)
            hashes, docs = hashes[order], chunk.ids[chunk.owner[at[order]]]
            first = _groups(hashes)
            if len(first):
                least, most = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
                hashes = hashes[first]
                for bucket, a, b in _bucket_cuts(hashes, 64, buckets):
                    ids = _pack_any(np.concatenate([least[a:b], most[a:b] - least[a:b]]))
                    sent.append((bucket, key[0].as_py(), _pack(hashes[a:b]), ids))
        return _table(sent, ["bucket", "chunk", "data", "ids"])

    return run


def _answer_windows(group: pa.Table) -> pa.Table:
    """For each chunk: the windows that some of its documents share with a smaller id, and that id."""
    sent = [_unpack(d) for d in group.column("data").to_pylist()]
    own = [_unpack_any(d).reshape(2, -1) for d in group.column("ids").to_pylist()]
    hashes, least = np.concatenate(sent), np.concatenate([x[0] for x in own])
    order = np.argsort(hashes)
    first = _groups(hashes[order])
    smallest = np.empty(len(hashes), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(hashes))))
    rows, start = [], 0
    for bucket, name, values, ids in zip(
        group.column("bucket").to_pylist(), group.column("chunk").to_pylist(), sent, own
    ):
        best = smallest[start : start + len(values)]
        start += len(values)
        loses = best < ids[0] + ids[1]
        if loses.any():
            rows.append((bucket, name, _pack(values[loses]), _pack_any(best[loses])))
    return _table(rows, ["bucket", "chunk", "data", "ids"])


def _cut(words):
    def run(chunks: pa.Table, answered: pa.Table) -> pa.Table:
        made = []
        hashes = [_unpack(d) for d in answered.column("data").to_pylist()]
        ids = [_unpack_any(d) for d in answered.column("ids").to_pylist()]
        hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        order = np.argsort(hashes)
        hashes, ids = hashes[order], ids[order]
        for data in chunks.column("data").to_pylist():
            chunk = Chunk(data, words)
            gone = np.zeros(len(chunk.hashes) + 1, np.int32)
            at, own = chunk.windows()
            if len(hashes) and len(at):
                place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                repeated = at[(hashes[place] == own) & (ids[place] < chunk.ids[chunk.owner[at]])]
                np.add.at(gone, repeated, 1)
                np.add.at(gone, repeated + words, -1)
            keep = np.cumsum(gone)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(keep)])
            left = before[chunk.offsets]
            kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), chunk.flat.filter(pa.array(keep)))
            n = np.diff(chunk.offsets)
            made.append(
                pa.table(
                    {
                        "_id": chunk.rows.column("_id"),
                        "n_words": pa.array(n, pa.int64()),
                        "n_removed": pa.array(n - np.diff(left), pa.int64()),
                        "text": pc.binary_join(kept, " "),
                    }
                )
            )
        return pa.concat_tables(made)

    return run


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", words=13) -> DataFrame:
    """(id, n_words, n_removed, text): every row's words that no repeated window covers, by one space.

    Ids are whole numbers. A row without an id counts as the last of all; rows that share an id do
    not remove each other's words. Null and empty texts have no words; texts of fewer than ``words``
    words are kept whole."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.text_of(text_col).alias("_text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    chunks = materialize(rows.mapInArrow(_pack_chunks, "chunk long, data binary"), "chunks")
    probes = chunks.mapInArrow(_send_probes(words, buckets), _SENT)
    hits = probes.groupBy("bucket").applyInArrow(_answer_probes, _SENT)
    packed = chunks.groupBy("chunk")
    windows = packed.cogroup(hits.groupBy("chunk")).applyInArrow(_send_windows(words, buckets), _IDS_SENT)
    repeats = windows.groupBy("bucket").applyInArrow(_answer_windows, _IDS_SENT)
    kept = packed.cogroup(repeats.groupBy("chunk")).applyInArrow(
        _cut(words), "_id long, n_words long, n_removed long, text string"
    )
    kind = docs.schema[id_col].dataType
    return kept.select(F.col("_id").cast(kind).alias(id_col), "n_words", "n_removed", "text")
