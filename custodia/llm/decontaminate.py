"""Benchmark decontamination with suffix arrays of the training text.

A test window is ``words`` consecutive words of an item, or the whole of a shorter item. A task
sorts the suffixes of its block of documents and finds every test suffix in them by binary search;
neighbouring hits of one item are then joined to the longest verbatim matches, with their places.

Suffixes that start with words no item has cannot match, so they are left out of the array, as is
whatever follows the first foreign word. The test set goes to the tasks in blocks of bounded bytes,
the documents stay where they are, and nothing is shuffled."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm import common

TEST_BYTES = 8 << 20  # of the test set sent to the tasks at once
SHARD_BYTES = 8 << 20  # of text under one suffix array


class TestSet:
    """The windows of a block of items, over the codes of the words that occur in it."""

    def __init__(self, items, words):
        self.words = words
        texts = pa.array([t for _, t in items], pa.string())
        flat, offsets = common.split_words(texts, common.alnum_table())
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        same = {}  # equal word sequences: one entry, all ids
        for (name, _), start, end in zip(items, offsets, offsets[1:]):
            if end > start:
                ids = same.setdefault(tuple(codes[start:end].tolist()), set())
                if name is not None:
                    ids.add(name)
        self.ids = [sorted(ids) for ids in same.values()]
        places = {}
        for number, sequence in enumerate(same):
            for at in range(max(1, len(sequence) - words + 1)):
                places.setdefault(sequence[at : at + words], []).append((number, at))
        self.lengths = np.array([len(w) for w in places], np.int64)
        self.shortest = int(self.lengths.min()) if places else 0
        low = np.zeros((len(places), words), np.int64)
        for row, window in enumerate(places):
            low[row, : len(window)] = window
        high = low.copy()
        high[np.arange(len(places)), self.lengths - 1] += 1
        self.low, self.high = sort_keys(low), sort_keys(high)
        found = [p for at in places.values() for p in at]
        self.place_starts = np.cumsum([0, *(len(at) for at in places.values())])
        self.place_items = np.array([p[0] for p in found], np.int64)
        self.place_offsets = np.array([p[1] for p in found], np.int64)


def sort_keys(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort like the rows."""
    width = codes.shape[1] * 4
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{width}").reshape(-1)


def _ranges(starts, counts):
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def search(texts: pa.Array, test: TestSet):
    """Word offsets of the texts, and the hits (word position, window) of all test suffixes."""
    flat, offsets = common.split_words(texts, common.alnum_table())
    none = np.empty(0, np.int64)
    if not len(test.lengths) or not len(flat):
        return offsets, none, none
    codes = pc.fill_null(pc.index_in(flat, value_set=test.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
    n = len(codes)
    place = np.arange(n)
    foreign = np.minimum.accumulate(np.where(codes == 0, place, n)[::-1])[::-1]
    run = np.minimum(foreign, np.repeat(offsets[1:], np.diff(offsets))) - place
    starts = np.flatnonzero(run >= test.shortest)
    depth = np.arange(test.words)
    rows = codes[np.minimum(starts[:, None] + depth, n - 1)] * (depth < run[starts, None])
    keys = sort_keys(rows)
    array = np.argsort(keys, kind="stable")
    keys = keys[array]
    first = np.searchsorted(keys, test.low)
    counts = np.searchsorted(keys, test.high) - first
    return offsets, starts[array[_ranges(first, counts)]], np.repeat(np.arange(len(counts)), counts)


def covered(n, places, lengths) -> np.ndarray:
    """Which of ``n`` words lie in a hit."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + lengths, -1)
    return np.cumsum(change)[:n] > 0


def matches(offsets, places, windows, test: TestSet):
    """Longest verbatim matches: (document, item, place in the document, length)."""
    counts = np.diff(test.place_starts)[windows]
    at = _ranges(test.place_starts[windows], counts)
    item, start = test.place_items[at], np.repeat(places, counts)
    diagonal = start - test.place_offsets[at]
    length = np.repeat(test.lengths[windows], counts)
    doc = np.searchsorted(offsets, start, side="right") - 1
    order = np.lexsort((start, diagonal, item, doc))
    doc, item, start, diagonal, length = (x[order] for x in (doc, item, start, diagonal, length))
    if not len(doc):
        return doc, item, start, length
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + 1)])
    head = np.flatnonzero(fresh)
    tail = np.concatenate([head[1:], [len(doc)]]) - 1
    return doc[head], item[head], start[head] - offsets[doc[head]], start[tail] + length[tail] - start[head]


def _test_blocks(benchmark, item_col, text_col, words, limit):
    """The test set in blocks of bounded bytes, one at a time."""
    size = F.octet_length(common.text_of(text_col)) + 16
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-total // limit))
    own = F.pmod(F.xxhash64(text_col), F.lit(parts))
    for part in range(parts):
        rows = benchmark.filter(own == part).select(item_col, common.text_of(text_col)).distinct().collect()
        yield TestSet([tuple(r) for r in rows], words)


def find(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
         item_text_col="text", words=10, test_bytes=TEST_BYTES) -> DataFrame:
    """(id, n_words, spans, matches, items) of every document.

    ``spans`` are the word ranges inside any occurrence of a window, ``matches`` the longest verbatim
    matches (item, start, length; for equal items the first id), ``items`` the ids of all items with an
    occurring window. Items without an id mark words but are not listed. Null texts have no words;
    empty tables and items without words match nothing; repeated rows stay."""
    kind = benchmark.schema[item_col].dataType
    span = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    match = T.ArrayType(T.StructType().add("item", kind).add("start", "integer").add("length", "integer"))
    found = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    found = found.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast(span),
            "matches": F.array().cast(match),
            "items": F.array().cast(T.ArrayType(kind)),
        }
    )
    schema = found.schema
    for test in _test_blocks(benchmark, item_col, item_text_col, words, test_bytes):
        found = found.mapInArrow(_scan(test), schema)
    return found.select(F.col("_id").alias(id_col), "n_words", "spans", "matches", "items")


def _scan(test: TestSet):
    def run(batches):
        for batch in batches:
            for block in common.blocks(batch, "_text", SHARD_BYTES):
                yield _annotate(block, test)

    return run


def _annotate(block, test):
    """Adds what one block of the test set finds to the columns of a block of documents."""
    offsets, places, windows = search(common.string_array(block.column("_text")), test)
    n = len(offsets) - 1
    inside = covered(int(offsets[-1]), places, test.lengths[windows])
    spans, found, items = ([list(x) for x in block.column(c).to_pylist()] for c in ("spans", "matches", "items"))
    for doc in np.flatnonzero([bool(x) for x in spans]):  # from earlier blocks of the test set
        for x in spans[doc]:
            inside[offsets[doc] + x["start"] : offsets[doc] + x["end"]] = True
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans = [[] for _ in range(n)]
    for start, end in zip(starts.tolist(), ends.tolist()):
        while start < end:  # a run may go on in the next document
            doc = int(np.searchsorted(offsets, start, side="right")) - 1
            stop = min(end, int(offsets[doc + 1]))
            spans[doc].append({"start": start - int(offsets[doc]), "end": stop - int(offsets[doc])})
            start = stop
    for doc, item, start, length in zip(*(x.tolist() for x in matches(offsets, places, windows, test))):
        ids = test.ids[item]
        found[doc].append({"item": ids[0] if ids else None, "start": start, "length": length})
        items[doc].extend(ids)
    items = [sorted(set(x)) if x else x for x in items]
    made = {"n_words": np.diff(offsets), "spans": spans, "matches": found, "items": items}
    columns = []
    for field in block.schema:
        values = made.get(field.name)
        columns.append(block.column(field.name) if values is None else pa.array(values, field.type))
    return pa.record_batch(columns, schema=block.schema)


def remove(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text",
           words=10, test_bytes=TEST_BYTES) -> DataFrame:
    """The documents that no window occurs in, all columns kept."""
    kept = docs
    for test in _test_blocks(benchmark, item_col, item_text_col, words, test_bytes):

        def run(batches, test=test):
            for batch in batches:
                for block in common.blocks(batch, text_col, SHARD_BYTES):
                    offsets, places, _ = search(common.string_array(block.column(text_col)), test)
                    hit = np.zeros(block.num_rows, bool)
                    hit[np.searchsorted(offsets, places, side="right") - 1] = True
                    yield block.filter(pa.array(~hit))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
