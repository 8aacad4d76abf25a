"""SentencePiece encoding and decoding with a table of distinct chunks.

A chunk is a run of white-space markers with the word behind it. Where no piece of the vocabulary
holds a marker after another character, no merge crosses from one chunk to the next, so a text's
ids are its chunks' ids in order. A task keeps a table of the chunks that it has met, has the
library segment each new one once, and fetches the ids of a whole block of texts by position.

The table belongs to the task, not to the corpus: one for all texts would shuffle every
occurrence with its position there and back, several times the input, to save segmenting a chunk
once per task. The table is emptied when it is full, so memory does not grow with the corpus."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm import common

MARK = "▁"
TABLE_CHUNKS = 300_000
TABLE_CHARS = 12_000_000
ENCODE_BYTES = 2 << 20  # of text encoded at once
IDS_AT_ONCE = 250_000
_CHUNK = re.compile(r" *[^ ]+| +\Z")
_PROBE = "Ａ ﬁ  x "  # a full-width letter, a ligature, a double and a trailing space


def load(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its chunks can be segmented alone."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
        raise ValueError("the model rewrites texts: only identity normalisation with a leading marker is supported")
    if model.piece_to_id(MARK) == model.unk_id():
        raise ValueError("the vocabulary has no white-space marker")
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("a piece crosses a white-space marker")
    return model


def chunks(text: str) -> list[str]:
    """The text's chunks without their first marker."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


class ChunkTable(dict):
    """Chunk to number; the ids of all chunks in one array."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        self.new, self.chars = [], 0
        self.ids = np.empty(0, np.int32)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk):
        number = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return number

    def segment(self):
        found = self.model.encode(self.new, num_threads=1) if self.new else []
        mark = [self.model.piece_to_id(MARK)]
        found = [ids if chunk else mark for ids, chunk in zip(found, self.new)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, flat])
        self.new = []

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.reset()
        numbers, ends = [], [0]
        number = self.__getitem__
        for text in texts:
            numbers.extend(map(number, chunks(text)))
            ends.append(len(numbers))
        self.segment()
        numbers = np.array(numbers, np.int64)
        counts = self.counts[numbers]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(before[-1]) + np.repeat(self.starts[numbers] - before[:-1], counts)
        return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(self.ids[at]))


def encode(docs: DataFrame, model_path: str, text_col="text", ids_col="ids", decoded_col=None) -> DataFrame:
    """The rows with the library's ids of their text, without begin or end ids.

    ``decoded_col`` adds what the library decodes from all ids of a row, in the same pass. Null and
    empty texts have no ids. Columns of these names are replaced. The model file must be on every
    executor, as the library itself."""
    new = [ids_col] + ([decoded_col] if decoded_col else [])
    rest = [c for c in docs.columns if c not in new]
    text = common.free_name(docs, "_text")
    # a text that is kept anyway is sent once
    source = text_col if text_col in rest else text
    chosen = docs.select(*rest, *([] if source == text_col else [common.text_of(text_col).alias(text)]))

    def run(batches):
        model = load(model_path)
        table = ChunkTable(model)
        for batch in batches:
            for block in common.blocks(batch, source, ENCODE_BYTES):
                ids = table.encode(common.string_array(block.column(source)).to_pylist())
                columns = [*(block.column(c) for c in rest), ids]
                if decoded_col:
                    columns.append(pa.array(_decode(model, ids), pa.string()))
                yield pa.record_batch(columns, [*rest, *new])

    schema = docs.select(*rest).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return chosen.mapInArrow(run, schema.add(decoded_col, "string") if decoded_col else schema)


def _decode(model, ids: pa.Array) -> list[str]:
    """What the library decodes from each list, a bounded number of ids at a time."""
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(counts, dtype=np.int64) // IDS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
    texts = []
    for start, end in zip(cuts, cuts[1:]):
        lists = [x or [] for x in ids.slice(start, end - start).to_pylist()]
        texts += model.decode(lists, num_threads=1) if lists else []
    return texts


def decode(encoded: DataFrame, model_path: str, ids_col="ids", out_col="decoded", keep_ids=True) -> DataFrame:
    """The rows with the text that the library decodes from their ids; null ids give an empty text."""
    rest = [c for c in encoded.columns if c != out_col and (keep_ids or c != ids_col)]
    chosen = encoded.select(*dict.fromkeys([*rest, ids_col]))

    def run(batches):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            texts = pa.array(_decode(model, batch.column(ids_col)), pa.string())
            yield pa.record_batch([*(batch.column(c) for c in rest), texts], [*rest, out_col])

    return chosen.mapInArrow(run, encoded.select(*rest).schema.add(out_col, "string"))


def id_digest(ids_col="ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(ids_col).cast("array<string>")), 256)
