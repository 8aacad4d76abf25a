"""Document fingerprints: digests of improbable features.

Every window of WIDTH bytes has an entropy. How rare an entropy is among all windows of the corpus
ranks the windows, rarest first; where a window is the first of lowest rank in many of the AREA
neighbourhoods that hold it, it is a feature of its text. A feature sets five bits of a Bloom filter;
a filter takes FEATURES features in the order of the text, then the next one is chained to it.
Fingerprints are compared by the bits that their filters share, beyond what chance would share, over
the most that they could.

The entropies are sliding sums of whole numbers, so equal texts have equal fingerprints anywhere. A
text is handled in segments with enough context on both sides, so its length does not matter. The
corpus statistics are one count per entropy. A neighbour in id order is found by ids alone; then texts
move once, by range of id, and each task meets its neighbours in order."""

import base64
import bisect
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from custodia.llm.common import run_arrow, string_array, text_of
from custodia.session import materialize, union

WIDTH = 32  # bytes of a window
AREA = 32  # windows of a neighbourhood; at most WIDTH, so that none reaches into the next segment
WINS = 8  # neighbourhoods in which a window must come first
FEATURES = 160  # of a full filter
FILTER_BYTES = 256
PROBES = 5
SEGMENT = 1 << 18  # bytes whose windows are handled at once
BLOCK = 4 << 20  # bytes of texts compared at once

_FINE, _SHIFT = 20, 18  # fractional bits of an entropy sum, and those left out when entropies are told apart
_BITS = 8 * FILTER_BYTES


def _entropy_steps():
    """What the n-th equal byte of a window adds to the sum of n log2 n, in whole units."""
    n = np.arange(WIDTH + 1, dtype=float)
    total = np.rint((1 << _FINE) * n * np.log2(np.maximum(n, 1))).astype(np.int32)
    return np.concatenate([[0], np.diff(total)]).astype(np.int32)


_STEPS = _entropy_steps()
_MOST = int(_STEPS.sum())  # of a window of one byte value
LEVELS = (_MOST >> _SHIFT) + 1  # entropies told apart


def entropies(raw: np.ndarray) -> np.ndarray:
    """The entropy of each window of the bytes, as a number below LEVELS; the windows run on to the end."""
    n = len(raw)
    if n < WIDTH:
        return np.zeros(0, np.int32)
    # equal bytes in the window that ends at a byte, and in the one that starts there
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for distance in range(1, WIDTH):
        equal = (raw[distance:] == raw[:-distance]).view(np.uint8)
        back[distance:] += equal
        ahead[:-distance] += equal
    sums = np.empty(n - WIDTH + 1, np.int32)
    sums[0] = np.cumsum(_STEPS)[np.bincount(raw[:WIDTH], minlength=256)].sum()
    np.cumsum(_STEPS.take(back[WIDTH:]) - _STEPS.take(ahead[: n - WIDTH]), out=sums[1:])
    sums[1:] += sums[0]
    return (_MOST - sums) >> _SHIFT


def rank_by_rarity(counts: dict[int, int]) -> np.ndarray:
    """The rank of each entropy, rarest first; of equally rare ones the higher entropy first."""
    seen = np.array([counts.get(e, 0) for e in range(LEVELS)])
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((-np.arange(LEVELS), seen))] = np.arange(LEVELS)
    return rank


class Segments:
    """Pieces of texts, lined up in one byte array; features count from ``keep[0]`` to ``keep[1]`` of each."""

    def __init__(self):
        self.parts, self.keep, self.owner, self.offset, self.size = [], [], [], [], 0

    def add(self, raw: bytes, owner: int, start=0):
        """The windows of ``raw`` from ``start`` on, in segments with their context."""
        windows = len(raw) - WIDTH + 1
        for a in range(start, windows, SEGMENT):
            b = min(a + SEGMENT, windows)
            left, right = max(0, a - AREA + 1), min(len(raw), b + AREA - 1 + WIDTH - 1)
            self.parts.append(raw[left:right])
            self.keep.append((a - left, b - left))
            self.owner.append(owner)
            self.offset.append(left)
            self.size += right - left


def chosen(segments: Segments, rank: np.ndarray):
    """(owner, position, hash) of all features, by segment and position."""
    if not segments.parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(b"".join(segments.parts), np.uint8)
    n = len(raw)
    ends = np.cumsum([len(p) for p in segments.parts])
    starts = np.concatenate([[0], ends[:-1]])
    # rank and place in one number, so that a minimum is the first of lowest rank
    none, bits = np.int32(2**31 - 1), (n - 1).bit_length()
    value = np.full(n - WIDTH + 1 + 2 * (AREA - 1), none)
    body = value[AREA - 1 : AREA - 1 + n - WIDTH + 1]
    body[:] = (rank.astype(np.int32) << bits).take(entropies(raw)) + np.arange(len(body), dtype=np.int32)
    for end in ends[:-1].tolist():  # windows across two segments
        body[max(0, end - WIDTH + 1) : end] = none
    # the least of each neighbourhood, by doubling
    least, span = value, 1
    while span < AREA:
        step = min(span, AREA - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # the neighbourhoods in which a window comes first follow one another
    runs = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    won = least[runs[:-1]]
    at = (won[(np.diff(runs) >= WINS) & (won < none)] & ((1 << bits) - 1)).astype(np.int64)
    segment = np.searchsorted(ends, at, side="right")
    local = at - starts[segment]
    keep = np.array(segments.keep)[segment]
    inside = (local >= keep[:, 0]) & (local < keep[:, 1])
    at, segment, local = at[inside], segment[inside], local[inside]
    hashes = _hash(np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[at])
    return np.array(segments.owner)[segment], local + np.array(segments.offset)[segment], hashes


def _hash(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    x = np.full(len(words), np.uint64(0x243F6A8885A308D3))
    for i in range(words.shape[1]):
        x = (x ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _whole(raw: bytes) -> np.ndarray:
    """A text shorter than a window is one feature, an empty one none."""
    digest = hashlib.blake2b(raw, digest_size=8).digest()
    return np.frombuffer(digest, "<u8")[: 1 if raw else 0].astype(np.uint64)


class Digest:
    """A chain of Bloom filters: a row of bytes and the number of features of each."""

    def __init__(self, hashes: np.ndarray):
        _, first = np.unique(hashes, return_index=True)  # a repeated feature counts once
        hashes = hashes[np.sort(first)]
        self.counts = np.bincount(np.arange(len(hashes)) // FEATURES)
        bits = np.zeros((len(self.counts), _BITS), np.uint8)
        row = np.arange(len(hashes)) // FEATURES
        for i in range(PROBES):
            bits[row, (hashes >> np.uint64(11 * i)).astype(np.int64) % _BITS] = 1
        self.filters = np.packbits(bits, axis=1)
        self.weights = bits.sum(axis=1, dtype=np.int64)

    def __str__(self):
        """The number of features and the bits of each filter."""
        return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts.tolist(), self.filters))


def _best(one: Digest, other: Digest) -> float:
    """The mean over the features of ``one`` of their filter's best overlap with a filter of ``other``."""
    # bits that two filters of so many features share by chance
    empty = 1.0 - 1.0 / _BITS
    p, q = (1.0 - empty ** (PROBES * d.counts) for d in (one, other))
    total = 0.0
    for i, n in enumerate(one.counts.tolist()):
        shared = np.bitwise_count(one.filters[i] & other.filters).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(one.weights[i], other.weights), _BITS * p[i] * q
        share = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), 0.0)
        total += n * min(1.0, max(0.0, float(share.max())))
    return total / int(one.counts.sum())


def likeness(one: Digest, other: Digest) -> float:
    """From 0, as different texts, to 1, as equal ones; two empty texts are alike.

    The digest of fewer features is looked for in the other, with as many both ways."""
    sizes = int(one.counts.sum()), int(other.counts.sum())
    if not min(sizes):
        return float(sizes[0] == sizes[1])
    if sizes[0] == sizes[1]:
        return (_best(one, other) + _best(other, one)) / 2
    return _best(one, other) if sizes[0] < sizes[1] else _best(other, one)


def rarity(docs: DataFrame, text_col="text") -> np.ndarray:
    """The rank of each entropy, from all windows of all texts; one count per entropy leaves Spark."""

    def run(block):
        counts = np.zeros(LEVELS, np.int64)
        for raw in _chunks(string_array(block.column(0)).cast(pa.binary()).to_pylist()):
            ends, total = raw
            seen = entropies(np.frombuffer(total, np.uint8))
            valid = np.ones(len(seen), bool)
            for end in ends:
                valid[max(0, end - WIDTH + 1) : end] = False
            counts += np.bincount(seen[valid], minlength=LEVELS)
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["entropy", "n"])

    rows = docs.select(text_of(text_col).alias("_text"))
    counted = run_arrow(rows, run, "entropy long, n long", "_text").groupBy("entropy").agg(F.sum("n").alias("n"))
    return rank_by_rarity({r["entropy"]: r["n"] for r in counted.collect()})


def _chunks(texts):
    """(ends, bytes) of runs of texts with about SEGMENT bytes; a longer text is cut, with context."""
    parts, ends, size = [], [], 0
    for raw in texts:
        for a in range(0, max(1, len(raw) - WIDTH + 1), SEGMENT):
            part = raw[a : a + SEGMENT + WIDTH - 1]
            parts.append(part)
            size += len(part)
            ends.append(size)
            if size >= SEGMENT:
                yield ends, b"".join(parts)
                parts, ends, size = [], [], 0
    if parts:
        yield ends, b"".join(parts)


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The fingerprints of some texts."""
    return [Digest(h) for h in _features([(t, 0) for t in texts], rank)[0]]


def _features(texts, rank):
    """For (text, start) pairs: the hashes of the features from ``start`` on, and their positions."""
    hashes, places = [[] for _ in texts], [[] for _ in texts]

    def flush(segments):
        owner, place, found = chosen(segments, rank)
        mine = list(dict.fromkeys(segments.owner))
        bounds = np.searchsorted(owner, [*mine, len(texts)]).tolist()  # segments are in the order of their owners
        for i, a, b in zip(mine, bounds, bounds[1:]):
            hashes[i].append(found[a:b])
            places[i].append(place[a:b])

    segments = Segments()
    for i, (raw, start) in enumerate(texts):
        if len(raw) < WIDTH:
            hashes[i].append(_whole(raw))
            places[i].append(np.zeros(len(hashes[i][0]), np.int64))
            continue
        segments.add(raw, i, start)
        if segments.size >= SEGMENT:
            flush(segments)
            segments = Segments()
    flush(segments)
    return [_one(h, np.uint64) for h in hashes], [_one(p, np.int64) for p in places]


def _one(parts, kind):
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, kind)])


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, fingerprint) of every row; a null text is empty, an empty one has the empty fingerprint."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(block):
        texts = string_array(block.column("_text")).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays(
            [block.column("_id"), pa.array([str(d) for d in digests(texts, rank)], pa.string())], ["_id", "fingerprint"])

    kind = rows.schema["_id"].dataType.simpleString()
    return run_arrow(rows, run, f"_id {kind}, fingerprint string", "_text").withColumnRenamed("_id", id_col)


# --- neighbours ----------------------------------------------------------------------------------


def _keys(docs, id_col, text_col):
    """Rows with their key: the id, nulls first, then a hash of the text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.select(F.col("_id").isNotNull().alias("_named"), "_id", F.xxhash64("_text").alias("_hash"), "_text")


_KEY = ["_named", "_id", "_hash"]


def _plain(key):
    """A key as a tuple that sorts as Spark sorts it."""
    named, name, h = key
    return (named, (name.encode() if isinstance(name, str) else name) if named else 0, h)


def _cells(keyed, parts):
    """Sorted keys at which the cells of the table start, and how many cells each of them fills.

    Spark orders the ids into ranges; each range is a cell, but a key that alone fills several gets as
    many, and the next key starts another cell."""
    ids = materialize(keyed.select(*_KEY), "keys")
    ordered = ids.repartitionByRange(parts, *_KEY).sortWithinPartitions(*_KEY)
    types = ids.schema

    typical = max(1, ids.count() // parts)

    def heads(batches):
        """(key, rows) of the first key, of those that fill a cell, and of those behind such a one."""
        found, names = [], types.names

        def runs():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        starts = True
        for key, rows in itertools.groupby(runs()):
            n = sum(1 for _ in rows)
            if starts or n >= typical:
                found.append((*key, n))
            starts = n >= typical
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(t.dataType)) for c, t in zip(zip(*found), fields)],
                                             [*names, "n"])

    fields = [*types.fields, T.StructField("n", T.LongType())]
    found = ordered.mapInArrow(heads, T.StructType(fields)).collect()
    cells = {_plain(key): max(1, n // typical) for *key, n in found}
    keys = sorted(cells)
    return keys, [cells[k] for k in keys]


def _placed(keyed, keys, sizes):
    """Rows in their cells, and in each cell once more the row that follows its last one."""
    first = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    number = {k: i for i, k in enumerate(keys)}

    def plain(*columns):
        return [_plain(k) for k in zip(*(c.to_pylist() for c in columns))]

    @F.arrow_udf("int")
    def own_cell(named: pa.Array, name: pa.Array, h: pa.Array, row: pa.Array) -> pa.Array:
        at = [bisect.bisect_right(keys, k) - 1 for k in plain(named, name, h)]
        return pa.array([first[i] + r % sizes[i] for i, r in zip(at, row.to_pylist())], pa.int32())

    @F.arrow_udf("array<int>")
    def cells_before(named: pa.Array, name: pa.Array, h: pa.Array) -> pa.Array:
        """The cells before the one that starts with this key, if one does; before the first lie the last."""
        at = [number.get(k) for k in plain(named, name, h)]
        cells = [[] if i is None else range(first[i - 1] if i else first[-1] - sizes[-1], first[i] if i else first[-1]) for i in at]
        return pa.array([list(c) for c in cells], pa.list_(pa.int32()))

    rows = keyed.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_cell", own_cell(*_KEY, "_row")).withColumn("_after", F.lit(False)).drop("_row")
    heads = keyed.filter(F.col("_hash").isin([k[-1] for k in keys])).groupBy(*_KEY).agg(F.min("_text").alias("_text"))
    heads = heads.withColumn("_cell", F.explode(cells_before(*_KEY))).withColumn("_after", F.lit(True))
    both = union(rows, heads)
    return both.repartitionById(first[-1], F.col("_cell")).sortWithinPartitions("_cell", "_after", *_KEY)


def _runs(batches):
    """(cell, is the next cell's, key, text, times) of rows in order, equal keys as one."""
    last = None
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)) for c in ("_cell", "_after", *_KEY)]
        texts = string_array(batch.column(names.index("_text"))).cast(pa.binary())
        for i, (cell, after, *key) in enumerate(zip(*(c.to_pylist() for c in columns))):
            if last and [cell, after, key] == last[:3]:
                last[-1] += 1
                continue
            if last:
                yield last
            last = [cell, after, key, texts[i].as_py(), 1]
    if last:
        yield last


def _edited(text: bytes, following: bytes):
    """The text's length, its kept bytes, and the edited text."""
    chars = text.decode()
    n = len(chars) // 4
    kept = chars[: len(chars) - n].encode()
    return len(chars), len(kept), kept + following.decode()[:n].encode()


def _compared(pairs, rank):
    """A row of figures for each (text, next text); the next one is mostly the text of the next pair."""
    pairs = list(pairs)
    texts = [t for t, _ in pairs]
    own, places = _features([(t, 0) for t in texts], rank)
    edits = [_edited(*p) for p in pairs]
    # behind what the edit can have changed, the features are the text's own
    since = [max(0, cut - (WIDTH - 1) - (AREA - 1)) for _, cut, _ in edits]
    tails, _ = _features([(e, s) for (*_, e), s in zip(edits, since)], rank)
    digest = [Digest(h) for h in own]
    strangers = [i for i, (_, following) in enumerate(pairs) if i + 1 == len(pairs) or texts[i + 1] is not following]
    found = dict(zip(strangers, digests([pairs[i][1] for i in strangers], rank)))
    for i, (n, _, edited) in enumerate(edits):
        if len(edited) < WIDTH:
            changed = Digest(tails[i])
        else:
            changed = Digest(np.concatenate([own[i][: np.searchsorted(places[i], since[i])], tails[i]]))
        following = found[i] if i in found else digest[i + 1]
        yield (n, hashlib.sha256(edited).hexdigest(), str(digest[i]), str(changed),
               likeness(digest[i], changed), likeness(digest[i], following))


def compare_edited(docs: DataFrame, id_col="doc_id", text_col="text", rank=None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter replaced by the start of the next document's text, in order of
    id, after the last the first; nulls come first, and different texts of one id follow each other by
    their hash. Rows that repeat an id and its text are one document, listed as often. A null text is
    empty; an only document is its own next. An empty table gives no rows."""
    rank = rarity(docs, text_col) if rank is None else rank
    keyed = _keys(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, sizes = _cells(keyed, parts)
    kind = keyed.schema["_id"].dataType.simpleString()
    schema = (f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    if not keys:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    id_type = to_arrow_type(keyed.schema["_id"].dataType)

    def run(batches):
        def block(waiting):
            figures = list(_compared([(t, following) for _, t, _, following in waiting], rank))
            times = np.array([n for _, _, n, _ in waiting])
            at = pa.array(np.repeat(np.arange(len(waiting)), times))
            columns = [pa.array([name for name, *_ in waiting], id_type), *map(pa.array, zip(*figures))]
            return pa.RecordBatch.from_arrays([c.take(at) for c in columns], schema_names)

        waiting, size, last = [], 0, None
        for cell, after, key, text, times in _runs(batches):
            if last and last[0] == cell:
                waiting.append((last[1], last[2], last[3], text))
                size += len(last[2])
            last = (cell, key[1], text, times) if not after else None
            if size >= BLOCK:
                yield block(waiting)
                waiting, size = [], 0
        if waiting:
            yield block(waiting)

    schema_names = [c.split()[0] for c in schema.split(", ")]
    found = _placed(keyed, keys, sizes).mapInArrow(run, schema)
    return found.withColumnRenamed("_id", id_col)
