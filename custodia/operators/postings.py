"""Inverted index over weighted terms, and exact top-k search that prunes by score bounds.

The corpus lies in segments of some thousand documents, a row each. A segment holds the postings of
every term it has, with the term's greatest weight there; its terms are dealt to BLOCKS columns, so
that a search reads the columns of its own terms only.

A search knows a floor for every query before it starts: a term's k-th greatest weight in the corpus,
times its weight in the query, is reached by k documents, and so is what a few segments, searched first, hold
for it. In a segment, the terms' greatest weights
bound what a document can score. Queries that stay below their floor leave the segment untouched. In
the others, the terms that together stay below the floor open no candidates: they are looked up only
for documents that the other terms have brought in. The floors rise with what a task has found.

Where many queries meet a segment, their scores are first bounded from above in bytes, for all its
documents at a time: a term's weights, times the query's weight rounded up to a step, are a row of bytes
that queries share, and a query's bounds are the sum of its rows. Only documents whose bound reaches the
floor are scored. The rows are cut into tiles of some hundred documents, one met after the other, so that those of
a tile stay near the processor while all queries add them up, and the floors rise with what a round of tiles has
found. A segment's documents lie by their heaviest terms, so that the greatest bytes of a tile rule out many queries."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.operators.topk import SCORE_DIGITS, Best, arrow_ids, id_type, plain_ids
from custodia.session import materialize, union

SEGMENT_DOCS = 8192
SEGMENT_POSTINGS = 4_000_000
BLOCKS = 16
FLOOR_SEGMENTS, FLOOR_SHARE = 8, 16  # searched first: at most so many, and one of so many
WAVES = 2  # of tasks that a block of queries goes to: each hands on k rows per query at most
CHAMPIONS = 100  # greatest weights of a term that floors can be taken from
SLACK = 1e-7  # bounds are compared with: more than scores are rounded by
QUERY_BYTES = 64 << 20  # of a block of queries, with what a task keeps for them
_ENTRY_BYTES, _KEPT_BYTES = 12, 24
STEP = 1.2  # from one step of query weights to the next
FEW_QUERIES = 32  # of a segment: they are searched by postings
MOST_TERMS = 100  # of a query whose bounds are summed in bytes
ROW_BYTES = 64 << 20  # of the rows of bytes, and of the weights beside them
TILE = 512  # documents of a tile
ROUND_DOCS = 2048  # after as many documents floors rise
GROUP_QUERIES = 256  # whose rows of a tile are added up at a time
PAIRS = 500_000  # of a term and a document, scored at a time

_BLOCK_TYPE = "struct<terms:binary,most:binary,ends:binary,docs:binary,weights:binary>"
_BLOCK_ARROW = pa.struct([(f, pa.binary()) for f in ("terms", "most", "ends", "docs", "weights")])


def _entries(column):
    """Row lengths, term ids and weights of an Arrow list<struct<i,w>> column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = array.flatten()
    return lengths, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _segment(lengths, terms, weights):
    """The blocks of one segment: for each, its terms, their greatest weights, and their postings in order."""
    docs = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
    order = np.argsort(terms, kind="stable")
    terms, docs, weights = terms[order], docs[order], weights[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    ends, found = np.r_[starts[1:], len(terms)].astype(np.int32)[: len(starts)], terms[starts]
    most = np.maximum.reduceat(weights, starts) if len(starts) else np.zeros(0)
    blocks = []
    for block in range(BLOCKS):
        mine = np.flatnonzero(found % BLOCKS == block)
        if not len(mine):
            blocks.append(None)
            continue
        spans = [slice(starts[i], ends[i]) for i in mine]
        blocks.append({
            "terms": found[mine].astype(np.int32).tobytes(), "most": most[mine].tobytes(),
            "ends": np.cumsum(ends[mine] - starts[mine]).astype(np.int32).tobytes(),
            "docs": np.concatenate([docs[s] for s in spans]).tobytes(),
            "weights": np.concatenate([weights[s] for s in spans]).tobytes(),
        })
    return blocks


def _by_heaviest(lengths, terms, weights):
    """An order of sparse vectors that puts those of the same heaviest term side by side, and among them of the same second one."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((-weights, row))
    starts, sorted_terms = np.cumsum(lengths) - lengths, np.append(terms[order], -1)
    first, second = (np.where(lengths > n, sorted_terms[np.minimum(starts + n, len(terms))], -1) for n in (0, 1))
    return np.lexsort((second, first))


def build(vectors: DataFrame, key="id", vector="vec") -> DataFrame:
    """(ids, b0, b1, ...): the segments of a table of sparse vectors, array<struct<i,w>> with w > 0."""
    kind = id_type(vectors, key)
    rows = vectors.select(F.col(key).cast(kind).alias("id"), F.col(vector).alias("vec"))
    names = [f"b{i}" for i in range(BLOCKS)]

    def made(waiting):
        ids = pa.concat_arrays([w[0] for w in waiting])
        lengths, terms, weights = (np.concatenate([w[i] for w in waiting]) for i in (1, 2, 3))
        order = _by_heaviest(lengths, terms, weights)
        ids, ends, new = ids.take(pa.array(order)), np.cumsum(lengths), lengths[order]
        at = np.arange(int(new.sum())) + np.repeat((ends - lengths)[order] - np.cumsum(new) + new, new)
        blocks = _segment(new, terms[at], weights[at])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([b], _BLOCK_ARROW) for b in blocks)], ["ids", *names])

    def run(batches):
        waiting, documents, size = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SEGMENT_DOCS - documents)
                lengths, terms, weights = _entries(part.column(1))
                fits = int(np.searchsorted(np.cumsum(lengths), SEGMENT_POSTINGS - size, side="right"))
                take = min(part.num_rows, max(fits, 0 if documents else 1))
                n = int(lengths[:take].sum())
                if take:
                    ids = part.column(0).slice(0, take)
                    waiting.append((ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, lengths[:take], terms[:n], weights[:n]))
                at, documents, size = at + take, documents + take, size + n
                if documents >= SEGMENT_DOCS or take < part.num_rows:
                    yield made(waiting)
                    waiting, documents, size = [], 0, 0
        if waiting:
            yield made(waiting)

    schema = f"ids array<{kind}>, " + ", ".join(f"{name} {_BLOCK_TYPE}" for name in names)
    return rows.mapInArrow(run, schema)


def champions(segments: DataFrame) -> dict[int, list[float]]:
    """Each term's CHAMPIONS greatest weights, greatest first.

    Tasks keep a term's greatest; these are cut twice, so that no group grows with the corpus' tasks."""
    names = [f"b{i}" for i in range(BLOCKS)]

    def run(batches):
        best = {}
        for batch in batches:
            for column in batch.columns:
                for block in _read(column):
                    for term, (_, weights) in block.items():
                        top = np.concatenate([best.get(term, np.zeros(0)), weights])
                        best[term] = -np.sort(-top)[:CHAMPIONS]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array([b.tolist() for b in best.values()], pa.list_(pa.float64()))],
                ["term", "weights"])

    found = segments.select(*names).mapInArrow(run, "term int, weights array<double>")
    found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(256)))
    for keys in (["term", "_part"], ["term"]):
        found = found.groupBy(*keys).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("weights")), asc=False), 1, CHAMPIONS).alias("weights"))
    return {r["term"]: r["weights"] for r in found.collect()}


def _read(column):
    """Per row of an Arrow column of blocks: term -> (documents, weights)."""
    for block in column.to_pylist():
        if block is None:
            yield {}
            continue
        terms, ends = np.frombuffer(block["terms"], np.int32), np.frombuffer(block["ends"], np.int32)
        docs, weights = np.frombuffer(block["docs"], np.uint16).astype(np.intp), np.frombuffer(block["weights"])
        yield {t: (docs[a:b], weights[a:b]) for t, a, b in zip(terms.tolist(), [0, *ends[:-1].tolist()], ends.tolist())}


def _bounds(column):
    """Per row of an Arrow column of blocks: its terms and their greatest weights."""
    for block in column.to_pylist():
        if block is not None:
            yield np.frombuffer(block["terms"], np.int32), np.frombuffer(block["most"])
        else:
            yield np.zeros(0, np.int32), np.zeros(0)


@dataclass
class Queries:
    """A block of queries: entries (query number, term, weight) in the order of the queries."""

    ids: np.ndarray
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, ids, vectors, tops, k, known=None):
        lengths, term, weight = _entries(vectors)
        row = np.repeat(np.arange(len(ids)), lengths)
        keep = weight > 0
        row, term, weight = row[keep], term[keep], weight[keep]
        # what k documents reach by one term alone
        reached = np.array([tops[t][k - 1] if len(tops.get(t, ())) >= k else -np.inf for t in term.tolist()])
        floor = np.full(len(ids), -np.inf) if known is None else known.copy()
        np.maximum.at(floor, row, reached * weight)
        return cls(ids, row, term, weight, floor)


class Searched:
    """What a search has touched: postings read, documents looked up in postings, and documents scored of those bounded."""

    def __init__(self):
        self.postings = self.lookups = self.skipped = self.bounded = self.scored = 0


def search_segment(queries: Queries, floor, k: int, postings: dict, bounds: np.ndarray, names: np.ndarray, searched: Searched,
                   only=None):
    """Arrays (query, document, score) of each query's k best documents of a segment, those below its floor left
    out; ``floor`` rises with them.

    ``postings`` has term -> (documents, weights), ``bounds`` the greatest weight of every term, ``names`` the
    ids of the documents; ``only`` marks the queries to search, else all."""
    impact = queries.weight * bounds[queries.term]
    reach = np.bincount(queries.row, impact, minlength=len(floor))
    alive = (reach > 0) & (reach >= floor - SLACK)
    searched.skipped += int(len(floor) - alive.sum())
    if only is not None:
        alive &= only
    # the entries of each query that have postings, least impact first
    at = np.flatnonzero(alive[queries.row] & (impact > 0))
    at = at[np.lexsort((impact[at], queries.row[at]))]
    row, term, weight, impact = queries.row[at], queries.term[at].tolist(), queries.weight[at].tolist(), impact[at]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    ends = np.r_[starts[1:], len(row)][: len(starts)].tolist()
    scores = np.zeros(len(names))
    found = []
    for q, a, b in zip(row[starts].tolist(), starts.tolist(), ends):
        least, total = floor[q] - SLACK, np.cumsum(impact[a:b])
        # terms that together stay below the floor open no candidates
        opens = a + int(np.searchsorted(total, least))
        left = float(total[opens - a - 1]) if opens > a else 0.0
        scores.fill(0.0)
        for i in range(opens, b):
            docs, weights = postings[term[i]]
            scores[docs] += weight[i] * weights
            searched.postings += len(docs)
        some = np.flatnonzero(scores >= max(least - left, SLACK * SLACK))
        for i in range(opens - 1, a - 1, -1):
            docs, weights = postings[term[i]]
            if 8 * len(some) > len(docs):
                scores[docs] += weight[i] * weights
                searched.postings += len(docs)
            else:
                place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
                hit = docs[place] == some
                scores[some[hit]] += weight[i] * weights[place[hit]]
                searched.lookups += len(some)
            left -= float(impact[i])
            some = some[scores[some] >= least - left - SLACK]
        reached = np.round(scores[some], SCORE_DIGITS)
        some, reached = some[reached >= least], reached[reached >= least]
        if len(some) >= k:
            kth = np.partition(reached, len(reached) - k)[len(reached) - k]
            floor[q] = max(floor[q], kth)
            some, reached = some[reached >= kth], reached[reached >= kth]
            if len(some) > k:
                order = np.lexsort((names[some], -reached))[:k]
                some, reached = some[order], reached[order]
        found.append((np.full(len(some), q), some, reached))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def bounded_in_bytes(queries: Queries, floor, bounds: np.ndarray):
    """The queries that a segment is worth bounding for: they may reach a known floor with a moderate number of terms."""
    impact = queries.weight * bounds[queries.term]
    reach = np.bincount(queries.row, impact, minlength=len(floor))
    terms = np.bincount(queries.row[impact > 0], minlength=len(floor))
    chosen = (reach >= floor - SLACK) & (floor > 2 * SLACK) & (terms > 0) & (terms <= MOST_TERMS)
    return chosen if chosen.sum() >= FEW_QUERIES else np.zeros_like(chosen)


def search_bytes(queries: Queries, chosen, floor, k: int, postings: dict, bounds: np.ndarray, names: np.ndarray, searched: Searched):
    """As ``search_segment``, for the chosen queries: bounds of all documents in bytes, scores of those that reach the floor."""
    impact = queries.weight * bounds[queries.term]
    at = np.flatnonzero(chosen[queries.row] & (impact > 0))
    row = queries.row[at]
    numbers, starts, count = np.unique(row, return_index=True, return_counts=True)
    length = _greatest_length(postings, len(names))
    # no score is above the sum of the greatest impacts, nor above the product of the lengths of both vectors
    reach = np.minimum(np.add.reduceat(impact[at], starts), length * np.sqrt(np.add.reduceat(queries.weight[at] ** 2, starts)))
    # rounded up to a step and to whole bytes, a document's impacts add up to 255 at most
    scale = (254 - count) / (reach * STEP)

    def needed():
        return np.ceil(scale * (floor[numbers] - SLACK)).clip(1, 255).astype(np.uint8)

    least = needed()
    asked = queries.weight[at] * np.repeat(scale, count)
    step = np.ceil(np.log(asked) / np.log(STEP)).clip(-2000).astype(np.int64)
    step += STEP**step < asked
    found = []
    # queries of as many terms side by side, in parts whose rows fit
    waiting = [np.argsort(count, kind="stable")]
    while waiting:
        some = waiting.pop()
        before = np.cumsum(count[some]) - count[some]
        places = np.arange(int(count[some].sum())) + np.repeat(starts[some] - before, count[some])
        keys, line = np.unique(queries.term[at[places]] * np.int64(4096) + step[places] + 2048, return_inverse=True)
        terms = np.unique(keys >> 12)
        tile = min(TILE, -(-len(names) // 8) * 8)
        tiles = -(-len(names) // tile)
        if len(some) > 1 and (len(keys) * tiles * tile > ROW_BYTES or len(terms) * len(names) * 8 > ROW_BYTES):
            waiting += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        lines, weights = _lines(keys, terms, postings, len(names), tile, tiles, searched)
        cells, groups = np.append(np.searchsorted(terms, keys >> 12), 0) * len(names), []
        ends = np.cumsum(count[some])
        first = 0
        while first < len(some):
            last = first + GROUP_QUERIES
            while int(count[some[min(last, len(some)) - 1]]) > 2 * int(count[some[first]]):
                last = (first + min(last, len(some)) + 1) // 2
            group = some[first:last]
            lengths, begin = count[group], int(ends[first] - count[group[0]])
            most = int(lengths[-1])
            # missing terms are a last row of zeros
            table = np.full((len(group), most), len(keys), np.int64)
            factor = np.zeros((len(group), most))
            used = np.arange(most) < lengths[:, None]
            table[used] = line[begin : begin + int(lengths.sum())]
            factor[used] = queries.weight[at[places[begin : begin + int(lengths.sum())]]]
            groups.append((group, table, cells[table], factor))
            first = min(last, len(some))
        # no sum of bytes goes beyond a byte, so that eight are added as one number
        space = [np.empty((GROUP_QUERIES, tile // 8), np.uint64) for _ in range(2)] + [np.empty((GROUP_QUERIES, tile), np.bool_)]
        held, pairs, mine = [], 0, []
        for i, (wide, top) in enumerate(zip(lines.view(np.uint64), lines.max(axis=2))):
            for group, table, place, factor in groups:
                # a tile's greatest bytes bound all of its documents
                may = np.flatnonzero(top.take(table).sum(axis=1) >= least[group])
                if not len(may):
                    continue
                if len(may) < len(group):
                    group, table, place, factor = group[may], table[may], place[may], factor[may]
                reached = _reaching(wide, table, least[group], space)
                words = np.flatnonzero(reached.view(np.uint64))
                hit = np.flatnonzero(reached.reshape(-1, 8)[words])
                pair = words[hit >> 3] * 8 + (hit & 7)
                q, doc = np.divmod(pair, tile)
                searched.scored += len(pair)
                if len(pair):
                    held.append((place, factor, q, doc + i * tile, group))
                    pairs += len(pair) * table.shape[1]
                if pairs >= PAIRS:
                    mine.append(_scored(held, weights.ravel(), numbers, floor))
                    held, pairs = [], 0
            done = min((i + 1) * tile, len(names))
            if held and (done % ROUND_DOCS == 0 or i + 1 == tiles):
                mine.append(_scored(held, weights.ravel(), numbers, floor))
                held, pairs = [], 0
            if mine and done % ROUND_DOCS == 0 and i + 1 < tiles:
                mine = [_best_few(mine, names, floor, k)]
                np.maximum(least, needed(), out=least)
        searched.bounded += len(some) * len(names)
        found += mine
    return _best_few(found, names, floor, k)


def _best_few(found, names, floor, k):
    """Each query's k best of what was found; ``floor`` rises with them."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, doc, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((names[doc], -score, q))
    q, doc, score = q[order], doc[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    last = rank == k - 1
    floor[q[last]] = np.maximum(floor[q[last]], score[last])
    return q[rank < k], doc[rank < k], score[rank < k]


def _reaching(wide, table, least, space):
    """For a row of lines per query, which of their sums of bytes reach the query's least; in arrays that are used again."""
    sums, added, reached = (x[: len(table)] for x in space)
    wide.take(table[:, 0], axis=0, out=sums, mode="clip")
    for lines in table.T[1:]:
        wide.take(lines, axis=0, out=added, mode="clip")
        np.add(sums, added, out=sums)
    return np.greater_equal(sums.view(np.uint8), least[:, None], out=reached).ravel()


def _scored(held, flat, numbers, floor):
    """Query, document and score of the documents that some groups of queries have left, those below their floor left out."""
    most, before = max(h[0].shape[1] for h in held), np.cumsum([0, *(len(h[4]) for h in held)])
    place, factor = (np.zeros((before[-1], most), kind) for kind in (np.int64, np.float64))
    for (places, weights, *_), a, b in zip(held, before, before[1:]):
        place[a:b, : places.shape[1]], factor[a:b, : places.shape[1]] = places, weights
    q = np.concatenate([h[2] + a for h, a in zip(held, before)])
    doc = np.concatenate([h[3] for h in held])
    scores, step = np.empty(len(q)), max(1, PAIRS // most)
    for a in range(0, len(q), step):
        row, column = q[a : a + step], doc[a : a + step]
        scores[a : a + step] = np.einsum("ij,ij->i", factor.take(row, axis=0), flat.take(place.take(row, axis=0) + column[:, None]))
    q, scores = numbers[np.concatenate([h[4] for h in held])][q], np.round(scores, SCORE_DIGITS)
    good = (scores > 0) & (scores >= floor[q] - SLACK)
    return q[good], doc[good], scores[good]


def _greatest_length(postings, documents):
    """Of a segment's vectors, as far as their postings are known."""
    squares = np.zeros(documents)
    for docs, weights in postings.values():
        squares[docs] += weights * weights  # a term has a document once
    return math.sqrt(squares.max(initial=0.0)) * (1 + SLACK)


def _lines(keys, terms, postings, documents, tile, tiles, searched):
    """Per tile, a row of bytes per (term, step) and a row of zeros behind them; and the terms' weights, a row per term."""
    lines = np.zeros((tiles, len(keys) + 1, tile), np.uint8)
    flat, weights = lines.ravel(), np.zeros((len(terms), documents))
    ends = np.searchsorted(keys >> 12, terms, side="right").tolist()
    steps = STEP ** ((keys & 4095) - 2048)
    for i, (term, a, b) in enumerate(zip(terms.tolist(), [0, *ends[:-1]], ends)):
        docs, found = postings[term]
        weights[i, docs] = found
        part, column = np.divmod(docs, tile)
        flat[np.arange(a, b)[:, None] * tile + (part * ((len(keys) + 1) * tile) + column)] = np.ceil(steps[a:b, None] * found)
        searched.postings += len(docs)
    return lines, weights


def _search_batches(batches, queries, k, dim, types):
    row, score, ids = _best(batches, queries, k, dim, types[1]).kept
    return pa.RecordBatch.from_arrays(
        [arrow_ids(queries.ids[row], types[0]), arrow_ids(ids, types[1]), pa.array(score)], ["query_id", "item_id", "score"])


def _best(batches, queries, k, dim, item_kind):
    """The best of some segments for a block of queries."""
    best = Best(len(queries.ids), k, True, item_kind)
    searched, floor = Searched(), queries.floor.copy()
    for batch in batches:
        columns = batch.columns[1:]
        for row in range(batch.num_rows):
            ids = batch.column(0)[row].values
            bounds, postings = np.zeros(dim), {}
            for column in columns:
                block = column.slice(row, 1)
                for terms, most in _bounds(block):
                    bounds[terms] = most
                postings.update(*_read(block))
            names = plain_ids(ids)
            chosen = bounded_in_bytes(queries, floor, bounds)
            if chosen.any():
                q, d, s = search_bytes(queries, chosen, floor, k, postings, bounds, names, searched)
                best.take(q, s, names[d])
            if not chosen.all():
                q, d, s = search_segment(queries, floor, k, postings, bounds, names, searched, ~chosen)
                best.take(q, s, names[d])
            best.merge()
            np.maximum(floor, best.floor, out=floor)
    best.merge()
    return best


def _with_floors(queries: DataFrame, segments: DataFrame, tops: dict, k: int, dim: int, item_kind) -> DataFrame:
    """The queries with what k documents of a few segments reach: the search of all segments starts from there.

    The better the floors, the fewer documents are scored and the fewer rows tasks hand on."""
    few = max(1, min(FLOOR_SEGMENTS, segments.count() // FLOOR_SHARE))
    shared = queries.sparkSession.sparkContext.broadcast((segments.limit(few).toArrow(), tops))

    def run(batches):
        segment, tops = shared.value
        for batch in batches:
            some = Queries.of(np.arange(batch.num_rows), batch.column(1), tops, k)
            floor = _best(segment.to_batches(max_chunksize=1), some, k, dim, item_kind).floor
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["id", "vec", "floor"])

    found = materialize(queries.mapInArrow(run, "id " + queries.schema["id"].dataType.simpleString() + ", vec array<struct<i:int,w:double>>, floor double"), "floors")
    shared.destroy()
    return found


def top_k(segments: DataFrame, tops: dict, queries: DataFrame, k: int, dim: int, query_key="query_id",
          vector="vec", query_bytes=QUERY_BYTES) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items of each query with a score above 0, ties by id.

    ``queries`` is computed once. Blocks of queries of a checked size go to all tasks, one after the
    other; ``tops`` are the champions of the model's terms."""
    kind = id_type(queries, query_key)
    item_kind = segments.schema["ids"].dataType.elementType.simpleString().replace("bigint", "long")
    asked = queries.select(F.col(query_key).cast(kind).alias("id"), F.col(vector).alias("vec"))
    stored = materialize(asked, "queries")
    size = stored.agg(F.count("*"), F.sum(F.size("vec"))).first()
    stored = _with_floors(stored, segments, tops, k, dim, item_kind)
    blocks = max(1, math.ceil((size[0] * _KEPT_BYTES * (k + 1) + (size[1] or 0) * _ENTRY_BYTES) / query_bytes))
    parts = []
    for block in range(blocks):
        mine = stored if blocks == 1 else stored.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        head = mine.toArrow()
        some = Queries.of(plain_ids(head.column(0)), head.column(1), tops, k, head.column(2).to_numpy())
        # written at once, whatever reads it later: the search runs a single time
        parts.append(materialize(_best_of_block(segments, some, k, dim, (kind, item_kind)), "best"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    ranked = union(*parts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def _best_of_block(segments, queries, k, dim, types):
    shared = segments.sparkSession.sparkContext.broadcast(queries)
    needed = sorted({int(t) % BLOCKS for t in np.unique(queries.term)})

    def run(batches):
        yield _search_batches(batches, shared.value, k, dim, types)

    schema = f"query_id {types[0]}, item_id {types[1]}, score double"
    held = segments.select("ids", *(f"b{b}" for b in needed))
    return held.coalesce(WAVES * segments.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
