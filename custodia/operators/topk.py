"""Exact top-k of many queries over a large table of vectors.

Scores are computed block against block with a matrix product inside Spark tasks. A task
emits at most k rows per query, never a row per pair.

The items stay where they are. Queries are sent to every task in blocks of bounded size, one
after the other: each block passes once over the items.

The product is made in single precision, of vectors scaled to lengths of 1 at most, so that its error has
a known limit. Only pairs that may reach their query's k-th best so far are scored, in double precision."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.session import materialize, union

SCORE_DIGITS = 9  # ranking precision: hides the summation order of the product
BLOCK_BYTES = 64 << 20
_KEPT_BYTES = 24  # of a scored id
_ITEMS_PER_STEP, _STAND_INS_PER_STEP = 2048, 1 << 20  # of 4 bytes, in arrays that are used again
_SCORES_PER_STEP = 1_000_000  # of 8 bytes: a task holds a few arrays of them
_ITEM_BYTES = 8 << 20
_FIRST_ITEMS, _GROWTH = 512, 4  # of the parts of the items: the best are merged after each
_SHARE = 32  # a query that more than this part of its items may reach is scored densely
_PAIR_BYTES = 8 << 20  # of the vectors of pairs scored at a time


def _dense(column, dim):
    """Arrow list column (all rows of length ``dim``) to a float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def id_type(df, column):
    """Ids are bigint where they are integers, else strings."""
    kind = df.schema[column].dataType
    return "long" if isinstance(kind, T.IntegralType) else "string"


def plain_ids(column):
    """Arrow ids to a numpy array that sorts as Spark does."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(**_copy(column))
    return np.array(column.to_pylist(), dtype=np.str_)


def _copy(column):
    return {} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False}


def arrow_ids(ids, kind):
    return pa.array(ids, _ARROW_IDS[kind])


_ARROW_IDS = {"long": pa.int64(), "string": pa.string()}


def _sizes(vectors, metric):
    """What ``_scores`` needs of each vector besides itself."""
    return (vectors**2).sum(axis=1) if metric == "l2" else np.linalg.norm(vectors, axis=1)


def _scores(queries, items, metric, query_sizes, item_sizes):
    """Every score of some queries and items; besides the result, one array of its size at most is made."""
    product = queries @ items.T
    if metric == "cosine":
        norms = query_sizes[:, None] * item_sizes[None, :]
        sized = norms > 0
        np.divide(product, norms, out=product, where=sized)
        product[~sized] = 0.0
    elif metric == "l2":
        # nearest first: the negative squared distance
        product *= 2
        product -= query_sizes[:, None] + item_sizes[None, :]
    np.round(product, SCORE_DIGITS, out=product)
    product += 0.0
    return product


class Best:
    """Running best k per query, ties by smaller id."""

    def __init__(self, count, k, positive_only, item_type):
        self.k, self.positive_only = k, positive_only
        no_ids = np.empty(0, np.int64 if item_type == "long" else np.str_)
        self.kept = (np.empty(0, np.int64), np.empty(0), no_ids)
        self.floor = np.full(count, -np.inf)
        self.waiting, self.waiting_rows = [], 0
        self.enough = 2 * count * k + 100_000

    def add(self, rows, scores, ids):
        k, width = self.k, scores.shape[1]
        floor = self.floor[rows]
        if width > k:
            floor = np.maximum(floor, np.partition(scores, width - k, axis=1)[:, width - k])
        r, c = np.nonzero(scores >= floor[:, None])
        self.take(rows[r], scores[r, c], ids[c])

    def take(self, rows, scores, ids):
        """Scored ids of some queries, by row; those below their floor may be among them."""
        scores = np.round(scores, SCORE_DIGITS)
        if self.positive_only:
            rows, scores, ids = (x[scores > 0] for x in (rows, scores, ids))
        self.waiting.append((rows, scores, ids))
        self.waiting_rows += len(rows)
        if self.waiting_rows > self.enough:
            self.merge()

    def merge(self):
        parts = zip(self.kept, *self.waiting)
        row, score, ids = (np.concatenate(p) for p in parts)
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        best, last = rank < self.k, rank == self.k - 1
        self.floor[row[last]] = score[last]
        self.kept = row[best], score[best], ids[best]
        self.waiting, self.waiting_rows = [], 0
        return self.kept


class _Screen:
    """Single-precision stand-ins for the scores of some items, and what they must reach.

    A stand-in differs from (score + shift) * factor by ``error`` at most."""

    def __init__(self, items, sizes, metric, space):
        self.metric, self.space, dim = metric, space, items.shape[1]
        # scaled vectors are rounded once, their products summed up: twice what that can lose, and more
        self.error = (dim + 8) * 2.0**-22
        self.rounding = (dim + 8) * 2.0**-50  # of a score in double precision, by the lengths of its vectors
        lengths = np.sqrt(sizes) if metric == "l2" else sizes
        self.most = float(lengths.max(initial=0.0)) or 1.0
        if metric == "cosine":
            self.items = (items / np.where(sizes > 0, sizes, np.inf)[:, None]).astype(np.float32)
        else:
            self.items = (items / self.most).astype(np.float32)
        if metric == "l2":
            # half of a squared length is one more dimension: the product adds it up, no pass of its own does
            half = (sizes / (-2 * self.most**2)).astype(np.float32)
            self.items = np.concatenate([self.items, half[:, None]], axis=1)

    def _kept(self, name, rows, kind):
        """An array of a row per query that is used again: new pages cost more than the product."""
        cells = rows * len(self.items)
        if name not in self.space or len(self.space[name]) < cells:
            self.space[name] = np.empty(cells, kind)
        return self.space[name][:cells].reshape(rows, -1)

    def reaching(self, product, least):
        """Row and column of the few cells that reach their row's least."""
        flat = np.greater_equal(product, least[:, None], out=self._kept("reached", len(product), np.bool_)).ravel()
        whole = len(flat) // 8 * 8
        words = np.flatnonzero(flat[:whole].view(np.uint64))
        hit = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
        at = np.concatenate([words[hit >> 3] * 8 + (hit & 7), whole + np.flatnonzero(flat[whole:])])
        return np.divmod(at, product.shape[1])

    def stand_ins(self, queries, sizes, floor, k):
        """The stand-ins, and per query the least that a pair has that may reach its floor, or without one, the part's k-th best."""
        lengths = np.sqrt(sizes) if self.metric == "l2" else sizes
        shift, factor, lost = 0.0, 1.0, self.rounding
        if self.metric == "cosine":
            scaled = queries / np.where(lengths > 0, lengths, np.inf)[:, None]
        elif self.metric == "dot":
            scaled = queries / np.where(lengths > 0, lengths, np.inf)[:, None]
            lost = self.rounding * lengths * self.most
            factor = 1 / (np.where(lengths > 0, lengths, 1.0) * self.most)
        else:
            scale = np.maximum(lengths, self.most)
            scaled = np.concatenate([queries, np.full((len(queries), 1), self.most)], axis=1) / scale[:, None]
            lost = self.rounding * (sizes + self.most**2)
            shift, factor = sizes, 1 / (2 * scale * self.most)
        product = np.matmul(scaled.astype(np.float32), self.items.T, out=self._kept("product", len(queries), np.float32))
        slack = (lost + 4 * 10.0**-SCORE_DIGITS) * factor
        least = (floor + shift) * factor - slack - self.error
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and product.shape[1] > k:
            width = product.shape[1]
            kth = np.partition(product if len(new) == len(product) else product[new], width - k, axis=1)[:, width - k]
            least[new] = kth.astype(np.float64) - np.broadcast_to(slack, floor.shape)[new] - 2 * self.error
        # the next smaller single: what the comparison would round up is still reached
        return product, np.nextafter(least.astype(np.float32), np.float32(-np.inf))


def _pair_scores(queries, items, metric, query_sizes, item_sizes):
    """The scores of pairs of rows, as ``_scores`` makes them."""
    product = np.einsum("ij,ij->i", queries, items)
    if metric == "cosine":
        norms = query_sizes * item_sizes
        product = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    elif metric == "l2":
        product = product * 2 - (query_sizes + item_sizes)
    return np.round(product, SCORE_DIGITS) + 0.0


def _add_screened(best, screen, queries, items, ids, query_sizes, item_sizes, first):
    """The pairs of some queries, from row ``first`` on, and some items that may be among the best."""
    floor = best.floor[first : first + len(queries)]
    product, least = screen.stand_ins(queries, query_sizes, floor, best.k)
    row, column = screen.reaching(product, least)
    met = np.bincount(row, minlength=len(queries))
    many = met > max(len(ids) // _SHARE, 4 * best.k)
    if many.any():
        # equal or close items: their scores come cheaper from a product
        few = ~many[row]
        row, column = row[few], column[few]
        dense = np.flatnonzero(many)
        scores = _scores(queries[dense], items, screen.metric, query_sizes[dense], item_sizes)
        best.add(dense + first, scores, ids)
    step = max(1, _PAIR_BYTES // (16 * queries.shape[1]))
    for a in range(0, len(row), step):
        r, c = row[a : a + step], column[a : a + step]
        scores = _pair_scores(queries[r], items[c], screen.metric, query_sizes[r], item_sizes[c])
        good = scores >= floor[r]
        best.take(r[good] + first, scores[good], ids[c[good]])


def _score_batches(batches, query_ids, query_matrix, k, metric, types):
    best = Best(len(query_ids), k, False, types[1])
    dim = query_matrix.shape[1]
    most = max(256, min(_ITEMS_PER_STEP, _ITEM_BYTES // (8 * dim)))
    query_sizes = _sizes(query_matrix, metric)
    plain = np.isfinite(query_sizes)
    odd_rows, space, done, merge_at = np.flatnonzero(~plain), {}, 0, _FIRST_ITEMS

    def densely(rows, items, ids, item_sizes):
        step = max(1, _SCORES_PER_STEP // max(1, len(ids)))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            best.add(some, _scores(query_matrix[some], items, metric, query_sizes[some], item_sizes), ids)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # parts end where the best are merged
            part = batch.slice(at, min(most, merge_at - done))
            at, done = at + part.num_rows, done + part.num_rows
            items, ids = _dense(part.column(1), dim), plain_ids(part.column(0))
            item_sizes = _sizes(items, metric)
            usual = np.isfinite(item_sizes)
            if not usual.all():
                # lengths beyond all bounds, and NaN, have no stand-ins
                densely(np.arange(len(query_ids)), items[~usual], ids[~usual], item_sizes[~usual])
                items, ids, item_sizes = items[usual], ids[usual], item_sizes[usual]
            if len(ids):
                densely(odd_rows, items, ids, item_sizes)
                screen = _Screen(items, item_sizes, metric, space)
                step = max(1, _STAND_INS_PER_STEP // len(ids))
                for first in range(0, len(query_ids), step):
                    some = slice(first, first + step)
                    if plain[some].all():
                        _add_screened(best, screen, query_matrix[some], items, ids, query_sizes[some], item_sizes, first)
                    else:
                        rows = np.flatnonzero(plain[some]) + first
                        densely(rows, items, ids, item_sizes)
            if done == merge_at:
                best.merge()
                merge_at *= _GROWTH
    row, score, ids = best.merge()
    return pa.RecordBatch.from_arrays(
        [arrow_ids(query_ids[row], types[0]), arrow_ids(ids, types[1]), pa.array(score)],
        ["query_id", "item_id", "score"],
    )


def _schema(types):
    return f"query_id {types[0]}, item_id {types[1]}, score double"


def _usable(df, key, vector, dim):
    out = df.select(F.col(key).cast(id_type(df, key)).alias("id"), F.col(vector).alias("vec"))
    # ragged or missing vectors cannot be scored; ensure_dimension() reports them
    return out.filter(F.size(F.array_compact("vec")) == dim)


def top_k(items: DataFrame, queries: DataFrame, k: int, dim: int, metric="cosine", item_key="id",
          query_key="query_id", vector="embedding", broadcast_bytes=BLOCK_BYTES, least_blocks=1) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items per query.

    ``metric`` is cosine, dot or l2 (score = minus the squared distance). Queries go to the tasks in
    blocks of at most about ``broadcast_bytes``, what a task keeps for them included."""
    types = id_type(queries, query_key), id_type(items, item_key)
    item_rows = _usable(items, item_key, vector, dim)
    query_rows = _usable(queries, query_key, vector, dim)
    # decoded queries are float64; a task keeps k scored ids of each
    limit = max(1, broadcast_bytes // (8 * dim + _KEPT_BYTES * (k + 1)))
    blocks = max(least_blocks, math.ceil(query_rows.count() / limit))
    parts = []
    for block in range(blocks):
        mine = query_rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else query_rows
        parts.append(_best_of_block(item_rows, mine.toArrow(), k, dim, metric, types))
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    ranked = union(*parts).withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= k)


def _best_of_block(items, head, k, dim, metric, types):
    """Each task's best items for one block of queries, written so that the block can be let go."""
    ids = plain_ids(head.column(0))
    matrix = _dense(head.column(1), dim)
    shared = items.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        query_ids, query_matrix = shared.value
        yield _score_batches(batches, query_ids, query_matrix, k, metric, types)

    found = materialize(items.mapInArrow(run, _schema(types)), "best")
    shared.destroy()
    return found
