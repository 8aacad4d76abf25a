"""Phrase collocations of every language by best-first branch and bound.

A phrase's score is its count times the language's size over the product of the counts of its two
parts, at its weakest cut. A part is at least as frequent as the whole, so no phrase that starts with
the word w can score above size / count(w): the count of a prefix bounds all that grows from it.
Words are therefore expanded best first, that is rarest first, in waves of a bounded number of
occurrences; a prefix below the least count is cut off with all its extensions. A language is settled
when its last wanted score lies above the bound of every word not yet expanded, so that no later
phrase can even tie. Nothing else ends the search, and what is left unexpanded is never counted.

Texts are read twice: to count the words, and into blocks of the frequent words' codes in the shared
folder. Each step of a wave is a narrow pass over these blocks, summed by Spark. Words and phrases are told apart by 64-bit hashes,
seeded by the language. The driver holds a wave's frontier: a phrase of it occurs ``least`` times, so
a slice of the wave has at most SLICE / ``least`` of one length, whatever the corpus; a wave that is
larger, because of a single very common word, is expanded slice by slice."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import blocks, string_array, text_of
from custodia.rules import local_table
from custodia.session import materialize

BLOCK = 1 << 20  # bytes of text in a block: its row stays small
PENDING = 1 << 20  # counts that a task gathers before it sums them
ROWS = 1 << 16  # of a batch of counts
MARKS = 1 << 20  # places that frequent words are marked at, so that blocks leave most others out
WAVE = 1 << 21  # occurrences of a language's words in its first wave; each next one has GROWTH times as many
GROWTH = 2
SLICE = 1 << 25  # occurrences whose phrases the driver keeps at once
EXACT = 1 << 12  # counts below are told apart when words are lined up, larger ones by sixteenths of an octave

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in BREAKS else b in BLANKS for b in range(256)], np.uint8)


# --- blocks of codes -------------------------------------------------------------------------


def word_codes(texts: pa.Array):
    """The distinct words of some texts, and all words in order as 1 + their index, 0 between pieces."""
    raw = np.frombuffer(b"\n".join(texts.cast(pa.binary()).to_pylist()).translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.uint32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
    coded = words.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    parted = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])
    codes = np.zeros(len(starts) + int(parted[-1]), np.uint32)
    codes[np.arange(len(starts)) + parted] = coded.indices.to_numpy() + 1
    return coded.dictionary, codes


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    found = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
    return np.maximum(found, np.uint64(1))  # 0 stands for a break


def _packed(codes: np.ndarray) -> bytes:
    """Two bytes a word where they do."""
    return codes.astype(np.uint16).tobytes() if not len(codes) or codes.max() < 1 << 16 else codes.tobytes()


def _rows(docs, text_col, lang_col):
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("_lang"), text_of(text_col).alias("_text"))


def _by_language(batch):
    """(language, texts) of blocks of one language each."""
    langs = string_array(batch.column(0)).dictionary_encode()
    of = langs.indices.to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        mine = batch.take(pa.array(np.flatnonzero(of == i)))
        for block in blocks(mine, "_text", BLOCK):
            yield lang, string_array(block.column("_text"))


_CODED = "lang string, n_words long, words binary, hashes binary, wide boolean, codes binary"


def code(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """Blocks of one language each: the words whose hash is marked in ``known``, joined by blanks, their hashes,
    and the words in order as codes. Other words part phrases as breaks do; ``n_words`` counts them too."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for lang, texts in _by_language(batch):
                words, codes = word_codes(texts)
                words = words.cast(pa.binary()).to_pylist()
                hashes = _word_hashes(words, lang)
                kept = np.flatnonzero(shared.value[hashes % np.uint64(len(shared.value))])
                number = np.zeros(len(words) + 1, np.uint32)
                number[kept + 1] = np.arange(1, len(kept) + 1)
                n, codes = int(np.count_nonzero(codes)), number[codes]
                codes = codes[(codes > 0) | np.concatenate([[False], codes[:-1] > 0])[: len(codes)]]  # one break at a time
                packed = _packed(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([n], pa.int64()), pa.array([b" ".join(words[i] for i in kept.tolist())], pa.binary()),
                     pa.array([hashes[kept].tobytes()], pa.binary()), pa.array([len(packed) == 4 * len(codes)]),
                     pa.array([packed], pa.binary())],
                    ["lang", "n_words", "words", "hashes", "wide", "codes"],
                )

    return rows.mapInArrow(run, _CODED)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, hash, n) of all words."""

    def run(batches):
        sums = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                words, codes = word_codes(texts)
                n = np.bincount(codes, minlength=len(words) + 1)[1:].astype(np.int64)
                sums.setdefault(lang, _Sum()).add(_word_hashes(words.cast(pa.binary()).to_pylist(), lang), n)
        yield from _summed(sums)

    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def _marked(frequent: DataFrame) -> np.ndarray:
    """A table of MARKS marks, whatever the vocabulary: a frequent word's hash falls on a marked place."""
    places = frequent.select((F.shiftrightunsigned("hash", 1) % F.lit(MARKS // 2)).alias("half"), (F.col("hash") % 2 != 0).alias("odd"))
    found = places.distinct().toArrow()
    marks = np.zeros(MARKS, bool)
    marks[found["half"].to_numpy() * 2 + found["odd"].to_numpy().astype(int)] = True
    return marks


def _scan(coded: DataFrame, found, schema: str) -> DataFrame:
    """Rows that ``found(hashes, codes)`` makes of each block, hashes[0] standing for a break."""

    def run(batches):
        for table, codes, _ in _blocks_of(batches):
            yield found(table, codes)

    return coded.select("hashes", "wide", "codes", "lang").mapInArrow(run, schema)


def _blocks_of(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            hashes, wide, codes, lang = (c[row].as_py() for c in batch.columns)
            table = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(hashes, np.uint64)])
            yield table, np.frombuffer(codes, np.uint32 if wide else np.uint16), lang


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


class _Sum:
    """Counts by hash, gathered over the blocks of a task."""

    def __init__(self):
        self.parts, self.waiting, self.size = [], 0, 0

    def add(self, hashes, n):
        self.parts.append((hashes, n))
        self.waiting += len(hashes)
        if self.waiting > max(PENDING, self.size):
            self.total()

    def total(self):
        hashes, n = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        found = hashes[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.waiting, self.size = [found], 0, len(first)
        return found


def _counted(coded: DataFrame, found) -> DataFrame:
    """(lang, hash, n) of the hashes that ``found(hashes, codes)`` lists with counts for each block."""

    def run(batches):
        sums = {}
        for table, codes, lang in _blocks_of(batches):
            sums.setdefault(lang, _Sum()).add(*found(table, codes))
        yield from _summed(sums)

    rows = coded.select("hashes", "wide", "codes", "lang").mapInArrow(run, _COUNTS)
    return rows.groupBy("lang", "hash").agg(F.sum("n").alias("n"))


_COUNTS = "lang string, hash long, n long"


def _summed(sums):
    """The counts of a task, by language, as batches."""
    for lang, counted in sums.items():
        hashes, n = counted.total()
        for a in range(0, len(hashes), ROWS):
            part = _signed(hashes[a : a + ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), part, pa.array(n[a : a + ROWS])], ["lang", "hash", "n"])


def _counts(values: np.ndarray):
    value, n = np.unique(values, return_counts=True)
    return value, n.astype(np.int64)


# --- one slice of a wave -----------------------------------------------------------------------


def _joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase one word longer."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _member(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values lie in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _starts(first: np.ndarray, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    known = _member(first, table)
    known[0] = False
    return np.flatnonzero(known[codes])


def _ordered_words(table: np.ndarray, codes: np.ndarray, longest: int) -> np.ndarray:
    return np.concatenate([table[codes], np.zeros(longest, np.uint64)])


def _grow(coded, tree, slices, mine, longest):
    """Counts of all phrases one word longer than the last level of the tree, from its phrases."""
    shared = coded.sparkSession.sparkContext.broadcast(tree)

    def found(table, codes):
        levels = shared.value
        at = _starts(levels[0], table, codes)
        words = _ordered_words(table, codes, longest)
        phrase = words[at]
        for length in range(2, len(levels) + 2):
            word = words[at + length - 1]
            phrase, keep = _joined(phrase, word), word != 0
            if length == 2 and slices > 1:
                keep &= phrase % np.uint64(slices) == mine
            if length <= len(levels):
                keep &= _member(levels[length - 1], phrase)
            at, phrase = at[keep], phrase[keep]
        return _counts(phrase)

    return _counted(coded, found), shared


_DESCRIBED = "hash long, words array<long>, least long, most long"


def _describe(coded, tree, longest):
    """Every phrase of the tree with its words, and the least and the greatest word before it."""
    shared = coded.sparkSession.sparkContext.broadcast(tree)

    def found(table, codes):
        levels = shared.value
        at = _starts(levels[0], table, codes)
        words = _ordered_words(table, codes, longest)
        before = np.concatenate([np.zeros(1, np.uint64), words])
        phrase, parts = words[at], []
        for length in range(2, len(levels) + 1):
            phrase = _joined(phrase, words[at + length - 1])
            keep = (words[at + length - 1] != 0) & _member(levels[length - 1], phrase)
            at, phrase = at[keep], phrase[keep]
            order = np.argsort(phrase, kind="stable")
            value, first = np.unique(phrase[order], return_index=True)
            if not len(value):
                break
            previous = before[at[order]].view(np.int64)
            spelled = words[at[order[first]][:, None] + np.arange(length)]
            offsets = np.arange(len(value) + 1, dtype=np.int32) * length
            parts.append(pa.RecordBatch.from_arrays(
                [_signed(value), pa.ListArray.from_arrays(pa.array(offsets), _signed(spelled.ravel())),
                 pa.array(np.minimum.reduceat(previous, first)), pa.array(np.maximum.reduceat(previous, first))],
                ["hash", "words", "least", "most"],
            ))
        empty = [pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())]
        return pa.concat_batches(parts) if parts else pa.RecordBatch.from_arrays(empty, ["hash", "words", "least", "most"])

    told = _scan(coded, found, _DESCRIBED).groupBy("hash").agg(
        F.any_value("words").alias("words"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    shared.destroy()
    return told


def _count_phrases(coded, wanted: list[np.ndarray], first: np.ndarray, longest):
    """Counts of the given phrases: wanted[i] has the sorted hashes of those of i + 1 words."""
    shared = coded.sparkSession.sparkContext.broadcast((wanted, first))

    def found(table, codes):
        lengths, starts = shared.value
        at = _starts(starts, table, codes)
        words = _ordered_words(table, codes, longest)
        phrase, hits = words[at], []
        for length, among in enumerate(lengths, 1):
            if length > 1:
                word = words[at + length - 1]
                phrase, keep = _joined(phrase, word), word != 0
                at, phrase = at[keep], phrase[keep]
            hits.append(phrase[_member(among, phrase)])
        return _counts(np.concatenate(hits))

    counted = _counted(coded, found).toArrow()
    shared.destroy()
    return _unsigned(counted["hash"]), counted["n"].to_numpy()


def _spelled_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases of one length, a row of words each."""
    out = words[:, 0]
    for i in range(1, words.shape[1]):
        out = _joined(out, words[:, i])
    return out


def _expand(coded, first: np.ndarray, slices: int, mine: int, least: int, longest: int):
    """All phrases from the given first words, by length: their words, counts, and whether a longer
    phrase is as frequent."""
    tree, counts = [np.sort(first)], [None]
    while len(tree) < longest:
        counted, shared = _grow(coded, tree, slices, mine, longest)
        grown = counted.filter(F.col("n") >= least).toArrow()
        shared.destroy()
        if not grown.num_rows:
            break
        hashes = _unsigned(grown["hash"])
        order = np.argsort(hashes)
        tree.append(hashes[order])
        counts.append(grown["n"].to_numpy()[order])
    if len(tree) == 1:
        return []
    told = _describe(coded, tree, longest)
    hashes, spelled = _unsigned(told["hash"]), told["words"].combine_chunks()
    lengths = spelled.value_lengths().to_numpy()
    same_before = ((told["least"].to_numpy() == told["most"].to_numpy()) & (told["least"].to_numpy() != 0))
    out = []
    for length in range(2, len(tree) + 1):
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(hashes[rows])]  # in the order of the tree
        words = spelled.take(pa.array(rows)).flatten().to_numpy().view(np.uint64).reshape(-1, length)
        out.append([words, counts[length - 1], same_before[rows] & (length < longest)])
    for (shorter, n, held), (longer, m, _) in zip(out, out[1:]):
        prefix = np.searchsorted(tree[shorter.shape[1] - 1], _spelled_hashes(longer[:, :-1]))
        held[prefix[m == n[prefix]]] = True
    return out


# --- the search --------------------------------------------------------------------------------


def _score(a: int, n: int, parts: list[tuple[int, int]]):
    """The lowest score over all cuts, and the counts of its parts; exact whole numbers."""
    scores = [1000 * a * n // (l * r) for l, r in parts]
    at = min(range(len(scores)), key=scores.__getitem__)
    return scores[at], *parts[at]


class _Language:
    """What is settled of a language: its best phrases so far, and the words still to expand."""

    def __init__(self, name, total, top):
        self.name, self.total, self.top = name, total, top
        self.steps = []  # (bucket, least count, occurrences), rarest first
        self.done = 0
        self.size = WAVE
        self.best = []  # (score, left, right, count, words), all that can still be wanted
        self.found = []  # newly

    def floor(self) -> int:
        """The last wanted score so far."""
        return self.best[self.top - 1][0] if len(self.best) >= self.top else -1

    def settled(self) -> bool:
        return self.done >= len(self.steps) or self.floor() > 1000 * self.total // self.steps[self.done][1]

    def next_wave(self) -> tuple[int, int, int]:
        """First and last bucket of the next wave, and its occurrences."""
        start, reached = self.done, 0
        while self.done < len(self.steps) and reached < self.size:
            reached += self.steps[self.done][2]
            self.done += 1
        self.size *= GROWTH
        return self.steps[start][0], self.steps[self.done - 1][0], reached

    def keep(self):
        self.best = sorted(self.best + self.found, key=lambda p: -p[0])
        self.found, floor = [], self.floor()
        self.best = [p for p in self.best if p[0] >= floor]


def _bucket(n):
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(16 * (F.log2(n) - math.log2(EXACT)))).cast("long")


class _Counts:
    """Counts by hash."""

    def __init__(self, hashes, n):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]

    def of(self, hashes):
        """The counts, 0 where unknown."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.n[at], 0)

    def and_(self, hashes, n):
        return _Counts(np.concatenate([self.hashes, hashes]), np.concatenate([self.n, n]))


def _settle(coded, levels, languages, lang_of, counts, longest):
    """Score the phrases of a slice that nothing drops and that can still be wanted.

    ``lang_of`` has the number of the language of a first word, by hash."""
    totals = np.array([x.total for x in languages], float)
    floors = np.array([x.floor() for x in languages], float)
    waiting, wanted, first = [], [[] for _ in range(longest - 1)], []
    for words, n, held in levels:
        length = words.shape[1]
        lang = lang_of.of(words[:, 0])
        bound = 1000 * totals[lang] / counts.of(words[:, 0])
        rows = np.flatnonzero(~held & (bound * (1 + 1e-9) >= floors[lang]))
        words, n, lang = words[rows], n[rows], lang[rows]
        rests = [_spelled_hashes(words[:, k:]) for k in range(1, length)]
        for k, rest in enumerate(rests, 1):
            open_ = counts.of(rest) == 0
            wanted[length - k - 1].append(rest[open_])
            first.append(words[open_, k])
        waiting.append((words, n, lang, rests))
    wanted = [np.unique(np.concatenate(w)) if w else np.zeros(0, np.uint64) for w in wanted]
    if any(map(len, wanted)):
        counts = counts.and_(*_count_phrases(coded, wanted, np.unique(np.concatenate(first)), longest))
    for words, n, lang, rests in waiting:
        lefts = [counts.of(_spelled_hashes(words[:, :k])) for k in range(1, words.shape[1])]
        rights = [counts.of(rest) for rest in rests]
        about = np.min([1000.0 * n * totals[lang] / (l.astype(float) * r) for l, r in zip(lefts, rights)], axis=0)
        for i in np.flatnonzero(about * (1 + 1e-9) >= floors[lang]).tolist():
            a, language = int(n[i]), languages[lang[i]]
            parts = [(int(l[i]), int(r[i])) for l, r in zip(lefts, rights)]
            language.found.append((*_score(a, language.total, parts), a, tuple(words[i].tolist())))
    for language in languages:
        language.keep()


def mine(docs: DataFrame, text_col="text", lang_col="lang", least=100, longest=5, top=2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count, at least ``least``, ``l`` and ``r`` those of its parts at the cut of
    lowest score (ties: the first), ``n`` the language's words. A phrase inside a longer one of the same
    count is left out. Order: score, count, both descending, then the phrase's bytes. A null language is
    ``und``; null and empty texts, and texts of blanks, have no words; repeated rows count each; texts
    are read whole, however long. A language without such a phrase, and an empty table, give no rows."""
    spark = docs.sparkSession
    rows = _rows(docs, text_col, lang_col)
    frequent = word_counts(rows).filter(F.col("n") >= least).withColumn("bucket", _bucket(F.col("n")))
    frequent = materialize(frequent, "frequent")
    coded = materialize(code(rows, _marked(frequent)), "coded")
    sizes = coded.groupBy("lang").agg(F.sum("n_words").alias("n")).orderBy("lang").collect()
    languages = [_Language(r["lang"], r["n"], top) for r in sizes]
    number = {x.name: i for i, x in enumerate(languages)}
    lines = frequent.groupBy("lang", "bucket").agg(F.min("n").alias("least"), F.sum("n").alias("n")).orderBy("bucket")
    for r in lines.collect():
        languages[number[r["lang"]]].steps.append((r["bucket"], r["least"], r["n"]))
    while waves := [(i, *x.next_wave()) for i, x in enumerate(languages) if not x.settled()]:
        ranges = local_table(spark, [(languages[i].name, i, a, b) for i, a, b, _ in waves], "_lang", "_number", "_from", "_to")
        mine_ = (F.col("lang") == F.col("_lang")) & F.col("bucket").between(F.col("_from"), F.col("_to"))
        picked = frequent.join(ranges, mine_).select("hash", "n", F.col("_number").cast("long")).toArrow()
        first, n = _unsigned(picked["hash"]), picked["n"].to_numpy()
        lang_of = _Counts(first, picked["_number"].to_numpy())
        slices = max(1, math.ceil(sum(w[-1] for w in waves) / SLICE))
        for part in range(slices):
            levels = _expand(coded, first, slices, part, least, longest)
            counts = _Counts(first, n)
            for spelled, times, _ in levels:
                counts = counts.and_(_spelled_hashes(spelled), times)
            _settle(coded, levels, languages, lang_of, counts, longest)
    return _ranked(spark, coded, languages, top)


def _ranked(spark, coded, languages, top) -> DataFrame:
    """The result's rows, spelled out."""
    needed = np.array(sorted({w for x in languages for p in x.best for w in p[4]}), np.uint64)
    shared = spark.sparkContext.broadcast(needed)

    def spell(batches):
        for batch in batches:
            for words, hashes in zip(batch.column(0), batch.column(1)):
                value = np.frombuffer(hashes.as_py(), np.uint64)
                at = np.flatnonzero(_member(shared.value, value))
                spelled = words.as_py().split(b" ")
                yield pa.RecordBatch.from_arrays([_signed(value[at]), pa.array([spelled[i].decode() for i in at.tolist()], pa.string())], ["hash", "word"])

    spelled = coded.select("words", "hashes").mapInArrow(spell, "hash long, word string")
    found = spelled.groupBy("hash").agg(F.min("word").alias("word")).toArrow()
    word = dict(zip(_unsigned(found["hash"]).tolist(), found["word"].to_pylist()))
    rows = []
    for x in languages:
        phrases = [(" ".join(word[w] for w in p[4]), p) for p in x.best]
        phrases.sort(key=lambda row: (-row[1][0], -row[1][3], row[0].encode()))
        rows += [(x.name, i, text, a, l, r, x.total, s) for i, (text, (s, l, r, a, _)) in enumerate(phrases[:top], 1)]
    return spark.createDataFrame(rows, "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
