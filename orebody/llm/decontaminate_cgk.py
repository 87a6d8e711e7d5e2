"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification, over words.

The CGK embedding walks along a sequence: step j writes the word under the pointer and moves on if a random bit of (j, word) says
so. Two windows at small edit distance soon fall into step again, so that their embeddings differ in few places. Each of several
repeats draws its own bits and its own SAMPLED coordinates out of the walk through a whole item-sized window; windows whose sampled
coordinates agree with an item's are candidates. They are verified by the exact edit distance between the item and the closest
stretch of the window (bit-parallel, whole item).

An item of n words with k edits keeps n - 1 - 2k of its neighbouring pairs of words. So a window is opened only where a text has a pair
that some item of that length has, with as many such pairs in the n + k words from there; no contained item is lost by this. The
first of the kept pairs stands at one of the item's first 2k + 1 places, so an item is entered at each of these. The number of
repeats is what simulated items of that length, edited up to the limit, need to be found with the probability `recall`.

Words are parted by ASCII white space, lower-cased and stripped of all but letters and digits; words left empty are dropped.
An item counts as contained if at most `max_edits` of its words (rounded down) must be inserted, deleted or replaced; items of fewer
than five words must so stand in a text word for word.

Edge cases: null and empty texts contain nothing; items without a word match nothing; an item in a script without spaces is one word;
rows with null ids are reported with them; repeated rows are each reported; an empty benchmark or table gives no
rows; other columns are ignored. The items are taken in blocks of about `block` bytes of text, each read against all documents in one
pass: a benchmark of any usual size is one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import coded, materialize, text_chunks, without

MAX_EDITS = 0.2
RECALL = 0.995
SAMPLED = 2  # coordinates of an embedding that a repeat looks at
BLOCK = 32 << 20
TRIALS = 400
MOST_REPEATS = 64  # of a simulation; more would mean that the walk itself is broken
MEMO = 300_000
GAP = 32  # zeros between texts, so that walks don't run on into the next one at once

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def normal_words(words: pa.Array) -> pa.Array:
    """The letters and digits of each word in lower case."""
    try:
        return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.string())), r"[^\pL\pN]+", "")
    except pa.ArrowInvalid:  # some word is no UTF-8
        return normal_words(pa.array([w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()], pa.string()))


class NormalWords(dict):
    """raw word -> hash of its normal form (0: empty), remembered for a bounded number of words."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        bare = normal_words(pa.array([raw], pa.binary()))[0].as_py()
        h = self[raw] = (xxhash.xxh3_64_intdigest(bare.encode()) | 1) if bare else 0
        return h


def words_of(text: bytes, memo: dict) -> np.ndarray:
    """The hashes of a text's words: the definition that `Vocabulary` follows for whole chunks."""
    raw = text.split()
    h = np.fromiter(map(memo.__getitem__, raw), np.uint64, len(raw))
    return h[h != 0]


def edit_search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between the pattern and any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score < best:
            best, end = score, j
    return best, end


def edit_limit(n: int, max_edits: float) -> int:
    return int(max_edits * n)


def walk_length(n: int, limit: int) -> int:
    """Steps of the walk from any of an item's entries: on average they lead through the words that all of them have before them."""
    return 2 * max(1, n - 2 * limit)


def _moves(codes: np.ndarray, seed: int, j: int) -> np.ndarray:
    """Whether the walk moves on at step j from each word."""
    return (_scramble(codes.astype(np.uint64) * _A + np.uint64((seed << 20) + j + 1)) >> np.uint64(63)).astype(np.int64)


def sampled_keys(line: np.ndarray, start: np.ndarray, seed: int, coordinates: np.ndarray) -> np.ndarray:
    """One key for each start: the words that its walk stands on at the coordinates (ascending). The line ends in zeros."""
    pos, key = start, np.zeros(len(start), np.uint64)
    for j in range(int(coordinates[-1]) + 1):
        word = line[pos]
        if j in coordinates:
            key = _scramble(key * _B + word.astype(np.uint64) + np.uint64(1))
        pos = np.minimum(pos + _moves(word, seed, j), len(line) - 1)
    return key


def draw_coordinates(n: int, limit: int, seed: int) -> np.ndarray:
    length = walk_length(n, limit)
    return np.sort(np.random.default_rng((n, limit, seed)).choice(length, min(SAMPLED, length), replace=False))


def first_hits(hits: np.ndarray, n: int, limit: int) -> np.ndarray:
    """The places among `hits` (of pairs of words, ascending) from which n + limit words hold as many as a contained item must keep."""
    need = max(1, n - 1 - 2 * limit)
    if len(hits) < need:
        return hits[:0]
    return hits[: len(hits) - need + 1][hits[need - 1 :] - hits[: len(hits) - need + 1] < n + limit]


@lru_cache(maxsize=4096)
def repeats_for(n: int, limit: int, recall: float) -> int:
    """The repeats after which simulated items of n words with `limit` random edits are found with the probability `recall`."""
    if not limit:
        return 1  # equal windows have equal embeddings
    rng = np.random.default_rng((n, limit))
    items, lines, starts, owner, at = [], [], [], [], 0
    for t in range(TRIALS):  # each with words of its own, as the walk's bits are the words'
        own = list(range(1, n + 1))
        for _ in range(limit):
            place, kind = int(rng.integers(len(own))), int(rng.integers(3))
            own[place : place + 1] = [[], [0], [own[place], 0]][kind]
        line = np.array([*own, *range(n + 1, 2 * n + 3)])  # what follows in the text isn't what follows in the index
        pairs = np.flatnonzero((line[:-1] > 0) & (line[:-1] < n) & (line[1:] == line[:-1] + 1))
        h = first_hits(pairs, n, limit)
        h = h[line[h] - 1 <= 2 * limit]
        items.append(np.concatenate([np.arange(1, n + 1) + t * (2 * n + 3), np.zeros(n + 2, np.int64)]))
        lines.append(np.where(line > 0, line + t * (2 * n + 3), 0))
        starts.append(h + at)
        owner.append(np.full(len(h), t))
        at += len(line)
    item, line, start, owner = (np.concatenate(x) for x in (items, lines, starts, owner))
    entry = line[start] - 1 - owner * (2 * n + 3) + owner * (2 * n + 2)
    missed = np.ones(TRIALS, bool)
    for r in range(MOST_REPEATS):
        coordinates = draw_coordinates(n, limit, r)
        same = sampled_keys(line, start, r, coordinates) == sampled_keys(item, entry, r, coordinates)
        missed[owner[same]] = False
        if missed.mean() <= (1 - recall) / 2:  # with a margin, as the trials are a sample
            return r + 1
    raise RuntimeError(f"items of {n} words aren't found after {MOST_REPEATS} repeats")


class Index:
    """The items' words and, for each length, the sampled embeddings of their entries."""

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float = MAX_EDITS, recall: float = RECALL) -> None:
        self.max_edits, self.recall = max_edits, recall
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.binary()).cast(pa.string())], ["t"])
        words, codes, lengths = coded(batch, "t", False)
        normal = normal_words(words)
        self.words = pc.unique(normal.filter(pc.not_equal(normal, ""))).sort()
        self.base = len(self.words) + 1
        own = self.code(words)[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.items = [(i, x[x > 0]) for (i, _), x in ((item, own[a:b]) for item, a, b in zip(items, ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
        by_length: dict[int, list[int]] = defaultdict(list)
        for place, (_, x) in enumerate(self.items):
            if len(x):
                by_length[len(x)].append(place)
        self.groups = [self._group(n, places) for n, places in sorted(by_length.items())]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *[g["pairs"] for g in self.groups if g["n"] > 1]]))
        self.bits = np.zeros(1 << max(12, (64 * len(every)).bit_length()), bool)
        self.bits[self._slot(every)] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _A) >> np.uint64(65 - len(self.bits).bit_length())).astype(np.int64)

    def code(self, words: pa.Array) -> np.ndarray:
        """For each raw word: 0 if no item has it, -1 if it has neither letters nor digits, else its place from 1."""
        normal = normal_words(words)
        found = pc.fill_null(pc.index_in(normal, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return np.where(pc.equal(normal, "").to_numpy(zero_copy_only=False), -1, found)

    def _group(self, n: int, places: list[int]) -> dict:
        limit = edit_limit(n, self.max_edits)
        entries = np.arange(min(2 * limit, max(0, n - 2)) + 1)
        block = np.zeros((len(places), n + walk_length(n, limit) + 1), np.int64)
        block[:, :n] = [self.items[p][1] for p in places]
        line, width = block.ravel(), block.shape[1]
        start = (np.arange(len(places))[:, None] * width + entries).ravel()
        what = np.stack([np.repeat(places, len(entries)), np.tile(entries, len(places))], axis=1)
        first = block[:, : n - 1] * self.base + block[:, 1:n] if n > 1 else block[:, :1]
        keys = []
        for r in range(repeats_for(n, limit, self.recall)):
            key = sampled_keys(line, start, r, draw_coordinates(n, limit, r))
            order = np.argsort(key, kind="stable")
            keys.append((key[order], what[order]))
        return {"n": n, "limit": limit, "pairs": np.unique(first), "entered": np.unique(first[:, : len(entries)]), "keys": keys}

    def search(self, line: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text's place, item id, edits, words in the item, first word of the item's stretch) for each contained item. The texts'
        codes stand in a line, each from its place in `begins` on and with zeros behind it."""
        if not self.groups or not len(begins):
            return []
        pair = line[:-1] * self.base + line[1:]
        known = (line[:-1] > 0) & (line[1:] > 0)
        hits = np.flatnonzero(known & self.bits[self._slot(pair)])
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for g in self.groups:
            n, limit = g["n"], g["limit"]
            if n == 1:
                start = np.flatnonzero(np.isin(line, g["entered"]))
            else:
                start = first_hits(hits[np.isin(pair[hits], g["pairs"])], n, limit)
                start = start[np.isin(pair[start], g["entered"])]
            for r, (keys, what) in enumerate(g["keys"] if len(start) else ()):
                got = sampled_keys(line, start, r, draw_coordinates(n, limit, r))
                lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                met = np.flatnonzero(hi > lo)
                texts = np.searchsorted(begins, start[met], "right") - 1
                for p, text, a, b in zip(start[met].tolist(), texts.tolist(), lo[met].tolist(), hi[met].tolist(), strict=True):
                    for item, offset in what[a:b].tolist():
                        found[text, item].add(p - int(begins[text]) - offset)
        ends = np.append(begins[1:], len(line))
        out = []
        for (text, item), starts in sorted(found.items()):
            ident, codes = self.items[item]
            limit, pattern = edit_limit(len(codes), self.max_edits), codes.tolist()
            best, done = None, -(10**9)
            for s in sorted(starts):
                if s < done:  # the last window, widened by the limit on either side, holds this one's best stretch too
                    continue
                done = s + 1
                low = max(0, s - limit)
                begin = int(begins[text])
                stretch = line[begin + low : min(begin + s + len(pattern) + limit, int(ends[text]))].tolist()
                have = set(stretch)
                if len(pattern) - sum(map(have.__contains__, pattern)) > limit:  # each word that is missing costs an edit
                    continue
                d, _ = edit_search(pattern, stretch)
                if d <= limit and (best is None or d < best[0]):
                    best = (d, max(0, s))
                if best and best[0] == 0:
                    break
            if best:
                out.append((text, ident, best[0], len(pattern), best[1]))
        return out


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text", block: int = BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about `block` bytes, streamed to the driver; no more than a block is held."""
    held, size = [], 0
    for r in benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        held.append((r.i, (r.t or "").encode()))
        size += len(held[-1][1]) + 16
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_edits: float = MAX_EDITS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document and item that it contains: key, item_id, edits, item_words, first_word."""
    spark = docs.sparkSession
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, item_id long, edits int, item_words int, first_word int"

    def against(held: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(held, max_edits, recall))  # of one block, whose size is bounded

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in text_chunks(batch, text):
                    words, codes, lengths = coded(part, text, False)
                    x = index.code(words)[codes]
                    row = np.repeat(np.arange(len(lengths)), lengths)[x >= 0]
                    begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))[:-1]]) + GAP * np.arange(len(lengths))
                    line = np.zeros(len(row) + GAP * len(lengths), np.int64)
                    line[np.arange(len(row)) + GAP * row] = x[x >= 0]
                    rows = index.search(line, begins)
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    ids = part.column(key).take(pa.array(cols[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)]], [key, "item_id", "edits", "item_words", "first_word"])

        return docs.select(key, text).mapInArrow(run, schema)

    blocks = [against(held) for held in benchmark_items(benchmark, block=block)]
    return reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], schema)


def op10_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document contains the item within the edit limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go. Rows without an id stay."""
    gone = materialize(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("doc_id is not null").select("doc_id").distinct(), "leaks")
    return without(docs, gone).select(*docs.columns)
