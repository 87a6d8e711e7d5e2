"""Periodic runs: the maximal stretches of a text in which words recur at a fixed distance, and the text without their repeats.

After Stoye and Gusfield. The suffix tree of the words is held as sorted suffixes with the intervals of their common prefixes, an interval being
an inner node. Of each node's children all but the largest give their leaves, and a leaf i under a node of depth d is tried with i + d and i - d:
where both stand under the node and the words after them differ, the words twice repeated from the first of them are a branching tandem
repeat. Rotating it to the left as long as it repeats gives a maximal run; runs found with several periods are merged under the smallest.
All steps work on whole chunks of documents in numpy; trees of different documents never share a node.

Before that, an exact screen: a run of period q has length - q words that recur q words further on, which is at least
least_length * (exponent - 1) / exponent. Only stretches covered by recurring word sequences of that size enter the trees, and every run lies in one.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows are treated alike; ties among runs go to the
smallest start, then period; keys may be null; an empty table gives no rows; other columns are left out. A chunk is some megabytes of texts,
or one longer text, whose task then holds about a hundred bytes for each word of its recurring stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from orebody.llm.common import coded, text_chunks

LEAST = 24
EXPONENT = 3
PAIRS = 1 << 20  # leaves tried at once

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    return (h ^ (h >> np.uint64(27))) * _MIX[2]


def _sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place on; those that reach past the end mean nothing."""

    def joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        out = a * _MIX[0]
        out[: max(0, len(b) - by)] += b[by:]
        return _mixed(out)

    power, size, total, got = _mixed(words.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while width:
        if width & 1:
            total, got = (power, size) if total is None else (joined(total, power, got), got + size)
        width >>= 1
        if width:
            power, size = joined(power, power, size), 2 * size
    return total


def recurring(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches covered by sequences of `width` words that stand twice or more in their document. starts: those of the
    documents, and the end of the last. Different sequences may be taken for one by their hashes, which only adds stretches."""
    n, sizes = len(words), np.diff(starts)
    fits = np.repeat(starts[1:], sizes) - np.arange(n) >= width
    hashes = _mixed(_sequence_hashes(words, width) ^ (np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * _MIX[0]))
    ordered = np.sort(hashes[fits])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    hit = np.flatnonzero(fits & (twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes))
    edge = np.zeros(n + 1, np.int32)
    edge[:-1] += np.bincount(hit, minlength=n).astype(np.int32)
    edge -= np.bincount(hit + width, minlength=n + 1).astype(np.int32)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = False
    begins = covered[1:] & (~covered[:-1] | first)
    ends = covered[1:-1] & (~covered[2:] | np.append(first[1:n], True))
    return np.flatnonzero(begins[:n]), np.flatnonzero(ends) + 1


class Suffixes:
    """The sorted suffixes of several word sequences, with ranks[k]: equal for two places if and only if the same 2^k words stand there in
    one sequence. What reaches past a sequence's end is equal to nothing else."""

    def __init__(self, words: np.ndarray, starts: np.ndarray) -> None:
        n = len(words)
        self.n, self.starts = n, starts
        sizes = np.diff(starts)
        self.end = np.repeat(starts[1:], sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1) + words
        rank = np.full(n + 1, -1, np.int32)
        order = np.argsort(key, kind="stable")
        rank[order] = self._first(key[order])
        self.ranks = [rank]
        open_ = self._open(rank[order], order)
        reach = 1
        while len(open_):
            rank = rank.copy()
            past = open_ + reach
            second = np.where(past < self.end[open_], rank[np.minimum(past, n)], -1)
            key = rank[open_].astype(np.int64) * (n + 2) + second + 1
            by = np.argsort(key, kind="stable")
            order, key = open_[by], key[by]
            old = rank[order].astype(np.int64)
            slots = old + np.arange(len(order)) - self._first(old)  # a group's places in the order are its rank and those after it
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
            self.ranks.append(rank)
            open_ = self._open(rank[order], order)
            reach *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank[:n]] = np.arange(n)

    @staticmethod
    def _first(key: np.ndarray) -> np.ndarray:
        """For each of sorted keys, the place of the first equal one."""
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))

    @staticmethod
    def _open(ranks: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Those that share their rank with another."""
        same = ranks[1:] == ranks[:-1]
        return order[np.concatenate([same, [False]])[: len(order)] | np.concatenate([[False], same])[: len(order)]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that the suffixes at a and b have in common (a and b differ everywhere)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            length += (rank[a + length] == rank[b + length]).astype(np.int64) << k
        return length

    def back(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far left of `at` each word equals the one `period` words further on."""
        left, begin = at.copy(), self.starts[np.searchsorted(self.starts, at, "right") - 1]
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, to = self.ranks[k], left - (1 << k)
            safe = np.maximum(to, 0)
            left = np.where((to >= begin) & (rank[safe] == rank[safe + period]), to, left)
        return at - left


def _node_bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and behind each of `at` with a smaller value; the first and last value are smaller than all others."""
    least = [lcp]
    while 2 << (len(least) - 1) <= len(lcp):
        last, half = least[-1], 1 << (len(least) - 1)
        least.append(np.minimum(last[:-half], last[half:]))
    value, left, right = lcp[at], at.copy(), at.copy()
    for k in range(len(least) - 1, -1, -1):
        row, step = least[k], 1 << k
        to = left - step
        left = np.where((to >= 0) & (row[np.maximum(to, 0)] >= value), to, left)
        to = right + 1
        right = np.where((to < len(row)) & (row[np.minimum(to, len(row) - 1)] >= value), right + step, right)
    return left - 1, right + 1


def _light_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the tree's inner nodes but the root: depth, first and last leaf + 1; of the children that aren't their node's largest: node, first
    leaf, size. Leaves are places in the order of the suffixes."""
    at = np.flatnonzero(lcp >= 1)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    left, right = _node_bounds(lcp, at)
    by = np.argsort(left * len(lcp) + right, kind="stable")
    at, left, right = at[by], left[by], right[by]
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    node, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    depth, first, last = lcp[at[heads]], left[heads], right[heads]
    # a child reaches from a place where the node's depth is met to the next such place; one more lies before the first of them
    tail = np.append(new[1:], True)
    begins = np.concatenate([first, at])
    ends = np.concatenate([at[heads], np.where(tail, right, np.append(at[1:], 0))])
    owner = np.concatenate([np.arange(len(heads)), node])
    sizes = ends - begins
    by = np.lexsort((begins, -sizes, owner))
    light = by[~np.concatenate([[True], owner[by][1:] != owner[by][:-1]])]
    return depth, first, last, owner[light], begins[light], sizes[light]


def tandem_repeats(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """The branching tandem repeats, each once: place and period. Their words stand twice, and not the same word follows both."""
    lcp = np.full(s.n + 1, -1, np.int64)
    lcp[1 : s.n] = s.common(s.order[:-1], s.order[1:])
    depth, first, last, owner, begins, sizes = _light_children(lcp)
    upto = np.cumsum(sizes)
    symbol, found = s.ranks[0], []
    for f in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        flat = np.arange(f, min(f + PAIRS, int(upto[-1])))
        child = np.searchsorted(upto, flat, "right")
        node = owner[child]
        i, d = s.order[begins[child] + flat - (upto[child] - sizes[child])], depth[node]
        for place, other in ((i, i + d), (i - d, i - d)):
            real = (other >= 0) & (other < s.n)
            place, other, q, v = place[real], other[real], d[real], node[real]
            under = (s.rank[other] >= first[v]) & (s.rank[other] < last[v])
            place, q = place[under], q[under]
            branch = symbol[place + q] != symbol[np.minimum(place + 2 * q, s.n)]
            found.append(np.stack([place[branch], q[branch]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of the maximal runs of max(least, exponent * period) words or more, by start, then period.

    words: numbers, of documents that lie one after another; starts: the documents' starts, and the end of the last. Places count from 0 over all.
    """
    if exponent < 2:
        raise ValueError("a run needs two periods at least")
    none = (np.zeros(0, np.int64),) * 3
    begins, ends = recurring(words, starts, max(1, -(-least * (exponent - 1) // exponent)))
    long = ends - begins >= max(least, exponent)
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return none
    own = np.concatenate([[0], np.cumsum(ends - begins)])
    shift = begins - own[:-1]
    s = Suffixes(words[np.arange(own[-1]) + np.repeat(shift, ends - begins)], own)
    place, period = tandem_repeats(s)
    length = 2 * period + s.back(place, period)
    real = length >= np.maximum(least, exponent * period)
    place, period, length = place[real], period[real], length[real]
    if not len(place):
        return none
    end = place + 2 * period
    start = end - length
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    start, end, period = start[one], end[one], period[one]
    to = shift[np.searchsorted(own, start, "right") - 1]
    by = np.lexsort((period, start))
    return (start + to)[by], (end + to)[by], period[by]


def looped(starts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For the words of documents with a number g (none: negative): the place of the word that stands there when the tail from g % n on repeats
    its first 1 + (n - a) // (3 + g % 8) words."""
    sizes = np.diff(starts)
    at = np.arange(starts[-1])
    for r in np.flatnonzero((number >= 0) & (sizes > 0)):
        n, g = int(sizes[r]), int(number[r])
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[starts[r] + a : starts[r] + n] = starts[r] + a + np.arange(n - a) % p
    return at


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT, loop: Column | None = None) -> DataFrame:
    """One row per row of `df`: key, n_words, runs (array of start, length, period, by start, then period), strongest (the run of the greatest
    length / period) and collapsed: the words joined by one space, without those that stand in a run behind its first period.

    loop: a number for rows whose text is to be given a repeating tail first (see `looped`); null for those taken as they are.
    """
    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType([df.schema[key]]).add("n_words", "long").add("runs", ArrayType(run_type)).add("strongest", run_type).add("collapsed", "string")
    names = schema.fieldNames()

    def described(part: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary, words, sizes = coded(part, "__text", lower=False)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        number = part.column("__loop").fill_null(-1).to_numpy(zero_copy_only=False)
        if (number >= 0).any():
            words = words[looped(starts, number)]
        start, end, period = runs_of(words, starts, least, exponent)
        row = np.searchsorted(starts, start, "right") - 1
        behind = np.zeros(len(words) + 1, np.int64)
        np.add.at(behind, start + period, 1)
        np.add.at(behind, end, -1)
        keep = np.cumsum(behind[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(keep)])[starts]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vocabulary.take(pa.array(words[keep])).cast(pa.string()))
        own = start - starts[row]
        runs = pa.StructArray.from_arrays([pa.array(x) for x in (own, end - start, period)], fields=list(_RUN))
        counts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        best: list[dict | None] = [None] * len(sizes)
        for r in np.unique(row):
            mine = runs[int(counts[r]) : int(counts[r + 1])].to_pylist()
            best[r] = max(mine, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), runs), pa.array(best, _RUN), pc.binary_join(lists, " ")], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "__text"):
                yield described(part)

    return df.select(F.col(key), F.col(text).alias("__text"), (F.lit(None) if loop is None else loop).cast("long").alias("__loop")).mapInArrow(run, schema)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, of which a tenth is given a repeating tail first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs(docs, loop=F.when(crc % 10 == 0, F.floor(crc / 10)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = rf"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k::BIGINT),
      lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x FROM documents
), drawn AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT),
    lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM split, crc_table
), tails AS (
  SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS c FROM drawn
), tokens AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // c) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM tails)
), equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {EXPONENT} * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal)
  GROUP BY doc_id, q, g HAVING count(*) + q >= greatest({LEAST}, {EXPONENT} * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS best FROM runs
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM tokens ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM drawn d LEFT JOIN listed USING (doc_id) LEFT JOIN (FROM ranked WHERE best = 1) r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
