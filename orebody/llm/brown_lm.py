"""LM scoring with Brown class-based bigrams.

Words are counted over the whole training part. The most frequent words and the suffix groups of all other words are the
items of an exchange clustering: each item in turn moves to the class that most raises the likelihood of the class bigrams,
until a sweep moves none. Then every other word with at least PLACED training tokens becomes an item as well: Spark counts the
classes to the left and right of each, and each moves to its best class by the same gain, all at once, in ROUNDS rounds with the
class table counted anew. Only rarer words stay in their groups, which move along. The model is

    P(w | v) = P(class(w) | class(v)) * P(item(w) | class(w)) * P(w | item(w)),

with class transitions drawn towards the class unigrams, items smoothed by an added constant, and words of a suffix group
smoothed likewise with one place for unseen words (a word that is an item has P(w | item) = 1). Perplexity is 10 ** (-score / n_tokens).

Counts are made on all training rows. Only the item bigrams ((HEAD + GROUPS + 1)^2 at most), about LOOKUP of the most frequent words and a
64-bit hash and a class for each placed word (9 bytes) come to the driver; the counts of all rarer words are joined to the texts
in Spark. Texts are cut into words and coded a chunk at a time by Arrow; only a chunk's different words are looked up. The training
texts' items are written once, four bytes a token, and the passes that count classes read these.

Edge cases: null and empty texts are one end token; without training rows every count is 0 and the scores are those of the smoothing
alone; rows with a null id are held in the training part and scored; rows that agree in id and text are scored once and
repeated in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import coded, discard, materialize, text_chunks, texts_of

HEAD = 1000
GROUPS = 128
CLASSES = 64
LOOKUP = 200_000
CHUNK = 6 << 20  # bytes of text that are coded at once
PIECE = 200_000  # items in a row of coded texts, but for longer texts
PLACED = 10  # training tokens from which a word has a class of its own choice
ROUNDS = 2
HELD = 1_000_000  # tokens whose neighbours are held before they are passed on
DRAWN = 4.0  # strength of the class unigrams in the transitions
ADDED = 0.5
ITEMS = HEAD + GROUPS + 1
END = ITEMS - 1


def in_training(key: str = "doc_id") -> Column:
    """All rows but those whose id's crc32 as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def suffix_group(word: bytes) -> int:
    """The group of a word by its last two bytes."""
    return zlib.crc32(word[-2:]) % GROUPS


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), grp, c: over all texts, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text, CHUNK):
                words, codes, _ = coded(part, text, True)
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(list(map(suffix_group, words.to_pylist())), pa.int32()), pa.array(n, pa.int64())], ["word", "grp", "n"])

    return docs.select(text).mapInArrow(run, "word binary, grp int, n long").groupBy("word", "grp").agg(F.sum("n").alias("c"))


def _summed(counted: DataFrame, side: int) -> np.ndarray:
    """A square table from rows (pair, n)."""
    total = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # side^2 rows at most
    out = np.zeros(side * side)
    out[total.column("pair").to_numpy()] = total.column("n").to_numpy()
    return out.reshape(side, side)


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def coded_lines(docs: DataFrame, head: list[bytes], keys: np.ndarray, text: str = "text") -> DataFrame:
    """line: the items of a run of texts as 32-bit numbers, with END before, between and after the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((head, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in batches:
            for part in text_chunks(batch, text, CHUNK):
                words, codes, lengths = coded(part, text, True)
                line = _between(items.of(words.to_pylist())[codes], lengths).astype(np.int32)
                ends = np.flatnonzero(line == END)
                cuts = np.unique(ends[np.searchsorted(ends, np.arange(0, len(line), PIECE))])
                cuts = np.append(cuts, len(line) - 1) if cuts[-1] != len(line) - 1 else cuts
                pieces = [line[a : b + 1].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["line"])

    return docs.select(text).mapInArrow(run, "line binary")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for v in batch.column(0):
            yield np.frombuffer(v.as_buffer(), np.int32).astype(np.int64)


def item_bigrams(lines: DataFrame, key_group: np.ndarray) -> np.ndarray:
    """How often item b follows item a over all texts, with placed words in their groups; every text ends in END and follows one."""
    shared = lines.sparkSession.sparkContext.broadcast(np.concatenate([np.arange(ITEMS), HEAD + key_group.astype(np.int64)]).astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for x in _lines(batches):
            x = place[x].astype(np.int64)
            total += np.bincount(x[:-1] * ITEMS + x[1:], minlength=ITEMS * ITEMS)
        yield _sparse(total)

    return _summed(lines.select("line").mapInArrow(run, "pair long, n long"), ITEMS)


class Items:
    """Words to items: a place in the head, HEAD + group, or ITEMS + the place of the word's hash in `keys`."""

    def __init__(self, head: list[bytes], keys: np.ndarray) -> None:
        self.head, self.keys = dict(zip(head, range(len(head)), strict=True)), keys

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.head.get, words, repeat(-1)), np.int64, len(words))
        left = np.flatnonzero(out < 0)
        if not len(left):
            return out
        other = [words[i] for i in left.tolist()]
        h = np.fromiter(map(xxhash.xxh64_intdigest, other, repeat(42)), np.uint64, len(other)).view(np.int64)
        at = np.searchsorted(self.keys, h)
        placed = np.zeros(len(other), bool)
        inside = at < len(self.keys)
        placed[inside] = self.keys[at[inside]] == h[inside]
        found = ITEMS + at
        found[~placed] = [HEAD + suffix_group(other[i]) for i in np.flatnonzero(~placed).tolist()]
        out[left] = found
        return out


def word_key(word: bytes) -> int:
    """The same number as Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def _between(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The items of rows with END before, between and after the rows."""
    out = np.full(len(x) + len(lengths) + 1, END, np.int64)
    out[np.arange(len(x)) + 1 + np.repeat(np.arange(len(lengths)), lengths)] = x
    return out


def class_bigrams(lines: DataFrame, cls: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """How often class b follows class a over all texts."""
    shared = lines.sparkSession.sparkContext.broadcast(cls.astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        total = np.zeros(classes * classes, np.int64)
        for x in _lines(batches):
            k = cls[x].astype(np.int64)
            total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        yield _sparse(total)

    return _summed(lines.select("line").mapInArrow(run, "pair long, n long"), classes)


def neighbour_classes(lines: DataFrame, cls: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """item, seen: for groups and placed words, one byte for the class to the left and one for that to the right of each token, `classes`
    standing for the item itself; those to the right have classes + 1 added. An item has a row for each lot of about HELD tokens. Rows with
    a null item hold the class bigrams of a part of the texts, as classes^2 64-bit numbers."""
    shared = lines.sparkSession.sparkContext.broadcast(cls.astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            at = np.flatnonzero((x >= HEAD) & (x != END))  # the first and last are END
            at = at[np.argsort(x[at], kind="stable")]
            k = x[at]
            seen = np.empty((len(at), 2), np.uint8)
            seen[:, 0] = np.where(x[at - 1] == k, classes, cls[x[at - 1]])
            seen[:, 1] = np.where(x[at + 1] == k, classes, cls[x[at + 1]]) + classes + 1
            first = np.flatnonzero(np.diff(k, prepend=-1))
            offsets = np.append(2 * first, seen.size).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(seen.tobytes())])], ["item", "seen"])

        n = 0
        total = np.zeros(classes * classes, np.int64)
        for x in _lines(batches):
            held.append(x)
            n += len(x)
            k = cls[x].astype(np.int64)
            total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
            if n > HELD:
                yield out()
                n = 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["item", "seen"])

    return lines.select("line").mapInArrow(run, "item long, seen binary")


def moves(seen: DataFrame, cls: np.ndarray, table: np.ndarray, fixed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The items of `seen` that gain by another class under `table`, and those classes."""
    classes = len(table)
    shared = seen.sparkSession.sparkContext.broadcast((cls.astype(np.uint8), table))
    width = 2 * (classes + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, table = shared.value
        last, last_n = -1, np.zeros(width, np.int64)  # the rows of an item stand together, maybe over two batches

        def best(own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            n = n.astype(float)
            to = [choose_many(table, cls[own[i : i + 512]].astype(np.int64), n[i : i + 512, classes + 1 : -1], n[i : i + 512, :classes], n[i : i + 512, classes], fixed) for i in range(0, len(own), 512)]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([np.zeros(0, np.int64), *to]).astype(np.int32))], ["item", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("seen")
            own, which = np.unique(batch.column("item").to_numpy(), return_inverse=True)
            at = np.repeat(which * width, pc.binary_length(lists).to_numpy(zero_copy_only=False)) + np.frombuffer(b"".join(lists.to_pylist()), np.uint8)
            n = np.bincount(at, minlength=len(own) * width).reshape(-1, width)
            if own[0] == last:
                n[0] += last_n
            elif last >= 0:
                own, n = np.insert(own, 0, last), np.insert(n, 0, last_n, axis=0)
            last, last_n = int(own[-1]), n[-1].copy()
            yield best(own[:-1], n[:-1])
        if last >= 0:
            yield best(np.array([last]), last_n[None])

    found = seen.repartition("item").sortWithinPartitions("item").mapInArrow(run, "item long, cls int").toArrow()  # two numbers for each item
    item, to = found.column("item").to_numpy(), found.column("cls").to_numpy()
    moved = cls[item] != to
    return item[moved], to[moved]


def _table_of(seen: DataFrame, classes: int) -> np.ndarray:
    """The class bigrams that `neighbour_classes` counted besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v, np.int64)
        yield _sparse(total)

    return _summed(seen.filter("item is null").select("seen").mapInArrow(run, "pair long, n long"), classes)


def place_words(lines: DataFrame, cls: np.ndarray, table: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all items after the placed words and the groups have chosen theirs, and the class bigrams. `cls` gives the start
    and `table` its class bigrams. One pass over the coded texts a round, and one for the last table."""
    moved = False
    for i in range(rounds if len(cls) > ITEMS else 0):
        seen = materialize(neighbour_classes(lines, cls), "neighbours")
        table = _table_of(seen, len(table)) if i else table
        item, to = moves(seen.filter("item is not null"), cls, table)
        discard(seen)
        moved = len(item) > 0
        if not moved:
            break
        cls = cls.copy()
        cls[item] = to
    return cls, class_bigrams(lines, cls) if moved else table


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1e-300))


def choose(table: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, self_: float, fixed: int = 1) -> int:
    """The class in which an item of class `a` makes the class bigrams likeliest. right, left: how often other items of each class
    follow and precede it; self_: how often it follows itself. `table` holds the item."""
    table = table.copy()
    table[a, :] -= right  # take it out of its class
    table[:, a] -= left
    table[a, a] -= self_
    gain = gains(table, right, left, self_)
    gain[len(table) - fixed :] = -np.inf
    b = int(np.argmax(gain))
    return a if gain[b] <= gain[a] + 1e-9 else b


def _part(table: np.ndarray, own: np.ndarray, cls: np.ndarray, added: np.ndarray, other: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """For each item and class, the gain of one side's cells: `added` (item by class) on top of the columns of `table`, from which the
    item has been taken; `other` is what it has on the other side."""
    out = np.zeros(added.shape)
    item, c = np.nonzero(added)
    if not len(item):
        return out
    cells, a = table.T[c], cls[item]
    each = np.arange(len(item))
    before = own.T[c]
    cells[each, a] -= added[item, c]
    back = np.flatnonzero(c == a)  # these columns hold the item's other side as well
    cells[back] -= other[item[back]]
    cells[back, a[back]] -= self_[item[back]]
    before[each, a] = _xlogx(cells[each, a])
    before[back] = _xlogx(cells[back])
    gain = _xlogx(cells + added[item, c][:, None]) - before
    first = np.flatnonzero(np.diff(item, prepend=-1))
    out[item[first]] = np.add.reduceat(gain, first)
    return out


def choose_many(table: np.ndarray, cls: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray, fixed: int = 1) -> np.ndarray:
    """`choose` for many items, each on its own against the same table."""
    n, each = len(cls), np.arange(len(cls))
    logs = _xlogx(table)
    gain = _part(table, logs, cls, right, left, self_) + _part(table.T, logs.T, cls, left, right, self_)
    row = np.repeat(table.sum(axis=1)[None], n, axis=0)  # without the item, but for what its neighbours have with it
    col = np.repeat(table.sum(axis=0)[None], n, axis=0)
    d = np.repeat(np.diag(table)[None], n, axis=0)
    out_n, in_n = right.sum(axis=1) + self_, left.sum(axis=1) + self_
    row[each, cls] -= out_n
    col[each, cls] -= in_n
    d[each, cls] -= right[each, cls] + left[each, cls] + self_
    gain += _xlogx(d + right + left + self_[:, None]) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    gain -= _xlogx(row + out_n[:, None]) - _xlogx(row) + _xlogx(col + in_n[:, None]) - _xlogx(col)
    gain[:, len(table) - fixed :] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where(gain[each, best] <= gain[each, cls] + 1e-9, cls, best)


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, self_: float) -> np.ndarray:
    """For each class, the gain in sum of n log n over cells, less that over margins, of putting an item into it that `table` lacks."""
    row, col = table.sum(axis=1) + left, table.sum(axis=0) + right  # the other items' own totals, with their bigrams with it
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    gain = (_xlogx(table[:, r] + right[r]) - _xlogx(table[:, r])).sum(axis=1) + (_xlogx(table[c] + left[c, None]) - _xlogx(table[c])).sum(axis=0)
    d = np.diag(table)
    gain += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    out_n, in_n = right.sum() + self_, left.sum() + self_
    return gain - (_xlogx(row + out_n) - _xlogx(row) + _xlogx(col + in_n) - _xlogx(col))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int | None = None, fixed: int = 1) -> np.ndarray:
    """The class of each item. At the start the most frequent items have classes of their own and all others share one; the last
    `fixed` items keep classes of their own. Each move raises the likelihood, so that sweeps without end come to one that moves none."""
    m = len(bigrams)
    free = m - fixed
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    cls = np.empty(m, np.int64)
    order = np.argsort(-weight[:free], kind="stable")
    cls[order] = np.minimum(np.arange(free), classes - fixed - 1)
    cls[free:] = classes - fixed + np.arange(fixed)
    one = np.zeros((m, classes))
    one[np.arange(m), cls] = 1
    to = bigrams @ one  # item -> class
    of = bigrams.T @ one  # class -> item, by item
    table = one.T @ to
    moved, sweep = 1, 0
    while moved and sweep != sweeps:
        moved, sweep = 0, sweep + 1
        for w in order:
            if not weight[w]:
                continue
            a, self_ = cls[w], bigrams[w, w]
            right, left = to[w].copy(), of[w].copy()
            right[a] -= self_
            left[a] -= self_
            table[a, :] -= right  # take w out of its class
            table[:, a] -= left
            table[a, a] -= self_
            gain = gains(table, right, left, self_)
            gain[classes - fixed :] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += right
            table[:, b] += left
            table[b, b] += self_
            if b != a:
                cls[w], moved = b, moved + 1
                to[:, a] -= bigrams[:, w]
                to[:, b] += bigrams[:, w]
                of[:, a] -= bigrams[w, :]
                of[:, b] += bigrams[w, :]
    return cls


@dataclass
class ClassModel:
    cls: np.ndarray  # of each item
    transition: np.ndarray  # log10 P(class | class)
    item: np.ndarray  # log10 P(item | class)
    scale: np.ndarray  # log10 of the smoothed tokens of each class
    group_n: np.ndarray  # training tokens in each suffix group
    group_v: np.ndarray  # different words there


def build(bigrams: np.ndarray, group_n: np.ndarray, group_v: np.ndarray, classes: int = CLASSES) -> ClassModel:
    """The model without placed words."""
    cls = exchange(bigrams, classes)
    one = np.zeros((ITEMS, classes))
    one[np.arange(ITEMS), cls] = 1
    return model_of(cls, one.T @ bigrams @ one, bigrams.sum(axis=0), group_n, group_v)


def model_of(cls: np.ndarray, table: np.ndarray, item_n: np.ndarray, group_n: np.ndarray, group_v: np.ndarray) -> ClassModel:
    """The model of given classes. item_n: the training tokens of the items that aren't placed words; those of the placed words are
    what `table` has besides."""
    classes = len(table)
    unigram = (table.sum(axis=0) + ADDED) / (table.sum() + ADDED * classes)
    transition = np.log10((table + DRAWN * unigram) / (table.sum(axis=1, keepdims=True) + DRAWN))
    scale = np.log10(np.maximum(table.sum(axis=0) + ADDED * np.bincount(cls, minlength=classes), 1e-300))  # an empty class has no item to scale
    item = np.log10(item_n + ADDED) - scale[cls[:ITEMS]]
    return ClassModel(cls, transition, item, scale, group_n, group_v)


@dataclass
class Trained:
    """What training leaves: the counted words (a table), sizes, the words that are looked up with their counts, and the model."""

    counts: DataFrame
    total: int  # tokens, ends included
    distinct: int  # different tokens, the end included
    ends: int
    ranked: list[bytes]  # by falling counts; the first HEAD are the head
    rank_c: np.ndarray
    keys: np.ndarray  # hashes of the placed words
    model: ClassModel


def train_model(train: DataFrame, text: str = "text") -> Trained:
    """Counts, classes and smoothed probabilities of the texts of `train`."""
    counts = materialize(word_counts(train, text), "words")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    total, distinct = size[0] + ends, size[1] + (ends > 0)
    head_rows = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    step = F.floor(F.log2("c") * 16)
    above, least = 0, None  # the words of the highest steps that together are LOOKUP at most
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # 16 rows a doubling of the counts
        above += r["count"]
        if above > LOOKUP:
            break
        least = r.s
    looked = {bytes(r.word): r.c for r in head_rows}
    if least is not None:
        top = counts.filter(step >= least).select("word", "c").toArrow()  # LOOKUP at most
        looked |= dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    ranked = sorted(looked, key=lambda w: (-looked[w], w))
    rank_c = np.array([looked[w] for w in ranked], np.float64)
    head = ranked[:HEAD]
    often = counts.filter(F.col("c") >= PLACED).select(F.xxhash64("word").alias("k"), F.col("grp").cast("tinyint")).toArrow()  # 9 bytes for each placed word
    keys, first = np.unique(often.column("k").to_numpy(), return_index=True)
    own = ~np.isin(keys, np.array([word_key(w) for w in head], np.int64))
    keys, key_group = keys[own], often.column("grp").to_numpy()[first[own]]
    per_group = counts.filter(F.col("c") < PLACED).groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # GROUPS rows
    group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in per_group:
        group_n[r.grp], group_v[r.grp] = r.n, r.v
    for w, c in zip(head, rank_c[:HEAD], strict=True):  # the head's words are items of their own, however rare
        if c < PLACED:
            g = suffix_group(w)
            group_n[g] -= c
            group_v[g] -= 1
    lines = materialize(coded_lines(train, head, keys, text), "lines")
    bigrams = item_bigrams(lines, key_group)
    cls = exchange(bigrams)
    one = np.zeros((ITEMS, CLASSES))
    one[np.arange(ITEMS), cls] = 1
    cls = np.concatenate([cls, cls[HEAD + key_group.astype(np.int64)]])  # each word starts in the class of its group
    cls, table = place_words(lines, cls, one.T @ bigrams @ one)
    discard(lines)
    item_n = np.zeros(ITEMS)
    item_n[: len(head)], item_n[HEAD:END], item_n[END] = rank_c[: len(head)], group_n, ends
    return Trained(counts, int(total), int(distinct), int(ends), ranked, rank_c, keys, model_of(cls, table, item_n, group_n, group_v))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    m = train_model(docs.select(key, text).filter(in_training(key)), text)
    counts, total, ends, model = m.counts, m.total, m.ends, m.model
    scale = np.log10(total + m.distinct + 1)
    base = np.append(np.log10(m.rank_c + 1) - scale, -scale)  # the last: of a word that isn't looked up, without its count
    word = np.array([0.0 if i < HEAD else np.log10(c + ADDED) for i, c in enumerate(m.rank_c)] + [0.0])  # the head's counts stand in model.item
    inner = np.append(model.item, 0.0)  # of an item, and of any placed word
    inner[HEAD:END] -= np.log10(model.group_n + ADDED * (model.group_v + 1))
    end_base = float(np.log10(ends + 1) - scale)
    shared = spark.sparkContext.broadcast((m.ranked, base, word, model.transition, model.scale, model.cls.astype(np.uint8), inner, m.keys))  # LOOKUP words, some arrays of that length and 9 bytes for each placed word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, base, word, transition, class_scale, cls, inner, keys = shared.value
        ranks, items = dict(zip(ranked, range(len(ranked)), strict=True)), Items(ranked[:HEAD], keys)
        for batch in batches:
            for part in text_chunks(batch, text, CHUNK):
                words, codes, lengths = coded(part, text, True)
                listed = words.to_pylist()
                rank = np.fromiter(map(ranks.get, listed, repeat(-1)), np.int64, len(listed))
                line = _between(items.of(listed)[codes], lengths)
                k = cls[line]
                to = line[1:]
                terms = transition[k[:-1], k[1:]] + inner[np.minimum(to, ITEMS)] - np.where(to >= ITEMS, class_scale[k[1:]], 0.0)
                is_word = np.ones(len(to), bool)
                is_word[np.cumsum(lengths + 1) - 1] = False  # each row's own end
                r = rank[codes]
                terms[is_word] += word[r]
                plain = np.full(len(to), end_base)
                plain[is_word] = base[r]
                first = np.cumsum(lengths + 1) - lengths - 1
                row = np.repeat(np.arange(len(lengths)), lengths)
                rare, rare_n = np.unique(row[r < 0] * len(listed) + codes[r < 0], return_counts=True)
                offsets = np.searchsorted(rare, np.arange(len(lengths) + 1) * len(listed)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), values)  # noqa: E731, B023
                known = np.bincount(row[r >= 0], minlength=len(lengths)) + (ends > 0)
                columns = [
                    part.column(key), pa.array(list(map(xxhash.xxh3_128_digest, texts_of(part, text))), pa.binary()), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(np.add.reduceat(plain, first)),
                    pa.array(np.add.reduceat(terms, first)), lists(words.take(pa.array(rare % max(1, len(listed))))), lists(pa.array(rare_n.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "h", "n_tokens", "n_known", "b", "s", "rare", "rare_n"])

    kind = docs.schema[key].dataType.simpleString()
    scored = materialize(docs.select(key, text).mapInArrow(run, f"{key} {kind}, h binary, n_tokens long, n_known long, b double, s double, rare array<binary>, rare_n array<long>"), "scored")
    # words beyond the lookup: their counts come by a join; the terms of a text add up to what it lacks
    rare = scored.dropDuplicates([key, "h"]).select(key, "h", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(key, "h", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    joined = rare.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    terms = joined.groupBy(key, "h").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tb"), F.sum(F.col("n") * F.log10(F.col("c") + ADDED)).alias("ts"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tk"))
    mine = scored.drop("rare", "rare_n").withColumnRenamed(key, "_k")
    out = mine.join(terms, F.col("_k").eqNullSafe(F.col(key)) & (mine["h"] == terms["h"]), "left")
    value = F.col("s") + F.coalesce("ts", F.lit(0.0))
    return out.select(
        F.col("_k").alias(key), (~in_training("_k")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("tk", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("tb", F.lit(0.0))).alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under class bigrams, beside the unigram base."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
