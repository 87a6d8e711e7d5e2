"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. One pass over whole texts makes each document's shingle set, a fingerprint of the whole set, and one-permutation signatures:
   one hash per shingle, bins by its high bits, the least hash of each bin; empty bins borrow from a bin chosen by a fixed
   hash sequence (optimal densification).
2. Equal sets form classes, each represented by its least id; only representatives go on.
3. Bands of the signature are bucket keys. In each bucket every member is paired with the bucket's least id: a star, so that
   pairs grow with members, not with their square.
4. Each candidate pair is compared on the full sets.
5. Components of the confirmed links, by contraction in Spark.
6. Two members of a star may be linked although one of them isn't linked to the hub. What the hub has in common with each, and the
   shingles that it lacks, bound what they can have in common. In a star with at most CROWD open members (not linked to the hub, but
   possibly to another member), pairs that pass this exact bound are compared as well: at most CROWD a member. The members of
   other stars go through 2 to 5 once more with finer bands and other hashes, whose buckets hold little but true duplicates; of
   those smaller stars all pairs within the bound are compared.

A pair at the threshold meets in a bucket with probability 1 - (1 - 0.8^5)^28 > 0.99998, in a finer one with 1 - (1 - 0.8^12)^152 >
0.99997; more similar pairs almost surely. Nothing else is left to chance.

Edge cases: null and empty texts, and texts of white space, have no shingles and link with nothing; texts shorter than a
shingle are one shingle as a whole; repeated rows belong to one component, and each carries it; rows with a null id take their class's component
(null if no row of the class has an id) and are kept only in that last case; rows that share an id but not a text are taken as
linked through the id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from orebody.llm.common import Sieve, coded, discard, materialize, salted_join, text_chunks, texts_of, without

BANDS = 28
ROWS = 5
FINE_BANDS = 152
FINE_ROWS = 12
CROWD = 128
SIMILARITY = 80  # per cent
SHINGLE = 4  # words; the query's contract says four
PACKED = 1 << 20  # bytes of compressed texts that are opened at once

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(part: pa.RecordBatch, text: str, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row of a chunk, the sorted distinct 64-bit hashes of its text's word shingles, A-Z lower-cased."""
    words, codes, lengths = coded(part, text, True)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[codes]
    at = 0
    for n in lengths.tolist():
        h = hashes[at : at + n]
        at += n
        if not n:
            yield np.empty(0, np.uint64)
            continue
        w = min(width, n)
        s = h[: n - w + 1].copy()
        for i in range(1, w):
            s = s * _M1 + h[i : n - w + 1 + i]
        yield np.unique(mix(s + np.uint64(w)))


def unpacked(part: pa.RecordBatch, unpack: Callable[[bytes], bytes]) -> pa.RecordBatch:
    """A chunk of compressed texts in the open, as `text`."""
    return pa.RecordBatch.from_arrays([*part.columns, pa.array([unpack(z) for z in part.column("z").to_pylist()], pa.binary())], [*part.schema.names, "text"])


def ask(t: np.ndarray, i: np.ndarray, bins: int) -> np.ndarray:
    """The bin that empty bin i asks in round t."""
    return (mix(mix(i + np.uint64(1)) + t * _M1) % np.uint64(bins)).astype(np.int64)


def densify_order(bins: int, rounds: int) -> np.ndarray:
    """order[t, i] = ask(t, i), for the first rounds."""
    return ask(*np.meshgrid(np.arange(rounds, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij"), bins)


def signature(shingles: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set, densified."""
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    sig = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    at = place[first].astype(np.int64)
    sig[at], full[at] = shingles[first], True
    if len(at) == 1:
        return np.full(bins, shingles[0])
    empty = np.flatnonzero(~full)
    t = 0
    while len(empty):  # some bin is full, so a random one is hit sooner or later
        asked = order[t, empty] if t < len(order) else ask(np.full(len(empty), t, np.uint64), empty.astype(np.uint64), bins)
        hit = full[asked]
        sig[empty[hit]] = sig[asked[hit]]
        empty = empty[~hit]
        t += 1
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; different bands never share keys by design of the mix."""
    rows = sig.reshape(bands, -1)
    key = mix(np.arange(bands, dtype=np.uint64) + _M1)
    for r in range(rows.shape[1]):
        key = mix(key * _M1 + rows[:, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int, seed: int = 0) -> DataFrame:
    """key, n_shingles, set_key (null for empty sets), bands. Another seed: other permutations. A column `z` holds compressed texts."""
    schema = StructType(list(docs.select(F.col(key).cast("long").alias("id")).schema.fields)).add("n_shingles", LongType()).add("set_key", BinaryType()).add("bands", ArrayType(LongType()))
    packed = text == "z"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, unpack = bands * rows, zstandard.ZstdDecompressor().decompress
        order = densify_order(bins, max(64, 100_000 // bins))
        other = mix(np.full(1, seed, np.uint64))  # 0 for seed 0
        for batch in batches:
            for part in text_chunks(batch, text, *([PACKED] if packed else [])):
                counts, keys, flat = [], [], []
                for s in shingle_sets(unpacked(part, unpack) if packed else part, "text", width):
                    counts.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    flat.append(band_keys(signature(np.sort(mix(s ^ other)) if seed else s, bins, order), bands) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(flat, pa.list_(pa.int64()))], ["id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("z" if packed else "text")).mapInArrow(run, schema)


def _packed(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, z: compressed texts of the ids in `wanted` and a few others, to be shuffled to where their pairs are."""
    shared = Sieve(wanted).shared()
    own = F.col(key).cast("long")
    asked = docs.select(own.alias("id"), F.col(text).alias("text"), F.xxhash64(own).alias("at")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = shared.value, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            few = batch.filter(pa.array(Sieve.places(batch.column("at").to_numpy(), words)))
            for part in text_chunks(few, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([pack(t) for t in texts_of(part, "text")], pa.binary())], ["id", "z"])

    return asked.mapInArrow(run, "id long, z binary")


def compared(pairs: DataFrame, texts: DataFrame, width: int, rest: bool) -> DataFrame:
    """Pairs (hub, member, crowd) with their full sets' sizes and intersection: hub, member, hub_n, n, x, and with `rest` the member's
    shingles that the hub lacks. crowd bounds a hub's members, for its split."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("member"), F.ceil(F.col("crowd") / 128)).cast("int"))
    members = dealt.join(texts, dealt["member"] == texts["id"]).select("hub", "part", F.col("member").alias("other"), "z")
    hubs = dealt.select("hub", "part").distinct().join(texts, F.col("hub") == F.col("id")).select("hub", "part", F.lit(None).cast("long").alias("other"), "z")
    rows = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        own: list[np.ndarray] = []
        now = None
        for batch in batches:
            for chunk in text_chunks(batch, "z", PACKED):
                out: list[tuple] = []
                for hub, part, other, s in zip(*(chunk.column(c).to_pylist() for c in ("hub", "part", "other")), shingle_sets(unpacked(chunk, unpack), "text", width), strict=True):
                    if (hub, part) != now:
                        own, now = [], (hub, part)
                    if other is None:
                        own.append(s)
                        continue
                    for h in own:  # one, unless ids repeat
                        inner = np.isin(s, h, assume_unique=True)
                        out.append((hub, other, len(h), len(s), int(inner.sum()), s[~inner].view(np.int64) if rest else None))
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["hub", "member", "hub_n", "n", "x", "rest"])

    return rows.mapInArrow(run, "hub long, member long, hub_n long, n long, x long, rest array<long>")


def _similar(percent: int) -> Column:
    return F.col("x") * 100 >= (F.col("hub_n") + F.col("n") - F.col("x")) * percent


def _rated(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The members of stars without their `rest`, with their components' roots and whether they are linked to the hub."""
    known = roots.select(F.col("id").alias("member"), "root")
    return stars.drop("rest").join(known, "member", "left").withColumn("root", F.coalesce("root", "member")).withColumn("linked", _similar(percent))


def _placed(stars: DataFrame, percent: int) -> DataFrame:
    """hub, member, at, g: those of a member's shingles that the hub lacks which another member has too and by which it may be found.

    They are ordered, rare ones first: the first that two linked members share must have as many more behind it on both sides as they
    need, so that a frequent shingle late in the order, as copies that lost the same word have, pairs nobody."""
    rest = stars.select("hub", "member", "n", "x", F.explode("rest").alias("g"))
    often = rest.groupBy("hub", "g").agg(F.count("*").alias("often")).filter("often > 1")
    ordered = rest.join(often, ["hub", "g"], "left").groupBy("hub", "member", "n", "x").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "g"))).alias("rest"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100 - 1e-9) - F.col("x"))  # of these, with any partner
    placed = ordered.select("hub", "member", "n", "x", F.posexplode("rest").alias("at", "r")).filter((F.col("r.often") > 1) & (F.col("at") <= F.col("n") - F.col("x") - least))
    return placed.select("hub", "member", "at", F.col("r.g").alias("g"))


def crowded_hubs(rated: DataFrame, placed: DataFrame, percent: int, crowd: int = CROWD) -> DataFrame:
    """The hubs with more than `crowd` open members: not linked, but by size and overlap perhaps linked to another member."""
    first = placed.select("hub", "member").distinct().withColumn("found", F.lit(True))
    unlinked = rated.filter(~F.col("linked")).join(first, ["hub", "member"], "left")
    return unlinked.filter((F.col("x") * 100 >= F.col("n") * percent) | F.col("found")).groupBy("hub").agg(F.count("*").alias("open")).filter(F.col("open") > crowd).select("hub")


def unsettled(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member) of one star, in different components, that may be linked although one of them isn't linked to their hub H.

    A link of O and M needs |O & M| >= percent / (100 + percent) * (|O| + |M|), and |O & M| <= min(|O & H|, |M & H|) + the shingles
    that both have and H lacks. Either the former alone suffices, found by a join on the few lengths of M for which it can; or they
    share `need` of the latter, found by a join on those shingles. No link is lost. The pairs are at most those of unlinked members with
    all members of their star."""
    return within_bound(_rated(stars, roots, percent), materialize(_placed(stars, percent), "placed"), percent)


def within_bound(rated: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """`unsettled` from its two sides."""
    found = placed.join(rated.select("hub", "member", "n", "x", "root", "linked"), ["hub", "member"])
    side = lambda d, k: d.select("hub", *(["g"] if "g" in d.columns else []), F.col("member").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("root").alias(f"r{k}"), *([F.col("at").alias(f"at{k}")] if "at" in d.columns else []), *(["linked"] if k == "m" else []))
    total = F.col("no") + F.col("nm")
    need = F.ceil(total * percent / (100 + percent) - 1e-9) - F.least("xo", "xm")
    apart = (F.col("ro") != F.col("rm")) & (F.col("linked") | (F.col("o") < F.col("m"))) & (F.least("no", "nm") * 100 >= F.greatest("no", "nm") * percent)
    early = (F.col("ato") <= F.col("no") - F.col("xo") - need) & (F.col("atm") <= F.col("nm") - F.col("xm") - need)
    shared = side(found.filter(~F.col("linked")), "o").join(side(found, "m"), ["hub", "g"]).filter(apart & early)
    inside = rated.filter(F.col("x") * 100 >= F.col("n") * percent)  # need <= 0 asks for this on both sides
    o, m = side(inside.filter(~F.col("linked")), "o"), side(inside, "m")
    low, high = F.ceil(F.col("no") * percent / 100 - 1e-9), F.floor(F.col("xo") * (100 + percent) / percent + 1e-9) - F.col("no")
    reach = o.withColumn("high", F.least(high, F.floor(F.col("no") * 100 / percent + 1e-9))).withColumn("low", low).filter("low <= high").withColumn("nm", F.explode(F.sequence("low", "high"))).drop("low", "high")
    inner = reach.join(m, ["hub", "nm"]).filter(apart & (need <= 0))
    both = shared.select("o", "m").union(inner.select("o", "m"))
    return both.select(F.least("o", "m").alias("hub"), F.greatest("o", "m").alias("member")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (u, v): the least id that can be reached. Contraction: each round links every node
    to its least neighbour, follows the links to their ends, and puts the ends in the edges' places. Joins are salted, as one root
    may own a third of all nodes."""
    left = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = materialize(left.select(F.col("u").alias("id")).union(left.select("v")).distinct().select("id", F.col("id").alias("root")), "roots")
    while not left.isEmpty():
        up = materialize(left.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("to")), "up")
        while True:  # after each doubling a node stands twice as high
            above = up.select(F.col("id").alias("to"), F.col("to").alias("higher"))
            jumped = materialize(salted_join(up, above, ["to"], "left", salts=4, by=["id"]).select("id", F.coalesce("higher", "to").alias("next"), F.col("higher").isNotNull().alias("moved")), "up")
            moved = not jumped.filter("moved").isEmpty()
            up = jumped.select("id", F.col("next").alias("to"))
            if not moved:
                break
        before, edged = nodes, left
        nodes = materialize(salted_join(nodes, up.select(F.col("id").alias("root"), "to"), ["root"], "left", salts=4, by=["id"]).select("id", F.coalesce("to", "root").alias("root")), "roots")
        a = salted_join(left, up.select(F.col("id").alias("u"), F.col("to").alias("a")), ["u"], "left", salts=4, by=["v"]).select(F.coalesce("a", "u").alias("u"), "v")
        b = salted_join(a, up.select(F.col("id").alias("v"), F.col("to").alias("b")), ["v"], "left", salts=4, by=["u"]).select("u", F.coalesce("b", "v").alias("v"))
        left = materialize(b.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(before, edged)
    return nodes


def star_pairs(reps: DataFrame) -> DataFrame:
    """(hub, member, crowd) from rep and bands: every member of a bucket with the bucket's least rep. Only rows of buckets with two
    members or more are shuffled for the join, but for few others."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    least = materialize(rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("crowd")).filter("crowd > 1"), "buckets")
    shared = Sieve(least.select("bucket")).shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            may = Sieve.places(batch.column("at").to_numpy(), words)
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(may)), batch.column("bucket").filter(pa.array(may))], ["rep", "bucket"])

    met = rows.withColumn("at", F.xxhash64("bucket")).mapInArrow(run, "rep long, bucket long")
    stars = salted_join(met, least, ["bucket"], salts=4, by=["rep"])
    pairs = stars.filter(F.col("rep") != F.col("hub")).groupBy("hub", F.col("rep").alias("member")).agg(F.max("crowd").alias("crowd"))
    out = materialize(pairs, "pairs")
    discard(least)
    return out


def _as_links(rated: DataFrame, percent: int) -> DataFrame:
    return rated.filter(_similar(percent)).select(F.col("hub").alias("u"), F.col("member").alias("v"))


def _compared_more(more: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among further pairs (hub, member)."""
    crowds = more.groupBy("hub").agg(F.count("*").alias("crowd"))
    found = compared(salted_join(more, crowds, ["hub"], salts=4, by=["member"]).select("hub", "member", "crowd"), texts, width, False)
    return _as_links(found, percent)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, crowd: int = CROWD) -> DataFrame:
    """One row per row of `docs`: key (as long), n_shingles, component_id, kept."""
    signed = materialize(signatures(docs, key, text, width, bands, rows), "signatures")
    real = signed.filter("id is not null and set_key is not null")
    best = real.groupBy("set_key").agg(F.min(F.struct("id", "bands")).alias("m"))
    reps = materialize(best.select("set_key", F.col("m.id").alias("rep"), F.col("m.bands").alias("bands")), "reps")
    sets = materialize(signed.select("id", "n_shingles", "set_key"), "sets")
    owners = materialize(reps.select("set_key", "rep"), "owners")
    discard(signed)

    pairs = star_pairs(reps)
    discard(reps)
    wanted = pairs.select(F.col("hub").alias("id")).union(pairs.select("member")).distinct()
    texts = materialize(_packed(docs, key, text, wanted), "texts")  # once, for all rounds: later ones have members of the first only
    stars = materialize(compared(pairs, texts, width, True), "stars")
    links = _as_links(stars, percent)
    roots = components(links)
    rated, placed = materialize(_rated(stars, roots, percent), "rated"), materialize(_placed(stars, percent), "placed")
    discard(stars)
    full = materialize(crowded_hubs(rated, placed, percent, crowd), "crowded")
    links = materialize(rated.filter("linked").select(F.col("hub").alias("u"), F.col("member").alias("v")), "links")
    more = materialize(within_bound(rated.join(full, "hub", "left_anti"), placed.join(full, "hub", "left_anti"), percent).join(pairs, ["hub", "member"], "left_anti"), "unsettled")
    if not more.isEmpty():
        links = links.unionByName(materialize(_compared_more(more, texts, width, percent), "links"))
    if not full.isEmpty():
        again = rated.join(full, "hub", "left_semi").select(F.col("member").alias("id")).union(full).distinct()
        links = links.unionByName(materialize(_finer(texts, again, pairs, links, width, percent), "links"))
    if not (more.isEmpty() and full.isEmpty()):
        roots = components(links)
    discard(rated, placed, texts)

    classes = owners.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    out = salted_join(sets, classes, ["set_key"], "left", by=["id"])
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _finer(texts: DataFrame, ids: DataFrame, pairs: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the texts of `ids`, by finer bands; pairs that have been compared already aren't again."""
    signed = signatures(texts.join(ids, "id", "left_semi"), "id", "z", width, FINE_BANDS, FINE_ROWS, seed=1)
    fine = star_pairs(materialize(signed.filter("set_key is not null").select(F.col("id").alias("rep"), "bands"), "finer"))
    stars = materialize(compared(fine, texts, width, True), "stars")
    found = materialize(_as_links(stars, percent), "links")
    more = unsettled(stars, components(links.unionByName(found)), percent)
    more = materialize(more.join(fine, ["hub", "member"], "left_anti").join(pairs, ["hub", "member"], "left_anti"), "unsettled")
    return found if more.isEmpty() else found.unionByName(_compared_more(more, texts, width, percent))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words
), sizes AS (SELECT doc_id, len(g) AS n FROM sets), flat AS (SELECT doc_id, unnest(g) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT a AS doc_id, n::BIGINT AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach JOIN sizes ON doc_id = a GROUP BY a, n
"""


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays. Rows without an id stay.

    Shingles have five words here, as stages on word shingles have unless a contract says otherwise; the query's contract says four."""
    gone = materialize(near_duplicates(docs, width=5).filter("not kept").select("doc_id").distinct(), "copies")
    return without(docs, gone).select(*docs.columns)
