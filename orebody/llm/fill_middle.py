"""Fill-in-middle: texts cut in three at counted units and set in another order around sentinels.

The cuts of a whole Arrow batch are found at once on its UTF-8 buffer: a lookup gives each byte its class, a table over adjacent bytes says
where units begin, a cumulative sum counts the units from each document's own start, and one binary search in it turns the counts of all rows
into byte places. Prefix, middle and suffix are then slices of the same buffer.

Edge cases: null and empty texts stay plain and empty; a text that holds a sentinel stays plain; a null key draws like an empty one; repeated
rows are treated alike; a cut may fall at either end, so that pieces may be empty; an empty table gives no rows; other columns pass through,
and those named like a new column are replaced. A text is never split among tasks: beside it, its task holds five bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import text_chunks

SEED = 1
RATE = 90  # of 100 texts are cut
SPM = 20  # of 100 cut texts begin with the suffix
SENTINELS = ("<P>", "<S>", "<M>")

_INSIDE, _SPACE, _BREAK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _INSIDE  # of a code point, after its first byte
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x0A] = _BREAK


def _begins(unit: str) -> np.ndarray:
    """For the classes of two adjacent bytes (4 * first + second): whether a unit begins with the second."""
    first, second = np.divmod(np.arange(16), 4)
    space = (first == _SPACE) | (first == _BREAK)
    return {"chars": second != _INSIDE, "words": space & (second == _OTHER), "lines": first == _BREAK}[unit]


def unit_sums(data: np.ndarray, starts: np.ndarray, unit: str = "chars") -> np.ndarray:
    """For each byte of documents that lie one after another: the units that have begun up to it. Each document's first byte begins one."""
    kinds = _CLASS[data]
    mask = np.empty(len(data), bool)
    mask[:1] = True
    mask[1:] = _begins(unit)[(kinds[:-1] << 2) | kinds[1:]]
    mask[starts[starts < len(data)]] = True
    return np.cumsum(mask, dtype=np.int32 if len(data) < 1 << 31 else np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str = "chars") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents data[offsets[r]:offsets[r+1]]: the units, the cuts in units, and the cuts in bytes of `data`. draws: two numbers a row, of
    which each is taken modulo the units + 1."""
    sums = unit_sums(data, offsets[:-1][np.diff(offsets) > 0], unit)
    before = np.concatenate([np.zeros(1, sums.dtype), sums])[offsets].astype(np.int64)
    units = np.diff(before)
    at = np.sort(draws % (units[:, None] + 1), axis=1)
    places = np.searchsorted(sums, (before[:-1, None] + at + 1).ravel().astype(sums.dtype), "left").reshape(at.shape)
    return units, at, np.minimum(places, offsets[1:, None])


def _cut_batch(column: pa.Array, form: pa.Array, draws: np.ndarray, unit: str) -> tuple[pa.Array, ...]:
    """units, prefix units, middle units, output."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
    own = offsets - offsets[0]
    units, at, places = cuts(data, own, draws, unit)
    thirds = np.append(np.column_stack([own[:-1], places]).ravel(), own[-1]) + offsets[0]
    pieces = pa.LargeStringArray.from_buffers(3 * len(column), pa.py_buffer(thirds), body)
    prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, 3 * len(column), 3))) for k in range(3))
    p, s, m = (pa.scalar(x, pa.large_string()) for x in SENTINELS)
    nothing = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    output = pc.if_else(pc.equal(form, "plain"), column, pc.if_else(pc.equal(form, "spm"), spm, psm))
    cut = pc.not_equal(form, "plain").to_numpy(zero_copy_only=False)
    return pa.array(units), pa.array(at[:, 0], mask=~cut), pa.array(at[:, 1] - at[:, 0], mask=~cut), output.cast(pa.string())


def draw(key: str, seed: int, which: int) -> Column:
    """One of eight 32-bit numbers that a seed and a key decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "chars") -> DataFrame:
    """`df` with units, form (plain, psm or spm), prefix_units, middle_units (null if plain) and output.

    unit: chars (code points), words (each with the white space behind it) or lines. The cuts depend on seed, key and the units alone.
    """
    new = ("form", "units", "prefix_units", "middle_units", "output")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = body.contains(SENTINELS[0]) | body.contains(SENTINELS[1]) | body.contains(SENTINELS[2])
    form = F.when((body == "") | marked | (draw(key, seed, 2) % 100 >= rate), "plain").when(draw(key, seed, 3) % 100 < spm, "spm").otherwise("psm")
    rest = [c for c in df.columns if c not in new]
    rows = df.select(*[f"`{c}`" for c in rest], draw(key, seed, 0).alias("__first"), draw(key, seed, 1).alias("__second"), form.alias("form"))
    schema = df.select(*[f"`{c}`" for c in rest]).schema.add("form", "string").add("units", "long").add("prefix_units", "long").add("middle_units", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                draws = np.column_stack([part.column(c).to_numpy() for c in ("__first", "__second")])
                made = _cut_batch(part.column(text), part.column("form"), draws, unit)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], part.column("form"), *made], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that was cut: no cut text holds a sentinel, so the three found in the output are those set in."""
    parts = F.split(F.col(output), "<[PSM]>")
    third = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(third(1), third(3), third(2))).when(F.col(form) == "spm", F.concat(third(2), third(3), third(1))).otherwise(F.col(output))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at code points, its output's digest and that of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


OP12_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), numbered AS (
  SELECT doc_id, t, n, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS u, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS v,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(s, 17, 8))::BIGINT % 100 >= {RATE} THEN 'plain'
      WHEN ('0x' || substr(s, 25, 8))::BIGINT % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substr(t, 1, least(u, v)) AS prefix, substr(t, least(u, v) + 1, greatest(u, v) - least(u, v)) AS middle, substr(t, greatest(u, v) + 1) AS suffix FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(u, v) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(u, v) - least(u, v) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
