"""Text sources: debug symbols, sections, system maps, configurations, allocation logs and traces, signatures (SRC1-SRC5, SRC11-SRC14).

Lines that a format doesn't know are skipped, as are empty files; malformed numbers give no row. A file's lines keep their order where
a record has several lines: those are numbered inside their file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.operators.store import cut


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: line, file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def hex_address(digits: Column) -> Column:
    """Up to 16 hex digits as the long with those bits."""
    padded = F.lpad(digits, 16, "0")
    half = lambda a: F.conv(F.substring(padded, a, 8), 16, 10).cast("bigint")
    return F.when(F.length(digits) <= 16, F.call_function("shiftleft", half(1), F.lit(32)).bitwiseOR(half(9)))


def system_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: address, type (one letter), name: three words parted by white space, the last with all that follows."""
    words = lines(spark, path).select(F.split(F.trim(F.translate("line", "\t\r", "  ")), " +", 3).alias("w"))
    real = words.filter((F.size("w") == 3) & (F.length(F.col("w")[1]) == 1) & (F.length(F.translate(F.lower(F.col("w")[0]), "0123456789abcdef", "")) == 0))
    return real.select(hex_address(F.col("w")[0]).alias("address"), F.col("w")[1].alias("type"), F.col("w")[2].alias("name")).filter("address is not null and name <> ''")


def kernel_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: key, value of set options."""
    pattern = r"^\s*(CONFIG_\w+)\s*=\s*(.*?)\s*$"
    return lines(spark, path).filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: constants of a probed system as key and value: numbers may be decimal or hexadecimal."""
    pattern = r"^\s*([A-Za-z_]\w*)\s*[=:]\s*(\S.*?)\s*$"
    found = lines(spark, path).filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    number = F.when(F.col("value").rlike("^0[xX][0-9a-fA-F]+$"), hex_address(F.substring("value", 3, 16))).otherwise(F.col("value").try_cast("bigint"))
    return found.withColumn("number", number)


def allocation_log(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """SRC11: cache, address; comments and lines of other than two words are left out, as are addresses outside [low, high]."""
    words = F.split(F.trim("line"), r"\s+")
    out = lines(spark, path).filter(~F.trim("line").startswith("#")).select(words.alias("w")).filter((F.size("w") == 2) & F.col("w")[1].rlike("^0[xX][0-9a-fA-F]+$"))
    out = out.select(F.col("w")[0].alias("cache"), hex_address(F.expr("substring(w[1], 3)")).alias("address")).filter("address is not null")
    return out if low is None else out.filter(F.col("address").between(low, high))


def trace_events(text: DataFrame, line: str = "line") -> DataFrame:
    """SRC12: cache, address, delta of each trace line; works on streams as well. A trace line holds, as words after one another: TRACE,
    the cache, alloc or free, the address after 0x, and a word that starts with inuse; words before and after them don't matter."""
    words = text.select(F.split(F.substring_index(F.concat(F.lit(" "), F.col(line)), " TRACE ", -1), " ").alias("w")).filter(F.col(line).contains("TRACE ") & (F.size("w") >= 4))
    digits = F.substring(F.col("w")[2], 3, 99)
    real = words.filter(F.col("w")[1].isin("alloc", "free") & F.col("w")[2].startswith("0x") & (digits != "") & (F.translate(digits, "0123456789abcdef", "") == "") & F.col("w")[3].startswith("inuse"))
    return real.select(F.col("w")[0].alias("cache"), hex_address(digits).alias("address"), F.when(F.col("w")[1] == "alloc", 1).otherwise(-1).alias("delta"))


def fold_trace(events: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """SRC12: net count by key and what it means: live (1), freed (0), anomaly."""
    folded = events.groupBy(*keys).agg(F.sum(delta).cast("bigint").alias("net"))
    return folded.withColumn("state", F.when(F.col("net") == 1, "live").when(F.col("net") == 0, "freed").otherwise("anomaly"))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: symbols with section, address and size from a symbol table listing."""
    pattern = r"^([0-9a-fA-F]+)\s(.{7})\s(\S+)\s+([0-9a-fA-F]+)\s+(?:\.hidden\s+)?(\S+)\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines(spark, path).filter(F.col("line").rlike(pattern)).select("file", hex_address(part(1)).alias("address"), part(2).alias("flags"), part(3).alias("section"), hex_address(part(4)).alias("size"), part(5).alias("name"))


_HEAD = r"^\s*<([0-9a-fA-F]+)><([0-9a-fA-F]+)>.*?\(DW_TAG_(\w+)\)"
_ATTR = r"^\s*(?:<[0-9a-fA-F]+>)?\s*DW_AT_(\w+)\s*:\s*(?:\(indirect string, offset: 0x[0-9a-fA-F]+\):\s*)?(.*?)\s*$"


def _heads(line: str) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(line, _HEAD, i)
    return {"id": part(2), "depth": part(1), "tag": part(3)}


def debug_records(text: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", split: str | None = None) -> DataFrame:
    """SRC1, SRC3: debug entries: file, record_id, depth, tag, attrs (map), parent_id. A record is a header line and the attribute lines after it; its
    parent is the nearest record before it of smaller depth.

    split: the column that numbers the splits of a file in ascending order (None: a file is one). Each split is read by itself, once, and what it makes is
    written: it numbers its records and finds their parents with a stack. What it can't know is asked of the splits before it: to which record
    its first attribute lines belong, and the parents of records whose scope began earlier. For that a split tells, for each depth, its last
    record that is still open at its end; a depth's splits are looked through in order, a row a split.
    """
    known = text.filter(F.col(line).contains("(DW_TAG_") | F.col(line).contains("DW_AT_"))
    said = F.when(F.col(line).contains(_MARK), F.lit(None)).otherwise(F.regexp_replace(line, _ATTR, f"$1{_MARK}$2"))  # both parts with one match
    heads = _heads(line)
    parsed = known.select(F.col(file).alias("file"), (F.lit(0) if split is None else F.col(split)).cast("bigint").alias("split"), F.col(line_no).cast("bigint").alias("at"), F.col(line).alias("_line"), heads["id"].alias("_id"), said.alias("_said"))
    head = F.col("_id") != ""
    plain = F.when(F.col("_said").contains(_MARK), F.col("_said"))
    key = F.coalesce(F.substring_index(plain, _MARK, 1), F.when(F.col("_said").isNull(), F.nullif(F.regexp_extract("_line", _ATTR, 1), F.lit(""))))
    value = F.coalesce(F.substring(plain, F.length(key) + 2, F.length(plain)), F.when(F.col("_said").isNull(), F.regexp_extract("_line", _ATTR, 2)))
    deep, tag = (F.when(head, _heads("_line")[k]) for k in ("depth", "tag"))
    parsed = parsed.select("file", "split", "at", F.when(head, F.conv("_id", 16, 10).cast("bigint")).alias("record_id"), deep.try_cast("int").alias("depth"), tag.alias("tag"), F.when(~head, key).alias("key"), F.when(~head, value).alias("value"))
    made = cut(parsed.groupBy("split", "file").applyInArrow(_scoped(), _MADE))  # a split's lines
    earlier = Window.partitionBy("file").orderBy("split").rangeBetween(Window.unboundedPreceding, -1)
    edges = made.filter("last or rec = 0").withColumn("from", F.last(F.when(F.col("last"), F.struct("split", "rec")), ignorenulls=True).over(earlier))  # two rows a split at most
    stray = edges.filter("rec = 0 and from is not null").groupBy("file", F.col("from.split").alias("split"), F.col("from.rec").alias("rec"))
    stray = stray.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("split", F.map_entries("attrs").alias("e")))), lambda x: x["e"])).alias("more"))
    alone = F.col("last") | (F.col("parent_id").isNull() & (F.coalesce("depth", F.lit(0)) > 0))  # what may need another split
    inner = made.filter(F.col("rec") > 0).filter(~alone)
    outer = made.filter(F.col("rec") > 0).filter(alone).withColumn("level", F.coalesce("depth", F.lit(0))).join(stray, ["file", "split", "rec"], "left")
    every = F.concat(F.map_entries("attrs"), "more")
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["key"]), x["key"]) == i + 1)
    outer = outer.withColumn("attrs", F.when(F.col("more").isNull(), F.col("attrs")).otherwise(F.map_from_entries(first)))
    outer = outer.join(_answers(made), ["file", "split", "level"], "left").withColumn("parent_id", F.coalesce("parent_id", "_up.record_id"))
    record = [F.col("file").alias(file), "record_id", "depth", "tag", "attrs", "parent_id"]
    return inner.select(*record).unionByName(outer.select(*record))


_MARK = "\0"
_MADE = "file string, split long, rec long, record_id long, depth int, tag string, attrs map<string,string>, parent_id long, open boolean, last boolean"


def _scoped() -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """A function that carries its code to workers without this package."""

    def scoped(key: tuple[pa.Scalar, ...], lines_: pa.Table) -> pa.Table:
        """The records of a split's lines: rec (from 1; 0: attribute lines before the first), attrs (of a name given twice, the first counts), parent_id,
        open (at the split's end), last (the split's last record). A depth that can't be read counts as 0."""
        lines_ = lines_.sort_by("at")
        lines_ = lines_.append_column("rec", pc.cumulative_sum(pc.is_valid(lines_["tag"]).cast(pa.int64())))
        given = lines_.filter(pc.is_valid(lines_["key"])).group_by(["rec", "key"], use_threads=False).aggregate([("value", "first")]).combine_chunks().sort_by("rec")
        heads = lines_.filter(pc.is_valid(lines_["tag"]))
        depths, ids = (pc.fill_null(heads[c], 0).to_numpy().tolist() for c in ("depth", "record_id"))
        stack: list[tuple[int, int]] = []  # of depth and place, both ascending
        parents: list[int | None] = [None]
        for at, depth in enumerate(depths):
            while stack and stack[-1][0] >= depth:
                stack.pop()
            parents.append(ids[stack[-1][1]] if stack else None)
            stack.append((depth, at))
        n, still = len(ids), {at for _, at in stack}
        bounds = np.searchsorted(given["rec"].to_numpy(), np.arange(n + 2)).astype("int32")
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        below = lambda c: pa.chunked_array([pa.nulls(1, c.type), *c.chunks])
        rows = {
            "file": pa.repeat(key[1], n + 1), "split": pa.repeat(key[0], n + 1), "rec": pa.array(range(n + 1), pa.int64()), "record_id": below(heads["record_id"]), "depth": below(heads["depth"]),
            "tag": below(heads["tag"]), "attrs": pa.MapArray.from_arrays(pa.array(bounds), whole(given["key"]), whole(given["value_first"])), "parent_id": pa.array(parents, pa.int64()),
            "open": pa.array([False, *(at in still for at in range(n))]), "last": pa.array([at == n for at in range(n + 1)]) if n else pa.array([False]),
        }
        return pa.table(rows).slice(0 if bounds[1] else 1)

    return scoped


def _answers(made: DataFrame) -> DataFrame:
    """file, split, level, _up: the nearest record of smaller depth in the splits before, for the levels that have records without a parent in theirs: of
    the depths below, that whose last open record came last."""
    level = F.coalesce("depth", F.lit(0)).alias("level")
    wanted = made.filter("rec > 0 and parent_id is null").select("file", "split", level).distinct().filter("level > 0")
    asked = wanted.select("file", "split", F.col("level").alias("want"), F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("level"), F.lit(None).cast("struct<split:bigint,rec:bigint,record_id:bigint>").alias("last"))
    told = made.filter("open").groupBy("file", "split", level).agg(F.max(F.struct("split", "rec", "record_id")).alias("last")).withColumn("want", F.lit(None).cast("int"))
    before = Window.partitionBy("file", "level").orderBy("split").rangeBetween(Window.unboundedPreceding, -1)
    up = told.unionByName(asked).withColumn("_up", F.max("last").over(before)).filter("want is not null and _up is not null")
    return up.groupBy("file", "split", F.col("want").alias("level")).agg(F.max("_up").alias("_up"))


#: Tags that are types, with the kind that they make (fixed names of the format).
TYPE_TAGS = {
    "base_type": "Base", "structure_type": "Struct", "union_type": "Union", "enumeration_type": "Enum", "pointer_type": "Pointer", "array_type": "Array",
    "typedef": "Typedef", "const_type": "Const", "volatile_type": "Volatile", "subroutine_type": "FuncPointer",
}


def typed_rows(records: DataFrame) -> dict[str, DataFrame]:
    """SRC1, SRC3: the catalog's rows that debug entries make: types (type_id, kind, name, size, ref_type_id, length), members (struct_id, idx, name,
    ref_type_id, offset, bit_size), enumerators (type_id, name, value), variables (var_id, name, type_id, address) and functions (func_id,
    name, type_id, pc_low, pc_high). Sub-entries are merged into what holds them: subranges give an array its length, members and
    enumerators their owner."""
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    ref = hex_address(F.regexp_extract(a("type"), "<(?:0x)?([0-9a-fA-F]+)>", 1))
    ref = F.when(a("type").isNotNull() & (F.regexp_extract(a("type"), "<(?:0x)?([0-9a-fA-F]+)>", 1) != ""), ref)
    hexed = lambda c: F.when(F.regexp_extract(c, "(?:0x)?([0-9a-fA-F]+)", 1) != "", hex_address(F.regexp_extract(c, "(?:0x)?([0-9a-fA-F]+)", 1)))
    whole = lambda k: F.regexp_extract(a(k), r"^(-?\d+)", 1).try_cast("bigint")
    of = F.struct("file", "parent_id")
    kind = F.create_map(*[F.lit(x) for kv in TYPE_TAGS.items() for x in kv])[F.col("tag")]
    rows = records.withColumn("_of", of)
    lengths = rows.filter("tag = 'subrange_type'").groupBy("file", F.col("parent_id").alias("type_id")).agg(F.product(F.coalesce(whole("count"), whole("upper_bound") + 1)).cast("bigint").alias("length"))
    types = rows.filter(kind.isNotNull()).select("file", F.col("record_id").alias("type_id"), kind.alias("kind"), a("name").alias("name"), whole("byte_size").alias("size"), ref.alias("ref_type_id"))
    located = F.regexp_extract(a("data_member_location"), r"(?:plus_uconst: |^)(\d+)\)?\s*$", 1).try_cast("bigint")
    members = rows.filter("tag = 'member'").select("file", F.col("parent_id").alias("struct_id"), F.col("record_id").alias("idx"), a("name").alias("name"), ref.alias("ref_type_id"), F.coalesce(located, F.lit(0)).alias("offset"), whole("bit_size").alias("bit_size"))
    address = F.regexp_extract(a("location"), r"DW_OP_addr: ([0-9a-fA-F]+)", 1)
    return {
        "types": types.join(lengths, ["file", "type_id"], "left"),
        "members": members,
        "enumerators": rows.filter("tag = 'enumerator'").select("file", F.col("parent_id").alias("type_id"), a("name").alias("name"), whole("const_value").alias("value")),
        "variables": rows.filter("tag = 'variable'").select("file", F.col("record_id").alias("var_id"), a("name").alias("name"), ref.alias("type_id"), F.when(address != "", hex_address(address)).alias("address")).filter("address is not null"),
        "functions": rows.filter("tag = 'subprogram'").select("file", F.col("record_id").alias("func_id"), a("name").alias("name"), ref.alias("type_id"), hexed(a("low_pc")).alias("pc_low"), hexed(a("high_pc")).alias("pc_high")),
    }


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split (the byte at which the part of the file begins that a task read) and line_no, which grows inside a split.
    A large file is read by many tasks, none of which holds it whole."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in their file: each file is read by one task, in order. For files of a task's size; `split_lines` is for others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                own = bytes(data).decode("utf-8", "replace").splitlines()
                yield pd.DataFrame({"file": name, "line_no": range(len(own)), "line": own})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no long, line string")


def syscall_signatures(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: name, arguments of `asmlinkage long sys_name(args);` declarations, which may span lines."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(asmlinkage\s+\w+\s+sys_\w+\s*\([^)]*\))"), F.lit(1))).alias("s"))
    return found.select(F.regexp_extract("s", r"sys_(\w+)", 1).alias("name"), F.transform(F.split(F.regexp_extract("s", r"\(([^)]*)\)", 1), ","), lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))).alias("args"))
