"""Memory images as tables of pages, and their dumps (SRC7-SRC9, SNK1, SNK3-SNK5, SNK7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 4096


def read_image(spark: SparkSession, path: str, dump_id: int = 0, page: int = PAGE) -> DataFrame:
    """SRC8: pages(dump_id, frame, data). The file is cut into records of one page, so its splits are read in parallel; the
    length must be a multiple of the page. Local or remote paths alike."""
    sc = spark.sparkContext
    sizes = sc._jvm.org.apache.hadoop.fs.Path(path)
    length = sizes.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(sizes).getLen()
    if length % page:
        raise ValueError(f"{path} holds no whole number of pages")
    records = sc.binaryRecords(path, page).zipWithIndex().map(lambda r: (dump_id, r[1], bytearray(r[0])))
    return spark.createDataFrame(records, "dump_id int, frame bigint, data binary")


def check_size(expected: int, found: int, slack: float = 0.1) -> bool:
    """SRC8: whether an image's size is within a tenth of what its system should have."""
    return abs(found - expected) <= expected * slack


class Dumps:
    """SRC8, SRC9, X7: loaded images by slot; a file that is loaded keeps its slot, free slots are used again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.slots = spark, {}

    def load(self, path: str, expected: int | None = None) -> int:
        """The slot of an image. expected: the bytes that its system should have; an image far off is refused."""
        for i, (p, _) in self.slots.items():
            if p == path:
                return i
        i = next(n for n in range(len(self.slots) + 1) if n not in self.slots)
        if expected is not None:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
            if not check_size(expected, found):
                raise ValueError(f"{path} holds {found} bytes where about {expected} were expected")
        self.slots[i] = (path, read_image(self.spark, path, i))
        return i

    def unload(self, which: int | str) -> int:
        i = which if isinstance(which, int) else next((n for n, (p, _) in self.slots.items() if p == which), -1)
        if i not in self.slots:
            raise KeyError(which)
        self.slots.pop(i)
        return i

    def list(self) -> dict[int, str]:
        return {i: p for i, (p, _) in sorted(self.slots.items())}

    def pages(self, i: int = 0) -> DataFrame:
        return self.slots[i][1]


def write_catalog(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """SNK1: one Parquet table per part of the catalog, with its version."""
    for name, df in tables.items():
        df.withColumn("catalog_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, names: list[str], newest: int = 1) -> dict[str, DataFrame]:
    """SRC7: the catalog's tables; raises if any was written by a newer version."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        if (v := df.agg(F.max("catalog_version")).first()[0]) is not None and v > newest:
            raise ValueError(f"{name} has version {v}")
        out[name] = df.drop("catalog_version")
    return out


def hex_dump(pages: DataFrame, width: int = 16, page: int = PAGE) -> DataFrame:
    """SNK5: address, hex, ascii; one row per `width` bytes."""
    n = F.ceil(F.length("data") / width).cast("int")
    rows = pages.select("frame", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring("data", i * width + 1, F.lit(width)))).alias("i", "b"))
    at = lambda i: F.hex(F.substring("b", i, F.lit(1)))
    each = F.sequence(F.lit(1), F.length("b"))
    code = lambda i: F.conv(at(i), 16, 10).cast("int")
    ascii_ = F.array_join(F.transform(each, lambda i: F.when(code(i).between(32, 126), F.char(code(i))).otherwise(".")), "")
    return rows.filter(F.length("b") > 0).select((F.col("frame") * page + F.col("i") * width).alias("address"), F.lower(F.array_join(F.transform(each, at), " ")).alias("hex"), ascii_.alias("ascii"))


def dump_objects(objects: DataFrame, path: str, columns: list[str]) -> None:
    """SNK3: one line per object."""
    objects.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def tree_lines(above: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """SNK4: an indented line for each node down to a depth, in the order of the paths. above: node, above (nearest first)."""
    path = F.concat(F.reverse("above"), F.array(F.col("node").cast("string")))
    return above.filter(F.size("above") < depth).select("node", path.alias("path"), F.concat(F.repeat(F.lit("  "), F.size("above")), F.col(name)).alias("line")).orderBy("path")


def tree_dump(parents: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    """SNK4 for trees of any depth: node, root, place, depth, line: an indented line for each node down to a depth, with its place in the dump, which
    is the node's in its tree. parents: node, parent, and the column shown. Nodes have no paths here, only numbers."""
    from orebody.operators.store import by_sorting
    from orebody.operators.trees import preorder

    rows = preorder(parents.select("node", "parent"))
    rows = rows if depth is None else rows.filter(F.col("depth") < depth)
    shown = parents.select("node", F.col(name).cast("string").alias("_name"))
    rows = rows.withColumn("_name", F.col("node").cast("string")) if name == "node" else rows.join(by_sorting(shown), "node")
    return rows.select("node", "root", "place", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), "_name").alias("line"))


def split_vector(df: DataFrame, vector: str) -> DataFrame:
    """SNK7: even and odd places of a vector."""
    return df.withColumn("even", F.filter(vector, lambda x, i: i % 2 == 0)).withColumn("odd", F.filter(vector, lambda x, i: i % 2 == 1))


def decode_bulk(df: DataFrame, data: str, layout: dict[str, tuple[int, str]]) -> DataFrame:
    """P13 in bulk: named little-endian fields (offset, numpy type such as '<i4') of a binary column, by Arrow batches."""
    import numpy as np

    spark_types = {"i1": "byte", "u1": "short", "i2": "short", "u2": "int", "i4": "int", "u4": "long", "i8": "long", "f4": "float", "f8": "double"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {spark_types[t.lstrip('<')]}" for n, (_, t) in layout.items()])
    outs = {n: {"u1": np.int16, "u2": np.int32, "u4": np.int64}.get(t.lstrip("<"), np.dtype(t)) for n, (_, t) in layout.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, (off, t) in layout.items():
                size = np.dtype(t).itemsize
                b[n] = [None if d is None or len(d) < off + size else outs[n](np.frombuffer(bytes(d[off : off + size]), t)[0]) if not isinstance(outs[n], np.dtype) else np.frombuffer(bytes(d[off : off + size]), t)[0] for d in b[data]]
            yield b

    return df.mapInPandas(run, schema)
