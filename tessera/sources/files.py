"""File sources and sinks: explicit schemas on every read, whole-file formats parsed by executors."""

from __future__ import annotations

import io
import re
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where the session names none and runs on one
    machine.  On a cluster without such a folder there is no right place, so that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.gettempdir()}/checkpoints/tessera"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with pinned types: identifiers keep their zeros."""
    return spark.read.schema(schema).option("dateFormat", "yyyy-MM-dd").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_positions(spark: SparkSession, path: str, columns: dict[int, str], sep: str = "\t") -> DataFrame:
    """A table without a header: the named positions as strings; rows without the first of them are dropped."""
    parts = F.split("value", re.escape(sep))
    df = spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in columns.items()])
    first = next(iter(columns.values()))
    return df.where(F.col(first).isNotNull() & (F.col(first) != ""))


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files that aren't empty, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, content) of whole files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def unzip(blobs: DataFrame, member: str | int = 0) -> DataFrame:
    """(name, content) of one member of each archive, by name or place; archives without it give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, raw in zip(pdf["name"], pdf["content"]):
                z = zipfile.ZipFile(io.BytesIO(raw))
                names = z.namelist()
                pick = names[member] if isinstance(member, int) and member < len(names) else member if member in names else None
                if pick is not None:
                    out.append((f"{name}!{pick}", z.read(pick)))
            yield pd.DataFrame(out, columns=["name", "content"])

    return blobs.mapInPandas(run, "name string, content binary")


def untar(blobs: DataFrame) -> DataFrame:
    """(archive, name, content) of all files of compressed archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["name"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    rows = [(name, m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return blobs.mapInPandas(run, "archive string, name string, content binary")


def mirror(blobs: DataFrame) -> DataFrame:
    """The archives to read of a mirror: the newest whole one if there is any, else all the partial ones."""
    total = blobs.where(F.col("name").contains("total"))
    newest = total.agg(F.max("name").alias("top"))
    picked = blobs.crossJoin(newest)  # one row
    return picked.where(F.when(F.col("top").isNull(), True).otherwise(F.col("name") == F.col("top"))).drop("top")


#: The escapes of the text form of COPY.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_escape = re.compile(r"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|(.))", re.S)


def copy_value(field: str) -> str | None:
    if field == "\\N":
        return None
    return _escape.sub(lambda m: chr(int(m[1], 8)) if m[1] else chr(int(m[2], 16)) if m[2] else _ESCAPES.get(m[3], m[3]), field)


def read_copy(blobs: DataFrame) -> DataFrame:
    """(table, row map) of every COPY ... FROM stdin block of database dumps in text form, up to its end mark."""
    head = re.compile(r"^COPY ([^ ]+) \(([^)]*)\) FROM stdin;$")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, table, cols = [], None, []
            for raw in pdf["content"]:
                for line in raw.decode().split("\n"):
                    if table is None:
                        if m := head.match(line):
                            table, cols = m[1], [c.strip().strip('"') for c in m[2].split(",")]
                    elif line == "\\.":
                        table = None
                    else:
                        out.append((table, dict(zip(cols, map(copy_value, line.split("\t"))))))
            yield pd.DataFrame(out, columns=["table", "row"])

    return blobs.mapInPandas(run, "table string, row map<string,string>")


def merged_headers(rows: list[list]) -> list[str]:
    """Column names of several header rows: blanks repeat the cell before, rows join by a space, repeats get _1."""
    filled = []
    for row in rows:
        last, line = "", []
        for cell in row:
            last = str(cell).strip() if cell not in (None, "") and cell == cell else last
            line.append(last)
        filled.append(line)
    names, seen = [], {}
    for parts in zip(*filled):
        name = " ".join(dict.fromkeys(p for p in parts if p))
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}_{seen[name]}" if seen[name] else name)
    return names


def sheet(spark: SparkSession, rows: list[list], header_rows: int) -> DataFrame:
    """A spreadsheet's cells (small, read by the driver) under merged headers, all strings."""
    names = merged_headers(rows[:header_rows])
    body = [[None if c is None or c != c else str(c) for c in r] for r in rows[header_rows:]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))


def newest_export(df: DataFrame, day: str, stamp: str) -> DataFrame:
    """Rows of the newest export of each day."""
    top = df.groupBy(day).agg(F.max(stamp).alias(stamp))
    return df.join(top, [day, stamp], "left_semi")


def write_lines(df: DataFrame, path: str, sort: str | None = None) -> None:
    """JSON lines, the largest first if a column is named."""
    (df.orderBy(F.desc_nulls_last(sort)) if sort else df).write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def promote(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the target, then put it in its place: readers see the old table or the new one."""
    jvm = spark.sparkContext._jvm
    temp = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(temp)
    there, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(temp)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{temp}.old")
    if fs.exists(there):
        fs.rename(there, old)
    fs.rename(new, there)
    fs.delete(old, True)


def changed_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash differs from the one known for their key."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns) if c != key]
    hashed = df.withColumn("sha256", F.sha2(F.concat_ws("\1", *cols), 256))
    return hashed.join(known.select(key, F.col("sha256").alias("_known")), key, "left").where(~F.col("sha256").eqNullSafe(F.col("_known"))).drop("_known")


def archive_new(df: DataFrame, done: DataFrame, host: str, day: str, today: str) -> DataFrame:
    """Rows of days before today whose (host, day) hasn't been archived."""
    return df.where(F.col(day) < F.lit(today).cast("date")).join(done, [host, day], "left_anti")


def chunked(df: DataFrame, size: int, key: str) -> DataFrame:
    """df with chunk and place: batches of at most `size` rows within each partition of the key's hash."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(key), F.lit(64))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return df.withColumn("_part", part).withColumn("_n", n).withColumn("chunk", F.concat_ws("-", "_part", F.floor(F.col("_n") / size))).drop("_part", "_n")
