"""Sources: CSV series in two dialects, workbooks read as plain XML, required columns, archives of files."""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import excel_date, month_start, null_if_nan


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{label}: missing {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header under an enforced schema; literal NaN in double columns becomes null."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    return df.select(*[null_if_nan(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def read_series(spark: SparkSession, path: str, value: str, out: str) -> DataFrame:
    """(date, out): a monthly series whose date column is `observation_date` or `date`; months once, the last row staying."""
    df = spark.read.csv(path, header=True)
    lower = df.toDF(*[c.strip().lower() for c in df.columns])
    date = next((c for c in ("observation_date", "date") if c in lower.columns), None)
    if date is None or value.lower() not in lower.columns:
        raise MissingColumns(f"{path}: a date column and {value} are needed; it has {', '.join(df.columns)}")
    rows = lower.select(month_start(F.col(date).try_cast("date")).alias("date"), null_if_nan(F.when(F.col(value.lower()) != ".", F.col(value.lower()))).alias(out), F.monotonically_increasing_id().alias("_o")).filter("date IS NOT NULL")
    w = Window.partitionBy("date").orderBy(F.col("_o").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_o")


def column_index(ref: str) -> int:
    """A1-style column letters to a place from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes, sheet: int = 0) -> list[list[str | None]]:
    """The cells of a sheet as text, by its XML parts alone: shared strings resolved, absent cells null."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        root = ElementTree.fromstring(z.read(sheets[sheet]))
    rows = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", ns):
            v = c.find("m:v", ns)
            inline = c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if v is None else v.text
            cells[column_index(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(row, cells array<string>) of workbooks at path; a file is read where it lies, in the executors."""

    def parse(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = workbook_rows(bytes(content), sheet)
                yield type(pdf)({"path": p, "row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row long, cells array<string>")


def workbook_table(rows: DataFrame, header: list[str]) -> DataFrame:
    """The rows below the first one that holds every name of `header` (case-insensitively), as string columns."""
    want = F.array(*[F.lit(h.lower()) for h in header])
    lowered = F.transform(F.col("cells"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    head = rows.filter(F.size(F.array_except(want, lowered)) == 0).agg(F.min(F.struct("row", lowered.alias("names"))).alias("h"))
    j = rows.crossJoin(F.broadcast(head)).filter(F.col("row") > F.col("h.row"))
    at = lambda h: F.try_element_at("cells", F.array_position("h.names", h.lower()).cast("int"))
    return j.select("row", *[at(h).alias(h) for h in header])


def date_or_serial(text: str) -> Column:
    """A date written as text or as a workbook's serial day."""
    serial = F.col(text).try_cast("double")
    return F.coalesce(F.when(serial.between(20000, 80000), excel_date(serial)), F.col(text).try_cast("date"))


#: Words by which a value column of an outside file is recognised, with their weight; others count against it.
NAME_WEIGHTS = (("surprise", 4), ("shock", 3), ("mps", 3), ("policy", 1), ("date", -9), ("year", -9), ("month", -9))


def choose_column(columns: list[str], prefer: tuple[tuple[str, int], ...] = NAME_WEIGHTS) -> str:
    """The column whose name scores highest; the first of equals. Raises where none scores above zero."""
    scored = [(sum(w for word, w in prefer if word in c.lower()), -i, c) for i, c in enumerate(columns)]
    best = max(scored)
    if best[0] <= 0:
        raise MissingColumns(f"no value column among {', '.join(columns)}")
    return best[2]


def extract_archive(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(name, content) of the members of a ZIP archive; an error where one of `required` is absent."""

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    files = [n for n in z.namelist() if not n.endswith("/")]
                    missing = [r for r in required if not any(n == r or n.endswith("/" + r) for n in files)]
                    if missing:
                        raise FileNotFoundError(f"missing members: {', '.join(missing)}")
                    yield type(pdf)({"name": files, "content": [z.read(n) for n in files]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "name string, content binary")


def read_path_table(spark: SparkSession, path: str, aliases: dict[str, str], required: list[str]) -> DataFrame:
    """A parquet path table with columns renamed by `aliases` and the required ones present."""
    df = spark.read.parquet(path)
    return require(df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns}), required, path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of `paths` that exists, on any file system that the session reads; an error names them all."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    raise FileNotFoundError(", ".join(paths))


def resolve(spark: SparkSession, names: list[str], folders: list[str], variable: str | None = None) -> str | None:
    """Where an optional source is: the path in the environment variable where that is set, else the first of `names`
    in the first of `folders`; None where there is none. A path in the variable that doesn't exist is an error."""
    told = os.environ.get(variable, "") if variable else ""
    if told:
        return first_existing(spark, [told])
    try:
        return first_existing(spark, [f"{folder.rstrip('/')}/{name}" for folder in folders if folder for name in names])
    except FileNotFoundError:
        return None


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, row, values) of the numeric arrays of NPZ files: one row for each index of the first axis,
    the rest flattened in C order. A file is read where it lies, in the executors; pickled members are refused."""

    def parse(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as members:
                    for name in members.files:
                        a = np.atleast_1d(members[name])
                        flat = a.reshape(len(a), -1).astype(float)
                        for lo in range(0, len(a), 1024):
                            part = list(flat[lo : lo + 1024])
                            yield type(pdf)({"path": p, "name": name, "shape": [list(a.shape)] * len(part), "row": range(lo, lo + len(part)), "values": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, name string, shape array<long>, row long, values array<double>")


def surprises_by_month(rows: DataFrame, prefer: tuple[tuple[str, int], ...] = NAME_WEIGHTS, date: str | None = None) -> DataFrame:
    """(date, value, n): the events of an outside table summed by month. The date column is `date`, or the first whose
    name holds "date"; the value column is the one whose name scores highest. Rows without either count for nothing."""
    when = date or next((c for c in rows.columns if "date" in c.lower()), None)
    if when is None:
        raise MissingColumns(f"no date column among {', '.join(rows.columns)}")
    value = choose_column([c for c in rows.columns if c != when], prefer)
    day = F.col(when) if isinstance(rows.schema[when].dataType, (T.DateType, T.TimestampType)) else date_or_serial(when)
    x = rows.select(month_start(day).alias("date"), F.col(value).try_cast("double").alias("x"))
    return x.filter("date IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)").groupBy("date").agg(F.sum("x").alias("value"), F.count("*").alias("n"))


def best_sheet(content: bytes, header: list[str]) -> int:
    """The sheet of a workbook one of whose rows names most of `header` (case-insensitively); the first of equals.
    Raises where no sheet names any."""
    want, scores, sheet = {h.lower() for h in header}, [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = sum(bool(re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)) for n in z.namelist())
    for sheet in range(sheets):
        rows = workbook_rows(content, sheet)
        scores.append(max((len(want & {(c or "").strip().lower() for c in row}) for row in rows), default=0))
    if not scores or max(scores) == 0:
        raise MissingColumns(f"no sheet names any of {', '.join(header)}")
    return scores.index(max(scores))
