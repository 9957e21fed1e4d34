"""Tables from files.  CSV and Parquet are Spark scans; a workbook's sheet is parsed on one reader."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Mapping, Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean a missing value in CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CSV_OPTIONS = ("encoding", "sep", "dtype")
EXCEL_OPTIONS = ("header", "names", "usecols", "dtype", "na_values", "keep_default_na", "skiprows", "nrows")


def _cast(df: DataFrame, dtype: Mapping[str, str] | str | None) -> DataFrame:
    if not dtype:
        return df
    wanted = dict.fromkeys(df.columns, dtype) if isinstance(dtype, str) else dtype
    for name in wanted:
        if name not in df.columns:
            raise ValueError(f"unknown column: {name}")
    return df.withColumns({n: F.col(f"`{n}`").cast(t) for n, t in wanted.items()})


def load_csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A CSV file with a header; only encoding, sep and dtype may be given.

    All usual texts for missing values are null before types are inferred, as columns are read as
    text first; inference tries long, double, boolean and timestamp on one aggregate.
    """
    for name in options:
        if name not in CSV_OPTIONS:
            raise ValueError(f"unsupported option: {name}")
    reader = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST").option("multiLine", False)
    reader = reader.option("sep", options.get("sep", ",")).option("encoding", options.get("encoding", "UTF-8"))
    raw = reader.csv(path)
    if len({c.lower() for c in raw.columns}) != len(raw.columns):
        raise ValueError("column names must be unique")
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    dtype = options.get("dtype")
    if dtype is not None and not isinstance(dtype, str):
        left = [c for c in raw.columns if c not in dtype]
    else:
        left = [] if dtype else raw.columns
    inferred = infer_types(raw, left)
    return _cast(raw.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in inferred.items()}), dtype)


def infer_types(raw: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The narrowest of long, double, boolean, timestamp_ntz that every value of a text column fits."""
    if not columns:
        return {}
    cells = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        cells += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("bigint")).alias(f"l{i}"), F.count(x.try_cast("double")).alias(f"d{i}"), F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}"), F.count_if(F.try_to_timestamp(x).isNotNull() & x.rlike(r"^\d{4}-\d{2}-\d{2}")).alias(f"t{i}"), F.count_if(x.rlike(r"^[+-]?\d+$")).alias(f"w{i}")]
    row = raw.agg(*cells).first()
    out = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n and row[f"w{i}"] == n:
            out[c] = "bigint"
        elif n and row[f"d{i}"] == n:
            out[c] = "double"
        elif n and row[f"b{i}"] == n:
            out[c] = "boolean"
        elif n and row[f"t{i}"] == n:
            out[c] = "timestamp_ntz"
    return out


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheet(data: bytes, sheet_name: int | str = 0) -> list[list[object]]:
    """The cells of one sheet: numbers, texts, booleans, dates; None where empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in tree("xl/sharedStrings.xml").findall("m:si", _NS)]
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]", "", f.get("formatCode", "")), re.I)}
            dated = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATES | own}
        sheets = tree("xl/workbook.xml").findall("m:sheets/m:sheet", _NS)
        links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        if isinstance(sheet_name, str):
            found = [s for s in sheets if s.get("name") == sheet_name]
            if not found:
                raise ValueError(f"unknown sheet: {sheet_name}")
            sheet = found[0]
        else:
            if not 0 <= sheet_name < len(sheets):
                raise ValueError(f"unknown sheet: {sheet_name}")
            sheet = sheets[sheet_name]
        target = links[sheet.get(f"{{{_NS['r']}}}id")]
        rows: list[list[object]] = []
        for row in tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").findall("m:sheetData/m:row", _NS):
            at = int(row.get("r", len(rows) + 1))
            while len(rows) < at:
                rows.append([])
            for c in row.findall("m:c", _NS):
                i = _column(c.get("r")) if c.get("r") else len(rows[at - 1])
                rows[at - 1] += [None] * (i + 1 - len(rows[at - 1]))
                rows[at - 1][i] = _cell(c, shared, dated)
        return rows


def _cell(c: ElementTree.Element, shared: list[str], dated: set[int]) -> object:
    kind, v = c.get("t", "n"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return None if kind == "e" else v.text
    x = float(v.text)
    if int(c.get("s", 0)) in dated:
        return dt.datetime(1899, 12, 30) + dt.timedelta(microseconds=round(x * 86_400_000_000))
    return int(x) if x.is_integer() and "." not in v.text and "e" not in v.text.lower() else x


def load_excel(spark: SparkSession, path: str, *, sheet_name: int | str = 0, opener: Callable[[str], bytes] | None = None, **options: object) -> DataFrame:
    """One sheet of an .xlsx workbook.  The file is read through Spark, so any store that Spark reads will do.

    A workbook holds a million rows a sheet at most, so it is parsed as a whole.
    """
    if isinstance(sheet_name, (list, tuple)) or sheet_name is None:
        raise ValueError("exactly one sheet is read")
    if not path.endswith(".xlsx"):
        raise ValueError("only .xlsx files are read")
    for name in options:
        if name not in EXCEL_OPTIONS:
            raise ValueError(f"unsupported option: {name}")
    data = opener(path) if opener else bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = read_sheet(data, sheet_name)[int(options.get("skiprows") or 0) :]
    header = options.get("header", 0)
    if header is None:
        width = max((len(r) for r in rows), default=0)
        names = [f"column_{i}" for i in range(width)]
    else:
        names = [str(x) if x is not None else f"column_{i}" for i, x in enumerate(rows[header])] if rows else []
        rows = rows[header + 1 :]
    names = list(options["names"]) if options.get("names") else names
    if len({n.lower() for n in names}) != len(names):
        raise ValueError("column names must be unique")
    if options.get("nrows") is not None:
        rows = rows[: int(options["nrows"])]
    missing = set(options.get("na_values") or ()) | (set(MISSING) if options.get("keep_default_na", True) else set())
    cells = [[(r[i] if i < len(r) else None) for i in range(len(names))] for r in rows]
    cells = [[None if isinstance(v, str) and v in missing else v for v in r] for r in cells]
    fields, columns = [], []
    for i, name in enumerate(names):
        values = [r[i] for r in cells]
        kinds = {type(v) for v in values if v is not None}
        kind: T.DataType = T.StringType()
        if kinds and kinds <= {int}:
            kind = T.LongType()
        elif kinds and kinds <= {int, float}:
            kind, values = T.DoubleType(), [None if v is None else float(v) for v in values]
        elif kinds == {bool}:
            kind = T.BooleanType()
        elif kinds == {dt.datetime}:
            kind = T.TimestampNTZType()
        else:
            values = [None if v is None else str(v) for v in values]
        fields.append(T.StructField(name, kind))
        columns.append(values)
    df = spark.createDataFrame(list(zip(*columns, strict=True)) if columns else [], T.StructType(fields))
    if options.get("usecols"):
        df = df.select(*options["usecols"])
    return _cast(df, options.get("dtype"))
