"""Files in: uploads, delimited text, workbooks, JSON settings. Files out: reports, GeoJSON, partitioned runs."""

from __future__ import annotations

import contextlib
import csv
import hashlib
import json
import os
import re
import time
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import StringIO
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gapline.functions.text import column_names
from gapline.operators.imports import MOST_BYTES, MOST_ROWS, SUFFIXES

ERRORS = ["#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!"]


def first_workbook(*folders: str) -> Path:
    """The first ``.xlsx`` by name in the first folder that has one."""
    for folder in folders:
        if found := sorted(p for p in Path(folder).glob("*.xlsx") if not p.name.startswith("~$")):
            return found[0]
    raise FileNotFoundError(f"no workbook in {', '.join(folders)}")


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; an empty cell is an empty string, never null; a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', nullValue="\x00", emptyValue="", inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns]).fillna("")
    return df.select(columns) if columns else df


def sniff(data: bytes) -> tuple[str, str]:
    """(encoding, separator) of an upload: UTF-8 with or without mark, else Latin-1; the separator that occurs most in the head."""
    try:
        text, encoding = data.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = data.decode("latin-1"), "ISO-8859-1"
    try:
        return encoding, csv.Sniffer().sniff(text[:4096], ",;\t|").delimiter
    except csv.Error:
        return encoding, ","


def check_upload(name: str, data: bytes) -> str:
    """The suffix of an upload that may be read; says why otherwise."""
    suffix = Path(name).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError("the file must be CSV or XLSX")
    if not data:
        raise ValueError("the file is empty")
    if len(data) > MOST_BYTES:
        raise ValueError("the file is over 10 MB")
    return suffix


def read_upload(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """One uploaded file, small by its checked limits, as text columns with snake-case names and ``row_no`` from 2, as in a sheet."""
    suffix = check_upload(name, data)
    if suffix == ".xlsx":
        sheet = next(iter(sheets(data).values()))
        rows = [list(r) for r in sheet]
    else:
        encoding, sep = sniff(data)
        rows = list(csv.reader(StringIO(data.decode("utf-8-sig" if encoding == "UTF-8" else "latin-1")), delimiter=sep))
    if len(rows) < 2:
        raise ValueError("the file has no rows")
    if len(rows) - 1 > MOST_ROWS:
        raise ValueError(f"the file has over {MOST_ROWS:,} rows")
    head = column_names(rows[0])
    body = [(i, *[(r[j] if j < len(r) else None) for j in range(len(head))]) for i, r in enumerate(rows[1:], 2)]
    schema = T.StructType([T.StructField("row_no", T.LongType()), *[T.StructField(c, T.StringType()) for c in head]])
    return spark.createDataFrame(body, schema)


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def cells(data: bytes) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """``(sheet, row, column, value, formula)`` of every filled cell of a workbook; rows and columns from 0."""
    from io import BytesIO

    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", NS):
            path = targets[sheet.get(REL)].lstrip("/")
            root = ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            for row in root.iterfind("m:sheetData/m:row", NS):
                for c in row.iterfind("m:c", NS):
                    v, f = c.find("m:v", NS), c.find("m:f", NS)
                    if c.get("t") == "s":
                        value = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                    else:
                        value = None if v is None else v.text
                    yield sheet.get("name"), int(row.get("r")) - 1, _column(c.get("r")), value, None if f is None else "=" + (f.text or "")


def sheets(data: bytes) -> dict[str, list[tuple]]:
    """The rows of every sheet, as text, padded to the sheet's width."""
    out: dict[str, dict] = {}
    for name, r, c, value, _ in cells(data):
        out.setdefault(name, {})[r, c] = value
    return {n: [tuple(g.get((r, c)) for c in range(max(k[1] for k in g) + 1)) for r in range(max(k[0] for k in g) + 1)] for n, g in out.items()}


@dataclass
class _Book(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [_Book(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for sheet, r, c, value, formula in cells(f.read()):
                yield partition.path, sheet, r, c, value, formula


class WorkbookSource(DataSource):
    """``spark.read.format("workbook_cells").load(path)``: a row per filled cell; a task per file. Paths are local to the executors."""

    @classmethod
    def name(cls):
        return "workbook_cells"

    def schema(self):
        return "path string, sheet string, row_no int, column_no int, value string, formula string"

    def reader(self, schema):
        return WorkbookReader(self.options)


def load_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of a local workbook, all columns as text, names as in the sheet made unique, and its row number."""
    out = {}
    for name, rows in sheets(Path(path).read_bytes()).items():
        head = column_names(list(rows[0]))
        schema = T.StructType([T.StructField("row_no", T.LongType()), *[T.StructField(c, T.StringType()) for c in head]])
        out[name] = spark.createDataFrame([(i, *r) for i, r in enumerate(rows[1:], 2)], schema)
    return out


def cell_issues(cell_rows: DataFrame) -> DataFrame:
    """Cells that hold a formula or an error code, from rows of ``workbook_cells``."""
    kind = F.when(F.col("formula").isNotNull() | F.col("value").startswith("="), "formula").when(F.col("value").isin(ERRORS), "error")
    return cell_rows.withColumn("issue", kind).where("issue is not null")


def unresolved_cells(cell_rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """The formulas and error codes in the columns of review texts: ``sheet``, ``cell``, ``issue_type``, ``raw_value``.

    ``columns``: sheet -> names that its text column may have; the first row of a sheet has the names.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.btrim(c)), "[^a-z0-9]+", "_")
    named = [(sheet, "_".join("".join(ch if ch.isalnum() else " " for ch in n.lower()).split())) for sheet, names in columns.items() for n in names]
    names = cell_rows.sparkSession.createDataFrame(named, "sheet string, _name string")
    head = cell_rows.where("row_no = 0").select("path", "sheet", "column_no", clean(F.col("value")).alias("_name"))
    texts = head.join(F.broadcast(names), ["sheet", "_name"]).groupBy("path", "sheet").agg(F.min("column_no").alias("column_no"))
    bad = cell_issues(cell_rows.where("row_no > 0")).join(F.broadcast(texts), ["path", "sheet", "column_no"])
    kind = F.when(F.col("issue") == "formula", "formula_in_review_text").otherwise("excel_error")
    raw = F.coalesce("formula", "value")
    return bad.select("sheet", F.concat(cell_letters(F.col("column_no")), (F.col("row_no") + 1).cast("string")).alias("cell"), kind.alias("issue_type"), raw.alias("raw_value"))


def cell_letters(column_no: Column) -> Column:
    """A column's letters from its number (from 0): A to Z, then AA and so on, up to three letters."""
    letter = lambda n: F.char(F.lit(65) + n.cast("int"))
    n = column_no
    two = F.concat(letter(F.floor(n / 26) - 1), letter(n % 26))
    m = n - 702
    three = F.concat(letter(F.floor(m / 676)), letter(F.floor(m / 26) % 26), letter(m % 26))
    return F.when(n < 26, letter(n)).when(n < 702, two).otherwise(three)


def first_examples(issues: DataFrame, by: list[str], order: list[str], most: int = 25) -> DataFrame:
    """At most ``most`` rows of each group, the first in order, as a report shows them."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return issues.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


@dataclass(frozen=True)
class SheetSpec:
    """Which raw column each canonical one comes from in one sheet, and what its rows are."""

    name: str
    columns: dict[str, str]
    category: str = "umum"
    constants: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.select("row_no", *[F.col(c).alias(n) if c in df.columns else F.lit(None).cast("string").alias(n) for n, c in self.columns.items()])
        for n, v in self.constants.items():
            out = out.withColumn(n, F.lit(v))
        return out.withColumn("source_sheet", F.lit(self.name)).withColumn("category", F.lit(self.category))


def load_settings(path: str, required: tuple[str, ...] = ()) -> dict:
    """JSON or (by its ending) YAML settings with the fields that must be there; an empty file has none."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package") from e
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    if gone := [k for k in required if k not in data]:
        raise ValueError(f"{path} lacks {', '.join(gone)}")
    return data


def write_report(path: str, report: dict) -> Path:
    """A JSON report, written beside its place and then moved there, so a reader sees all of it or none."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(p.suffix + ".part")
    part.write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    part.replace(p)
    return p


def write_run(df: DataFrame, root: str, import_id: str) -> None:
    """One import run as a partition of its table; a run that is there already is an error."""
    checked_id(import_id)
    df.drop("import_id").write.mode("errorifexists").parquet(f"{root.rstrip('/')}/import_id={import_id}")


@contextlib.contextmanager
def run_lock(folder: str, seconds: float = 30.0):
    """One writer at a time in a local folder: a lock file that only one process can make. A lock that stays past ``seconds`` is an error."""
    lock = Path(folder, ".lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    end = time.monotonic() + seconds
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() > end:
                raise TimeoutError(f"{lock} is held by another writer") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def write_or_pend(text: str, path: str) -> tuple[str, Path]:
    """("written", path), or ("pending", path of a ``.pending`` file beside it) where the file is locked by the program that has it open."""
    p = Path(path)
    for name, q in (("written", p), ("pending", p.with_suffix(f".pending{p.suffix}"))):
        try:
            q.write_text(text, encoding="utf-8-sig")
        except PermissionError:
            continue
        return name, q
    raise PermissionError(f"neither {p} nor a pending file beside it can be written")


def write_run_geojson(store, root: str, import_id: str) -> Path:
    """The map of one run: its places with their top gap, as a file of the run."""
    return write_geojson(store.features("place"), str(Path(root, f"{import_id}.geojson")))


def read_run(root: str, import_id: str, ending: str) -> dict:
    """The stored summary or map of a run, by its id; unknown ids are an error."""
    p = Path(root, f"{checked_id(import_id)}{ending}")
    if not p.exists():
        raise FileNotFoundError(f"no run {import_id}")
    return json.loads(p.read_text(encoding="utf-8"))


def checked_id(import_id: str) -> str:
    if not re.fullmatch(r"imp-[0-9A-Za-z-]+", import_id):
        raise ValueError("not an import id")
    return import_id


def write_excel_csv(df: DataFrame, path: str) -> None:
    """CSV with header that spreadsheet programs open as UTF-8: the first name carries the byte-order mark."""
    df.toDF("﻿" + df.columns[0], *df.columns[1:]).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def feature_collection(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as text, from ``x``, ``y`` and a ``properties`` struct; a sink adds the brackets."""
    point = F.struct(F.array("x", "y").alias("coordinates"), F.lit("Point").alias("type"))
    return features.select(F.to_json(F.struct(point.alias("geometry"), "properties", F.lit("Feature").alias("type"))).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> Path:
    """A FeatureCollection file, streamed from the executors a feature at a time."""
    p = Path(path)
    part = p.with_suffix(p.suffix + ".part")
    with part.open("w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(feature_collection(features).toLocalIterator()):
            f.write(("," if i else "") + row[0])
        f.write("]}")
    part.replace(p)
    return p


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def artifact_index(paths: dict[str, str]) -> list[dict]:
    """Name, path, existence and size of each artifact."""
    return [{"name": n, "path": p, "exists": Path(p).exists(), "bytes": Path(p).stat().st_size if Path(p).exists() else 0} for n, p in paths.items()]
