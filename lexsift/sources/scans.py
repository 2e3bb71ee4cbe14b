"""Scans: everything becomes a table of documents (document_name, source_path, extracted_text)."""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import session
from ..functions import text as X
from ..schemas import analysis_ddl

#: From a file's bytes to its text.
Extractor = Callable[[bytes], str]


#: Splits up to which a scan is dealt out over the cores: beyond it moving all rows costs more than idle cores.
FEW_SPLITS = 16


def spread(scan: DataFrame) -> DataFrame:
    """A scan of very few splits, fewer than there are cores, dealt out over all of them; others as they are.

    A file of one large row group would otherwise keep all work on one core.  A scan of more
    than FEW_SPLITS splits never moves, however many cores there are.
    """
    splits, cores = scan.rdd.getNumPartitions(), scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if splits < min(cores, FEW_SPLITS) else scan


def read_table(path: str) -> DataFrame:
    """A Parquet table of texts."""
    return spread(session().read.parquet(path))


def pdf_text(content: bytes) -> str:
    """The text of a PDF's pages, joined by line feeds; RuntimeError without the package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages).strip()


def _named(df: DataFrame, text: Column) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    return df.select(F.element_at(F.split(path, "/"), -1).alias("document_name"), path.alias("source_path"), text.alias("extracted_text"))


def _metadata_path() -> Column:
    """The path of a row's file; Spark's metadata have it encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def binary_files(path: str, pattern: str) -> DataFrame:
    """Files right inside a directory, or one file."""
    return session().read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def pdf_documents(path: str, extractor: Extractor | None = None) -> DataFrame:
    """PDF files of a directory (not of those inside it), or one file; ``extractor`` replaces the default one."""
    read = extractor or pdf_text

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(read)

    files = binary_files(path, "*.[pP][dD][fF]" if path.lower().endswith(".pdf") else "*.pdf")
    return _named(files, F.pandas_udf(T.StringType())(run)("content"))


def file_inventory(path: str, pattern: str = "*.pdf") -> DataFrame:
    """Names and sizes of files; their content isn't read."""
    return binary_files(path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("document_name"), F.col("length").alias("size_bytes")).orderBy("document_name")


def text_documents(path: str, pattern: str = "*.txt") -> DataFrame:
    """Text files, each one document."""
    return _named(session().read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(_metadata_path().alias("path"), "value"), F.col("value"))


def html_documents(path: str, pattern: str = "*.html") -> DataFrame:
    """HTML files, each one document, as plain text."""
    return _named(session().read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(_metadata_path().alias("path"), "value"), X.strip_markup(F.col("value")))


def table_documents(df: DataFrame, name: str | Column, text: str | Column, source: str = "table") -> DataFrame:
    """Any table with a name and a text column."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(column(name).cast("string").alias("document_name"), F.lit(source).alias("source_path"), column(text).alias("extracted_text"))


def read_cases(path: str, required: Sequence[str] = ("text", "control_family")) -> DataFrame:
    """Test cases from a CSV file with quoted line feeds; empty cells are empty strings, missing columns raise ValueError."""
    cases = session().read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(required) - set(cases.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return cases.na.fill("")


def load_results(path: str) -> DataFrame:
    """Stored analyses, from one JSON array or from a folder of JSON lines; keys that aren't known raise ValueError."""
    spark = session()
    reader = spark.read.schema(analysis_ddl())
    lines = path.rstrip("/").endswith(".jsonl")
    loaded = reader.option("multiLine", not lines).json(path)
    inferred = spark.read.option("multiLine", not lines).json(path).schema
    if "findings" in inferred.names and isinstance(inferred["findings"].dataType, T.ArrayType) and isinstance(inferred["findings"].dataType.elementType, T.StructType):
        known = set(loaded.schema["findings"].dataType.elementType.names)
        odd = sorted(set(inferred["findings"].dataType.elementType.names) - known)
        if odd:
            raise ValueError(f"unknown fields of findings: {', '.join(odd)}")
    findings = loaded.schema["findings"].dataType
    return loaded.select("document_name", "source_path", F.coalesce("extracted_text", F.lit("")).alias("extracted_text"), F.coalesce("sections", F.create_map().cast("map<string,string>")).alias("sections"), F.coalesce("findings", F.array().cast(findings)).alias("findings"), "metadata")


def findings_of(results: DataFrame) -> DataFrame:
    """The flat table of stored analyses, one row of nulls for a document without findings."""
    from ..schemas import FLAT_COLUMNS

    one = results.select("document_name", "source_path", F.size("findings").cast("long").alias("finding_count"), F.explode_outer("findings").alias("f"))
    return one.select(*(F.col(c) if c in ("document_name", "source_path", "finding_count") else F.col(f"f.{c}").alias(c) for c in FLAT_COLUMNS))
