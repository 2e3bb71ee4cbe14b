"""Sinks: distributed tables, and single files for small results."""

from __future__ import annotations

import csv
import json
import os
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..plans.engine import Analysis


def write_json_lines(nested: DataFrame, path: str) -> None:
    """Analyses as a folder of JSON lines, nulls kept."""
    nested.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_findings(flat: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Flat findings as a folder of Parquet, ORC or CSV files."""
    writer = flat.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def save_results(analysis: Analysis | DataFrame, path: str) -> str:
    """Analyses as one JSON array, ASCII only, indented by two; rows pass through the driver one partition at a time."""
    nested = analysis if isinstance(analysis, DataFrame) else analysis.nested()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = nested.orderBy("source_path", "document_name").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        first = True
        for row in rows:
            item = json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=True)
            f.write(("[\n  " if first else ",\n  ") + item.replace("\n", "\n  "))
            first = False
        f.write("[]" if first else "\n]")
    return path


def save_csv(flat: DataFrame, path: str) -> str:
    """Findings as one CSV file with a byte order mark; rows pass through the driver one partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(flat.columns)
        for row in flat.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
    return path


def save_review(flat: DataFrame, folder: str) -> list[str]:
    """Four CSV files: all findings, those of general rules, those of article 9, and the review queue."""
    from ..operators import report

    flagged = report.prioritized(report.with_flags(flat))
    parts = {"findings_all": flagged, "findings_generic": flagged.where("is_generic"), "findings_article9": flagged.where("is_article9"), "human_review": report.review_queue(flagged)}
    return [save_csv(df, os.path.join(folder, f"{name}.csv")) for name, df in parts.items()]


def print_summary(summary: DataFrame) -> dict:
    """The corpus summary as JSON on standard output."""
    row = summary.first().asDict(recursive=True)
    print(json.dumps(row, indent=2, ensure_ascii=False))
    return row
