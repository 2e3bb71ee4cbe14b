"""Documents cut into named sections: one row for each, without a join or a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Section
from ..functions import text as X
from .findings import Cut

_EDGE = " :-"


def between(one: Column, low: Column, at: Column, start: str, end: str | None) -> Column:
    """What a compact text has after the marker ``start``, found at ``at`` (from 1; 0: nowhere), up to ``end`` or its own end.

    ``low`` is the text in lower case: markers count in any case.  Letters whose case
    folding has another length (like the sharp s) keep their own places here.
    """
    begin = at + len(start)
    stop = F.position(F.lit(end.casefold()), low, begin) if end else F.lit(0)
    length = F.when(stop > 0, stop - begin).otherwise(F.length(one))
    return F.when(at == 0, "").otherwise(F.btrim(F.substring(one, begin, length), F.lit(_EDGE)))


def whole(section: Section) -> bool:
    return section.section_id == "document" or not section.start_marker


def _cut(docs: DataFrame, sections: Sequence[Section], text: str) -> tuple[DataFrame, list[Column]]:
    """The documents with helping columns, each made once, and the expressions of the sections' texts over them."""
    marked = [s for s in sections if not whole(s)]
    docs = docs.withColumn("s_text", F.coalesce(F.col(text), F.lit("")))
    if marked:
        docs = docs.withColumn("s_one", X.compact(F.col("s_text"))).withColumn("s_low", F.lower("s_one"))
        docs = docs.withColumns({f"s_at{i}": F.locate(s.start_marker.casefold(), F.col("s_low")) for i, s in enumerate(sections) if not whole(s)})
    one, low = F.col("s_one"), F.col("s_low")
    return docs, [X.normalize_lines(F.col("s_text")) if whole(s) else between(one, low, F.col(f"s_at{i}"), s.start_marker, s.end_marker) for i, s in enumerate(sections)]


def effective(sections: Sequence[Section]) -> list[Section]:
    """One definition for each id: the last one, in the first one's place."""
    return list({s.section_id: s for s in sections}.values())


def with_sections(docs: DataFrame, sections: Sequence[Section], text: str = "extracted_text") -> DataFrame:
    """A row for each document and section, with ``section_ord``, ``section`` and ``section_text`` added; null texts are empty."""
    sections = effective(sections)
    if not sections:
        return docs.select("*", F.lit(0).alias("section_ord"), F.lit("").alias("section"), F.lit("").alias("section_text")).where(F.lit(False))
    cut, texts = _cut(docs, sections, text)
    rows = [F.struct(F.lit(i).alias("section_ord"), F.lit(s.section_id).alias("section"), t.alias("section_text")) for i, (s, t) in enumerate(zip(sections, texts))]
    # The array is never empty; the outer form spares a test of that, which would make it twice.
    return cut.select(*docs.columns, F.inline_outer(F.array(*rows)))


def with_cuts(docs: DataFrame, sections: Sequence[Section], text: str = "extracted_text") -> tuple[DataFrame, list[tuple[str, Cut]]]:
    """The documents with the text of each section in a column of its own, and where each stands."""
    sections = effective(sections)
    cut, texts = _cut(docs, sections, text)
    named = cut.withColumns({f"s{i}_text": t for i, t in enumerate(texts)}) if texts else cut
    named = named.select(*docs.columns, *(f"s{i}_text" for i in range(len(texts))))
    return named, [(s.section_id, Cut(F.lit(s.section_id), F.lit(i), F.col(f"s{i}_text"), f"s{i}_")) for i, s in enumerate(sections)]


def with_section_map(docs: DataFrame, sections: Sequence[Section], text: str = "extracted_text") -> DataFrame:
    """The documents with all their sections as one map, ``sections``."""
    cut, cuts = with_cuts(docs, sections, text)
    pairs = [x for s, c in cuts for x in (F.lit(s), c.text)]
    return cut.select(*docs.columns, (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("sections"))
