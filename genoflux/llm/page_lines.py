"""Lines of pages by host, in DataFrame operations only; shared by the line rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition.
SPACES = " \t\n\x0b\x0c\r"
_BLANKS = r"[\x20\x09-\x0D]+"


def normal(line: Column) -> Column:
    """A line as it is compared: lower case, words with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(line), _BLANKS, " "), F.lit(SPACES))


def normal_lines(text: Column) -> Column:
    """Normalised lines of a text. One pass over the whole text: blanks inside lines shrink, then lines are split and trimmed. Lines end at \\n
    alone: U+0085, U+2028 and U+2029 are characters of a line like others, which the pattern has to be told."""
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.split(F.regexp_replace(flat, r"(?md)^ | $", ""), "\n")


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """df with named columns that are computed once a row: a generator of one row, through which the optimiser neither
    pushes filters nor merges projections that would repeat the work."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def page_key(copies_once: bool = False) -> Column:
    """What tells pages apart: doc_id and text, or the text alone where copies are to count as one page."""
    return F.xxhash64("text") if copies_once else F.xxhash64("doc_id", "text")


def host_lines(pages: DataFrame) -> DataFrame:
    """(host, line, pages): on how many pages (host, page, hashes) of its host a line's hash occurs.

    A page's lines count once, and rows whose `page` is equal are one page. Both counts are sums that start on the
    map side, so a line of any frequency is one row per task.
    """
    one = pages.select("host", "page", F.explode(F.array_distinct("hashes")).alias("line"))
    return one.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
