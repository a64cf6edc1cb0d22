"""Page furniture: running heads and feet, page marks and navigation lines.

Lines are an array column, and each operator is a Column over it, so a document's cleaning needs
no shuffle; :func:`repeated_lines` is the same count as a window over exploded lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.functions.text import bound, digit_mask, squeeze

# Patterns (fixed values).
CONTACT = r"(@|www\.|http|\+\d{2}[\s-]|\bCIN\b|\bGST\b|\bpage\s+\d|\bpvt\.?\s*ltd\b|\bprivate\s+limited\b|\bcorporate\s+office\b|\bregd\.?\s*office\b)"
WORDS = r"(?:confidential|\bpage\b|all\s+rights\s+reserved|©|copyright\s+\d{4}|for\s+software\s+testing|not\s+a\s+real\s+contract)"
PAGE_MARK = r"(?i)(\bpage\s+\d|\bp\.\s*\d+\b|\b\d+\s+of\s+\d+\b)"
NAVIGATION = r"(?i)^\s*(?:clauses?|sections?|articles?)\s+\d{1,3}\s*(?:-|–|—|to)\s*\d{1,3}\s*(?:\||:|$)"
CAPITALS = r"^\s*[A-Z][A-Z0-9 ,&'/()\-]{2,70}\s*$"
NUMBERED = r"^\s*(?:\d{1,2}(?:\.\d{1,2})*[.)]?|\([a-z0-9]{1,3}\))\s"
MIN_LINE, SHORT_LINE, SHORT_WORDS = 6, 120, 16


def contact(line: Column) -> Column:
    return line.rlike("(?i)" + CONTACT)


def furniture_like(line: Column) -> Column:
    return contact(line) | line.rlike("(?i)" + WORDS)


def line_key(line: Column) -> Column:
    """What a squeezed line is counted by: its digits count only in lines that are no furniture."""
    return F.when(furniture_like(line), digit_mask(line)).otherwise(line)


def counted(line: Column) -> Column:
    """Whether a squeezed line is counted at all."""
    words = F.size(F.filter(F.split(line, " "), lambda w: w != ""))
    return (F.length(line) >= MIN_LINE) & (((F.length(line) <= SHORT_LINE) & (words <= SHORT_WORDS)) | contact(line))


def repeated_lines(lines: DataFrame, doc: str = "doc_id", flags: str = "(?U)") -> DataFrame:
    """lines (doc, line_no, line) with ``key`` and ``repeats``, how many counted lines of the document share the key."""
    norm = squeeze(F.col("line"), flags)
    own = lines.withColumn("norm", norm).withColumn("key", line_key(F.col("norm")))
    return own.withColumn("repeats", F.sum(counted(F.col("norm")).cast("int")).over(Window.partitionBy(doc, "key"))).drop("norm")


def strip_repeating_lines(text: Column, min_repeats: int = 2) -> Column:
    """A text without all copies of the lines whose key is counted min_repeats times or more.

    Lines of one key are equal once their digits are masked, so only lines that have such an equal
    are looked at by the patterns.
    """
    return bound(text, lambda x: bound(F.transform(F.split(x, "\n"), lambda line: squeeze(line)), lambda norms: _stripped(x, norms, min_repeats)))


def _often(keys: Column, min_repeats: int) -> Column:
    """Keys that are there min_repeats times or more."""
    # sorted, so that equal ones are neighbours at a distance of min_repeats - 1
    gap = min_repeats - 1
    ahead = lambda own: F.slice(F.concat(own, F.array_repeat(F.lit(None).cast("string"), gap)), F.lit(1 + gap), F.greatest(F.size(own), F.lit(0)))
    return bound(F.sort_array(keys), lambda own: F.array_distinct(F.filter(F.zip_with(own, ahead(own), lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull())))


def _stripped(text: Column, norms: Column, min_repeats: int) -> Column:
    alike = _often(F.transform(F.filter(norms, lambda n: F.length(n) >= MIN_LINE), digit_mask), min_repeats)

    def without(alike: Column) -> Column:
        key = lambda n: F.when(F.array_contains(alike, digit_mask(n)), F.struct(line_key(n).alias("key"), counted(n).alias("counted")))
        keyed = F.zip_with(F.split(text, "\n"), F.transform(norms, key), lambda line, k: F.struct(line.alias("line"), k["key"].alias("key"), k["counted"].alias("counted")))
        return F.when(F.size(alike) == 0, text).otherwise(bound(keyed, lambda ks: _without(ks, min_repeats)))

    return bound(alike, without)


def _without(keyed: Column, min_repeats: int) -> Column:
    gone = _often(F.transform(F.filter(keyed, lambda s: s["counted"]), lambda s: s["key"]), min_repeats)
    kept = lambda gone: F.filter(keyed, lambda s: s["key"].isNull() | ~F.array_contains(gone, s["key"]))
    return F.array_join(F.transform(bound(gone, kept), lambda s: s["line"]), "\n")


def strip_section_banners(text: Column) -> Column:
    """A text without navigation lines and the capital titles in up to three lines above each."""
    return bound(text, _without_banners)


def _without_banners(text: Column) -> Column:
    lines = F.split(text, "\n")
    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(NAVIGATION).alias("nav"), (F.trim(x) == "").alias("blank"), (x.rlike(CAPITALS) & ~x.rlike(NUMBERED)).alias("title")))

    def goes(rows: Column, s: Column, i: Column) -> Column:
        at = lambda k: F.get(rows, i + k)
        through = lambda k: F.coalesce(at(k)["blank"] | at(k)["title"], F.lit(False))
        is_nav = lambda k: F.coalesce(at(k)["nav"], F.lit(False))
        above = is_nav(1) | (through(1) & is_nav(2)) | (through(1) & through(2) & is_nav(3))
        return s["nav"] | (s["title"] & above)

    kept = bound(rows, lambda rs: F.array_join(F.transform(F.filter(rs, lambda s, i: ~goes(rs, s, i)), lambda s: s["line"]), "\n"))
    return F.when(text.rlike("(?m)" + NAVIGATION), kept).otherwise(text)


def positional_furniture(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """pages (doc, page_no, line_no, line) without what repeats in the first or last two lines that are not blank.

    A document of one page stays as it is.
    """
    page = Window.partitionBy(doc, "page_no")
    own = pages.withColumn("filled", (F.trim("line") != "").cast("int"))
    own = own.withColumn("down", F.sum("filled").over(page.orderBy("line_no"))).withColumn("up", F.sum("filled").over(page.orderBy(F.desc("line_no"))))
    own = own.withColumn("band", (F.col("filled") == 1) & ((F.col("down") <= 2) | (F.col("up") <= 2)))
    masked = digit_mask(squeeze(F.col("line")))
    own = own.withColumn("masked", F.when(F.col("band"), masked))
    # a page counts each of its band lines; the window is one key of one document
    own = own.withColumn("seen", F.when(F.col("band"), F.count(F.lit(1)).over(Window.partitionBy(doc, "masked"))).otherwise(F.lit(0)))
    own = own.withColumn("pages", F.max("page_no").over(Window.partitionBy(doc)) - F.min("page_no").over(Window.partitionBy(doc)) + 1)
    repeated = (F.col("seen") >= 2) & (furniture_like(F.col("line")) | (F.length(squeeze(F.col("line"))) <= SHORT_LINE))
    gone = F.col("band") & (F.col("pages") >= 2) & (repeated | F.col("line").rlike(PAGE_MARK))
    return own.where(~F.coalesce(gone, F.lit(False))).select(*pages.columns)
