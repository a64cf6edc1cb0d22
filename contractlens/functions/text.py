"""Text expressions: Column in, Column out, nothing leaves the JVM.

Two registers of white space and word classes: the faithful one is Unicode (``(?U)``), the
portable one is ASCII and has the same meaning in other SQL engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNICODE = "(?U)"
#: A character that texts don't hold, to cut at.
CUT = "\x01"


def strip(x: Column, flags: str = UNICODE) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(F.regexp_replace(x, flags + r"^\s+", ""), flags + r"\s+\z", "")


def squeeze(x: Column, flags: str = UNICODE) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, flags + r"\s+", " "))


def unix_lines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def digit_mask(x: Column) -> Column:
    return F.regexp_replace(x, r"\d+", "#")


def matches(x: Column, pattern: str) -> Column:
    """Whether a pattern occurs, without regard to case, null as no."""
    return F.coalesce(x.rlike("(?iuU)" + pattern), F.lit(False))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(x: Column) -> Column:
    """Distinct tokens of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def sentences(x: Column, flags: str = UNICODE) -> Column:
    """Pieces of the squeezed text after each full stop or semicolon that white space follows."""
    return F.split(F.regexp_replace(squeeze(x, flags), r"([.;])\s+", "$1" + CUT), CUT)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def clause_id(doc_id: Column, order: Column, text: Column) -> Column:
    """doc_id, order in three digits, and eight digits of the stripped text's SHA-1."""
    return F.concat(doc_id.cast("string"), F.lit("::"), F.lpad(order.cast("string"), 3, "0"), F.lit("::"), F.substring(F.sha1(strip(text).cast("binary")), 1, 8))


def text_digest(text: Column) -> Column:
    """SHA-1 of the lower-cased squeezed text."""
    return F.sha1(F.lower(squeeze(text)).cast("binary"))


def heading_key(heading: Column) -> Column:
    """Words of a heading without its number: those over two letters, or all if there are none."""
    bare = F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"^[\s\d.()ivxlc]*[\s.):]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(bare, "[^a-z]+", " ")), " "), lambda w: F.length(w) >= 2)
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(F.when(F.size(long) > 0, long).otherwise(words))


def evidence(x: Column, pattern: str, width: int = 90) -> Column:
    """The first match widened to white space, squeezed and cut; null without a match."""
    found = squeeze(F.regexp_extract(x, r"(?iuUs)\S*?(?:" + pattern + r")\S*", 0))
    return F.when(found == "", F.lit(None)).otherwise(F.when(F.length(found) > width, F.concat(F.left(found, F.lit(width)), F.lit("..."))).otherwise(found))


def contains_any(x: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(x, p))


def count_present(x: Column, phrases) -> Column:
    """How many of the phrases occur."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(x, p)))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often it is read.

    Neighbouring projections are merged, and a struct whose fields are read is then written out
    at each use; a one-row generator between them keeps them apart.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_built: dict[tuple, tuple] = {}


def once(build: Callable[..., Column], *names: str) -> Column:
    """build(*columns of these names), made once in a process: large expressions take thousands of calls to put together."""
    gateway, key = SparkContext._gateway, (build, *names)
    if _built.get(key, (None,))[0] is not gateway:
        _built[key] = gateway, build(*map(F.col, names))
    return _built[key][1]
