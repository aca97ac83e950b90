"""Text functions on columns: normalising, tokens, phrases, headings, table-of-contents lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a JVM pattern's \s leaves out.
SPACE = r"[\s\x1C-\x1F\u0085   ]+"
TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


#: What ``SPACE`` finds besides single blanks and line ends. To look for each takes a fifth of the time of a pattern.
UNEVEN = (*"\t\v\f\r\x1c\x1d\x1e\x1f\u0085\u1680\u2028\u2029", "  ")
DASHES, QUOTES = "—–−", "’‘"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no function for it, but the library that its collations come with has."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNull() | (F.char_length(text) == F.octet_length(text)), text).otherwise(composed)


def spaced(text: Column) -> Column:
    """White space runs as one blank. Most texts have single blanks and line ends only, which need no pattern."""
    return let(F.replace(text, F.lit("\n"), F.lit(" ")), lambda t: F.when(holds_any(t, UNEVEN), F.regexp_replace(t, SPACE, " ")).otherwise(t))


def folded(text: Column) -> Column:
    """Lower case, dashes and quotes unified, white space runs as one space, trimmed; null is empty."""

    def unified(t: Column) -> Column:
        return F.when(holds_any(t, DASHES + QUOTES), F.translate(t, DASHES + QUOTES, "-" * len(DASHES) + "'" * len(QUOTES))).otherwise(t)

    return F.trim(spaced(let(F.lower(F.coalesce(text, F.lit(""))), unified)))


def normalized(text: Column, composed: bool = False) -> Column:
    """The form in which texts are compared. ``composed`` says that the text is in NFKC already."""
    return folded(text if composed else nfkc(text))


def tokens(norm: Column) -> Column:
    """Runs of letters and digits; those joined by hyphens are one token, followed by its parts."""

    def found(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))

    def with_parts(t: Column) -> Column:
        return F.flatten(F.transform(found(t), lambda x: F.when(F.contains(x, F.lit("-")), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))

    return let(norm, lambda t: F.when(F.contains(t, F.lit("-")), with_parts(t)).otherwise(found(t)))


def terms(norm: Column) -> Column:
    """Different tokens in the order of their first places."""
    return F.array_distinct(tokens(norm))


def phrases(query: Column, composed: bool = True) -> Column:
    """The normalised contents of straight double quotes, without empty ones."""
    found = F.regexp_extract_all(query if composed else nfkc(F.translate(query, "＂", " ")), F.lit('"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(found, folded), lambda p: p != "")


def term_counts(toks: Column) -> Column:
    """(term, tf, positions) for each different token of an array, as an array of structs."""
    return F.transform(
        F.array_distinct(toks),
        lambda t: F.struct(
            t.alias("term"),
            F.filter(F.transform(toks, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("positions"),
        ),
    )


def compact(text: Column) -> Column:
    """White space runs as one space, trimmed; null is empty."""
    return F.trim(spaced(F.coalesce(text, F.lit(""))))


def word_count(text: Column) -> Column:
    """Tokens as words between white space: the stand-in where no model's tokenizer is plugged in."""
    blanks = let(compact(text), lambda t: F.when(t == "", -1).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))))
    return (blanks + 1).cast("int")
