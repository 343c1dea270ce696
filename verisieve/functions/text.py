"""Text Column functions.  Patterns are Unicode-aware where white space, word edges or case matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOPWORDS = "a an and are as at be because but by for from has have in is it of on or that the there these this those to was were while with".split()
ALIGN_STOPWORDS = sorted([*STOPWORDS, "its"])


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is used and in whatever lambdas."""
    return F.element_at(F.transform(F.array(x), lambda y: use(y)), 1)


def words_of(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs))


def clean(x: Column) -> Column:
    """White-space runs become one space, ends are trimmed, NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)\s+", " "))


def find_all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))


def content_tokens(x: Column, stop: list[str] = STOPWORDS) -> Column:
    """Distinct lower-case alphanumeric tokens without stop words, in order of first use."""
    return F.array_except(F.array_distinct(find_all(F.lower(clean(x)), "[a-z0-9]+")), words_of(stop))


def content_words(x: Column) -> Column:
    """Alphanumeric words without stop words, repeats kept."""
    return F.filter(find_all(F.lower(F.coalesce(x, F.lit(""))), "[a-z0-9]+"), lambda w: ~w.isin(ALIGN_STOPWORDS))


def normalize(x: Column) -> Column:
    """Lower case, articles dropped, everything but a-z and 0-9 becomes a space, spaces collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def numbers(normalized: Column) -> Column:
    return F.array_distinct(find_all(normalized, r"\d+(?:[.:]\d+)?"))


def characters(normalized: Column) -> Column:
    """Distinct characters other than the space."""
    return F.filter(F.array_distinct(F.split(F.replace(normalized, F.lit(" "), F.lit("")), "")), lambda c: c != "")


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """size(part) / size(whole), or ``empty`` if ``whole`` is empty."""
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(empty))


def parse_support(x: Column) -> Column:
    """1, 0 or 0.5: the first word of the first line that means yes or no."""
    line = F.element_at(F.split(F.trim(F.lower(F.coalesce(x, F.lit("")))), r"\n"), 1)
    # fixed values: words that mean yes and no
    yes, no = ["yes", "true", "correct", "supported", "support"], ["no", "false", "incorrect", "unsupported", "contradict"]
    first = F.try_element_at(F.filter(find_all(line, "[a-z']+"), lambda w: w.isin(yes + no)), F.lit(1))
    return F.when(first.isin(yes), 1.0).when(first.isin(no), 0.0).otherwise(0.5)
