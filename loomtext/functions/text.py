"""String functions as Column builders. Null gives null unless told otherwise."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext import patterns as P


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(x), rf"^{P.WS}+|{P.WS}+\z", "")


def words(x) -> Column:
    return F.filter(F.split(col(x), P.WS + "+"), lambda t: t != "")


def word_count(x) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(words(x)), F.lit(0)).cast("bigint")


def collapse(x, blanks: str = P.WS + "+") -> Column:
    return F.regexp_replace(col(x), blanks, " ")


def universal_newlines(x) -> Column:
    return F.regexp_replace(col(x), "\r\n?", "\n")


def is_cjk_dominant(x, threshold: float = 0.3) -> Column:
    """More than `threshold` of all characters but white space are CJK; False for none."""
    x = col(x)
    total = F.length(F.regexp_replace(x, P.WS, ""))
    return F.coalesce(F.when(total > 0, F.regexp_count(x, F.lit(P.CJK)) / total > threshold), F.lit(False))


def has_math(x) -> Column:
    return col(x).rlike(P.MATH)


def is_link_only(x) -> Column:
    return strip(F.regexp_replace(col(x), P.URL, "")) == ""


def urls(x) -> Column:
    return F.regexp_extract_all(col(x), F.lit(P.URL), F.lit(0))


def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def _normalised(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


# Python functions become UDFs where they are used: a worker that imports this module has no session.
def unescape_html(x) -> Column:
    return F.pandas_udf(_unescaped, "string")(col(x))


def nfkc(x) -> Column:
    return F.pandas_udf(_normalised, "string")(col(x))


def slugify(x, max_length: int = 80, normalise: bool = True) -> Column:
    """A file name's part: letters, digits and single hyphens; `untitled` where nothing is left."""
    s = F.lower(nfkc(col(x)) if normalise else col(x))
    s = F.regexp_replace(s, rf"(?:{P.WS}|_)+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\-]", ""), "-{2,}", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, r"^-+|-+\z", ""), F.lit(max_length)), r"-+\z", "")
    return F.when(s == "", "untitled").otherwise(s)


def make_title(x, max_length: int = 80) -> Column:
    """The first characters on one line, cut at a word with an ellipsis."""
    x = col(x)
    head = F.translate(F.left(x, F.lit(max_length)), "\n", " ")
    return F.when(F.length(x) <= max_length, head).otherwise(F.concat(F.regexp_replace(head, r"^([\s\S]*) [^ ]*\z", "$1"), F.lit("...")))


def escape_yaml(x) -> Column:
    return F.replace(F.replace(col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def strip_tags(x) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), P.WORD_STAMP, ""), P.TAG, "")


def normalise_language(x) -> Column:
    """The part before a hyphen, in lower case; null if it is longer than three letters."""
    base = F.lower(F.split_part(col(x), F.lit("-"), F.lit(1)))
    return F.when(F.length(base) <= 3, base)


def estimate_tokens(x, cjk: bool = False) -> Column:
    n = F.length(col(x))
    return F.greatest(F.lit(1), F.floor(n / 1.5) if cjk else F.floor(n / 4)).cast("bigint")


def clean_body(x, pdf_cleanup: bool = True) -> Column:
    s = F.regexp_replace(strip(x), "\n{3,}", "\n\n")
    if pdf_cleanup:
        s = F.regexp_replace(F.regexp_replace(s, P.IMAGE_REF, ""), P.HYPHEN_BREAK, "$1$2")
    return strip(s)


def table_markdown(cells: Column) -> Column:
    """Rows of cells as lines, a rule after the first."""
    lines = F.transform(cells, lambda row: F.array_join(row, " | "))
    rule = F.array_join(F.transform(cells[0], lambda _: F.lit("---")), " | ")
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def quote_notes(x) -> Column:
    return F.concat(F.lit("> **Speaker Notes:** "), F.replace(col(x), F.lit("\n"), F.lit("\n> ")))


def any_of(x, parts) -> Column:
    """Whether any of the substrings occurs."""
    return reduce(lambda a, b: a | b, [F.contains(col(x), F.lit(p)) for p in parts])
