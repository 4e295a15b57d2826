"""Texts cut into sections, within their row: arrays of (seq, heading, level, body).

Lines are split, heading lines found and the lines between them joined again inside one expression, so that no line and
no text is shuffled. Array forms take and give Columns; frames of rows (doc_id, seq, heading, level, body) come from
`exploded`. A null text has no sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext import patterns as P
from loomtext.functions.text import clean_body, col, strip, universal_newlines, word_count

Rule = Callable[[Column], Column]


def let(value: Column, use: Rule) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut(text, is_heading: Rule, heading: Rule, level: Rule | None = None, first_level: int = 2) -> Column:
    """Sections of all lines; those before any heading form section 0, whose heading is empty."""
    level = level or (lambda _: F.lit(2))

    def of(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())

        def section(heads: Column, at: Column, k: Column) -> Column:
            line, end = F.get(lines, at), F.coalesce(F.get(heads, k), F.size(lines))
            return F.struct(
                k.cast("bigint").alias("seq"), F.when(at >= 0, heading(line)).otherwise("").alias("heading"), F.when(at >= 0, level(line)).otherwise(first_level).cast("int").alias("level"),
                F.array_join(F.slice(lines, at + 2, end - at - 1), "\n").alias("body"),
            )

        return let(places, lambda heads: F.transform(F.concat(F.array(F.lit(-1)), heads), lambda at, k: section(heads, at, k)))

    return F.when(col(text).isNotNull(), let(F.split(universal_newlines(text), "\n"), of))


def _made(s: Column, body: Column, heading: Column | None = None, level: Column | None = None) -> Column:
    return F.struct(s["seq"].alias("seq"), (s["heading"] if heading is None else heading).alias("heading"), (s["level"] if level is None else level).alias("level"), body.alias("body"))


def _filled(sections: Column) -> Column:
    return F.filter(sections, lambda s: (s["heading"] != "") | (s["body"] != ""))


def markdown(text, pdf_cleanup: bool = True) -> Column:
    """By lines of one to six `#`; headings count in code fences too. Sections with neither heading nor body go."""
    hashes, title = lambda x: F.length(F.regexp_extract(x, P.MD_HEADING, 1)), lambda x: strip(F.regexp_extract(x, P.MD_HEADING, 2))
    found = _cut(text, lambda x: x.rlike(P.MD_HEADING), title, hashes)
    return let(_filled(F.transform(found, lambda s: _made(s, clean_body(s["body"], pdf_cleanup)))), refined)


def converted(text) -> Column:
    """By lines of `## ` alone; a title line before the first is dropped, as are sections without body."""
    found = _cut(text, lambda x: F.startswith(x, F.lit("## ")), lambda x: strip(F.substring(x, 4, 1 << 30)))
    untitled = lambda b: F.array_join(F.filter(F.split(b, "\n"), lambda x: ~F.startswith(x, F.lit("# "))), "\n")
    found = F.transform(found, lambda s: _made(s, strip(F.when(s["seq"] == 0, untitled(s["body"])).otherwise(s["body"]))))
    return F.filter(found, lambda s: s["body"] != "")


def plain(text) -> Column:
    """By lines in capitals or ending in a colon."""
    is_heading = lambda x: strip(x).rlike(P.CAPS_HEADING) | strip(x).rlike(P.COLON_HEADING)
    found = _cut(text, is_heading, lambda x: F.regexp_replace(strip(x), r":+\z", ""))
    return _filled(F.transform(found, lambda s: _made(s, strip(s["body"]))))


def whole(text) -> Column:
    """One section of all the text, runs of blank lines made one."""
    return F.when(col(text).isNotNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("heading"), F.lit(2).alias("level"), F.regexp_replace(col(text), "\n{3,}", "\n\n").alias("body"))))


def polish(text) -> Column:
    """By lines of `## `, kept whole as headings; what stands before is section 0."""
    return F.transform(_cut(text, lambda x: F.startswith(x, F.lit("## ")), lambda x: x), lambda s: _made(s, strip(s["body"])))


def refined(sections: Column) -> Column:
    """Headed sections go a level down if any of them is of level 1."""
    least = F.array_min(F.transform(F.filter(sections, lambda s: s["heading"] != ""), lambda s: s["level"]))
    return let(least, lambda m: F.transform(sections, lambda s: _made(s, s["body"], level=F.when((s["heading"] != "") & (m == 1), s["level"] + 1).otherwise(s["level"]))))


def _first_seq(sections: Column, is_it: Rule) -> Column:
    return F.array_min(F.transform(F.filter(sections, lambda s: is_it(s["heading"])), lambda s: s["seq"]))


def _is_abstract(heading: Column) -> Column:
    return F.lower(strip(heading)) == "abstract"


def without_references(sections) -> Column:
    """Nothing from the first heading of references on."""
    sections = col(sections)
    return let(_first_seq(sections, lambda h: strip(h).rlike(P.REFERENCES)), lambda cut: F.filter(sections, lambda s: cut.isNull() | (s["seq"] < cut)))


def abstract(sections) -> Column:
    """The body of the first section headed `abstract`, or an empty text."""
    return F.coalesce(F.get(F.transform(F.filter(col(sections), lambda s: _is_abstract(s["heading"])), lambda s: s["body"]), 0), F.lit(""))


def without_abstract(sections) -> Column:
    sections = col(sections)
    return let(_first_seq(sections, _is_abstract), lambda at: F.filter(sections, lambda s: at.isNull() | (s["seq"] != at)))


def first_heading(sections, default: str | Column = "Untitled") -> Column:
    """The first heading that isn't empty."""
    named = F.filter(F.transform(col(sections), lambda s: s["heading"]), lambda h: h != "")
    return F.coalesce(F.get(named, 0), F.lit(default) if isinstance(default, str) else default)


def body_text(sections, with_headings: bool = True) -> Column:
    """Headings and bodies in order, with blank lines between."""
    each = F.flatten(F.transform(col(sections), lambda s: F.array(s["heading"], s["body"]) if with_headings else F.array(s["body"])))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n\n")


def words(sections, headings: bool) -> Column:
    """Words of all bodies, and of headings for articles and local files."""
    each = lambda s: word_count(s["body"]) + (word_count(s["heading"]) if headings else 0)
    return F.aggregate(col(sections), F.lit(0).cast("bigint"), lambda n, s: n + each(s))


def exploded(docs: DataFrame, sections: Column, *keep: str) -> DataFrame:
    """Rows (doc_id, columns in `keep`, seq, heading, level, body) of an array of sections."""
    return docs.select("doc_id", *keep, F.explode(sections).alias("s")).select("doc_id", *keep, "s.seq", "s.heading", "s.level", "s.body")


def markdown_sections(docs: DataFrame, pdf_cleanup: bool = True) -> DataFrame:
    return exploded(docs, markdown("text", pdf_cleanup))


def converter_sections(docs: DataFrame) -> DataFrame:
    return exploded(docs, converted("text"))


def text_sections(docs: DataFrame) -> DataFrame:
    return exploded(docs, plain("text"))


def polish_sections(docs: DataFrame) -> DataFrame:
    return exploded(docs, polish("text"))
