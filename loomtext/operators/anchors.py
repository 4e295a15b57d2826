"""Pictures put after the words that came before them on their page.

A document's sections and pictures are arrays in its row. One automaton over the document's anchor texts goes through each
body once and gives all places of all anchors; then the pictures take theirs in order. A picture goes to the first section
that still has a place for its anchor: places of an anchor are taken one after the other without overlap, so that pictures
with equal anchors go to successive ones, and a place that an earlier picture's line has cut in two is none any more.
Descriptions that have been put in are not searched. Where two lines go to the same place, the later one stands first.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import ship
from loomtext.sources.structured import SECTIONS

_PICTURES = "array<struct<seq:bigint,anchor:string,description:string>>"
_PLACES = "array<struct<seq:bigint,section:bigint,at:int>>"
_SECTION = pa.struct([("seq", pa.int64()), ("heading", pa.string()), ("level", pa.int32()), ("body", pa.string())])
_PLACE = pa.struct([("seq", pa.int64()), ("section", pa.int64()), ("at", pa.int32())])


def line(description: str) -> str:
    return f"> [Image: {description.strip()}]"


def occurrences(anchors: set[str], bodies: list[str]) -> dict[tuple[int, str], list[int]]:
    """Where each anchor begins in each body, in order."""
    found: dict[tuple[int, str], list[int]] = {}
    automaton = ahocorasick.Automaton()
    for anchor in anchors:
        automaton.add_word(anchor, anchor)
    if anchors:
        automaton.make_automaton()
        for i, body in enumerate(bodies):
            for end, anchor in automaton.iter(body):
                found.setdefault((i, anchor), []).append(end + 1 - len(anchor))
    return found


def placed(bodies: list[str], anchors: list[str]) -> list[tuple[int, int] | None]:
    """For each anchor in order, the section and offset behind the place that it takes, in the bodies as they are given."""
    found = occurrences({a for a in anchors if a}, bodies)
    cuts: list[list[int]] = [[] for _ in bodies]
    next_of: dict[tuple[int, str], int] = {}
    free_from: dict[tuple[int, str], int] = {}
    out: list[tuple[int, int] | None] = []
    for anchor in anchors:
        out.append(None)
        for i in range(len(bodies)) if anchor else ():
            key = (i, anchor)
            starts = found.get(key)
            if not starts:
                continue
            n, first, size = next_of.get(key, 0), free_from.get(key, 0), len(anchor)
            while n < len(starts):
                start = starts[n]
                after = bisect_left(cuts[i], start + 1)
                if start >= first and not (after < len(cuts[i]) and cuts[i][after] < start + size):
                    break
                n += 1
            next_of[key] = n
            if n < len(starts):
                end = starts[n] + size
                free_from[key] = end
                insort(cuts[i], end)
                out[-1] = (i, end)
                break
    return out


def filled(sections: list[dict], pictures: list[dict]) -> tuple[list[dict], list[dict]]:
    """Sections with the pictures' lines, and where each went."""
    told = [p for p in pictures if p["description"]]
    where = placed([s["body"] or "" for s in sections], [p["anchor"] or "" for p in told])
    lines: list[dict[int, list[str]]] = [{} for _ in sections]
    for picture, spot in zip(told, where):
        if spot:
            lines[spot[0]].setdefault(spot[1], []).append(f"\n\n{line(picture['description'])}\n")
    out = []
    for section, at in zip(sections, lines):
        body, pieces, last = section["body"] or "", [], 0
        for end in sorted(at):
            pieces += [body[last:end], *reversed(at[end])]
            last = end
        out.append(section | {"body": "".join([*pieces, body[last:]])} if at else section)
    left = [line(p["description"]) for p, spot in zip(told, where) if not spot]
    if left:
        out.append({"seq": max((s["seq"] for s in sections), default=-1) + 1, "heading": "Figures", "level": 2, "body": "\n\n".join(left)})
    places = [{"seq": p["seq"], "section": sections[spot[0]]["seq"] if spot else None, "at": spot[1] if spot else None} for p, spot in zip(told, where)]
    return out, places


def _filled(sections: pa.Array, pictures: pa.Array) -> pa.Array:
    made, places = [], []
    for own, more in zip(sections.to_pylist(), pictures.to_pylist()):
        a, b = (None, None) if more is None else filled(own or [], sorted(more, key=lambda p: p["seq"]))
        made.append(a)
        places.append(b)
    return pa.StructArray.from_arrays([pa.array(made, pa.list_(_SECTION)), pa.array(places, pa.list_(_PLACE))], names=["sections", "places"])


def insert_at_anchors(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Documents (doc_id, sections, ...) with descriptions as quoted lines after their anchor texts, those without a place in
    a last section `Figures`, and `image_places`: where each went. images: (doc_id, seq, anchor_text, description); those
    without a description are left out. Only descriptions are shuffled by document where they are small, and documents
    without any do not go through the automaton. Null bodies count as empty; extra columns are carried along."""
    ship(docs.sparkSession)
    own = F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("anchor_text").alias("anchor"), "description"))
    told = images.where("description <> ''").groupBy("doc_id").agg(own.cast(_PICTURES).alias("pictures_"))
    rows = docs.join(told, "doc_id", "left")
    made = F.arrow_udf(_filled, f"struct<sections:{SECTIONS},places:{_PLACES}>")(F.when(F.col("pictures_").isNotNull(), F.col("sections")), F.col("pictures_"))
    rows = rows.withColumn("made_", made)
    columns = [F.coalesce("made_.sections", "sections").alias("sections") if c == "sections" else F.col(c) for c in docs.columns]
    return rows.select(*columns, F.col("made_.places").alias("image_places"))


def anchored(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose anchor text has a place in a body of their document, with that section and the offset behind the anchor."""
    asked = images.withColumn("description", F.lit("?"))
    places = insert_at_anchors(docs.select("doc_id", "sections"), asked).select("doc_id", F.explode("image_places").alias("p"))
    there = places.where("p.section IS NOT NULL").select("doc_id", "p.seq", "p.section", "p.at")
    return images.join(there, ["doc_id", "seq"])
