"""Notes: guides from web pages, searches over a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import library

#: Blocks of a page that hold no text of its own, entities that are decoded, and limits in characters.
BLOCKS = ("script", "style", "nav", "aside", "header", "footer", "noscript")
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
LEAST_TEXT, MOST_TEXT, TAGGED_TEXT = 300, 100_000, 4_000


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _decoded(c: Column) -> Column:
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def without_blocks(html: Column) -> Column:
    for tag in BLOCKS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def page_text(shown: Column) -> Column:
    """Text of html without blocks: a line for each piece between tags, at most one empty line between them."""
    return _stripped(F.regexp_replace(_decoded(F.regexp_replace(shown, "<[^>]+>", "\n")), r"\n{3,}", "\n\n"))


def page_title(shown: Column, stem: Column) -> Column:
    """The title, else the first heading, else the file's stem; a site's name at the end goes, and if nothing is left the stem stays."""
    inside = lambda tag: F.nullif(_stripped(_decoded(F.regexp_replace(F.regexp_extract(shown, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), "<[^>]+>", ""))), F.lit(""))
    full = F.coalesce(inside("title"), inside("h1"), stem)
    return F.coalesce(F.nullif(_stripped(F.regexp_replace(full, r"\s*_\s*Civitai\s*$", "")), F.lit("")), stem)


def guides(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Guide notes (page_id, id, title, tags, text) of pages (page_id, stem, html), and the pages (page_id, reason) with too little text.

    Equal slugs of titles get numbers in order of page_id.  Null html has no text.
    """
    shown = pages.select("page_id", "stem", without_blocks(F.coalesce("html", F.lit(""))).alias("shown"))
    own = shown.select("page_id", page_title(F.col("shown"), F.col("stem")).alias("title"), page_text(F.col("shown")).alias("text"))
    said = F.concat(F.lower("title"), F.lower(F.substr("text", F.lit(1), F.lit(TAGGED_TEXT))))
    has = lambda *words: F.when(said.rlike("|".join(words)), True)
    tags = F.filter(F.array(F.lit("civitai"), F.when(has("pony", "score_9"), "pony"), F.when(has("prompt"), "prompting")), lambda x: x.isNotNull())
    enough = F.length("text") >= LEAST_TEXT
    kept = library.slug_suffix(own.where(enough).withColumn("tags", tags), t.slug(F.col("title")), "page_id")
    return kept.select("page_id", "id", "title", "tags", F.substr("text", F.lit(1), F.lit(MOST_TEXT)).alias("text")), own.where(~enough).select("page_id", F.lit("too little text").alias("reason"))


def search(notes: DataFrame, q: str = "", tag: str = "", kind: str = "") -> DataFrame:
    """Notes (id, title, type, tags, links, body) by type, tag and a text anywhere in them, whatever its case; an empty parameter doesn't filter.  Adds a snippet of 140 characters."""
    rows = notes.where(F.coalesce("type", F.lit("note")) == kind) if kind else notes
    rows = rows.where(F.array_contains("tags", tag)) if tag else rows
    hay = F.lower(F.concat_ws(" ", "id", "title", "body", F.array_join("tags", " "), F.array_join("links", " ")))
    rows = rows.where(F.contains(hay, F.lit(q.lower()))) if q else rows
    # as a heading goes only where it is all of the body
    bare = F.regexp_replace("body", r"^#[^\n]*\z", "")
    return rows.withColumn("snippet", F.substr(_stripped(F.regexp_replace(bare, r"\s+", " ")), F.lit(1), F.lit(140)))
