"""Text functions as column expressions; all stay in the JVM unless the name says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-]*[\p{L}\p{N}_])?"
MAX_TERMS, MAX_TAGS, MAX_TAG, MAX_EXCERPT, MAX_TITLE = 16, 64, 100, 240, 60
# Fixed signs that a file name of a captured note may not hold.
FORBIDDEN, CONTROL = r'[\\/:*?"<>|#^\[\]]', r"[\x00-\x1f\x7f]"


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalise_tags(raw: Column) -> Column:
    """Tags of a string: split at commas and blanks, without leading #, lower case, first of equals, bounded."""
    parts = F.split(raw, r"[,\s]+")
    clean = F.transform(parts, lambda t: F.lower(F.trim(F.regexp_replace(F.trim(t), "^#+", ""))))
    good = F.filter(clean, lambda t: (t != "") & (F.char_length(t) <= MAX_TAG))
    return F.slice(F.array_distinct(good), 1, MAX_TAGS)


def is_identifier(term: Column) -> Column:
    """2 to 64 characters with a digit or one of . _ -"""
    return F.char_length(term).between(2, 64) & term.rlike(r"[\p{N}._\-]")


def chat_terms(text: Column) -> Column:
    """Terms of a question: identifiers first, then words of three letters or more, longest first; 16 at most."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    identifiers = F.filter(terms, is_identifier)
    plain = F.filter(terms, lambda t: ~is_identifier(t) & (F.char_length(t) >= 3))
    keyed = F.transform(plain, lambda t, i: F.struct((-F.char_length(t)).alias("n"), i.alias("i"), t.alias("t")))
    ranked = F.transform(F.array_sort(keyed), lambda s: s["t"])
    return F.slice(F.concat(identifiers, ranked), 1, MAX_TERMS)


def heading_text(title: Column, headings: Column) -> Column:
    """Headings joined by blanks, with the title in front unless it is the first of them."""
    first = F.get(headings, F.lit(0))
    return F.concat_ws(" ", F.when(first.eqNullSafe(title), headings).otherwise(F.concat(F.array(title), headings)))


def trail(title: Column, headings: Column) -> Column:
    """Headings without a first one that equals the title."""
    return F.when(F.get(headings, F.lit(0)).eqNullSafe(title), F.slice(headings, F.lit(2), F.greatest(F.size(headings), F.lit(1)))).otherwise(headings)


def embed_text(title: Column, headings: Column, content: Column) -> Column:
    return F.concat(F.array_join(F.concat(F.array(title), headings), " › "), F.lit("\n\n"), content)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def excerpt(text: Column) -> Column:
    """White space collapsed, escaped, cut at a blank within 240 characters without a torn entity, with an ellipsis."""
    flat = escape_html(F.trim(F.regexp_replace(text, r"\s+", " ")))
    head = F.substring(flat, 1, MAX_EXCERPT)
    at_blank = F.regexp_replace(head, r"\s\S*$", "")
    whole = F.regexp_replace(at_blank, r"&[a-zA-Z]*$", "")
    return F.when(F.char_length(flat) <= MAX_EXCERPT, flat).otherwise(F.concat(whole, F.lit("…")))


def deep_link(vault: Column, path: Column) -> Column:
    """A link that opens a note; blanks are %20."""
    quote = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("obsidian://open?vault="), quote(vault), F.lit("&file="), quote(path))


def capture_title(text: Column) -> Column:
    """A file name from the first line that isn't blank: no leading #, no forbidden signs, 60 characters at most, cut at a word."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x.rlike(r"(?U)\S"))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), r"(?U)^\s*#*", ""), CONTROL, " ")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, FORBIDDEN, ""), r"(?U)\s+", " "), r"^ | $", "")
    head = F.regexp_replace(F.substring(flat, 1, MAX_TITLE + 1), r" [^ ]*$", "")
    short = F.when(F.char_length(head) > MAX_TITLE, F.substring(flat, 1, MAX_TITLE)).otherwise(head)
    title = F.regexp_replace(F.when(F.char_length(flat) > MAX_TITLE, short).otherwise(flat), r"[. ]+$", "")
    return F.when(title == "", "Capture").otherwise(title)


OPERAND = re.compile(r'(?P<skip>[\s!&|()]+)|(?P<minus>-)|"(?P<quoted>[^"]*)"?|(?P<bare>[^\s"!&|()]+)')
OR = re.compile(r"\s*or(?![\w-])(?=\s*\S)", re.I)


def web_operands(query: str | None) -> list[dict]:
    """Operands of a web search: those of one part belong together (and), parts are alternatives (or); never fails.

    Quotes make a phrase, up to the end if they aren't closed; - before an operand negates it; "or" between two
    operands parts them and is a word elsewhere; ! & | ( ) are blanks.
    """
    out, part, negated, at, text = [], 0, False, 0, query or ""
    while m := OPERAND.match(text, at):
        at = m.end()
        if m["minus"]:
            negated = not negated
        elif not m["skip"]:
            out.append({"part": part, "negated": negated, "operand": m["bare"] or m["quoted"] or ""})
            negated = False
            if other := OR.match(text, at):
                part, at = part + 1, other.end()
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("part", "integer").add("negated", "boolean").add("operand", "string")))
def web_operands_arrow(queries: pd.Series) -> pd.Series:
    return queries.map(web_operands)


@F.pandas_udf(T.StringType())
def normalise_name(names: pd.Series) -> pd.Series:
    """NFKC, single blanks, case-folded. Built-ins lack case folding, so this one is an Arrow function."""
    return names.map(lambda n: None if n is None else " ".join(unicodedata.normalize("NFKC", n).split()).casefold())
