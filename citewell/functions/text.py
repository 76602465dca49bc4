"""Text functions: Column -> Column, in whole-stage code, no Python on the executors.

Rules follow the text model of the engine: characters are code points; white space is Unicode white space where a
rule says so; folding is for search and comparison, never for display.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges of the normal forms.
WHITE_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LEXICAL_DROPPED = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
SEARCH_DROPPED = r"[\x{064B}-\x{0655}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
MATCH_FOLD = ("أإآٱؤئىةء", "ااااوييه")
SEARCH_FOLD = ("آأإٱىة", "اااايه")
BASMALA = "بسم الله الرحمن الرحيم"
BASMALA_OPENING = "بسم"


def squeeze(text: Column) -> Column:
    """Every run of Unicode white space to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE + "+", " "))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~F.rlike(text, F.lit(f"[^{WHITE_SPACE[1:]}")), F.lit(True))


def is_blank_lexical(text: Column) -> Column:
    """Whether nothing is left of lexical_form(text), without making it; null is blank."""
    return F.coalesce(~F.rlike(text, F.lit(f"[^{WHITE_SPACE[1:-1]}{LEXICAL_DROPPED[1:]}")), F.lit(True))


def lexical_form(text: Column) -> Column:
    """Without combining marks, annotation marks and the elongation glyph; white space squeezed."""
    return squeeze(F.regexp_replace(text, LEXICAL_DROPPED, ""))


def has_diacritics(text: Column) -> Column:
    return F.regexp_like(text, F.lit(LEXICAL_DROPPED))


def match_form(text: Column) -> Column:
    """lexical_form with letter variants folded and the lone hamza deleted; inner double spaces may remain."""
    return F.trim(F.translate(lexical_form(text), *MATCH_FOLD))


def search_fold(text: Column) -> Column:
    """The search form: fewer letters folded than in match_form, hamza kept."""
    return squeeze(F.translate(F.regexp_replace(text, SEARCH_DROPPED, ""), *SEARCH_FOLD))


def letter_key(text: Column) -> Column:
    """Letters for comparing sources: search folds, hamza before alef joined, spaces removed."""
    folded = F.translate(F.regexp_replace(text, SEARCH_DROPPED, ""), *SEARCH_FOLD)
    return F.translate(F.replace(folded, F.lit("ءا"), F.lit("ا")), " ـ", "")


def strip_basmala(text: Column, full_phrase: bool = True) -> Column:
    """The text after a leading four-word opening; unchanged (but trimmed) without one or without words after it.

    full_phrase=False guards on the first word only, as the reference behaves.
    """
    t = trim_unicode(text)
    guard = letter_key(F.lit(BASMALA if full_phrase else BASMALA_OPENING))
    parts = F.split(t, " ", 5)
    return F.when(F.startswith(letter_key(t), guard) & (F.size(parts) == 5), trim_unicode(parts[4])).otherwise(t)


# ---------------------------------------------------------------- markup and paragraphs

#: Tags that stand for line breaks; named entities that are resolved in whole-stage code.
BLOCK_TAGS = "p|div|br|li|tr|h[1-6]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))


def unescape_common(text: Column) -> Column:
    """The entities of ENTITIES and, last, &amp; with or without its semicolon."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, "&amp;?", "&")


def clean_html(html: Column, unescape=None) -> Column:
    """Plain text of markup: block tags become line breaks, other tags go, their text stays (also of scripts).

    Entities (all of HTML, or as `unescape` does it) are resolved after the tags are gone; lines are trimmed, runs of
    blank lines cut to one. Null is empty.
    """
    if unescape is None:
        from citewell.functions.entities import unescape_html as unescape
    t = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?i)</({BLOCK_TAGS})(?!\w)[^>]*>", "\n\n")
    t = F.regexp_replace(t, rf"(?i)<({BLOCK_TAGS})(?!\w)[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t\x{A0}]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "")


def unescape_html_udf():
    """Every named and numeric entity, as HTML defines them; Arrow batches."""
    import html as _html

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _html.unescape(t))

    return unescape


def split_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed; single line breaks stay inside; empty ones dropped."""
    lines = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    blank = WHITE_SPACE.replace(r"\n", "")
    return F.filter(F.transform(F.split(lines, rf"\n(?:{blank}*\n)+"), trim_unicode), lambda p: p != "")


def pack_words(text: Column, cap: int) -> Column:
    """Pieces of at most cap characters: the text itself if it fits, else words packed greedily with single spaces.

    A word longer than the cap is a piece of its own. Words are folded from left to right in one aggregate.
    """
    words = F.filter(F.split(text, WHITE_SPACE + "+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, word: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + 1 + F.length(word) > cap)
        joined = F.when(state["open"] == "", word).otherwise(F.concat(state["open"], F.lit(" "), word))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, word).otherwise(joined).alias("open"),
        )

    packed = F.aggregate(words, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.length(text) <= cap, F.array(text)).otherwise(packed)


def pack_words_udf(cap: int):
    """pack_words in Arrow batches: linear in the text's length, for very long texts."""
    import re

    space = re.compile("[\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

    def pieces(text):
        if text is None:
            return None
        if len(text) <= cap:
            return [text]
        out, words, size = [], [], 0
        for w in filter(None, space.split(text)):
            if words and size + 1 + len(w) > cap:
                out.append(" ".join(words))
                words, size = [], 0
            size += len(w) + bool(words)
            words.append(w)
        return [*out, " ".join(words)] if words else out

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(pieces)

    return pack


# ---------------------------------------------------------------- identity


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def null_terminated_hash(*parts: Column) -> Column:
    """sha256 of the parts as text, each followed by a NUL."""
    pieces = [x for p in parts for x in (p.cast("string"), F.lit("\x00"))]
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def chunk_id(source: Column, version: Column, start: Column, end: Column, mapping_type: Column, text_hash: Column, dup: Column, document: Column | None = None) -> Column:
    """Content-derived identity of a chunk. With a document its id takes part too, so equal text at equal anchors
    of two documents keeps two identities; without one this is the legacy identity."""
    head = [source, version] if document is None else [source, version, document]
    return null_terminated_hash(*head, start, end, mapping_type, text_hash, dup)


def preview(text: Column, n: int) -> Column:
    t = trim_unicode(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def truncate_line(text: Column, n: int) -> Column:
    """One line of at most n characters, marked where cut; never cuts inside a character."""
    t = trim_unicode(F.translate(text, "\n", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def run_key(group: Column, anchor: Column) -> Column:
    return F.format_string("s%03da%03d", group.cast("int"), anchor.cast("int"))


def media_key(group: Column, anchor: Column) -> Column:
    return F.format_string("%03d%03d.mp3", group.cast("int"), anchor.cast("int"))


def prompt_fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sys-"), F.left(content_hash(text), F.lit(12)))


def model_of_url(url: Column) -> Column:
    """The segment after /models/ up to a colon, slash, query or fragment; the whole address if there is none."""
    found = F.regexp_extract(url, r"/models/([^:/?#]+)", 1)
    return F.when(found == "", url).otherwise(found)


def style_language(style: Column) -> Column:
    return F.when(F.endswith(style, F.lit("_ar")), "ar").otherwise("en")


def strict_style_language(style: Column) -> Column:
    """Null for a style that has no rule."""
    return F.when(style.isin("simplified_ar", "egyptian_ar"), "ar").when(style == "en", "en")


def style_or_default(style: Column) -> Column:
    return F.coalesce(style, F.lit("simplified_ar"))


def summarize(text: Column, n: int = 400) -> Column:
    return F.left(trim_unicode(text), F.lit(n))


def split_header(text: Column) -> Column:
    """struct(header, body, ok) at the first line of three dashes. Without one the file is not accepted: ok is false."""
    at = F.instr(text, "\n---\n")
    return F.when(at > 0, F.struct(F.left(text, at - 1).alias("header"), F.substr(text, at + 5).alias("body"), F.lit(True).alias("ok"))).otherwise(F.struct(F.lit("").alias("header"), text.alias("body"), F.lit(False).alias("ok")))


def body_of(text: Column) -> Column:
    """The body below the header; a text without the separator is an error."""
    parts = split_header(text)
    return F.when(parts["ok"], parts["body"]).otherwise(F.raise_error(F.lit("no header separator")).cast("string"))
