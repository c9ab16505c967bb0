"""Column functions on texts."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import tokens_with

#: What counts as a word: letters, digits and marks of any script, and ideographs one by one.
CJK = "一-鿿"
WORD = r"[\p{L}\p{N}_]+"


def strip_boilerplate(text: Column) -> Column:
    """Tags to spaces, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\s]+", " "))


def _character(code: Column) -> Column:
    """The character of a code point by the rules for numeric references: Windows letters for 128 to 159, a replacement mark for what is none."""
    windows = F.lit("".join(bytes([n]).decode("cp1252", "replace") for n in range(128, 160)))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    none = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(none, F.lit("\ufffd")).when(code.between(128, 159), F.substr(windows, code.cast("int") - 127, F.lit(1))).otherwise(plain)


def html_unescape(text: Column, names: dict[str, str] = html5) -> Column:
    """Character references replaced by what they stand for: numeric ones, and those of the public table of names.

    Of letters that are no name, the longest beginning that is a name without a semicolon is
    read. What is no reference stays. Texts without an ampersand are not looked into.
    """
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    short = f"^({'|'.join(sorted((n for n in names if not n.endswith(';')), key=len, reverse=True))})"
    head = r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*)(;?)"

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, head, 1)
        whole = F.regexp_extract(p, head, 0)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
        found = F.when(name.startswith("#"), _character(code)).when(name != "", F.element_at(table, whole))
        begun = F.regexp_extract(p, short, 1)
        return F.coalesce(
            F.concat(found, F.substr(p, F.length(whole) + 1)),
            F.when(begun != "", F.concat(F.element_at(table, begun), F.substr(p, F.length(begun) + 1))),
            F.concat(F.lit("&"), p),
        )

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))).otherwise(text)


def clean_content(text: Column, platform: Column | None = None, boilerplate: dict[str, list[str]] | None = None) -> Column:
    """References decoded, zero-width marks and the platform's boilerplate dropped, at most one blank line, lines trimmed."""
    out = html_unescape(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, "[​-‏﻿]", "")
    for of, sentences in (boilerplate or {}).items():
        clean = out
        for s in sentences:
            clean = F.replace(clean, F.lit(s), F.lit(""))
        out = F.when(platform == of, clean).otherwise(out)
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, "(?m)^[ \t\r\f]+", ""), "(?m)[ \t\r\f]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"^\s+", ""), r"\s+$", "")


def tokenize(text: Column, stopwords: list[str] = (), remove_stopwords: bool = True) -> Column:
    """Words of two characters or more that hold a letter, repeats kept; ideographs give their bigrams."""
    part = rf"[A-Za-z[\p{{L}}\p{{N}}_&&[^{CJK}]]]"
    other = rf"[\p{{L}}\p{{N}}_&&[^{CJK}A-Za-z]]"
    # The letter may stand anywhere in the word. Words without one are passed over as a whole, not looked through again from each of their characters.
    words = F.array_remove(F.regexp_extract_all(text, F.lit(f"([A-Za-z]{part}+|{other}+[A-Za-z]{part}*)|{other}+"), 1), "")
    runs = F.when(text.rlike(f"[{CJK}]"), F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), 1)).otherwise(F.array().cast("array<string>"))
    found = F.when(text.isNotNull(), F.concat(words, F.flatten(F.transform(runs, char_bigrams))))
    return F.filter(found, lambda t: ~t.isin(list(stopwords))) if remove_stopwords and stopwords else found


def windows_of(text: Column, n: int) -> Column:
    """All windows of n characters, in one pass: each match takes one character and looks n ahead."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def char_bigrams(text: Column) -> Column:
    """All windows of two characters of the trimmed text; a single character gives none."""
    return windows_of(F.trim(text), 2)


def shingles(text: Column, n: int = 4) -> Column:
    """Windows of n characters of the text without white space; a shorter text is one shingle, an empty one none."""
    t = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(t) >= n, windows_of(t, n)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, least: int = 6) -> Column:
    """Trimmed sentences of at least so many characters."""
    return F.filter(F.transform(F.split(text, "[。！？!?；;\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def first_sentences(text: Column, most: int, least: int = 6, chars: int = 1000) -> Column:
    """The first of the ``sentences``. Only a text whose beginning doesn't hold so many is cut as a whole."""
    pieces = F.split(F.substring(text, 1, chars), "[。！？!?；;\n]+")
    # The last piece may go on behind the beginning.
    ended = F.transform(F.array(pieces), lambda p: F.slice(p, 1, F.size(p) - 1))[0]
    early = F.filter(F.transform(ended, lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.transform(F.array(early), lambda e: F.when(F.size(e) >= most, F.slice(e, 1, most)).otherwise(F.slice(sentences(text, least), 1, most)))[0]


def combined_text(*parts: Column, keywords: Column) -> Column:
    """The parts and the keywords, joined by spaces; a null part leaves its place empty."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts], F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))


def snippet(title: Column, content: Column, length: int = 40) -> Column:
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), content), 1, length)


def event_title_clean(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"https?://\S+", ""))


#: Lexicons of up to so many words are one pattern; larger ones an automaton.
FEW_WORDS = 64


def contains_any(tokens: Column, lexicon: list[str]) -> Column:
    """How many tokens hold a word of the lexicon."""
    if len(lexicon) > FEW_WORDS:
        return tokens_with(tokens, lexicon)
    pattern = "|".join(F"\\Q{w}\\E" for w in lexicon)
    return F.size(F.filter(tokens, lambda t: t.rlike(pattern))).cast("long") if lexicon else F.lit(0).cast("long")
