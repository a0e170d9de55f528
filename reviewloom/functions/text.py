"""Text normalization and tokens, as Column -> Column functions.

Regular expressions carry (?U) where white space, digits or words must be those of
Unicode. Nulls stay null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

U = "(?U)"
ZWNJ = "‌"


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, U + r"\s+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty, or white space alone."""
    return F.coalesce(collapse(c) == "", F.lit(True))


def digits(c: Column) -> Column:
    """Persian and Arabic-Indic digits to ASCII."""
    return F.translate(c, fixed.DIGITS_FROM, fixed.DIGITS_TO)


def elongation(c: Column, copies: int = 2) -> Column:
    """Three or more of one character to `copies` of it."""
    return F.regexp_replace(c, U + r"(\S)\1{2,}", "$1" * copies)


def char_normalize(c: Column, map_yeh_hamza: bool = False) -> Column:
    """Step 1: control characters, digits, letter variants, kept characters, elongation, spaces."""
    c = F.regexp_replace(c, fixed.CONTROL_CHARS, " ")
    extra = ("ئ", "ی") if map_yeh_hamza else ("", "")
    c = F.translate(c, fixed.DIGITS_FROM + fixed.LETTERS_FROM + extra[0], fixed.DIGITS_TO + fixed.LETTERS_TO + extra[1])
    c = F.regexp_replace(c, U + r"[^0-9A-Za-z؀-ۿ\s]", " ")
    return collapse(elongation(c))


def pre_clean(c: Column, keep_quote: bool = False) -> Column:
    """Step 2: elongation, Persian punctuation, dots without a digit beside them. keep_quote: the query's variant."""
    punct = fixed.PERSIAN_PUNCT.replace('"', "") if keep_quote else fixed.PERSIAN_PUNCT
    c = F.regexp_replace(elongation(c), punct, " ")
    return collapse(F.regexp_replace(c, U + r"(?<!\d)\.(?!\d)", " "))


def persian_style(c: Column) -> Column:
    """Step 3, the native part: no diacritics, spaces between digits and letters, joined verb prefixes and plural endings."""
    c = F.regexp_replace(c, r"[ً-ْ]", "")
    c = F.regexp_replace(c, r"(?<=[ؠ-ٟٮ-ۯۺ-ۿ])(?=[0-9])|(?<=[0-9])(?=[ؠ-ٟٮ-ۯۺ-ۿ])", " ")
    c = F.regexp_replace(c, r"(?<!\S)(ن?می) (?=\S)", "$1" + ZWNJ)
    return collapse(F.regexp_replace(c, r"(?<=\S) (های|ها|ای|ام|ات|اش|تر|ترین)(?!\S)", ZWNJ + "$1"))


def deglue(c: Column, rules: dict[str, str] = fixed.DEGLUE) -> Column:
    """Step 4: whole tokens rewritten; the text's spaces are collapsed."""
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.array_join(F.transform(F.split(collapse(c), " "), lambda t: F.coalesce(table[t], t)), " ")


def normalize(c: Column) -> Column:
    """Steps 1 to 4: one function for corpora and for queries."""
    return deglue(persian_style(pre_clean(char_normalize(c))))


def tokens(c: Column, min_len: int = 2) -> Column:
    """White-space tokens of at least `min_len` characters; blank: an empty array."""
    return F.filter(F.split(collapse(F.coalesce(c, F.lit(""))), " "), lambda t: (F.length(t) >= min_len) & (t != ""))


def without(toks: Column, stopwords: list[str], keep: list[str] = fixed.NEGATION_KEEP) -> Column:
    """Tokens that are no stopwords; words in `keep` never are."""
    drop = [s for s in dict.fromkeys(stopwords) if s not in set(keep)]
    return F.filter(toks, lambda t: ~t.isin(drop)) if drop else toks


def norm_token(c: Column) -> Column:
    return F.replace(F.lower(collapse(c)), F.lit(ZWNJ), F.lit(""))


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def greedy_stop_filter(toks: Column, stop: list[str], bigrams: list[tuple[str, str]] = (), allow: list[str] = ()) -> tuple[Column, Column]:
    """(kept, removed) of a scan from the left: allowed tokens stay, then a bigram drops both its tokens, then stopwords go.

    Each token gets a digit (2: begins a bigram, 1: stopword, 0: neither); a replacement from the
    left, which like the scan goes on behind each bigram it finds, marks the bigrams' tokens with 3.
    """
    pairs = [f"{a} {b}" for a, b in bigrams]
    stopped = [s for s in stop if s not in set(allow)]

    def digit(key: Column, after: Column) -> Column:
        out = F.when(key.isin(stopped), "1").otherwise("0") if stopped else F.lit("0")
        begins = after.isNotNull() & F.concat_ws(" ", key, after).isin(pairs) if pairs else F.lit(False)
        return F.when(begins & ~key.isin(list(allow)) if allow else begins, "2").otherwise(out)

    def split(marks: Column) -> Column:
        marked = F.zip_with(toks, marks, lambda t, m: F.struct(t.alias("t"), m.alias("m")))
        take = lambda *m: lambda all_: F.transform(F.filter(all_, lambda e: e["m"].isin(*m)), lambda e: e["t"])
        return _let(marked, lambda all_: F.struct(take("0")(all_).alias("kept"), take("1", "3")(all_).alias("removed")))

    digits = _let(F.transform(toks, norm_token), lambda k: F.array_join(F.zip_with(k, F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), digit), ""))
    both = _let(F.split(F.regexp_replace(digits, "2.", "33"), ""), split)
    return both["kept"], both["removed"]


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens, joined by a space; fewer than two tokens: none."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def ngrams(toks: Column) -> Column:
    """Tokens and bigrams, in that order."""
    return F.concat(toks, bigrams(toks))


def text_key(c: Column) -> Column:
    """The key that equal texts share: no joiners or byte-order marks, collapsed; null: empty."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "[‌﻿]", " "))


def norm_text(c: Column) -> Column:
    """The weak labels' normalization: joiners to spaces, collapsed, then elongation; null: empty."""
    return elongation(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), ZWNJ, " ")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(norm_text(c), " "), lambda t: t != ""))


def compact(c: Column, limit: int = 700) -> Column:
    """Text for a label request: control white space to spaces, at most `limit` characters, trimmed."""
    return F.trim(F.left(F.regexp_replace(c, "[\\x00\\r\\n\\t]", " "), F.lit(limit)))


def simple(c: Column) -> Column:
    return collapse(F.lower(F.regexp_replace(c, ZWNJ, " ")))


def keyword_tokens(c: Column) -> Column:
    """Lower-case tokens of kept characters."""
    kept = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), ZWNJ, " ")), U + r"[^0-9a-z؀-ۿ\s]", " ")
    return F.filter(F.split(collapse(kept), " "), lambda t: t != "")


def has_any_token(toks: Column, words: list[str]) -> Column:
    return F.arrays_overlap(toks, F.array(*map(F.lit, words)))


def has_any_phrase(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def unique(c: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(c)


def removed_sample(removed: Column, most: int = 30) -> Column:
    return F.concat_ws(" | ", F.slice(F.array_distinct(removed), 1, most))


def preview(c: Column, limit: int = 80) -> Column:
    c = F.regexp_replace(c, "\\n", " ")
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def count_chars(c: Column, chars: str) -> Column:
    """How many characters of `c` are in the class `chars` (a Java character class)."""
    return F.length(c) - F.length(F.regexp_replace(c, chars, ""))


def char_stats(c: Column) -> dict[str, Column]:
    """Counts by class of character; null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    return {
        "n_total": F.length(c),
        "n_persian": count_chars(c, r"[؀-ۿ]"),
        "n_latin": count_chars(c, "[A-Za-z]"),
        "n_digit": count_chars(c, U + r"\d"),
        "n_nonstd": count_chars(c, U + r"[^؀-ۿ0-9A-Za-z\s]"),
        "n_space": count_chars(c, " "),
    }


def latin_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9._\-]{1,}"), F.lit(0)), F.lower)


def has_token(c: Column, token: str) -> Column:
    """Whether the whole token occurs between white space."""
    return F.array_contains(F.split(collapse(F.coalesce(c, F.lit(""))), " "), token)


def year_of(c: Column) -> Column:
    """The first four digits in a row of a date string, or null."""
    return F.nullif(F.regexp_extract(digits(c), r"(\d{4})", 1), F.lit(""))
