"""Character classes shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from re import _parser as re_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrollwork.functions import packs

#: What counts as white space, code point for code point.
WS_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same class in RE2 notation, for the SQL twins.
WS_CLASS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: What a fingerprint leaves out, and what separates the pieces of a hook.
FP_DROP = r"[\s，,。.、；;：:!！?？\"'“”‘’()（）【】\[\]-]+"
DNA_SPLIT = r"[-—–－/／、,，;；|:：\t-\r\x1c-\x20\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
DNA_SPLIT_RE2 = r"[-—–－/／、,，;；|:：\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


#: The same characters one by one, for functions that take a list.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(WS_CLASS, c))


def strip_ws(c: Column) -> Column:
    """`c` without white space of any kind at either end; null stays null."""
    return F.trim(c, F.lit(WS_CHARS))


def strip_ws_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS_CLASS_RE2}+|{WS_CLASS_RE2}+$', '', 'g')"


#: What ends a line, and the same in RE2 notation.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_END_RE2 = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def count_words(c: Column) -> Column:
    """Characters without white space."""
    return F.length(F.translate(c, WS_CHARS, ""))


def lines(c: Column) -> Column:
    """The lines of a text; an empty line after the last line end is none."""
    a = F.split(c, LINE_END)
    return F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)


def narration(c: Column) -> Column:
    """A text without quoted speech and headings.

    What follows the last closing quote holds no whole speech and is left out of the search: every quote that opens
    there would be followed to the text's end.
    """
    def silent(t: Column) -> Column:
        head = F.regexp_extract(t, "(?s)\\A.*[”」』]", 0)
        return bound(head, lambda h: F.concat(F.regexp_replace(h, packs.SPEECH, ""), F.substring(t, F.length(h) + 1, F.lit(0x7FFFFFFF))))

    return F.regexp_replace(silent(c), "(?md)^#.*$", "")


def sentences(c: Column, least: int = 2) -> Column:
    """Trimmed sentences of at least `least` characters."""
    return F.filter(F.transform(F.split(c, packs.SENTENCE_END), strip_ws), lambda s: F.length(s) >= least)


def first_chars(pattern: str) -> set[str] | None:
    """The characters a match can begin with, or None if they aren't a short list."""
    def of(items: list) -> tuple[set[str], bool] | None:  # noqa: ANN401
        out: set[str] = set()
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                return out | {chr(arg)}, False
            if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                return out | {chr(a) for _, a in arg}, False
            if name == "SUBPATTERN":
                got = of(list(arg[3]))
            elif name == "BRANCH":
                parts = [of(list(x)) for x in arg[1]]
                got = None if None in parts else (set().union(*(x[0] for x in parts)), any(x[1] for x in parts))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                got = of(list(arg[2]))
                got = got and (got[0], got[1] or arg[0] == 0)
            else:
                return None
            if got is None:
                return None
            out |= got[0]
            if not got[1]:
                return out, False
        return out, True

    got = of(list(re_parser.parse(pattern)))
    return got[0] if got and not got[1] and len(got[0]) < 200 else None


@lru_cache(256)
def guarded(pattern: str) -> str:
    """`pattern` behind a look at its possible first characters: one test of a class where an alternation would try every branch."""
    chars = first_chars(pattern)
    if not chars:
        return pattern
    return f"(?=[{''.join(re.escape(c) for c in sorted(chars))}])(?:{pattern})"


@lru_cache(256)
def parted(pattern: str) -> tuple[str, str]:
    """(single characters, other pattern) that an alternation of words can be counted by one after the other.

    A word that begins with an earlier one is never met. The characters that are words by themselves and stand in no longer
    word can overlap none, so their counts add up.
    """
    words = pattern.split("|")
    if not all(words) or any(re.escape(w) != w for w in words):
        return "", pattern
    met = [w for i, w in enumerate(words) if not any(w.startswith(v) for v in words[:i])]
    longer = "".join(w for w in met if len(w) > 1)
    single = [w for w in met if len(w) == 1 and w not in longer]
    return "".join(single), "|".join(w for w in met if w not in single)


def hits(c: Column, pattern: str) -> Column:
    """How often a pattern without groups of its own matches."""
    single, rest = parted(pattern)
    many = F.regexp_count(c, F.lit(guarded(rest))) if rest else F.lit(0)
    return F.length(c) - F.length(F.translate(c, single, "")) + many if single else many


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(c: Column, n: int) -> Column:
    """Overlapping n-grams of a string, in order; none if it is shorter. Characters are split once, as a string has no direct access."""
    def all_(a: Column) -> Column:
        return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.concat(*[F.element_at(a, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return bound(F.split(c, ""), all_)


def fingerprint(c: Column) -> Column:
    """First ten hex digits of the SHA-1 of a title in lower case without punctuation; empty for an empty one."""
    s = F.regexp_replace(F.lower(strip_ws(F.coalesce(c, F.lit("")))), FP_DROP, "")
    return F.when(s == "", "").otherwise(F.substring(F.sha1(s), 1, 10))


def dna(c: Column) -> Column:
    """Distinct pieces of a hook of at least two characters, or the whole of it if it has none."""
    v = F.coalesce(c, F.lit(""))
    t = F.array_distinct(F.filter(F.split(v, DNA_SPLIT), lambda x: F.length(x) >= 2))
    whole = strip_ws(v)
    return F.when((F.size(t) == 0) & (F.length(whole) >= 2), F.array(whole)).otherwise(t)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def plan_field(c: Column, field: str) -> Column:
    """The value of the first line `field: value` of a plan, null if there is none."""
    v = F.regexp_extract(c, f"(?md)^[ \\t]*(?:[-*+][ \\t]+)?\\*{{0,2}}{field}\\*{{0,2}}[ \\t]*[:：][ \\t]*([^\\n\\r]*)", 1)
    return F.when(v == "", None).otherwise(strip_ws(v))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words, then Chinese characters and pairs of neighbours, with repeats."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(c, F.lit(f"[{packs.HAN}]+"), F.lit(0))
    return F.concat(words, F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2)))))
