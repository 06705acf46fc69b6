"""Column expressions on text that several operators share."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the web platform trims it; Java's own class holds ASCII only.
SPACE = r"[\s\x0B   -     　﻿]"
#: Characters that belong to a term: a term matches where none of them adjoins it.
TERM_CHARS = "a-z0-9+#."
#: Word and term characters written out: Java tests single characters with one look-up, ranges one after the other.
_WORD, _FAST = f"{string.ascii_letters}{string.digits}_", f"{string.ascii_lowercase}{string.digits}+#."
BULLET = r"^[-•*▪◦‣·–—>]"


def literal(value) -> str:
    """A value as SQL text."""
    if value is None or isinstance(value, bool | int | float):
        return {None: "NULL", True: "true", False: "false"}.get(value, str(value)) if value is None or isinstance(value, bool) else str(value)
    if isinstance(value, tuple | list):
        return f"array({', '.join(map(literal, value))})"
    text = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{text}'"


def words(items: Sequence[str]) -> Column:
    """A constant array, made in one call."""
    return F.expr(literal(tuple(items))) if items else F.array().cast("array<string>")


def values_table(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A small constant table that is part of the plan."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names})")


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it: a function of an array's elements would compute it for each of them."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def stripped(c: Column) -> Column:
    """strip() of a column or variable, most of whose values have no white space at their ends."""
    return F.when(c.rlike(r"\A[!-~](?s:.*[!-~])?\z"), c).otherwise(strip(c))


def bounded(words: str) -> str:
    """A case-blind pattern for whole words, with ASCII word boundaries."""
    return f"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def quick(pattern: str) -> str:
    """The same pattern with the class of word characters in Java's quick form."""
    return pattern.replace("[A-Za-z0-9_]", f"[{_WORD}]")


#: So many first characters are tested at once.
_AT_ONCE = 5


def _filed(files: dict[str, list[str]], plain: str) -> str:
    """A pattern of alternatives that are filed by their first character: a place is tried with a few first characters at once, then with one, then with the second.

    plain: what a rest looks like that begins with one character, taken as it is. Alternatives that begin alike keep their order.
    """
    def one_of(chars) -> str:
        return f"(?=[{''.join(map(re.escape, dict.fromkeys(chars)))}])"

    def file(c: str, rests: list[str]) -> str:
        seconds = [m[0] if (m := re.match(plain, r)) else "" for r in rests]
        return f"{re.escape(c)}{one_of(s[-1] for s in seconds) if all(seconds) else ''}(?:{'|'.join(rests)})"

    some = [list(files)[i : i + _AT_ONCE] for i in range(0, len(files), _AT_ONCE)]
    return "|".join(f"{one_of(cs)}(?:{'|'.join(file(c, files[c]) for c in cs)})" for cs in some)


def either(words: str) -> str:
    """The same alternatives filed by their first letter, for patterns that only test: a place is tried with those alone that begin like it.

    Those that don't begin with one letter or digit are tried everywhere.
    """
    filed: dict[str, list[str]] = {}
    others, own = [], ""
    for part in words.split("|"):
        own = f"{own}|{part}" if own else part
        if own.count("(") == own.count(")"):
            if re.match(r"[A-Za-z0-9](?![?*+{])", own):
                filed.setdefault(own[0].lower(), []).append(own[1:])
            else:
                others.append(own)
            own = ""
    files = [_filed(filed, r"[A-Za-z0-9](?![?*+{])")] if filed else []
    return f"(?:{'|'.join([*files, *others])})"


def word_count(c: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of term characters."""
    return F.split(F.lower(c), f"[^{TERM_CHARS}]+")


def match_terms(text: Column, vocabulary: Sequence[str]) -> Column:
    """The terms of a vocabulary that occur in a text between boundaries, in the vocabulary's order."""
    return in_order(found_terms(text, vocabulary), vocabulary)


def in_order(found: Column, vocabulary: Sequence[str]) -> Column:
    """Terms in a vocabulary's order, each once."""
    return F.array_intersect(words(vocabulary), found)


def found_terms(text: Column, vocabulary: Sequence[str]) -> Column:
    """The terms of match_terms() in no order, some of them more than once: their number and what they have in common needs no more.

    One pass of one pattern, which is tried where a boundary is: alternatives by their first character, the longest first. Terms that begin the one found and
    end at a boundary in it are there as well.
    """
    by_first: dict[str, list[str]] = {}
    for t in sorted(dict.fromkeys(vocabulary), key=len, reverse=True):
        if t:
            by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    if not by_first:
        return F.array().cast("array<string>")
    any_of = _filed(by_first, r"\\?[^\\]")
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?<![{_FAST}])(?=({any_of})(?![{_FAST}]))"), F.lit(1))
    heads = {t: [h for h in vocabulary if h and t.startswith(h) and not re.match(f"[{TERM_CHARS}]", t[len(h) :])] for t in vocabulary}
    more = [x for t, own in heads.items() if len(own) > 1 for x in (F.lit(t), words(own))]
    if more:
        table = F.create_map(*more)
        found = F.flatten(F.transform(found, lambda v: F.coalesce(F.element_at(table, v), F.array(v))))
    return found


def _in(low: Column, term: Column) -> Column:
    # the term comes first in the pattern, so that places without it are passed quickly
    return F.contains(low, term) & F.rlike(low, F.concat(F.lit(r"\Q"), term, F.lit(rf"\E(?![{TERM_CHARS}])(?<![{TERM_CHARS}]\Q"), term, F.lit(r"\E)")))


def has_term(text: Column, term: Column) -> Column:
    """Whether a term held in a column occurs in a text between boundaries."""
    return _in(F.lower(text), term)


def terms_in(text: Column, terms: Column) -> Column:
    """Those terms of an array that occur in a text between boundaries."""
    return bind(F.lower(text), lambda low: F.filter(terms, lambda t: _in(low, t)))


def one_decimal(c: Column) -> Column:
    """Not below 0, rounded half up to a tenth."""
    return F.greatest(F.lit(0.0), F.floor(c * 10 + 0.5) / 10)
