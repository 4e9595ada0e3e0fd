"""What can be read off the text of a saved query.

Every function takes columns and returns a column of built-in, code-generated expressions. ``lowered``
and friends are meant to be computed once per row by the caller (see ``operators.corpus``) and handed to
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query classes by the prefix of the trimmed, lower-cased text, first match wins.
PREFIX_CLASSES = (
    ("select", "select"),
    ("insert", "append"),
    ("update", "update"),
    ("delete", "delete"),
    ("transform", "crosstab"),
    ("create table", "make-table"),
    ("parameter", "parameter"),
)
LATE_PREFIX_CLASSES = (
    ("pass-through", "pass-through"),
    ("create ", "ddl"),
    ("alter ", "ddl"),
    ("drop ", "ddl"),
)
UNION_MARK = " union "

# Dialect constructs and the texts that report them.
CONDITIONALS = ("iif(", "nz(", "switch(")
DOMAIN_AGGREGATES = ("dlookup(", "dsum(", "dcount(")
UNTRANSLATED_CALLS = ("iif(", "nz(", "dlookup(", "format$(", "date()", "now()")
DATE_MARK = "#"
LIKE_MARK = " like "
WILDCARD = "*"
WARN_CONDITIONAL = "Access-specific conditional function detected"
WARN_DOMAIN = "Domain aggregate function detected"
WARN_DATE = "Access date literal syntax detected"
WARN_WILDCARD = "Access wildcard syntax detected"
WARN_NOT_TRANSLATED = "Translation disabled or empty SQL"
WARN_FUNCTION = "Access-specific function detected; translation left conservative"
WARN_LIKE = "Wildcard semantics may differ outside Access"

# Confidence of a translation and what lowers it.
BASE_CONFIDENCE = 0.45
FUNCTION_PENALTY = 0.2
WILDCARD_PENALTY = 0.1

# Fixed value: where a table name stands in a query; it keeps spaces in unbracketed names. The look-ahead at
# three letters changes no match; it turns most positions away before the alternatives are tried, which halves the time.
COMPAT_SOURCE = r"(?i)(?=[fjui][ropn][oidt])(?:from|join|update|into)\s+\[?([\p{L}\p{N}_ ]+)\]?"
# The tokens of a query: literals, comments, bracketed names, words, any other sign. A doubled quote inside a literal
# ends one literal and begins the next, which comes to the same.
TOKEN = r"'[^']*'|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/|\[[^\]]*\]|[\p{L}\p{N}_]+|\S"
SOURCE_WORDS = ("from", "join", "update", "into")
_SOURCE_NAME = r"^(?:\[[^\]]+\]|[\p{L}\p{N}_]+)$"
# Names may hold the sign that joins them; it is written as two characters then.
_ESCAPE, _SIGN = "\x1f0", "\x1f1"

# Nothing but white space, the non-breaking kinds not counted as such.
_BLANK_TEXT = r"^[\s\x1c-\x1f\p{Z}&&[^\u00a0\u2007\u202f]]*$"

# Characters up to U+0020, which the class test strips from both ends.
_CONTROLS = "".join(map(chr, range(0x21)))


def _calls_any(text: Column, calls: tuple[str, ...]) -> Column:
    # All of them hold a bracket; a text without one is not searched for each.
    found = text.contains(calls[0])
    for call in calls[1:]:
        found = found | text.contains(call)
    return text.contains("(") & found


def _texts(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order, without the lambda ``array_compact`` would bring."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(text))).otherwise(none) for cond, text in pairs])


def lowered(sql: Column) -> Column:
    return F.lower(F.coalesce(sql, F.lit("")))


def head_of(lower: Column) -> Column:
    return F.btrim(lower, F.lit(_CONTROLS))


def query_class(head: Column) -> Column:
    """The class by the trimmed, lower-cased text."""
    found = F
    for prefix, name in PREFIX_CLASSES:
        found = found.when(head.startswith(prefix), name)
    found = found.when(head.contains(UNION_MARK), "union")
    for prefix, name in LATE_PREFIX_CLASSES:
        found = found.when(head.startswith(prefix), name)
    return found.otherwise("unknown")


def dialect_warnings(lower: Column) -> Column:
    return _texts(
        (_calls_any(lower, CONDITIONALS), WARN_CONDITIONAL),
        (_calls_any(lower, DOMAIN_AGGREGATES), WARN_DOMAIN),
        (lower.contains(DATE_MARK), WARN_DATE),
        (has_wildcards(lower), WARN_WILDCARD),
    )


def found_sources(sql: Column, mode: str = "compat") -> Column:
    """All table names after from/join/update/into, joined by ``|``.

    ``compat`` goes by one pattern, in literals and comments too. ``strict`` reads the text as tokens, in one pass: a name is a
    bracketed name, whole, or one word that follows one of the four words; what stands in literals and comments is neither.
    """
    if mode == "compat":
        names = F.regexp_extract_all(sql, F.lit(COMPAT_SOURCE), F.lit(1))
        return F.array_join(names, "|")
    if mode == "strict":
        tokens = F.filter(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(?:--|/\*.)"))
        before = F.concat(F.array(F.lit("")), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))
        named = F.filter(
            F.zip_with(before, tokens, lambda b, t: F.when(F.lower(b).isin(*SOURCE_WORDS) & t.rlike(_SOURCE_NAME), t)),
            lambda t: t.isNotNull(),
        )
        bare = F.transform(named, lambda t: F.when(t.startswith("["), t.substr(F.lit(2), F.char_length(t) - 2)).otherwise(t))
        safe = F.transform(bare, lambda t: F.replace(F.replace(t, F.lit(_ESCAPE[0]), F.lit(_ESCAPE)), F.lit("|"), F.lit(_SIGN)))
        return F.array_join(safe, "|")
    raise ValueError(f"mode={mode!r} is neither 'compat' nor 'strict'")


def dependencies(found: Column, mode: str = "compat") -> Column:
    """Trimmed, distinct, first seen first, from ``found_sources`` in the same mode.

    Names are trimmed in the joined text rather than one by one, which keeps the step code-generated. Only strict names can
    hold the sign that joins them.
    """
    trimmed = F.btrim(F.regexp_replace(found, r" *\| *", "|"))
    names = F.array_distinct(F.split(trimmed, r"\|"))
    if mode == "strict":
        plain = F.transform(names, lambda t: F.replace(F.replace(t, F.lit(_SIGN), F.lit("|")), F.lit(_ESCAPE), F.lit(_ESCAPE[0])))
        names = F.when(found.contains(_ESCAPE[0]), plain).otherwise(names)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(names)


def is_blank(sql: Column) -> Column:
    return sql.isNull() | sql.rlike(_BLANK_TEXT)


def translated(sql: Column, blank: Column) -> Column:
    # Two replacements search bytes; ``translate`` would go through every character.
    quoted = F.replace(F.replace(sql, F.lit("["), F.lit('"')), F.lit("]"), F.lit('"'))
    return F.when(~blank, quoted)


def has_untranslated_calls(lower: Column) -> Column:
    return _calls_any(lower, UNTRANSLATED_CALLS)


def has_wildcards(lower: Column) -> Column:
    return lower.contains(WILDCARD) & lower.contains(LIKE_MARK)


def confidence(calls: Column, wildcards: Column, blank: Column) -> Column:
    left = (
        F.lit(BASE_CONFIDENCE)
        - F.when(calls, F.lit(FUNCTION_PENALTY)).otherwise(F.lit(0.0))
        - F.when(wildcards, F.lit(WILDCARD_PENALTY)).otherwise(F.lit(0.0))
    )
    return F.when(blank, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), left))


def translation_warnings(calls: Column, wildcards: Column, blank: Column) -> Column:
    return F.when(blank, F.array(F.lit(WARN_NOT_TRANSLATED))).otherwise(
        _texts((calls, WARN_FUNCTION), (wildcards, WARN_LIKE))
    )
