"""Column expressions over text: concepts, ordered tokens, phrases. All work inside a row, so none of them shuffles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfold.functions import vocab

# What counts as a word, and as a part of one.
WORD = "[A-Za-z][A-Za-z0-9]*|[0-9]+"
PART = "[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+"


def lookup(table: dict[str, list[str]] | dict[str, str]) -> Column:
    """A small vocabulary as a map column."""
    quoted = lambda v: "array(" + ", ".join(map(quoted, v)) + ")" if isinstance(v, list) else "'" + v.replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_line(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def split_words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself: every ASCII sign is escaped."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def words(text: Column) -> Column:
    return F.regexp_extract_all(clean_line(text), F.lit(WORD), F.lit(0))


def _expanded(tokens: Column, table: dict[str, list[str]]) -> Column:
    known = lookup(table)
    return F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(*table)), lambda t: known[t]))  # a set is asked at once, a map key by key


def ordered_tokens(text: Column, aliases: dict[str, list[str]] | None = None, normal: dict[str, str] | None = None) -> Column:
    """Tokens in order: the parts of a word if it has several, else the word; aliases and normal forms replace."""
    aliases, normal = aliases or vocab.ALIASES, normal or vocab.NORMAL_FORMS
    replace = lookup({**{k: [v] for k, v in normal.items()}, **aliases})
    split = lambda w: let(F.regexp_extract_all(w, F.lit(PART), F.lit(0)), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(w)))
    known = (*normal, *aliases)
    return F.flatten(F.transform(F.flatten(F.transform(words(text), split)), lambda t: let(F.lower(t), lambda x: F.when(x.isin(*known), replace[x]).otherwise(F.array(x)))))


def has_sequence(tokens: Column, expected: list[str]) -> Column:
    """True where the tokens hold the expected ones one after the other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(expected)} "))


def has_phrase(text: Column, expected: list[str]) -> Column:
    return has_sequence(ordered_tokens(text), expected)


def concepts(text: Column) -> Column:
    """The set of concepts of a text, as an array without repeats."""
    normal = {k: [v] for k, v in vocab.NORMAL_FORMS.items()}

    def base(found: Column) -> Column:
        parts = F.flatten(F.transform(found, lambda w: F.regexp_extract_all(w, F.lit(PART), F.lit(0))))
        return F.array_distinct(F.transform(F.concat(found, parts), lambda t: F.lower(t)))

    first = let(let(words(text), base), lambda b: F.concat(b, _expanded(b, vocab.ALIASES), _expanded(b, normal)))
    found = F.array_distinct(let(first, lambda f: F.concat(f, _expanded(f, vocab.CONTEXT))))

    def with_phrases(found: Column) -> Column:
        for phrase, more in vocab.PHRASES.items():
            # ordered tokens are concepts too, so few texts need the dearer look at their order
            held = reduce(and_, (F.array_contains(found, t) for t in phrase)) & has_phrase(text, list(phrase))
            found = F.array_union(found, F.when(held, F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
        return found

    return let(found, with_phrases)


def trigrams(tokens: Column) -> Column:
    """Character 3-grams of the sorted, joined concept tokens; a shorter string is its own only gram."""
    def cut(joined: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 2, F.lit(1))), lambda i: F.substring(joined, i, F.lit(3)))
        return F.filter(F.array_distinct(grams), lambda g: g != "")

    return let(F.array_join(F.array_sort(tokens), " "), cut)
