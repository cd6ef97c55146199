"""The same expressions as DuckDB SQL text, for the oracle statements."""

from __future__ import annotations

from logfold.functions import vocab


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def sql_map(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {sql_list(v)}" for k, v in table.items()) + "}"


def _expand(tokens: str, table: dict[str, list[str]]) -> str:
    return f"flatten(list_transform({tokens}, lambda t: coalesce({sql_map(table)}[t], []::VARCHAR[])))"


def parts_of(x: str) -> str:
    """The text with its words parted at camel case and digit edges."""
    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = rf"regexp_replace({x}, '{pattern}', '\1 \2', 'g')"
    return x


def ordered_expr(x: str) -> str:
    found = f"regexp_extract_all({parts_of(x)}, '[A-Za-z]+|[0-9]+')"
    replace = {**{k: [v] for k, v in vocab.NORMAL_FORMS.items()}, **vocab.ALIASES}
    return f"flatten(list_transform({found}, lambda t: coalesce({sql_map(replace)}[lower(t)], [lower(t)])))"


def has_phrase_expr(x: str, expected: list[str]) -> str:
    return f"contains(' ' || array_to_string({ordered_expr(x)}, ' ') || ' ', {_q(' ' + ' '.join(expected) + ' ')})"


def concept_ctes(name: str, source: str, ids: str, text: str) -> str:
    """CTEs ending in ``name``(ids, concepts): the concept set of every row of ``source``."""
    word = "'[A-Za-z][A-Za-z0-9]*|[0-9]+'"
    normal = {k: [v] for k, v in vocab.NORMAL_FORMS.items()}
    base = f"list_distinct(list_transform(list_concat(regexp_extract_all({text}, {word}), regexp_extract_all({parts_of(text)}, {word})), lambda t: lower(t)))"
    more = sql_list(vocab.PHRASES["signed", "in"])
    return f"""{name}_0 AS (SELECT {ids}, {base} AS c, {has_phrase_expr(text, ['signed', 'in'])} AS p FROM {source}),
{name}_1 AS (SELECT {ids}, p, list_distinct(list_concat(c, list_concat({_expand('c', vocab.ALIASES)}, {_expand('c', normal)}))) AS c FROM {name}_0),
{name}_2 AS (SELECT {ids}, p, list_distinct(list_concat(c, {_expand('c', vocab.CONTEXT)})) AS c FROM {name}_1),
{name} AS (SELECT {ids}, CASE WHEN p THEN list_distinct(list_concat(c, {more})) ELSE c END AS concepts FROM {name}_2)"""


def catalog_values() -> str:
    rows = ", ".join(f"({_q(n)}, {_q(t)}, {_q(c)}, {_q(s)}, {_q(lt)}, {sql_list(v)})" for n, t, c, s, lt, v in vocab.CATALOG)
    return f"(VALUES {rows}) AS catalog(field, type, class, schema_name, logical_type, allowed_values)"
