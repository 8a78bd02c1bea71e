"""DuckDB SQL fragments mirroring the Spark column expressions (oracle side)."""

from __future__ import annotations

from papertrail import constants as K
from papertrail.functions.tokens import PUNCT_CLASS_RE2


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def char_len(c: str) -> str:
    return f"CAST(CASE WHEN {c} IS NULL OR {c} = '' THEN 0 ELSE length({c}) END AS BIGINT)"


def space_tokens(c: str) -> str:
    return f"CAST(CASE WHEN {c} IS NULL OR {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END AS BIGINT)"


def graph_len(c: str) -> str:
    return f"CAST(coalesce(length({c}), 0) AS BIGINT)"


def graph_tokens(c: str) -> str:
    return f"CAST(CASE WHEN {c} IS NULL THEN 0 ELSE len(string_split({c}, ' ')) END AS BIGINT)"


def list_chars(c: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({c}, lambda x: coalesce(length(x), 0))), 0) AS BIGINT)"


def list_tokens(c: str) -> str:
    return (f"CAST(coalesce(list_sum(list_transform({c}, lambda x: CASE WHEN x IS NULL THEN 0 "
            f"ELSE len(string_split(x, ' ')) END)), 0) AS BIGINT)")


def ratio0(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN CAST(({num}) AS DOUBLE) / ({den}) ELSE 0.0 END"


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def clean_phrase(e: str, stop=K.TABULAR_STOPWORDS) -> str:
    s = f"lower({ustrip(e)})"
    s = f"regexp_replace({s}, {lit(PUNCT_CLASS_RE2)}, ' ', 'g')"
    s = ustrip(f"regexp_replace({s}, '\\s{{2,}}', ' ', 'g')")
    return (f"list_filter(string_split({s}, ' '), lambda t: length(t) > 1 "
            f"AND NOT list_contains({str_list(stop)}, t))")


def ws_tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array({ustrip('coalesce(' + e + ', ' + lit('') + ')')}, '\\s+'), lambda t: t <> '')"


def jaro(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL "
            f"WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 "
            f"WHEN greatest(length({a}), length({b})) <= 1 THEN 0.0 "
            f"ELSE jaro_similarity({a}, {b}) END)")


def prefix(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    eq = f"list_transform(range(1, {n} + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1))"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE coalesce(nullif(list_position({eq}, false), 0) - 1, {n}) END)"


def jaro_winkler(a: str, b: str, scale: float = K.WINKLER_SCALE) -> str:
    j = jaro(a, b)
    return f"({j} + {prefix(a, b)} * {scale} * (1.0 - {j}))"
