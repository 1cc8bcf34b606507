"""SQL snippets shared by the check queries."""

from __future__ import annotations

from qassay import constants as C


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '\\s+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '\\s+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


def ascii_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def invalid(x: str) -> str:
    return f"coalesce(lower({strip(x)}), '') IN {in_list(C.INVALID_ANSWERS)}"


def f1(p: str, g: str) -> str:
    """F1 of two token lists."""
    common = (
        f"coalesce(list_sum(list_transform(list_distinct({p}), "
        f"lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda y: y = t))))), 0)"
    )
    return (
        f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0::DOUBLE WHEN len({p}) = 0 OR len({g}) = 0 OR {common} = 0 THEN 0.0::DOUBLE "
        f"ELSE 2 * ({common}::DOUBLE / len({p})) * ({common}::DOUBLE / len({g})) "
        f"/ ({common}::DOUBLE / len({p}) + {common}::DOUBLE / len({g})) END"
    )


def any_contains(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(p)})" for p in phrases) + ")"


def refusal_gold(x: str) -> str:
    return f"(contains({norm(x)}, {quote(C.REFUSAL_SUBSTRING)}) OR {norm(x)} IN {in_list(C.REFUSAL_EXACT)})"


def refusal_class(x: str) -> str:
    p = strip(x)
    return (
        f"CASE WHEN {invalid(x)} THEN 'empty' WHEN contains(lower({p}), {quote(C.REFUSAL_SUBSTRING)}) THEN 'canonical_refusal' "
        f"WHEN {any_contains(f'lower({p})', C.EXPLICIT_REFUSALS)} THEN 'explicit_refusal' "
        f"WHEN {any_contains(f'lower({p})[1:{C.SOFT_REFUSAL_PREFIX}]', C.SOFT_REFUSALS)} THEN 'soft_refusal' "
        f"WHEN length({p}) > {C.CONTEXT_DUMP_CHARS} THEN 'context_dump' ELSE 'invented_answer' END"
    )


def invented(cls: str) -> str:
    return f"({cls}) IN {in_list(C.INVENTED_CLASSES)}"


def refusing(cls: str) -> str:
    return f"({cls}) IN {in_list(C.REFUSAL_CLASSES)}"


def tier(answer: str, g: str, r: str, d: str, o: str) -> str:
    worst = f"least({g}, {r}, {d}, {o})"
    return (
        f"CASE WHEN {invalid(answer)} OR {g} <= 2 THEN 'drop' WHEN {worst} <= 2 THEN 'low' WHEN {worst} >= 4 THEN 'high' "
        "ELSE 'medium' END"
    )


def r(x: str, digits: int = 4) -> str:
    """Half-even rounding of a double."""
    return f"round_even(CAST({x} AS DOUBLE), {digits})"


def hash_key(seed, *cols: str) -> str:
    return "sha256(" + " || ':' || ".join([f"'{seed}'", *cols]) + ")"


def hms(x: str) -> str:
    s = f"CAST(round_even({x}, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"
