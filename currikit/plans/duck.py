"""The text rules as DuckDB expressions, for the oracle queries."""

from __future__ import annotations

from currikit.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replace_all(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def strip(x: str) -> str:
    return replace_all(x, T.STRIP)


def normalize(x: str) -> str:
    t = f"translate(coalesce({x}, ''), chr(160), ' ')"
    t = replace_all(replace_all(t, T.FENCE), "[ \t]+", "' '")
    return strip(replace_all(t, "\n{3,}", "chr(10) || chr(10)"))


def clean(x: str) -> str:
    t = normalize(x)
    for p in (T.COMMENT_OPEN, T.BLOCK_OPEN, T.BLOCK_CLOSE):
        t = replace_all(t, p)
    line = strip(replace_all("x", T.LINE_STAR))
    lines = f"list_filter(list_transform(regexp_split_to_array({t}, {lit(T.LINE_BREAK)}), lambda x: {line}), lambda x: x <> '')"
    return normalize(f"array_to_string({lines}, chr(10))")


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def found(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)})"


def token_len(x: str) -> str:
    return f"CAST(len({found(x, T.TOKEN)}) AS INTEGER)"


def words(x: str) -> str:
    return found(f"lower({normalize(x)})", T.WORD_TOKEN)


def code_ratio(x: str) -> str:
    """Of a normalised text."""
    return f"CASE WHEN length({x}) > 0 THEN (length({x}) - length(translate({x}, {lit(T.CODE_CHARS)}, ''))) / length({x}) ELSE 0e0 END"


def bad_reason(x: str) -> str:
    """Of a cleaned text."""
    return f"""CASE WHEN {x} = '' THEN 'empty' WHEN {matches(f"lower({x})", T.CODE_BLOCK)} THEN 'code_block' WHEN {code_ratio(x)} > {T.CODE_LIKE_LIMIT}e0 THEN 'code_like'
      WHEN {matches(x, T.KEYWORDS)} THEN 'contains_code' WHEN {matches(f"lower({x})", T.REFUSAL)} THEN 'assistant_refusal' WHEN len({words(x)}) < {T.MIN_WORDS} THEN 'too_short' END"""


def english(x: str) -> str:
    """Of a normalised text."""
    other = replace_all(x, r"[\x00-\x7F]")
    return f"({matches(x, '[A-Za-z]')} AND length({other}) / greatest(length({x}), 1) < {T.NON_ASCII_LIMIT}e0)"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct(list_concat({a}, {b}))) ELSE 0e0 END"


def probability(x: str, low: str = "-5e-1", high: str = "5e-1") -> str:
    share = f"((greatest({low}, least({high}, {x})) - {low}) / ({high} - {low}))"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(1e-4, least(1e0 - 1e-4, {share})) END"


def pooled(*ps: str) -> str:
    yes = " * ".join(["1e0", *(f"coalesce({p}, 1e0)" for p in ps)])
    no = " * ".join(["1e0", *(f"coalesce(1e0 - {p}, 1e0)" for p in ps)])
    return f"CASE WHEN coalesce({', '.join(ps)}) IS NOT NULL AND ({yes}) + ({no}) > 0 THEN ({yes}) / (({yes}) + ({no})) END"


def seeded(seed: str, row_id: str) -> str:
    return f"md5(concat_ws('|', {lit(seed)}, {row_id}))"
