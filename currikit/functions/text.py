"""Text rules as column expressions: cleaning, tokens, predicates and record fields.

``\\w``, ``\\s`` and ``\\b`` mean Unicode letters, digits and white space here,
whatever the regex engine's default, so the classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, patterns, prompt wording and names that results depend on.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WS = r"[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
FENCE = "```" + f"(?:{WORD}+)?"
STRIP = f"^{WS}+|{WS}+$"
COMMENT_OPEN = f"^{WS}*(//+|#+){WS}*"
BLOCK_OPEN = rf"^{WS}*/\*+{WS}*"
BLOCK_CLOSE = rf"{WS}*\*/{WS}*$"
LINE_STAR = rf"^{WS}*\*{WS}?"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"
WORD_TOKEN = f"[A-Za-z_]{WORD}*"
CODE_CHARS = "{}[]();=<>`/\\|"
SPECIAL = f"<img({NOT_WORD}|$)|<a({NOT_WORD}|$)|</?{WORD}+[^>]*>|https?://|www\\."
CODE_BLOCK = "```|<code|</code"
KEYWORDS = f"(^|{NOT_WORD})(import|def|class|return|public|private|function|var|let|const){WS}+[A-Za-z_]"
REFUSAL = f"(^|{NOT_WORD})(as an ai|i cannot|i'm sorry|cannot determine|not enough information)({NOT_WORD}|$)"
CODE_LIKE_LIMIT, NON_ASCII_LIMIT, MIN_WORDS = 0.08, 0.08, 3
PROMPT = ("Generate a concise English docstring that summarizes the following code.", "Return only the docstring text.")
TRUNCATED, HEAD_SHARE = "# ... truncated long code ...", 0.65
LANGUAGES = ("go", "java", "javascript", "php", "python", "ruby")
LEVELS = ("easy", "medium", "hard")
KEY_MARKERS = ("layers.", "embed_tokens.", "norm.", "lm_head.", "lora_A.", "lora_B.")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it: nested rules would grow without end otherwise."""
    return F.transform(F.array(value), body)[0]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.trim(text, F.lit(WS_CHARS))


def normalize_text(text: Column) -> Column:
    """Null becomes empty; no-break spaces, fences and runs of blanks and blank lines are evened out; ends are stripped."""
    t = F.translate(F.coalesce(text, F.lit("")), "\u00a0", " ")
    t = F.regexp_replace(F.regexp_replace(t, FENCE, ""), "[ \t]+", " ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_docstring(text: Column) -> Column:
    """Normalised text without comment marks, line stars and empty lines."""
    t = normalize_text(text)
    for pattern in (COMMENT_OPEN, BLOCK_OPEN, BLOCK_CLOSE):
        t = F.regexp_replace(t, pattern, "")
    lines = F.transform(F.split(t, LINE_BREAK, -1), lambda x: strip(F.regexp_replace(x, LINE_STAR, "")))
    return normalize_text(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def token_len(text: Column) -> Column:
    """Number of words and single marks."""
    return F.regexp_count(text, F.lit(TOKEN))


def word_tokens(text: Column, normalize: bool = True) -> Column:
    """Lower-case identifiers and words that begin with an ASCII letter or an underscore."""
    return _all(F.lower(normalize_text(text) if normalize else F.coalesce(text, F.lit(""))), WORD_TOKEN)


def field_tokens(tokens: Column, text: Column) -> Column:
    """The token list, normalised, lower-cased and without empty ones; where there is none, the words of the text."""
    listed = F.filter(F.transform(tokens, lambda x: F.lower(normalize_text(x))), lambda x: x != "")
    return F.when(tokens.isNotNull(), listed).otherwise(word_tokens(text))


def code_like_ratio(text: Column, normalize: bool = True) -> Column:
    """Share of characters that code is full of; 0 for an empty text."""

    def ratio(t: Column) -> Column:
        n = F.length(t)
        return F.when(n > 0, (n - F.length(F.translate(t, CODE_CHARS, ""))) / n).otherwise(F.lit(0.0))

    return let(normalize_text(text) if normalize else F.coalesce(text, F.lit("")), ratio)


def bad_docstring_reason(text: Column, clean: bool = True) -> Column:
    """The first rule that a docstring breaks, or null."""

    def reason(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(t == "", "empty")
            .when(F.rlike(low, F.lit(CODE_BLOCK)), "code_block")
            .when(code_like_ratio(t, clean) > CODE_LIKE_LIMIT, "code_like")
            .when(F.rlike(t, F.lit(KEYWORDS)), "contains_code")
            .when(F.rlike(low, F.lit(REFUSAL)), "assistant_refusal")
            .when(F.size(word_tokens(t, clean)) < MIN_WORDS, "too_short")
        )

    return let(clean_docstring(text) if clean else strip(F.coalesce(text, F.lit(""))), reason)


def is_probably_english(text: Column) -> Column:
    def english(t: Column) -> Column:
        other = F.length(F.regexp_replace(t, r"[\x00-\x7F]+", ""))
        return F.rlike(t, F.lit("[A-Za-z]")) & (other / F.greatest(F.length(t), F.lit(1)) < NON_ASCII_LIMIT)

    return let(normalize_text(text), english)


def has_special_tokens(text: Column) -> Column:
    """Whether a docstring has tags or addresses."""
    return F.rlike(F.lower(normalize_text(text)), F.lit(SPECIAL))


def is_fit_doc(doc: Column, tokens: Column, least: int = 3, most: int = 256) -> Column:
    """Whether a cleaned docstring has a fitting length, no tags or addresses, and looks English."""
    return F.size(field_tokens(tokens, doc)).between(least, most) & ~has_special_tokens(doc) & is_probably_english(doc)


def passes_doc_filter(docstring: Column, tokens: Column, least: int = 3, most: int = 256) -> Column:
    """The same of a docstring as it comes."""
    return let(clean_docstring(docstring), lambda doc: is_fit_doc(doc, tokens, least, most))


def first_nonblank(*values: Column) -> Column:
    """The first string that is not blank, or an empty one."""
    return F.coalesce(*(F.when(strip(v) != "", strip(v)) for v in values), F.lit(""))


def extract_text(text: Column | None = None, messages: Column | None = None) -> Column:
    """Text as it is, stripped; of a list of messages the first of the user, or the list as JSON where there is none."""
    if messages is None:
        return strip(F.coalesce(text, F.lit("")))
    user = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return strip(F.coalesce(user, F.to_json(messages), F.lit("")))


def build_query(code: Column, func_name: Column, language: Column) -> Column:
    """The prompt for a code sample; the function's name only where there is one."""
    name = normalize_text(func_name)
    named = F.when(name != "", F.concat(F.lit("Function: "), name))
    fence = F.lit("```")
    return F.concat_ws("\n", *map(F.lit, PROMPT), F.concat(F.lit("Language: "), language), named, F.lit(""), F.lit("Code:"), F.concat(fence, language), normalize_text(code), fence, F.lit(""), F.lit("Docstring:"))


def chat_template(query: Column, system: Column | None = None) -> Column:
    """System, user and assistant turns with their marks; an empty system turn is left out."""
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    head = F.lit("") if system is None else F.when(F.coalesce(system, F.lit("")) != "", turn("system", system)).otherwise("")
    return F.concat(head, turn("user", query), F.lit("<|im_start|>assistant\n"))


def sample_id(language: Column, split: Column, own: Column, index: Column) -> Column:
    return F.concat_ws(":", language, split, F.coalesce(own.cast("string"), index.cast("string")))


def row_identity(repo: Column, path: Column, func_name: Column, own: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(text(repo).alias("repo"), text(path).alias("path"), text(func_name).alias("func_name"), text(own).alias("id"))


def synthetic_candidates(chosen: Column) -> Column:
    """Altered docstrings in order of preference: another verb for returning, for creating, and the last two words swapped."""

    def altered(doc: Column) -> Column:
        swap = lambda verb, new: F.when(F.rlike(doc, F.lit(rf"(?is)(^|{NOT_WORD}){verb}s?({NOT_WORD}|$)")), F.regexp_replace(doc, rf"(?is)^((?:.*?{NOT_WORD})?){verb}s?(?={NOT_WORD}|$)", f"$1{new}"))
        return F.filter(F.array(swap("return", "validates"), swap("create", "deletes"), let(F.filter(F.split(doc, f"{WS}+"), lambda w: w != ""), swapped)), lambda c: c.isNotNull())

    def swapped(words: Column) -> Column:
        n = F.size(words)
        return F.when(n >= 6, F.concat_ws(" ", F.slice(words, F.lit(1), n - 2), F.get(words, n - 1), F.get(words, n - 2)))

    return let(clean_docstring(chosen), altered)


def difficulty_of_source(source: Column) -> Column:
    out = F.lit("unknown")
    for level in reversed(LEVELS):
        out = F.when(F.contains(source, F.lit(level)), level).otherwise(out)
    return out


def origin_of_source(source: Column) -> Column:
    return F.when(source.startswith("public_"), "public").otherwise("local")


def level_id(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int")


def suffix_from_marker(key: Column) -> Column:
    """The part of a parameter key from the first marker that it has, in the markers' order."""
    out = key
    for m in reversed(KEY_MARKERS):
        out = F.when(F.contains(key, F.lit(m)), F.substring(key, F.locate(m, key), F.length(key))).otherwise(out)
    return out


def is_lora_a(key: Column) -> Column:
    return F.contains(key, F.lit("lora_A"))


def is_lora_b(key: Column) -> Column:
    return F.contains(key, F.lit("lora_B"))


def pair_key(query: Column, chosen: Column, rejected: Column) -> Column:
    return F.to_json(F.struct(chosen.alias("chosen"), query.alias("query"), rejected.alias("rejected")), {"ignoreNullFields": "false"})


def truncate_middle(tokens: Column, budget: Column, mark: str = TRUNCATED) -> Column:
    """A token list cut to a budget: head and tail with a mark between; a budget of 16 or less keeps the head only."""
    head = F.greatest(F.lit(8), F.floor(budget * HEAD_SHARE).cast("int"))
    tail = F.greatest(F.lit(8), budget - head)
    tail = F.when(head + tail > budget, F.greatest(F.lit(1), budget - head)).otherwise(tail)
    cut = F.concat(F.slice(tokens, F.lit(1), head), F.array(F.lit(mark)), F.slice(tokens, -tail, tail))
    return F.when(F.size(tokens) <= budget, tokens).when(budget <= 16, F.slice(tokens, F.lit(1), budget)).otherwise(cut)


def fit_budget(n_tokens: Column, overhead: Column, limit: int, mark_tokens: int = 0) -> Column:
    """Tokens that code may have so that the prompt fits: the first of up to 8 shrinking budgets that does, else the last; null where the whole prompt fits."""
    budget = F.greatest(F.lit(32), F.lit(limit) - overhead - 16)
    steps = [budget]
    for _ in range(7):
        steps.append(F.greatest(F.lit(32), F.floor(steps[-1] * 0.85).cast("int")))
    out = steps[-1]
    for b in reversed(steps[:-1]):
        final = overhead + F.when(n_tokens > b, b + mark_tokens).otherwise(n_tokens)
        out = F.when((final <= limit) | (b <= 32), b).otherwise(out)
    return F.when(n_tokens + overhead > limit, out)


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def language_list(text: str | None, known: Sequence[str] = LANGUAGES) -> list[str]:
    """Names parted by commas or white space; none, or ``all``, means all known ones."""
    names = (text or "").replace(",", " ").split()
    return list(known) if not names or names == ["all"] else names
