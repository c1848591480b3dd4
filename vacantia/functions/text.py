"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vacantia.fixed_values import BLANK_CHARS, BLANK_CLASS

LIST_SEPARATOR = "\u001f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(BLANK_CHARS))


def strip_html_spaced(c: Column | str) -> Column:
    """Tags become spaces, blank runs become one space, ends are trimmed."""
    spaced = F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(spaced, BLANK_CLASS + "+", " "))


def strip_tags_tight(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]*>", "")


def cut_text(c: Column | str, n: int) -> Column:
    return F.nullif(F.substring(col(c), 1, n), F.lit(""))


def truthy_coalesce(*cs: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def truthy_number(c: Column | str) -> Column:
    """Null for null, zero and NaN."""
    return F.when((col(c) != 0) & ~F.isnan(col(c).cast("double")), col(c))


def join_parts(*cs: Column | str, fallback: Column | str | None = None) -> Column:
    """Non-empty parts joined by comma and space; the fallback when there is none."""
    joined = F.nullif(F.concat_ws(", ", *[F.nullif(col(c), F.lit("")) for c in cs]), F.lit(""))
    return joined if fallback is None else F.coalesce(joined, F.nullif(col(fallback), F.lit("")))


def years_requirement(c: Column | str) -> Column:
    pattern = rf"(\d+){BLANK_CLASS}*\+?{BLANK_CLASS}*years?"
    years = F.nullif(F.regexp_extract(F.lower(col(c)), pattern, 1), F.lit(""))
    return F.concat(years, F.lit("+ years"))


def count_substring(text: Column | str, keyword: str) -> Column:
    """Non-overlapping occurrences of a keyword, whatever its case; blank keyword counts 0."""
    return count_in_lowered(F.lower(col(text)), keyword)


def count_in_lowered(lowered: Column, keyword: str) -> Column:
    word = keyword.lower()
    if not word:
        return F.lit(0)
    removed = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))
    return F.coalesce(F.floor(removed / F.lit(len(word))).cast("int"), F.lit(0))


def escape_pattern(keyword: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in keyword)


def word_pattern(keyword: str) -> str:
    """The keyword between ASCII word boundaries. Its end characters are known, so each boundary is one look, made where the keyword is found."""
    word = keyword.lower()

    def is_word(ch: str) -> bool:
        return ch.isascii() and (ch.isalnum() or ch == "_")

    before = "(?<!" if is_word(word[0]) else "(?<="
    after = r"(?!\w)" if is_word(word[-1]) else r"(?=\w)"
    return rf"{escape_pattern(word)}{before}\w{escape_pattern(word)}){after}"


def count_word(text: Column | str, keyword: str) -> Column:
    if not keyword:
        return F.lit(0)
    return F.coalesce(F.regexp_count(F.lower(col(text)), F.lit(word_pattern(keyword))), F.lit(0))


def sql_text(value: str) -> str:
    """The value as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_word(lowered: str, keyword: str) -> str:
    """SQL test whether a lowered text column holds the keyword as a word; the plain search runs first."""
    if not keyword:
        return "false"
    return f"(contains({lowered}, {sql_text(keyword.lower())}) and rlike({lowered}, {sql_text(word_pattern(keyword))}))"


def has_free_word(text: str, words: Sequence[str]) -> str:
    """SQL test whether a text column holds any of the words, as they are written, with no word character on either side."""
    tests = [rf"{escape_pattern(w)}(?<!\w{escape_pattern(w)})(?!\w)" for w in words]
    return "(" + (" or ".join(f"(contains({text}, {sql_text(w)}) and rlike({text}, {sql_text(t)}))" for w, t in zip(words, tests)) or "false") + ")"


def at_least_pattern(k: int) -> str:
    """Pattern of the one- and two-digit numbers that are at least ``k``."""
    if k <= 0:
        return r"\d{1,2}"
    if k <= 9:
        return rf"0?[{k}-9]|[1-9]\d"
    if k > 99:
        return r"(?!)"
    tens, ones = divmod(k, 10)
    higher = rf"|[{tens + 1}-9]\d" if tens < 9 else ""
    return rf"{tens}[{ones}-9]{higher}"


def min_years_pattern(k: int) -> str:
    return rf"(?=\d)(?<!\w)(?:{at_least_pattern(k)}){BLANK_CLASS}*\+?{BLANK_CLASS}*(?:years?|yrs?)(?!\w)"


def min_years_hit(text: Column | str, k: int) -> Column:
    """Whether any ``N years`` in the text has N at least ``k``."""
    return F.coalesce(F.lower(col(text)).rlike(min_years_pattern(k)), F.lit(False))


def compact_list(items: list[str]) -> Column:
    """Array of the non-null SQL text items, in order; plain string work keeps it in generated code."""
    if not items:
        return F.expr("cast(array() as array<string>)")
    joined = f"concat_ws({sql_text(LIST_SEPARATOR)}, {', '.join(items)})"
    return F.expr(f"if({joined} = '', cast(array() as array<string>), split({joined}, {sql_text(LIST_SEPARATOR)}))")
