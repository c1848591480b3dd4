"""Many keywords in one pass over a text: a prefix-tree pattern finds which are there, and only those are looked at further."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vacantia.functions.text import escape_pattern

#: Up to here every keyword gets a test of its own in generated code; beyond, the expression would outgrow it.
MANY = 64
_END = ""


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _after(word: str) -> str:
    return r"(?!\w)" if _is_word(word[-1]) else r"(?=\w)"


def _tree(words: Sequence[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[_END] = word
    return root


def _pattern(node: dict, bounded: bool) -> str:
    """The longest word of the tree that fits: longer branches are tried before the word that ends here."""
    branches = [escape_pattern(ch) + _pattern(child, bounded) for ch, child in sorted(node.items()) if ch != _END]
    if _END in node:
        branches.append(_after(node[_END]) if bounded else "")
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def tree_pattern(words: Sequence[str], bounded: bool = False) -> str:
    """Pattern that captures, at every place, the longest of the (lower-case) words beginning there; ``bounded`` asks for ASCII word
    boundaries at both ends."""
    if not bounded:
        return f"(?=({_pattern(_tree(words), False)}))"
    starts = []
    for before, own in ((r"(?<!\w)", [w for w in words if _is_word(w[0])]), (r"(?<=\w)", [w for w in words if not _is_word(w[0])])):
        if own:
            starts.append(before + _pattern(_tree(own), True))
    return f"(?=({'|'.join(starts)}))"


def _inside(word: str, longer: str, bounded: bool) -> bool:
    """Whether the word is there wherever ``longer`` is found: it begins it, and the boundary after it holds inside."""
    if word == longer:
        return True
    if not longer.startswith(word):
        return False
    following = _is_word(longer[len(word)])
    return not bounded or (not following if _is_word(word[-1]) else following)


def rules_present(lowered: Column, rules: Sequence[tuple[str, dict]], bounded: bool = False) -> Column:
    """Array of the rules whose word is in the text, as structs ordered by their place in ``rules``; each rule is (word, fields), all with the same
    fields, of which ``place`` is added. Empty words are never there. The text is searched once; a lookup table turns what was found into rules."""
    placed = [(w, {"place": i, **fields}) for i, (w, fields) in enumerate(rules) if w]
    names = list(placed[0][1]) if placed else ["place"]
    kinds = {n: ("string" if placed and isinstance(placed[0][1][n], str) else "bigint") for n in names}
    struct = ", ".join(f"{n}: {kinds[n]}" for n in names)
    if not placed:
        return F.expr(f"cast(array() as array<struct<{struct}>>)")
    by_word: dict[str, list[dict]] = {}
    for word, fields in placed:
        by_word.setdefault(word, []).append(fields)
    prefixes = {w: [p for p in (w[:n] for n in range(1, len(w) + 1)) if p in by_word and _inside(p, w, bounded)] for w in by_word}
    table = {w: [fields for p in own for fields in by_word[p]] for w, own in prefixes.items()}
    lookup = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"map<string, array<struct<{struct}>>>")
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(tree_pattern(list(by_word), bounded)), F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(lookup, w)))))
