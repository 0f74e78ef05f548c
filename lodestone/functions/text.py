"""Text expressions. All are native column expressions, given as SQL fragments so that they nest cheaply."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Lists of at least so many entries are one literal and one loop over it, so that a rule costs a few expressions whatever its dictionary holds.
LONG_LIST = 3


def strings(values: Iterable[str]) -> str:
    """An array of texts. A long one is a single literal that is cut at compile time."""
    items = list(values)
    if len(items) >= LONG_LIST and not any("\n" in x for x in items):
        return f"split({quoted(chr(10).join(items))}, '\\n')"
    return "array(" + ", ".join(map(quoted, items)) + ")" if items else "cast(array() AS array<string>)"


def _each(column: str, tokens: list[str], body: str) -> str:
    """body over the text txt_ and the list toks_; a column that takes work is worked out once."""
    listed = body.replace("toks_", strings(tokens))
    return listed.replace("txt_", column) if column.isidentifier() else let("txt_", column, listed)


def any_in(column: str, tokens: Iterable[str]) -> str:
    """Whether the text contains any token as a substring. Null counts as no."""
    found = list(dict.fromkeys(tokens))
    if len(found) < LONG_LIST:
        return f"coalesce({' OR '.join(f'contains({column}, {quoted(t)})' for t in found)}, false)" if found else "false"
    return f"coalesce({_each(column, found, 'exists(toks_, tok_ -> contains(txt_, tok_))')}, false)"


def first_in(column: str, tokens: Iterable[str], prefix: str = "") -> str:
    """The first token, in order of the list, that the text contains, behind a prefix; else null."""
    first = _each(column, list(tokens), "get(filter(toks_, tok_ -> contains(txt_, tok_)), 0)")
    return f"concat({quoted(prefix)}, {first})" if prefix else first


def starts_any(column: str, tokens: Iterable[str]) -> str:
    found = list(tokens)
    return f"coalesce({_each(column, found, 'exists(toks_, tok_ -> startswith(txt_, tok_))')}, false)" if found else "false"


def hits(column: str, tokens: Iterable[str]) -> str:
    """How many entries of the list the text contains; entries that repeat count again."""
    return _each(column, list(tokens), "size(filter(toks_, tok_ -> contains(txt_, tok_)))")


def matched(column: str, tokens: Iterable[str]) -> str:
    """Array of the contained tokens in order of the list."""
    return _each(column, list(tokens), "filter(toks_, tok_ -> contains(txt_, tok_))")


def occurrences(column: str, tokens: Iterable[str]) -> str:
    """Sum of the counts of non-overlapping occurrences."""
    return _each(column, list(tokens), "aggregate(toks_, 0L, (n_, tok_) -> CASE WHEN contains(txt_, tok_) THEN n_ + (length(txt_) - length(replace(txt_, tok_, ''))) div length(tok_) ELSE n_ END)")


@cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII character, and those characters; from the Unicode tables."""
    pairs = {chr(c): n for c in range(0xA0, 0x250) if len(n := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1}
    pairs |= {chr(c): n for c in range(0x1E00, 0x1F00) if len(n := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1}
    return "".join(pairs), "".join(pairs.values())


def ascii_fold(column: str) -> str:
    """Accents off, what isn't ASCII dropped, lower case; white space as it is."""
    a, b = _accents()
    return f"lower(regexp_replace(translate(coalesce({column}, ''), {quoted(a)}, {quoted(b)}), '[^\\\\x00-\\\\x7F]', ''))"


def fold_padded(column: str) -> str:
    """Folded, with a blank at each end."""
    return f"concat(' ', {ascii_fold(column)}, ' ')"


def fold_trimmed(column: str) -> str:
    """Folded, white space collapsed and trimmed."""
    return f"trim(regexp_replace({ascii_fold(column)}, '\\\\s+', ' '))"


def collapse(column: str) -> str:
    """White space collapsed and trimmed, case kept; null is empty."""
    return f"trim(regexp_replace(coalesce({column}, ''), '\\\\s+', ' '))"


def lower_padded(column: str) -> str:
    """Lower case, collapsed, a blank at each end; one blank if nothing is left. Accents stay."""
    return let("low", f"lower({collapse(column)})", "CASE WHEN low = '' THEN ' ' ELSE concat(' ', low, ' ') END")


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, so that a long value is computed once however often body names it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def first_of_each(items: str, key: str) -> str:
    """The first item of each key, in order. key is in terms of x, an item. Sorted, so that time isn't the square of the items."""
    ranked = f"array_sort(transform({items}, (x, n) -> named_struct('k', {key}, 'n', n, 'x', x)))"
    new = "filter(ranked_, (e, j) -> j = 0 OR NOT (e.k <=> ranked_[j - 1].k))"
    return let("ranked_", ranked, f"transform(array_sort(transform({new}, e -> named_struct('n', e.n, 'x', e.x))), e -> e.x)")


def best_of(scores: dict[str, str], least: str) -> str:
    """Name of the greatest score if it is over least; the first name wins ties."""
    ranked = "array_max(array(" + ", ".join(f"named_struct('s', {s}, 'o', {-i}, 'n', {quoted(n)})" for i, (n, s) in enumerate(scores.items())) + "))"
    return let("best", ranked, f"CASE WHEN best.s > {least} THEN best.n END")


def even(value: str, digits: int) -> str:
    """Rounding half to even."""
    return f"bround({value}, {digits})"


def truthy(column: str) -> str:
    """A text, or null if it is empty."""
    return f"nullif({column}, '')"
