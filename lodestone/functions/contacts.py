"""Emails and phones: extraction and validation as expressions."""

from __future__ import annotations

from ..rules import pages
from .text import any_in, quoted

#: Fixed values.
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:(?:\+|00)\d{1,3}[\s\-./]?)?(?:\(?\d{2,4}\)?[\s\-./]?){2,5}\d{2,4}"
METRIC_HINTS = ["followers", "likes", "views", "seguidores", "vistas", "k", "m"]
ASCENDING, DESCENDING = "01234567890", "09876543210"
MAIL_EDGES = ".,;:()[]{}<>\"'"


def extract_emails(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(EMAIL)}, 0)"


def extract_phones(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(PHONE)}, 0)"


def email(candidate: str, blocklist: list[str] = pages.EMAIL_BLOCKLIST) -> str:
    """Normalised address, or null without an @ or with a blocked part."""
    clean = f"lower(trim(BOTH {quoted(MAIL_EDGES)} FROM trim({candidate})))"
    return f"CASE WHEN contains({clean}, '@') AND NOT {any_in(clean, blocklist)} THEN {clean} END"


def phone_digits(candidate: str) -> str:
    """Digits and plus signs, with a leading 00 as plus."""
    kept = f"regexp_replace({candidate}, '[^0-9+]', '')"
    return f"regexp_replace({kept}, '^00', '+')"


def _dated(d: str) -> str:
    """Eight digits that read as day, month, year or year, month, day. Fixed-width digits compare as text."""
    part = lambda a, n: f"substring({d}, {a}, {n})"
    first = f"{part(1, 2)} BETWEEN '01' AND '31' AND {part(3, 2)} BETWEEN '01' AND '12' AND {part(5, 4)} BETWEEN '1900' AND '2100'"
    second = f"{part(1, 4)} BETWEEN '1900' AND '2100' AND {part(5, 2)} BETWEEN '01' AND '12' AND {part(7, 2)} BETWEEN '01' AND '31'"
    return f"(length({d}) = 8 AND (({first}) OR ({second})))"


def phone_rejection(candidate: str, n: str | None = None, d: str | None = None) -> str:
    """Why a candidate is no phone number; null if it is one. n, d: names that hold phone_digits and the digits alone."""
    n = n or phone_digits(candidate)
    d = d or f"regexp_replace({n}, '[+]', '')"
    low = f"lower({candidate})"
    return (
        f"CASE WHEN length({n}) - length(replace({n}, '+', '')) > 1 OR (contains({n}, '+') AND NOT startswith({n}, '+')) THEN 'invalid_plus_format'"
        f" WHEN length({d}) < 7 OR length({d}) > 15 THEN 'invalid_length'"
        f" WHEN {_dated(d)} THEN 'date_like'"
        f" WHEN (contains({low}, ':') AND length({d}) <= 8) OR {low} rlike '\\\\b[0-9]{{1,2}}:[0-9]{{2}}\\\\b' THEN 'timestamp_like'"
        f" WHEN {any_in(low, METRIC_HINTS)} OR (length({d}) IN (8, 10) AND substring({d}, 1, 2) IN ('19', '20')) THEN 'metric_like'"
        f" WHEN replace({d}, left({d}, 1), '') = '' OR contains('{ASCENDING}', {d}) OR contains('{DESCENDING}', {d}) THEN 'sequence_noise' END"
    )


def phone(candidate: str) -> str:
    return f"CASE WHEN {phone_rejection(candidate)} IS NULL THEN {phone_digits(candidate)} END"


def judged_phones(candidates: str) -> str:
    """Array of structs (c, n, d, reason) of an array of candidates; n is the number where reason is null."""
    step = f"transform({candidates}, c -> named_struct('c', c, 'n', {phone_digits('c')}))"
    step = f"transform({step}, x -> named_struct('c', x.c, 'n', x.n, 'd', regexp_replace(x.n, '[+]', '')))"
    return f"transform({step}, x -> named_struct('c', x.c, 'n', x.n, 'd', x.d, 'reason', {phone_rejection('x.c', 'x.n', 'x.d')}))"


def tally(reasons: str) -> str:
    """Counts per value of an array, as a map."""
    return f"map_from_entries(transform(array_sort(array_distinct(array_compact({reasons}))), r -> struct(r, size(filter({reasons}, q -> q = r)))))"
