"""URL expressions, tolerant of malformed input."""

from __future__ import annotations

from .text import any_in, quoted


def netloc(url: str) -> str:
    """Authority of a URL with its port, lower case; empty if there is none."""
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def host(url: str) -> str:
    """Authority without a leading www."""
    return f"regexp_replace({netloc(url)}, '^www[.]', '')"


def path(url: str) -> str:
    """Path of a URL as it stands, empty if there is none."""
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def segments(url: str) -> str:
    return f"filter(split({path(url)}, '/'), s -> s <> '')"


def domain(url: str) -> str:
    """Identity of a site: authority, or the path of something without one; no leading www; lower case."""
    whole = f"CASE WHEN {netloc(url)} <> '' THEN regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ELSE {path(url)} END"
    return f"lower(regexp_replace({whole}, '^www[.]', ''))"


def root_domain(url: str) -> str:
    """Last two labels of the host, or null with fewer than two."""
    h = host(url)
    return f"CASE WHEN size(split({h}, '[.]')) >= 2 THEN substring_index({h}, '.', -2) END"


def registered(host_column: str, second_level: list[str]) -> str:
    """Registered domain of a host: two labels, three under a two-letter country with a common second level."""
    parts = f"filter(split(lower(coalesce({host_column}, '')), '[.]'), p -> p <> '')"
    seconds = ", ".join(quoted(s) for s in second_level)
    return (
        f"CASE WHEN size({parts}) <= 2 THEN array_join({parts}, '.')"
        f" WHEN try_element_at({parts}, -2) IN ({seconds}) AND length(try_element_at({parts}, -1)) = 2 THEN array_join(slice({parts}, -3, 3), '.')"
        f" ELSE array_join(slice({parts}, -2, 2), '.') END"
    )


#: Kinds of pages by substrings of the URL. The three classifiers differ in order and words on purpose.
PARSED_KINDS = [
    ("booking", ["book", "booking", "reserv", "agenda", "cita"]),
    ("pricing", ["pricing", "precio", "precios", "quote", "cotiza"]),
    ("services", ["service", "servicio"]),
    ("locations", ["location", "ubicacion", "locations", "sede"]),
    ("contact", ["contact", "contacto"]),
    ("about", ["about", "nosotros", "equipo"]),
    ("careers", ["career", "trabajo", "empleo"]),
]
CRAWL_KINDS = [
    ("contact", ["contact", "contacto"]),
    ("locations", ["location", "ubicacion", "locations", "sede"]),
    ("pricing", ["pricing", "precio", "precios", "cotiza"]),
    ("booking", ["book", "booking", "reserv", "agenda", "cita"]),
    ("services", ["service", "servicio"]),
    ("about", ["about", "nosotros", "equipo"]),
    ("careers", ["career", "trabajo", "empleo"]),
]
STORED_KINDS = [
    ("contact", ["contact", "contacto"]),
    ("booking", ["book", "reserv", "agenda"]),
    ("pricing", ["pricing", "precio", "precios", "cotiza"]),
    ("services", ["service", "servicio"]),
    ("about", ["about", "nosotros", "equipo"]),
    ("careers", ["career", "trabajo", "empleo"]),
]


def page_kind(url: str, kinds: list[tuple[str, list[str]]]) -> str:
    whens = " ".join(f"WHEN {any_in(f'lower({url})', words)} THEN {quoted(kind)}" for kind, words in kinds)
    return f"CASE {whens} ELSE 'other' END"


def crawl_priority(kind: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {i}" for i, (k, _) in enumerate(CRAWL_KINDS))
    return f"CASE {kind} {whens} ELSE {len(CRAWL_KINDS)} END"
