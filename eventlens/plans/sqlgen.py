"""DuckDB text of the expressions in ``eventlens.functions`` (oracle side only)."""
from __future__ import annotations

from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(T.STRIP_RE)}, '', 'g')"


def norm_v1(x: str) -> str:
    return f"translate(regexp_replace(coalesce({x}, ''), {lit(T.MARKS_V1_RE)}, '', 'g'), 'أإآةى', 'اااهي')"


def norm_v2(x: str) -> str:
    return f"translate(regexp_replace(coalesce({x}, ''), {lit(T.MARKS_V2_RE)}, '', 'g'), 'إأآةى', 'اااهي')"


def normalize_text(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), {lit(T.PUNCT_RE)}, '', 'g'))"


def content_hash(h: str, d: str) -> str:
    return f"sha256(lower({strip(norm_v1(h))}) || '|' || lower({strip(norm_v1(d))}))"


def entities(s: str) -> str:
    """The named references that the test pages hold, and the common ones; the ampersand last."""
    for name, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("copy", 169), ("middot", 183),
                       ("laquo", 171), ("raquo", 187), ("ndash", 8211), ("mdash", 8212), ("hellip", 8230), ("amp", 38)):
        s = f"replace({s}, '&{name};', chr({code}))"
    return s


def html_to_text(x: str) -> str:
    s = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    s = f"regexp_replace({s}, {lit(r'(?is)<script\b[^>]*>.*?</script\s*>')}, chr(1), 'g')"
    s = f"regexp_replace({s}, {lit(r'(?is)<style\b[^>]*>.*?</style\s*>')}, chr(1), 'g')"
    s = entities(f"regexp_replace({s}, '<[^>]*>', chr(1), 'g')")
    parts = f"list_transform(string_split({s}, chr(1)), lambda p: {strip('p')})"
    return f"array_to_string(list_filter({parts}, lambda p: p <> ''), '')"


def image_url_from_html(x: str) -> str:
    tag = f"regexp_extract(coalesce({x}, ''), '(?i)<img\\b[^>]*>')"
    src = entities(f"trim(regexp_extract({tag}, {lit(r'(?i)\s+src=("[^"]*|[^ >]+)')}, 1), '\"')")
    return f"coalesce(nullif({src}, ''), 'N/A')"


def any_contains(col: str, needles: list[str]) -> str:
    if not needles:
        return "false"
    return "(" + " OR ".join(f"contains({col}, {lit(n)})" for n in needles) + ")"
