"""Text expressions (E-1 … E-6, E-19, E-22 … E-25) as built-in Spark Columns.

Everything here is a composition of JVM expressions (regexp_replace,
translate, sha2, higher-order array functions), so it runs inside
whole-stage code generation with no Python in the hot path.
"""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx

# The characters Python's str.strip()/str.isspace() treat as white space,
# written as one regex class body that both Java regex and RE2 accept.
WS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
STRIP_RE = rf"^[{WS}]+|[{WS}]+\z"
# Python's [^\w\s] (Unicode): not a letter, number, underscore or white space.
PUNCT_RE = rf"[^\p{{L}}\p{{N}}_{WS}]"
# Arabic marks removed by the two normalisers.
MARKS_V1_RE = r"[\x{064B}-\x{065F}\x{0670}]"
MARKS_V2_RE = r"[\x{064B}-\x{0652}\x{0640}]"
SEP = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as literal characters (for btrim).
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(c) -> Column:
    """Python ``str.strip()``: trim the white-space set at both ends (no regex)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def arabic_normalize_v1(c) -> Column:
    """E-1: drop marks U+064B–065F and U+0670; أإآ→ا; ة→ه; ى→ي; null→''."""
    x = F.regexp_replace(F.coalesce(_c(c), F.lit("")), MARKS_V1_RE, "")
    return F.translate(x, "أإآةى", "اااهي")


def arabic_normalize_v2(c) -> Column:
    """E-2: drop the eight marks U+064B–0652 and tatweel U+0640; إأآا→ا; ة→ه; ى→ي."""
    x = F.regexp_replace(F.coalesce(_c(c), F.lit("")), MARKS_V2_RE, "")
    return F.translate(x, "إأآةى", "اااهي")


def normalize_text(c) -> Column:
    """E-3: remove everything but letters, numbers, '_' and white space; lower-case."""
    return F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), PUNCT_RE, ""))


def content_hash(headline, description) -> Column:
    """E-4: sha256 hex of ``norm1(h).strip().lower() + '|' + norm1(d).strip().lower()``."""
    h = F.lower(strip(arabic_normalize_v1(headline)))
    d = F.lower(strip(arabic_normalize_v1(description)))
    return F.sha2(F.concat(h, F.lit("|"), d), 256)


# What an HTML reader makes of the code points 128-159: windows-1252, where that has a character.
_C1 = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
_C1_FROM = "".join(chr(n) for n, c in _C1.items() if c)
_C1_TO = "".join(c for c in _C1.values() if c)


def decode_entities(c) -> Column:
    """Character references of a text, numeric and named (HTML 4 names), each decoded once;
    anything else after an ampersand stays as it is."""
    names = F.create_map(*[F.lit(x) for name, n in name2codepoint.items() for x in (name, chr(n))])

    def piece(s: Column, i: Column) -> Column:
        name = F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9]{1,9});", 1)
        code = F.coalesce(F.nullif(F.regexp_extract(s, r"^#([0-9]{1,7});?", 1), F.lit("")).cast("int"),
                          F.conv(F.nullif(F.regexp_extract(s, r"^#[xX]([0-9A-Fa-f]{1,6});?", 1), F.lit("")), 16, 10).cast("int"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.translate(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"), _C1_FROM, _C1_TO)
        rest = F.regexp_replace(s, r"^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", "")
        kept = F.concat(F.lit("&"), s)
        return (F.when(i == 0, s)
                .when(s.startswith("#"), F.when(valid, F.concat(char, rest)).otherwise(kept))
                .otherwise(F.coalesce(F.concat(F.try_element_at(names, name), F.substr(s, F.length(name) + 2)), kept)))

    return F.array_join(F.transform(F.split(_c(c), "&"), piece), "")


def html_to_text(c) -> Column:
    """E-5: visible text of an HTML fragment, each text node stripped, joined with no separator.
    Tags, comments, scripts and style sheets separate text nodes."""
    x = F.regexp_replace(_c(c), r"(?s)<!--.*?-->", SEP)
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script\s*>", SEP)
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style\s*>", SEP)
    x = F.regexp_replace(x, r"<[^>]*>", SEP)
    parts = F.transform(F.split(x, SEP), lambda p: strip(decode_entities(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "")


IMG_RE = r"""(?i)<img\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
IMG_SRC_RE = r"""(?i)\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def image_url(media_url, encoded, description) -> Column:
    """E-6: media:content url, else the src of the first <img> of content:encoded (if non-empty)
    or of the description, else 'N/A'."""
    html = F.when(F.coalesce(_c(encoded), F.lit("")) != "", _c(encoded)).otherwise(_c(description))
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), IMG_RE, 0)
    src = F.element_at(F.transform(F.array(tag), lambda t: F.concat(*[F.regexp_extract(t, IMG_SRC_RE, k) for k in (1, 2, 3)])), 1)
    return F.coalesce(F.nullif(_c(media_url), F.lit("")), F.nullif(decode_entities(src), F.lit("")), F.lit("N/A"))


def truncate(c, n: int = fx.TRUNCATE_TITLE, ellipsis: str = "") -> Column:
    """E-19: first ``n`` characters (+ optional suffix)."""
    return F.concat(F.substring(_c(c), 1, n), F.lit(ellipsis))


def clean_model_response(c) -> Column:
    """E-22: strip; drop a leading ```json (7 chars) and a trailing ``` ; strip again."""
    x = strip(_c(c))
    x = F.when(x.startswith("```json"), F.substr(x, F.lit(8))).otherwise(x)
    x = F.when(x.endswith("```"), F.left(x, F.length(x) - 3)).otherwise(x)
    return strip(x)


def analysis_text(headline, description) -> Column:
    """E-24: ``headline + ' ' + description``."""
    return F.concat(_c(headline), F.lit(" "), _c(description))


def source_defaults(url, name, language) -> tuple[Column, Column]:
    """E-25: name defaults to the url (empty counts as absent), language to 'ar'."""
    nm = F.when(F.coalesce(_c(name), F.lit("")) == "", _c(url)).otherwise(_c(name))
    return nm, F.coalesce(_c(language), F.lit("ar"))
