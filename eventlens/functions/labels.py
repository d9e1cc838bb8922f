"""Display labels (E-14 … E-17) as map lookups and ``when`` chains."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, key)


def bias_label(c, labels: dict = fx.BIAS_LABELS, unknown: str = fx.BIAS_LABEL_UNKNOWN) -> Column:
    """E-14: bias value → display label, anything else → the 'unknown' label."""
    return F.coalesce(_lookup(labels, _c(c)), F.lit(unknown))


def bias_css(c, classes: dict = fx.BIAS_CSS) -> Column:
    """E-16: exact-match css class, else 'unknown'."""
    return F.coalesce(_lookup(classes, _c(c)), F.lit("unknown"))


def language_label(c) -> Column:
    """E-16: 'ar' → Arabic label, else the code itself."""
    return F.when(_c(c) == "ar", F.lit(fx.LANGUAGE_AR_LABEL)).otherwise(_c(c))


def local_label(c) -> Column:
    """E-16: 'local' → local label, anything else → international label."""
    return F.when(_c(c) == "local", F.lit(fx.LABEL_LOCAL)).otherwise(F.lit(fx.LABEL_INTERNATIONAL))


def blindspot_caption(c, captions: dict = fx.BLINDSPOT_CAPTIONS) -> Column:
    """E-17: caption for three of the five blindspot types (null for the others)."""
    return _lookup(captions, _c(c))
