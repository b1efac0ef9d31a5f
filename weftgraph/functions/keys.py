"""Key normalisation used wherever two tables meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are removed at both ends of a key (fixed values).
BLANKS = " \t\n\r\u00a0\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str) -> Column:
    """Blanks at both ends removed, upper case; null stays null."""
    return F.upper(F.btrim(col(c), F.lit(BLANKS)))


def real_key(c: Column | str) -> Column:
    """``norm_key`` with blank keys as null."""
    return F.nullif(norm_key(c), F.lit(""))


def reference_key(c: Column | str) -> Column:
    """``real_key`` with the sentinel ``ALL`` as null too: such values refer to nothing."""
    return F.nullif(real_key(c), F.lit("ALL"))
