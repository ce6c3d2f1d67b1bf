"""String building blocks as column expressions (no Python runs on the executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line terminators that ECMAScript's trim() removes.
JS_WS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Arabic yeh, alef maksura and kaf, and the Persian letters they fold to.
FOLD_FROM = "يىك"
FOLD_TO = "ییک"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(c: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def js_trim(c: Column) -> Column:
    """Strip the ECMAScript white-space set from both ends."""
    return F.btrim(c, F.lit(JS_WS))


def is_blank(c: Column) -> Column:
    return js_trim(or_empty(c)) == ""


def normalize_text(c: Column) -> Column:
    """Lower-case, fold Arabic letter variants, trim; NULL gives the empty string."""
    return js_trim(F.translate(F.lower(or_empty(c)), FOLD_FROM, FOLD_TO))
