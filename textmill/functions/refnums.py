"""Reference numbers: the pair of 6-digit numbers in a file name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill import schemas
from textmill.functions.text import bound
from textmill.functions.urls import POLICY, REFERENCE

# The number written in a name (a plus and leading zeros are allowed,
# and blanks around it), and the name: two numbers, at most one more extension, .txt.
# Six digits without a leading zero are exactly 100000 to 999999.
_NUMBER = r"[\x00-\x20]*\+?0*([1-9][0-9]{5})[\x00-\x20]*"
NAME_WITH_REFNUMS = rf"(?si)\A{_NUMBER}-{_NUMBER}-*(?:\.[^.]*)?\.txt\z"

# Why a number is refused, after its name.
IS_NULL = "cannot be null"
NOT_SIX_DIGITS = "must be a 6-digit integer (100000-999999), got: "


def parse_refnums(name: Column) -> Column:
    """`struct<refnum1, refnum2>`, or null for any other name."""

    digits = F.split(F.regexp_replace(name, NAME_WITH_REFNUMS, "$1-$2"), "-")
    return bound(F.when(name.rlike(NAME_WITH_REFNUMS), digits), lambda pair: F.when(
        pair.isNotNull(),
        F.struct(F.get(pair, 0).cast("int").alias("refnum1"), F.get(pair, 1).cast("int").alias("refnum2")),
    ))


def valid_refnum(number: Column) -> Column:
    return F.coalesce(number.between(schemas.REFNUM_MIN, schemas.REFNUM_MAX), F.lit(False))


def resolve_refnums(parsed: Column, doc_type: Column, defaults=schemas.DEFAULT_REFNUMS) -> Column:
    """Both parsed numbers or both defaults; a reference document has none."""
    default = F.struct(*[
        F.lit(value).cast("int").alias(name) for name, value in zip(("refnum1", "refnum2"), defaults)
    ])
    return F.when(doc_type != REFERENCE, F.coalesce(parsed, default))


def refnum_error(doc_type: Column, refnum1: Column, refnum2: Column) -> Column:
    """Why a policy row has to be refused; null when it may be stored."""

    def reason(number, name):
        out_of_range = F.concat(F.lit(f"{name} {NOT_SIX_DIGITS}"), number.cast("string"))
        return F.when(number.isNull(), f"{name} {IS_NULL}").when(~valid_refnum(number), out_of_range)

    problem = F.coalesce(reason(refnum1, "refnum1"), reason(refnum2, "refnum2"))
    return F.when(doc_type == POLICY, problem)
