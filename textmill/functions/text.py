"""Text columns: trimming, word counts, previews."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill import schemas

# The characters a trim removes (U+0000 to U+0020), the ASCII
# whitespace that separates words, and the mark of an absent text.
TRIMMED = "".join(chr(code) for code in range(0x21))
WHITESPACE = r"[ \t\n\x0B\f\r]+"
NO_CONTENT = "[No content]"

# A word counts when it holds an ASCII letter or digit and no line separator. The
# parts never give characters back, so a text is passed over once.
_GAP, _LINE = r" \t\n\x0B\f\r", r"\u0085\u2028\u2029"
MEANINGFUL = (
    rf"(?<![^{_GAP}])[^{_GAP}{_LINE}A-Za-z0-9]*+[A-Za-z0-9][^{_GAP}{_LINE}]*+(?![^{_GAP}])"
)


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def not_blank(text: Column) -> Column:
    """True for a text with something left after trimming; null and blank give false."""
    return F.coalesce(trimmed(text) != "", F.lit(False))


def filled(text: Column) -> Column:
    """The text, or null when it is blank."""
    return bound(text, lambda value: F.when(trimmed(value) != "", value))


def meaningful_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(MEANINGFUL)), F.lit(0))


def preview(text: Column, n: int = schemas.PREVIEW_CHARS) -> Column:
    return (
        F.when(text.isNull(), NO_CONTENT)
        .when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("...")))
        .otherwise(text)
    )
