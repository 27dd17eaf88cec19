"""Text and value helpers shared by identities, mappings and catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as booleans, in any case.
TRUE_WORDS = ("true", "1", "yes", "on", "active")
FALSE_WORDS = ("false", "0", "no", "off", "inactive")

SNIPPET_LENGTH = 50

_SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def non_empty(value: Column) -> Column:
    """The value, or null for an empty string: empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[non_empty(v) for v in values])


def strip(value: Column) -> Column:
    """Strips all white space, not only blanks as `trim` does."""
    return F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+$", "")


def snippet(text: Column) -> Column:
    """First 50 code points on one line, stripped; '' when there is none."""
    head = F.substring(text, 1, SNIPPET_LENGTH)
    return F.coalesce(strip(F.translate(head, "\n", " ")), F.lit(""))


def word_to_boolean(value: Column) -> Column:
    """true / false for the known words, null for anything else."""
    word = F.lower(value)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def title_case(name: Column) -> Column:
    """Upper-cases every letter that follows a non-letter, lower-cases the rest."""
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(
        runs,
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
    )
    return F.array_join(capital, "")


def field_label(name: Column) -> Column:
    return title_case(F.translate(name, "_", " "))


def like_escape(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
