"""Column-level helpers (all built on JVM-side Spark functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference: characters not allowed in file names.
FILENAME_FORBIDDEN = r'[<>:"/\\|?*]'
# Fixed values of the reference: characters replaced before title casing.
TITLE_SEPARATORS = r"""[\s'"()]"""
# Unicode word token (Java's \w is ASCII-only).
WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def safe_double(c) -> Column:
    """Bad number -> NULL (ANSI casts raise, ``try_cast`` does not)."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def numeric_or(c, default: float = 0.0) -> Column:
    return F.coalesce(safe_double(c), F.lit(float(default)))


def title_case(c) -> Column:
    """Python ``str.title``: upper-case a letter after any non-letter, lower-case the rest."""
    chars = F.split(F.lower(col(c)), "")
    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(ch)
            ).otherwise(ch),
        ),
        "",
    )


def sanitise_name(c, variant: str = "file") -> Column:
    """'file': forbidden file-name characters -> '_'; 'title': separators -> '_' then title case."""
    if variant == "file":
        return F.regexp_replace(col(c), FILENAME_FORBIDDEN, "_")
    return title_case(F.regexp_replace(col(c), TITLE_SEPARATORS, "_"))


def nonempty_flag(c) -> Column:
    """TRUE when the array has an element; NULL array -> FALSE."""
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def clip_negative(c) -> Column:
    """max(x, 0) with NULL -> 0."""
    return F.coalesce(F.greatest(col(c), F.lit(0)), F.lit(0))


def token_count(c, sep: str = ",") -> Column:
    """Tokens of a separated list, NULL -> 0."""
    return F.when(col(c).isNull(), F.lit(0)).otherwise(F.size(F.split(col(c), sep)))


def token_distinct_count(c, sep: str = ",") -> Column:
    """Distinct raw tokens of a separated list (no trimming, as ``set(x.split(','))``), NULL -> 0."""
    return F.when(col(c).isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.split(col(c), sep))))


def full_name(struct_col) -> Column:
    return F.concat(struct_col["first_name"], F.lit(" "), struct_col["last_name"])


def tokens(c, min_len: int = 1) -> Column:
    """Lower-case Unicode word tokens."""
    pat = WORD if min_len <= 1 else r"[\p{L}\p{N}_]{%d,}" % min_len
    return F.regexp_extract_all(F.lower(col(c)), F.lit(pat), 0)


def stable_hash(c, seed: int) -> Column:
    """Integer in [0, 2^32) from the first 32 bits of md5("<value>:<seed>").

    Deterministic across runs, task retries and engines (the SQL oracle
    computes the same value), used for reproducible draws and orders.
    """
    txt = F.concat(col(c).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


def stable_unit(c, seed: int) -> Column:
    """``stable_hash`` scaled to [0, 1)."""
    return stable_hash(c, seed) / F.lit(4294967296.0)
