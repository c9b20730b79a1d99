"""Column functions over text: normalising, tokenising, story-time labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K

# Python's whitespace class: Unicode White_Space plus the ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c) -> Column:
    """Collapse whitespace, trim, lower-case; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), SPACE, " ")))


def canonical_name(c) -> Column:
    """Normalised name without a leading article; other symbols become one space.

    The words are taken out and joined: a search for all that is no word takes several times as long.
    """
    plain = F.regexp_replace(norm_text(c), r"^the\s+", "")
    return F.array_join(F.regexp_extract_all(plain, F.lit("[a-z0-9一-鿿]+"), F.lit(0)), " ")


def squash_text(c) -> Column:
    """Letters, digits and underscore only, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"[^\p{L}\p{N}_]+", ""))


def tokenize(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit(K.TOKEN_PATTERN), 0)


def content_tokens(c) -> Column:
    """Distinct tokens longer than one character that are not stop words."""
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    return F.filter(F.array_except(tokenize(c), stop), lambda t: F.length(t) > 1)


def word_regex(words: list[str]) -> str:
    """Case-insensitive whole-word alternation with Unicode word boundaries."""
    return r"(?iU)\b(" + "|".join(words) + r")\b"


def time_day(label, strict: bool = False) -> Column:
    """Story day of a label; ``strict`` asks for a word boundary before the marker."""
    pattern = (r"\b" if strict else "") + K.DAY_PATTERN
    day = F.regexp_extract(F.lower(F.trim(as_col(label))), pattern, 1)
    return F.expr("cast(null as int)") if label is None else F.when(day != "", day.try_cast("int"))


def time_period(label) -> Column:
    text = F.lower(F.coalesce(as_col(label), F.lit("")))
    out = F.lit(None).cast("string")
    for name in reversed(K.PERIODS):
        out = F.when(text.contains(name), name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def _lookup(values: dict, key, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(as_col(key), F.lit(""))), F.lit(default))


def period_rank(period) -> Column:
    return _lookup(K.PERIOD_RANK, F.lower(as_col(period)), 0)


def period_hour(period) -> Column:
    return _lookup(K.PERIOD_HOUR, period, 12)


def period_duration(period) -> Column:
    return _lookup(K.PERIOD_DURATION, period, 8)


def visible_prefix(text, mask_char) -> Column:
    """Text before a mask offset; no mask or a non-positive one shows everything."""
    text, mask_char = as_col(text), as_col(mask_char)
    return F.when(mask_char > 0, F.left(text, mask_char)).otherwise(text)


def tail_window(text, size: int) -> Column:
    return F.right(as_col(text), F.lit(size))


def head_tail(text, head: int, tail: int, gap: str = "\n...\n") -> Column:
    text = as_col(text)
    cut = F.concat(F.left(text, F.lit(head)), F.lit(gap), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > head + tail, cut).otherwise(text)


def hex_int(digest, start: int, width: int = 8) -> Column:
    """Integer value of ``width`` hex digits of a digest."""
    return F.conv(F.substring(as_col(digest), start, width), 16, 10).cast("long")


def hash_mod(key, n) -> Column:
    """Deterministic pseudo-random integer in [0, n) from a string key."""
    return hex_int(F.md5(as_col(key)), 1) % n
