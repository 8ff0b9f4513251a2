"""Column helpers.

All of them are plain Spark expressions that stay inside whole-stage codegen,
except ``format_exact`` (an Arrow-batched formatter for small report tables).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace characters we split and strip on (ASCII
# whitespace: tab, newline, vertical tab, form feed, carriage return, space).
# Written so that Java regex and RE2 read it the same way.
WS_CLASS = r"[\t\n\x0B\f\r ]"

# Fixed value: every character that counts as white space at the ends of a
# text (Python's str.strip set), in a form Java regex and RE2 both read.
STRIP_CLASS = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters one by one.
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """B2: trim all whitespace at both ends (Spark ``trim`` drops spaces only)."""
    c = _col(c)
    return F.regexp_replace(F.regexp_replace(c, "^" + STRIP_CLASS + "+", ""),
                            STRIP_CLASS + r"+\z", "")


def words(c) -> Column:
    """Whitespace tokens of a text, no empty tokens (empty text -> [])."""
    return F.filter(F.split(_col(c), WS_CLASS + "+"), lambda x: x != F.lit(""))


def clean_id_string(c) -> Column:
    """Remove ``[``, ``]`` and ``,``; strip; wrap in double quotes."""
    return F.concat(F.lit('"'), strip_text(F.translate(_col(c), "[],", "")), F.lit('"'))


def ids_to_string(c, sep: str = " ") -> Column:
    """Render an id array as text."""
    return F.array_join(F.transform(_col(c), lambda x: x.cast("string")), sep)


def list_repr(c) -> Column:
    """An id array rendered the way a Python list prints: ``[1, 2, 3]``."""
    return F.concat(F.lit("["), ids_to_string(c, ", "), F.lit("]"))


def output_length_limit(src_len, a: float, b: float, cap: int,
                        min_len: int | None = None, match: bool = False) -> Column:
    """``min(int(a*src_len + b), cap - 1)``; fails the task below ``min_len``.

    With ``match`` the limit is ``src_len`` itself (give the batch's longest
    source): output as long as input, no factor and no cap."""
    limit = _col(src_len).cast("long") if match else F.least(
        F.floor(F.lit(float(a)) * _col(src_len) + F.lit(float(b))), F.lit(cap - 1).cast("long"))
    if min_len is None:
        return limit
    return F.when(F.assert_true(limit >= F.lit(min_len),
                                F.lit("output length limit below min_len")).isNull(), limit)


def source_length(tokens, pad: int, eos: int) -> Column:
    """Tokens that are neither eos nor pad."""
    return F.size(F.filter(_col(tokens), lambda x: ~x.isin(pad, eos)))


LN2 = math.log(2.0)


def to_log2(c) -> Column:
    """Natural-log score to base 2."""
    return _col(c) / F.lit(LN2)


def format_fixed(c, decimals: int = 4) -> Column:
    """A number with a fixed count of decimals, rounded half-even (JVM
    ``format_number`` without grouping commas).  ``format_string('%.4f')``
    rounds half-up on the shortest decimal form instead, which differs from
    Python and C formatting on decimal ties."""
    v = _col(c).cast("double")
    return (F.when(F.isnan(v), F.lit("nan")).when(v == F.lit(float("inf")), F.lit("inf"))
            .when(v == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(F.regexp_replace(F.format_number(v, decimals), ",", "")))


def format_exact(c, decimals: int = 3) -> Column:
    """Python's ``'%.{decimals}f' % x`` exactly (correct rounding of the
    binary value); a missing value prints as ``nan``.  An Arrow-batched helper for small report tables; the
    per-row path is ``format_fixed``."""
    fmt = f"%.{decimals}f"

    @F.pandas_udf("string")
    def fixed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: "nan" if pd.isna(x) else fmt % x)

    return fixed(_col(c).cast("double"))


def format_repr(c) -> Column:
    """Python's ``str(x)`` of a number; a missing value prints as ``nan``.
    For small report tables, like ``format_exact``."""
    @F.pandas_udf("string")
    def plain(v: pd.Series) -> pd.Series:
        return v.map(lambda x: "nan" if pd.isna(x) else repr(float(x)))

    return plain(_col(c).cast("double"))


def render_scores(c, decimals: int = 4, sep: str = " ") -> Column:
    """An array of scores rendered with 4 decimals and space-joined."""
    return F.array_join(F.transform(_col(c), lambda x: format_fixed(x, decimals)), sep)


def strip_pad(tokens, pad) -> Column:
    """Remove pad ids."""
    return F.array_remove(_col(tokens), pad)


def padding_mask(tokens, pad) -> Column:
    """True where the token is the pad id."""
    return F.transform(_col(tokens), lambda x: x == F.lit(pad))


def append_token(tokens, token) -> Column:
    """Append a separator token."""
    return F.concat(_col(tokens), F.array(F.lit(token)))


def drop_first(tokens) -> Column:
    """Drop the first token."""
    t = _col(tokens)
    return F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))


def take_prefix(tokens, n: int) -> Column:
    """The first ``n`` tokens."""
    return F.slice(_col(tokens), 1, n)


def from_offset(tokens, offset: int) -> Column:
    """Tokens from a 0-based offset on."""
    t = _col(tokens)
    return F.slice(t, offset + 1, F.greatest(F.size(t) - offset, F.lit(0)))


def vector_norm(vec) -> Column:
    return F.sqrt(F.aggregate(_col(vec), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vec, scale: float = 1.0) -> Column:
    """C11: unit-length vector, optionally scaled; zero vectors stay zero."""
    v = _col(vec)
    norm = F.greatest(vector_norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double") / norm)


def partial_accuracy(hyp, ref) -> Column:
    """``max(0, matches - len_diff) / len(ref)``.

    The hypothesis is cut to the reference length; each missing position is a
    miss and also subtracts one; extra tokens cost nothing.  Missing positions
    are null (never equal to a real token).  An empty reference gives null.
    """
    h, r = _col(hyp), _col(ref)
    matches = F.size(F.filter(F.zip_with(r, h, lambda a, b: a == b), lambda m: m))
    len_diff = F.greatest(F.size(r) - F.size(h), F.lit(0))
    return F.when(F.size(r) > 0,
                  F.greatest(matches - len_diff, F.lit(0)).cast("double") / F.size(r))


def exact(hyp_text, ref_text) -> Column:
    """Exact match as 0/1 (plain string equality; null never matches)."""
    return F.coalesce((_col(hyp_text) == _col(ref_text)).cast("int"), F.lit(0))


def length_normalized(score, length, penalty: float = 1.0, normalize: bool = True) -> Column:
    """``score / length ** penalty`` (length counts eos); switchable off."""
    if not normalize:
        return _col(score)
    return _col(score) / F.pow(_col(length).cast("double"), F.lit(float(penalty)))
