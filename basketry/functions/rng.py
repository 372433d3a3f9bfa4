"""Seeded draws as column expressions.

A draw is the leading hex digits of ``md5('seed|purpose|k1|k2|...')`` read
as an integer.  It is a pure function of its keys, so a draw is the same
after a retry, a lost executor or a different partitioning, and DuckDB
computes the same value (``cast('0x' || substr(md5(..), 1, 15) as bigint)``).
``rand()`` is never used: it changes with partitioning and task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 60 bits: fits a signed bigint and keeps modulo bias below 2^-20 for
# moduli up to 2^40.
DRAW_HEX = 15
DRAW_SPAN = float(16 ** DRAW_HEX)


def _key(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def draw(seed, purpose: str, *keys) -> Column:
    """Integer in [0, 2^60), fixed by (seed, purpose, keys)."""
    text = F.concat_ws("|", _key(seed), F.lit(purpose), *[_key(k) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DRAW_HEX), 16, 10).cast("bigint")


def draw_mod(seed, purpose: str, modulus, *keys) -> Column:
    """Integer in [0, modulus)."""
    m = modulus if isinstance(modulus, Column) else F.lit(int(modulus))
    return F.pmod(draw(seed, purpose, *keys), m.cast("bigint"))


def unit(seed, purpose: str, *keys) -> Column:
    """Double in [0, 1)."""
    return draw(seed, purpose, *keys).cast("double") / F.lit(DRAW_SPAN)


def sql_draw(seed: str, purpose: str, *keys: str) -> str:
    """The DuckDB text of :func:`draw`; arguments are SQL expressions."""
    parts = ", ".join([f"cast({seed} as varchar)", f"'{purpose}'"] + [f"cast({k} as varchar)" for k in keys])
    return f"cast('0x' || substr(md5(concat_ws('|', {parts})), 1, {DRAW_HEX}) as bigint)"


def sql_draw_mod(seed: str, purpose: str, modulus: str, *keys: str) -> str:
    return f"({sql_draw(seed, purpose, *keys)} % cast({modulus} as bigint))"
