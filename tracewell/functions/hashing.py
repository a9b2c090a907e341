"""64-bit avalanche hashing with native integer expressions.

Multiplication modulo 2**64 is done on 22/22/20-bit limbs and addition on 32-bit halves,
so nothing overflows a long and the expressions are valid with ANSI mode on. Each
intermediate value is bound once (``_let``), so the expression stays small when the
optimizer copies it, for example into a pushed-down filter. The expressions are built as SQL
text, which the session parses in one call. Unsigned values live in signed longs; order by
``unsigned_order`` to sort them as unsigned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash constants and salts that results depend on.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
ITEM_MULTIPLIER = 0xD2B74407B1CE6E93
SPLIT_SALT = 0xA17E5D93C4B28601
SAMPLE_SALT = 0x6C8E9CF570932BD5
GAP_SALT = 0xD1B54A32D192ED03

_MASK64 = (1 << 64) - 1


def signed(value: int) -> int:
    """The signed long with the same 64 bits."""
    value &= _MASK64
    return value - (1 << 64) if value >> 63 else value


def _lit(value: int) -> str:
    return f"cast('{signed(value)}' as bigint)"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _shr(x: str, bits: int) -> str:
    return f"shiftrightunsigned({x}, {bits})"


def _low(x: str, bits: int) -> str:
    return f"({x} & {_lit((1 << bits) - 1)})"


def xor_shift(x: str, bits: int) -> str:
    return _let(x, "v", f"(v ^ {_shr('v', bits)})")


def wrap_add(x: str, constant: int) -> str:
    """x + constant (mod 2**64)."""
    constant &= _MASK64
    low = f"({_low('v', 32)} + {_lit(constant & ((1 << 32) - 1))})"
    high = _low(f"({_shr('v', 32)} + {_lit(constant >> 32)} + {_shr('s', 32)})", 32)
    return _let(x, "v", _let(low, "s", f"(shiftleft({high}, 32) | {_low('s', 32)})"))


def wrap_multiply(x: str, constant: int) -> str:
    """x * constant (mod 2**64)."""
    constant &= _MASK64
    c0, c1, c2 = (_lit(c) for c in (constant & ((1 << 22) - 1), (constant >> 22) & ((1 << 22) - 1), constant >> 44))
    a0, a1, a2 = _low("v", 22), _low(_shr("v", 22), 22), _shr("v", 44)
    middle = f"({a0} * {c1} + {a1} * {c0})"
    bottom = f"({a0} * {c0} + shiftleft({_low('m', 22)}, 22))"
    high = _low(f"({_shr('b', 44)} + {_shr('m', 22)} + {a0} * {c2} + {a1} * {c1} + {a2} * {c0})", 20)
    joined = f"(shiftleft({high}, 44) | {_low('b', 44)})"
    return _let(x, "v", _let(middle, "m", _let(bottom, "b", joined)))


def splitmix64_sql(x: str) -> str:
    z = wrap_add(f"cast({x} as bigint)", GOLDEN)
    z = wrap_multiply(xor_shift(z, 30), MIX_1)
    z = wrap_multiply(xor_shift(z, 27), MIX_2)
    return xor_shift(z, 31)


def splitmix64(x: str) -> Column:
    """The splitmix64 avalanche of a long (column name or SQL expression) read as unsigned."""
    return F.expr(splitmix64_sql(x))


def unsigned_order(h: Column) -> Column:
    return h.bitwiseXOR(F.expr(_lit(1 << 63)))


def unsigned_decimal(h: Column) -> Column:
    """The unsigned value as decimal(20, 0)."""
    value = h.cast("decimal(20,0)")
    return F.when(h < 0, value + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def _bucket_10000(h: str) -> str:
    """Unsigned ``h % 10000``."""
    return _let(h, "v", f"(2 * ({_shr('v', 1)} % 5000) + (v & 1))")


def learner_split(learner: str) -> Column:
    """0 train (70 %), 1 calibration (15 %), 2 test (15 %), fixed per learner."""
    bucket = _bucket_10000(splitmix64_sql(f"(cast({learner} as bigint) ^ {_lit(SPLIT_SALT)})"))
    return F.expr(_let(bucket, "b", "case when b < 7000 then 0 when b < 8500 then 1 else 2 end"))


def _learner_skill(learner: str, skill: str) -> str:
    return f"cast({learner} as bigint) ^ shiftleft(cast({skill} as bigint), 32)"


def sample_priority(learner: str, skill: str, class_code: str) -> Column:
    key = f"{_learner_skill(learner, skill)} ^ shiftleft(cast({class_code} as bigint), 60)"
    return splitmix64(f"({key} ^ {_lit(SAMPLE_SALT)})")


def gap_priority(learner: str, skill: str, timestamp: str) -> Column:
    return splitmix64(f"({_learner_skill(learner, skill)} ^ cast({timestamp} as bigint) ^ {_lit(GAP_SALT)})")


def keyed_uniform(seed: int, stream: int, learner: str, step: int, skill: str, item: str) -> Column:
    """A reproducible uniform in [0, 1) that depends only on its keys."""
    fixed = (seed + GOLDEN * (stream + 1)) & _MASK64
    fixed ^= ((step + 1) * MIX_1) & _MASK64
    by_skill = wrap_multiply(f"(cast({skill} as bigint) + 1)", MIX_2)
    by_item = wrap_multiply(f"(cast({item} as bigint) + 1)", ITEM_MULTIPLIER)
    x = f"(cast({learner} as bigint) ^ {_lit(fixed)} ^ {by_skill} ^ {by_item})"
    x = wrap_multiply(xor_shift(x, 30), MIX_1)
    x = xor_shift(wrap_multiply(xor_shift(x, 27), MIX_2), 31)
    return F.expr(f"cast({_shr(x, 11)} as double) * {1.0 / (1 << 53)!r}D")
