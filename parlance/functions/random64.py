"""Reproducible random streams as columns: unsigned 64-bit generators by 32-bit limbs, and draws from distributions.

A 64-bit number is a long with the same bits, so half of them are negative; unsigned() shows one as it is meant. Sums and
products wrap in limbs that never pass 2^63, as longs that overflow are an error. A stream's seed comes from a master seed,
a name and an epoch, so stream k of a key is reached at once, wherever its row is: reruns and partitions change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _SHORT = 0xFFFFFFFF, 0xFFFF
#: The generators' increment and multipliers, and the byte hash's start and prime.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bits(x: int) -> Column:
    """A literal of 64 bits."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def unsigned(x: Column) -> Column:
    """The number of a long's bits, as a decimal."""
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW).cast("long"))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64."""
    return let(_low(a) + _low(b), lambda low: _joined(_high(a) + _high(b) + _high(low), low))


def times(a: Column, by: int) -> Column:
    """a * by modulo 2^64."""
    c0, c1, high = by & _SHORT, (by >> 16) & _SHORT, by >> 32

    def product(x: Column) -> Column:
        """The low 64 bits of a limb by the factor's low limb, as (high, low) parts."""
        p0, p1 = _low(x) * F.lit(c0), _low(x) * F.lit(c1)
        low = _low(p0) + F.shiftleft(p1.bitwiseAND(F.lit(_SHORT).cast("long")), 16)
        return F.struct((_high(p0) + F.shiftrightunsigned(p1, 16) + _high(low)).alias("h"), _low(low).alias("l"))

    def short(x: Column, factor: int) -> Column:
        """x * factor modulo 2^32."""
        return _low(_low(x) * F.lit(factor & _SHORT) + F.shiftleft((_low(x) * F.lit(factor >> 16)).bitwiseAND(F.lit(_SHORT).cast("long")), 16))

    return let(a, lambda x: let(product(x), lambda p: _joined(p["h"] + short(_high(x), by & _LOW) + short(x, high), p["l"])))


def rotated(x: Column, k: int) -> Column:
    return F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def split_mix(state: Column) -> Column:
    """The number that a state of the mixing generator gives; the next state is add(state, GOLDEN)."""
    step = lambda shift, by: lambda z: times(z.bitwiseXOR(F.shiftrightunsigned(z, shift)), by)
    mixed = let(let(add(state, bits(GOLDEN)), step(30, MIX_1)), step(27, MIX_2))
    return let(mixed, lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def byte_hash(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes or a binary, of 64 bits; null for null."""
    digits = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    return F.aggregate(digits, bits(FNV_START), lambda h, d: times(h.bitwiseXOR(F.conv(d, 16, 10).cast("long")), FNV_PRIME))


def stream_seed(master: int, name: Column, epoch: Column) -> Column:
    """The seed of a name's stream in an epoch (a long)."""
    return split_mix(bits(master).bitwiseXOR(byte_hash(name)).bitwiseXOR(times(epoch.cast("long"), GOLDEN)))


def draws(seed: Column, n: int) -> Column:
    """The first n numbers (few) of the stream with a seed, as an array of longs: four mixed numbers are the state of a
    generator of 256 bits that shifts and rotates."""

    def begun(s: Column) -> Column:
        states = [s]
        for _ in range(3):
            states.append(add(states[-1], bits(GOLDEN)))
        return F.struct(*(split_mix(x).alias(f"s{k}") for k, x in enumerate(states)), F.array().cast("array<long>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        s0, s1, s2, s3 = (state[f"s{k}"] for k in range(4))
        x2, x3 = s2.bitwiseXOR(s0), s3.bitwiseXOR(s1)
        fresh = let(times(s1, 5), lambda x: times(rotated(x, 7), 9))
        return F.struct(
            s0.bitwiseXOR(x3).alias("s0"), s1.bitwiseXOR(x2).alias("s1"), x2.bitwiseXOR(F.shiftleft(s1, 17)).alias("s2"),
            let(x3, lambda x: rotated(x, 45)).alias("s3"), F.concat(state["out"], F.array(fresh)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), let(seed, begun), step, lambda state: state["out"])


def uniform(x: Column) -> Column:
    """A drawn number as a double in [0, 1), of its upper 53 bits."""
    return F.shiftrightunsigned(x, 11).cast("double") * F.lit(2.0**-53)


def below(numbers: Column, n: int) -> Column:
    """An unbiased integer in [0, n) of some drawn numbers: of x * n the upper half, for the first x whose lower half isn't
    among the few that would favour small results; null if none is (of probability n / 2^64 each). n is under 2^31."""
    if not 0 < n < 1 << 31:
        raise ValueError("n must be from 1 to 2^31 - 1")
    least = ((1 << 64) - n) % n

    def split(x: Column) -> Column:
        return let(_low(x) * n, lambda p: let(_high(x) * n + _high(p), lambda q: F.struct(_high(q).alias("value"), _joined(q, p).alias("rest"))))

    # Unsigned comparison: the sign bits are turned.
    turned = lambda x: x.bitwiseXOR(bits(1 << 63))
    fit = F.filter(F.transform(numbers, split), lambda s: turned(s["rest"]) >= turned(bits(least)))
    return F.try_element_at(fit, F.lit(1))["value"]


#: The rational approximation of the normal quantile (relative error under 1.2e-9) in the middle and in the tails.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def normal_quantile(p: Column) -> Column:
    """The value that a standard normal variable is under with probability p; p is held within (0, 1)."""
    inner = F.greatest(F.lit(2.0**-54), F.least(p, F.lit(1 - 2.0**-53)))
    tail = lambda q: _polynomial(q, _C) / _polynomial(q, _D)
    middle = lambda q: let(q * q, lambda r: _polynomial(r, _A) * q / _polynomial(r, _B))
    return let(inner, lambda x: F.when(x < _TAIL, tail(F.sqrt(-2 * F.log(x)))).when(x > 1 - _TAIL, -tail(F.sqrt(-2 * F.log(1 - x)))).otherwise(middle(x - 0.5)))


def exponential(u: Column, mean: float) -> Column:
    return -mean * F.log(1 - u)


def normal(u: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return mean + deviation * normal_quantile(u)


def log_normal(u: Column, mu: float, sigma: float) -> Column:
    return F.exp(normal(u, mu, sigma))


def truncated_normal(u: Column, deviation: float, limit: float) -> Column:
    """A normal variable given that it lies within limit deviations of 0: the quantile of the part of (0, 1) between them."""
    from statistics import NormalDist

    low = NormalDist().cdf(-limit)
    return deviation * F.greatest(F.lit(-limit), F.least(F.lit(limit), normal_quantile(low + u * (1 - 2 * low))))


def weighted_choice(u: Column, weights: Column) -> Column:
    """The place (from 0) in an array of weights at which their running sum passes u of the whole; those that aren't positive
    are never chosen, null if none is positive."""
    own = F.transform(weights, lambda w: F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(own, F.lit(0.0), lambda s, w: s + w)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"), F.lit(None).cast("int").alias("last"))

    def walk(target: Column) -> Column:
        step = lambda s, w: F.struct(
            (s["sum"] + w).alias("sum"), (s["at"] + 1).alias("at"),
            F.coalesce(s["found"], F.when((w > 0) & (target < s["sum"] + w), s["at"])).alias("found"), F.when(w > 0, s["at"]).otherwise(s["last"]).alias("last"),
        )
        return F.aggregate(own, zero, step, lambda s: F.coalesce(s["found"], s["last"]))

    return let(u * total, walk)
