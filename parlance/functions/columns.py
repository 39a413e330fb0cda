"""Column functions: levels, pitch, rates, interpolation, formatting, text and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def db(power: Column, floor: float = 1e-20) -> Column:
    """Ten times the decimal logarithm of a power, not under the floor's."""
    return 10 * F.log10(F.greatest(power, F.lit(floor)))


def power(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 10)


def semitones(hertz: Column, reference: float = 100.0) -> Column:
    """Above the reference; null where the pitch isn't known."""
    return F.when(hertz > 0, 12 * F.log2(hertz / reference))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def convert_rate(samples: Column, source: int, target: int) -> Column:
    """A sample position at another rate, halves rounded up; floors for negative positions too."""
    return F.floor((2 * samples * target + source) / (2 * source)).cast("long")


def power_mix(share: Column) -> tuple[Column, Column]:
    """Gains of two sources whose powers add up to one."""
    b = clamp(share, 0.0, 1.0)
    return F.sqrt(b), F.sqrt(1 - b)


def interpolate(x: Column, anchors: list[tuple[float, float]], kind: str = "linear") -> Column:
    """Piecewise values between anchors, held at both ends.

    log: geometric where both values of a piece are over zero, else linear; step: the value of the last anchor passed.
    """
    out = F.lit(float(anchors[0][1]))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        t = (x - x0) / (x1 - x0)
        if kind == "step":
            value = F.lit(float(y0))
        elif kind == "log" and y0 > 0 and y1 > 0:
            value = F.lit(float(y0)) * F.pow(F.lit(y1 / y0), t)
        else:
            value = y0 + t * (y1 - y0)
        out = F.when(x >= x0, value).otherwise(out)
    return F.when(x >= anchors[-1][0], F.lit(float(anchors[-1][1]))).otherwise(out)


def monotone_cubic(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """A piecewise cubic between anchors that never leaves the range of its two ends, held at both ends."""
    slopes = _slopes(anchors)
    out = F.lit(float(anchors[0][1]))
    for ((x0, y0), m0), ((x1, y1), m1) in zip(pieces := list(zip(anchors, slopes, strict=True)), pieces[1:], strict=False):
        h = x1 - x0
        t = (x - x0) / h
        value = (2 * t * t * t - 3 * t * t + 1) * y0 + (t * t * t - 2 * t * t + t) * (h * m0) + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * (h * m1)
        out = F.when(x > x0, value).otherwise(out)
    return F.when(x >= anchors[-1][0], F.lit(float(anchors[-1][1]))).otherwise(out)


def _slopes(anchors: list[tuple[float, float]]) -> list[float]:
    """Slopes at the anchors: weighted harmonic means within, three-point estimates that keep the shape at the ends."""
    h = [b[0] - a[0] for a, b in zip(anchors, anchors[1:], strict=False)]
    d = [(b[1] - a[1]) / w for a, b, w in zip(anchors, anchors[1:], h, strict=False)]
    if len(d) == 1:
        return [d[0], d[0]]

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if m * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(m) > 3 * abs(d0) else m

    inner = [0.0 if d[k] * d[k + 1] <= 0 else 3 * (h[k] + h[k + 1]) / ((2 * h[k + 1] + h[k]) / d[k] + (h[k + 1] + 2 * h[k]) / d[k + 1]) for k in range(len(d) - 1)]
    return [end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])]


def parsed(name: str, names: list[str]) -> Column:
    """A name's number among the names, null if it is none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(name)).cast("int") - 1, F.lit(-1))


def printed(code: Column, names: list[str], other: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code), F.lit(other))


def top_peaks(power: Column, n: int, least: float) -> Column:
    """Places (from 1) of the n strongest local maxima of an array, none under a share of its largest value; ties to the earlier."""
    inside = F.sequence(F.lit(1), F.size(power) - 2)
    kept = F.filter(inside, lambda k: (F.get(power, k) > F.get(power, k - 1)) & (F.get(power, k) >= F.get(power, k + 1)) & (F.get(power, k) >= F.array_max(power) * least))
    ranked = F.array_sort(F.transform(kept, lambda k: F.struct((-F.get(power, k)).alias("p"), (k + 1).alias("k"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["k"])


def hours_minutes_seconds(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def sanitize(version: Column) -> Column:
    return F.regexp_replace(version, "[^0-9A-Za-z]", "")


def normalise_path(path: Column) -> Column:
    """Trimmed, lower case, forward slashes, none doubled or leading."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+", "/"), "^/", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def fnv1a_32(s: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, by exact decimal-free arithmetic in 64-bit integers."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.conv(F.substring(F.hex(F.encode(s, "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda acc, b: acc.bitwiseXOR(b) * F.lit(16777619) % F.lit(1 << 32)
    return F.aggregate(F.when(F.length(s) > 0, codes).otherwise(F.array().cast("array<long>")), F.lit(2166136261).cast("long"), step)


def redact_path(s: Column) -> Column:
    """A path as its hash and extension, so that logs don't name files."""
    ext = F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.lit("<path:"), F.lower(F.lpad(F.hex(fnv1a_32(s)), 8, "0")), F.lit(">"), ext)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_power(a: Column) -> Column:
    """An array scaled so that its squares add up to one."""
    # The norm in an array of one: as a column inside the lambda it would be worked out again for each component.
    scaled = F.transform(F.array(F.sqrt(dot(a, a))), lambda norm: F.transform(a, lambda x: F.when(norm == 0, x * float("nan")).otherwise(x.cast("double") / norm)))
    return F.element_at(scaled, 1)


def rounded(x: Column, places: int) -> Column:
    """x rounded, with its sign also where that leaves zero, as IEEE 754 and other engines have it."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)


def weighted_distance(a: Column, b: Column, weights: list[float]) -> Column:
    """A Euclidean distance over the first components."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    terms = F.zip_with(F.zip_with(F.slice(a, 1, len(weights)), F.slice(b, 1, len(weights)), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), w, lambda d, k: d * k)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def first_set(*values: Column) -> Column:
    """The most specific layer that says anything."""
    return F.coalesce(*values)


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules)))


def penalty(x: Column, fine: float, bad: float, most: float) -> Column:
    """0 at fine, most at bad, linear between, whichever of the two is larger."""
    return clamp((x - fine) / (bad - fine), 0.0, 1.0) * most


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
