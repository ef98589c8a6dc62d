"""Random draws as pure functions of (seed, tag, row key).

A value depends on nothing but its key: not on partitioning, task retries or the order of rows.
Every draw is a column expression that runs inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

DRAW_BITS = 52  # 13 hexadecimal digits of the digest fill the mantissa of a DOUBLE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u01(seed: int, tag: str, *key: Column | str) -> Column:
    """Uniform DOUBLE in [0, 1) keyed by ``seed``, ``tag`` and the key columns."""
    if all(isinstance(k, str) for k in key):  # names only: one SQL expression, cheap to build
        names = "".join(f", cast(`{k}` as string)" for k in key)
        digest = f"md5(concat_ws('|', '{seed}|{tag}'{names}))"
        return F.expr(f"cast(conv(substring({digest}, 1, 13), 16, 10) as bigint) / {float(2**DRAW_BITS)!r}D")
    text = F.concat_ws("|", F.lit(f"{seed}|{tag}"), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**DRAW_BITS))


def below(n: Column | int, u: Column) -> Column:
    """Uniform BIGINT in [0, n) from a uniform ``u``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u * n)


def uint(lo: Column | int, hi: Column | int, u: Column) -> Column:
    """Uniform BIGINT in [lo, hi]."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return lo + F.floor(u * (hi - lo + F.lit(1)))


def pick(values: Sequence | Column, u: Column) -> Column:
    """One element of a literal list or of an array column, all equally likely."""
    if isinstance(values, Column):
        return F.element_at(values, (below(F.size(values), u) + 1).cast("int"))
    array = F.array(*[F.lit(v) for v in values])
    return F.element_at(array, (below(len(values), u) + 1).cast("int"))


def weighted(values: Sequence, weights: Sequence[float], u: Column) -> Column:
    """One of ``values`` with the given weights: thresholds are constants, rows see a CASE."""
    total, upto, out = float(sum(weights)), 0.0, None
    for value, weight in zip(values[:-1], weights[:-1]):
        upto += weight
        hit = u < F.lit(upto / total)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    last = F.lit(values[-1])
    return last if out is None else out.otherwise(last)


def exp_drop(values: Sequence, denom: int, u: Column) -> Column:
    """One of ``values``, each ``denom`` times less likely than the one before it."""
    return weighted(list(values), [1.0 / denom**i for i in range(len(values))], u)


def exp_drop_length(m: Column, denom: int, u: Column) -> Column:
    """1..m with the weights of ``exp_drop`` where ``m`` differs by row (closed form of the CDF)."""
    tail = F.lit(1.0) - F.pow(F.lit(float(denom)), -m.cast("double"))
    steps = F.floor(-F.log(F.lit(1.0) - u * tail) / F.lit(math.log(denom)))
    return F.least(m.cast("bigint"), F.lit(1) + steps)


def beta(a: int, b: int, seed: int, tag: str, *key: Column | str) -> Column:
    """Beta(a, b) for whole a and b: the a-th smallest of n = a + b - 1 uniforms. The smallest of n is
    1 - (1-u)^(1/n), the next is the smallest of the n - 1 above it: a draws instead of n."""
    above, n = F.lit(1.0), a + b - 1
    for i in range(a):
        above = above * F.pow(F.lit(1.0) - u01(seed, f"{tag}{i}", *key), F.lit(1.0 / (n - i)))
    return F.lit(1.0) - above


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


TRIES = 3  # candidates of a gamma draw; the law accepts 95 % of them at shape 1 and over 99 % from 8 on
SMALL = 16  # trials that a binomial draw counts one by one


def gamma(shape: Column, seed: int, tag: str, *key: Column | str) -> Column:
    """Gamma(shape, 1) for shapes of 1 and more, by Marsaglia and Tsang's rejection. Candidates are drawn one after the other until one is accepted; the chance
    that none of TRIES is, in which case the mean is taken, is below 1e-6 from shape 8 on."""
    def made(d: Column) -> Column:
        def candidate(t: int) -> Column:
            draw = lambda part: u01(seed, f"{tag}.{t}{part}", *key)
            normal = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - draw("a"))) * F.cos(F.lit(2 * math.pi) * draw("b"))

            def accepted(z: Column) -> Column:
                w = F.lit(1.0) + z / F.sqrt(F.lit(9.0) * d)
                good = lambda v: (v > 0) & (F.log(F.lit(1.0) - draw("c")) < F.lit(0.5) * z * z + d - d * v + d * F.log(v))
                return let(w * w * w, lambda v: F.when(good(v), d * v))

            return let(normal, accepted)

        return F.coalesce(*[candidate(t) for t in range(TRIES)], d)

    return let(shape - F.lit(1.0 / 3.0), made)


def binomial(n: Column, p: Column, seed: int, tag: str, *key: Column | str) -> Column:
    """Binomial(n, p), exactly: the median of n uniforms is a beta draw; the half of them on one side of it is below p or above it for certain, the other half is
    a smaller binomial. After about log2(n / SMALL) steps what is left is counted one by one."""
    def step(state: Column, level: Column) -> Column:
        n, p, x = state["n"], state["p"], state["x"]
        i = F.floor((n + F.lit(1)) / F.lit(2)).cast("bigint")

        def halved(y: Column) -> Column:
            low = F.struct((n - i).alias("n"), ((p - y) / (F.lit(1.0) - y)).alias("p"), (x + i).alias("x"))
            return F.when(y <= p, low).otherwise(F.struct((i - F.lit(1)).alias("n"), (p / y).alias("p"), x.alias("x")))

        below_ = gamma(i.cast("double"), seed, f"{tag}.g", level, *key)
        above = gamma((n + F.lit(1) - i).cast("double"), seed, f"{tag}.h", level, *key)
        median = let(below_, lambda g: g / (g + above))
        return F.when((n > SMALL) & (p > 0) & (p < 1), let(median, halved)).otherwise(state)

    def rest(state: Column) -> Column:
        one_by_one = F.size(F.filter(F.sequence(F.lit(1), F.lit(SMALL)), lambda k: (k <= state["n"]) & (u01(seed, f"{tag}.u", k, *key) < state["p"])))
        return state["x"] + F.when(state["p"] <= 0, F.lit(0)).when(state["p"] >= 1, state["n"]).otherwise(one_by_one)

    start = F.struct(n.cast("bigint").alias("n"), p.cast("double").alias("p"), F.lit(0).cast("bigint").alias("x"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2((n + F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(levels, start, step, rest)


def skew_quantile(p: Column, b: Column | float) -> Column:
    """Quantile of Beta(1, b) at ``p``."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return -F.expm1(F.log1p(-p) / b)


def sap_number(digits: int | Column, u: Column) -> Column:
    """Number of ``digits`` digits with a leading 1, skewed to low values, as text."""
    n = (digits if isinstance(digits, Column) else F.lit(digits)).cast("double")
    base = F.pow(F.lit(10.0), n - 1)
    offset = F.floor(skew_quantile(u, F.pow(F.lit(10.0), n - 5)) * (base - 1))
    return (base.cast("bigint") + offset).cast("string")


# Primes, hence coprime to every smaller n; the first whose remainder is no short step is the multiplier.
PRIMES = (2**61 - 1, 10**15 + 37, 10**14 + 31, 10**13 + 37, 10**12 + 39)


def permuted(index: Column, n: int | Column, seed: int) -> Column:
    """Bijection of 0..n-1: ``(index * a + shift) mod n``. ``a`` is the remainder of the first prime that lies between n/5 and
    4n/5, so that consecutive ranks are far apart."""
    if isinstance(n, int) and n < 2**31:  # the product fits BIGINT
        a = next((p % n for p in PRIMES if n <= 5 * (p % n) <= 4 * n), PRIMES[-1] % n)
        return F.pmod(index.cast("bigint") * F.lit(a) + F.lit(seed % n), F.lit(n))
    n = (n if isinstance(n, Column) else F.lit(n)).cast("decimal(17,0)")
    rest = [(F.lit(p).cast("decimal(20,0)") % n).cast("decimal(17,0)") for p in PRIMES]
    a = F.coalesce(*[F.when((r * 5 >= n) & (r * 5 <= n * 4), r) for r in rest], rest[-1])
    return ((index.cast("decimal(17,0)") * a + F.lit(seed).cast("decimal(17,0)")) % n).cast("bigint")


FEISTEL_ROUNDS, WALK = 6, 64


def feistel(index: Column, n: Column | int, seed: int, tag: str, *key: Column | str) -> Column:
    """A keyed permutation of 0..n-1 without constant steps: a Feistel network over the bits of n, each round of which mixes one half of the number with a keyed digest
    of the other. A number that leaves 0..n-1 is mixed again until it is back (cycle walking); as at least half of all numbers are below n, WALK steps do but for a
    chance of 2^-WALK, in which case NULL comes. ``key`` columns give each row a permutation of its own."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    # all bits of n - 1, in two halves: the lower has ``low`` bits, the upper one less or as many
    bits = F.greatest(F.lit(2), F.ceil(F.log2(n.cast("double"))).cast("int"))

    of_row = F.concat_ws("|", n.cast("string"), *[col(k).cast("string") for k in key])  # the same in every round

    def mixed(x: Column, b: Column, rest: Column) -> Column:
        """One pass of all rounds; the halves change places, so that their widths do as well."""
        def rounds(left: Column, right: Column, r: int, moduli: tuple[Column, Column]) -> Column:
            if r == FEISTEL_ROUNDS:
                return left * moduli[1] + right
            digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{tag}|{r}|"), right.cast("string"), F.lit("|"), rest)), 1, 13), 16, 10).cast("bigint")
            changed = F.pmod(left.bitwiseXOR(digest), moduli[r % 2])  # of as many bits as the half had
            return let(changed, lambda y: rounds(right, y, r + 1, moduli))

        def halved(m: Column) -> Column:
            return let(F.struct(F.floor(x / m["low"]).cast("bigint").alias("left"), F.pmod(x, m["low"]).alias("right")),
                       lambda s: rounds(s["left"], s["right"], 0, (m["high"], m["low"])))

        a = F.floor(b / F.lit(2)).cast("int")
        power = lambda e: F.pow(F.lit(2.0), e).cast("bigint")
        return let(F.struct(power(a).alias("high"), power(b - a).alias("low")), halved)

    def walked(first: Column, rest: Column) -> Column:
        """Few numbers leave 0..n-1 at once: only they take further steps."""
        again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, step: F.when(x >= n, mixed(x, bits, rest)).otherwise(x))
        return F.when(first < n, first).otherwise(let(again, lambda x: F.when(x < n, x)))

    return let(of_row, lambda rest: let(mixed(index.cast("bigint"), bits, rest), lambda first: walked(first, rest)))


def sample_ranks(n: int | Column, k: int, seed: int, tag: str, *key: Column | str) -> Column:
    """k different numbers of 0..n-1 (k at most n) in random order, in time proportional to k: where a keyed permutation of each row sends 0..k-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: feistel(i, n, seed, tag, *key))


def unique_value(rank: Column, n: int | Column, digits: int) -> Column:
    """BIGINT of ``digits`` digits, unique per rank in 0..n-1 and skewed to low values.

    The map from rank to value is strictly increasing, hence no two ranks share a value and no
    draw has to be repeated."""
    n = n if isinstance(n, Column) else F.lit(n)
    scale = float(10 ** (digits - 1) - 1)
    quantile = skew_quantile(rank / n.cast("double"), float(10 ** (digits - 5)))
    return F.lit(10 ** (digits - 1)) + rank + F.floor(quantile * scale)


def skip_over(r: Column, taken_sorted: Column) -> Column:
    """The r-th (from 0) whole number that is not in the sorted array ``taken_sorted``."""
    return F.aggregate(
        taken_sorted, r.cast("bigint"), lambda acc, x: F.when(acc >= x, acc + F.lit(1)).otherwise(acc))


def draw_outside(n: int | Column, taken_sorted: Column, u: Column) -> Column:
    """Uniform in 0..n-1 without the numbers in ``taken_sorted``: no retry, no candidate list."""
    n = n if isinstance(n, Column) else F.lit(n)
    return skip_over(below(n - F.size(taken_sorted), u), taken_sorted)


def draw_outside_range(n: int | Column, start: Column, size: Column, u: Column) -> Column:
    """Uniform in 0..n-1 without start..start+size-1, in constant time for a range of any size."""
    n = n if isinstance(n, Column) else F.lit(n)
    r = below(n - size, u)
    return F.when(r < start, r).otherwise(r + size)


def sample_k(n: int | Column, k: int, exclude: Column, seed: int, tag: str, *key: Column | str) -> Column:
    """k different numbers of 0..n-1, none of them in the array ``exclude``, in draw order."""
    n = n if isinstance(n, Column) else F.lit(n)

    def draw(taken: Column, i: Column) -> Column:
        r = below(n - F.size(taken), u01(seed, tag, i, *key))
        return F.concat(taken, F.array(skip_over(r, F.sort_array(taken))))

    taken = F.aggregate(F.sequence(F.lit(1), F.lit(k)), exclude.cast("array<bigint>"), draw)
    return F.slice(taken, F.size(exclude) + F.lit(1), F.lit(k))


def weighted_subset(values: Sequence[str], weights: Sequence[float], size: Column,
                    seed: int, tag: str, *key: Column | str) -> Column:
    """``size`` different values, each step weighted: the smallest keys -ln(u) / w win."""
    keyed = [
        F.struct((-F.log(u01(seed, f"{tag}{i}", *key) + F.lit(2.0**-53)) / F.lit(float(w))).alias("k"),
                 F.lit(v).alias("v"))
        for i, (v, w) in enumerate(zip(values, weights))
    ]
    # no lambda anywhere: generated code sorts, and ``v`` of an array of structs is an array
    return F.slice(F.sort_array(F.array(*keyed)), F.lit(1), size.cast("int"))["v"]


def rand_chars(alphabet: str, length: int | Column, seed: int, tag: str, *key: Column | str) -> Column:
    """Text of ``length`` characters, each drawn from ``alphabet``."""
    def char(i: Column) -> Column:
        at = below(len(alphabet), u01(seed, tag, i, *key)) + F.lit(1)
        return F.substr(F.lit(alphabet), at.cast("int"), F.lit(1))

    if isinstance(length, int):  # no lambda: generated code
        return F.concat(F.lit(""), *[char(F.lit(i)) for i in range(1, length + 1)])
    return F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), char), "")


def shuffled(array: Column, seed: int, tag: str, *key: Column | str) -> Column:
    """The elements of a short array in keyed random order."""
    keyed = F.transform(array, lambda x, i: F.struct(u01(seed, tag, i, *key).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
