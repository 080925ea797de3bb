"""Regular bag expressions: derivatives on the driver, intervals as plain numbers or as Columns.

The interval of a single-occurrence expression for a bag of counts is the range of repetitions by which
the bag can be made; the bag matches if 1 lies in it. An empty bag is decided by nullability.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = 1 << 40


@dataclass(frozen=True)
class Sym:
    name: object
    low: int = 1
    high: int | None = 1


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    """An expression low to high times; None: without an upper bound."""

    inner: object
    low: int
    high: int | None


@dataclass(frozen=True)
class Empty:
    pass


FAIL = None


def symbols(e) -> set:
    if isinstance(e, Sym):
        return {e.name}
    if isinstance(e, (And, Or)):
        return set().union(*(symbols(p) for p in e.parts))
    return symbols(e.inner) if isinstance(e, Rep) else set()


def nullable(e) -> bool:
    if e is FAIL:
        return False
    if isinstance(e, Empty):
        return True
    if isinstance(e, Sym):
        return e.low == 0
    if isinstance(e, And):
        return all(map(nullable, e.parts))
    if isinstance(e, Or):
        return any(map(nullable, e.parts))
    return e.low == 0 or nullable(e.inner)


def _and(parts) -> object:
    flat = []
    for p in parts:
        if p is FAIL:
            return FAIL
        flat += [] if isinstance(p, Empty) else p.parts if isinstance(p, And) else [p]
    return Empty() if not flat else flat[0] if len(flat) == 1 else And(tuple(sorted(flat, key=repr)))


def _or(parts) -> object:
    kept = tuple(dict.fromkeys(p for p in parts if p is not FAIL))
    return FAIL if not kept else kept[0] if len(kept) == 1 else Or(kept)


def _rep(inner, low: int, high: int | None) -> object:
    if high == 0 or inner is FAIL:
        return Empty() if low == 0 else FAIL
    return Rep(inner, low, high)


def derive(e, x, open_: bool = False, controlled: frozenset = frozenset()):
    """What is left of an expression after one x."""
    extra = open_ and x not in controlled
    if e is FAIL:
        return FAIL
    if isinstance(e, Empty):
        return e if extra else FAIL
    if isinstance(e, Sym):
        if e.name != x:
            return e if extra else FAIL
        if e.high == 0:
            return FAIL
        low, high = max(0, e.low - 1), None if e.high is None else e.high - 1
        return Empty() if high == 0 else Sym(x, low, high)
    if extra:
        return e
    if isinstance(e, And):
        return _or([_and([*e.parts[:i], derive(p, x, open_, controlled), *e.parts[i + 1 :]]) for i, p in enumerate(e.parts)])
    if isinstance(e, Or):
        return _or([derive(p, x, open_, controlled) for p in e.parts])
    rest = _rep(e.inner, max(0, e.low - 1), None if e.high is None else e.high - 1)
    return _and([derive(e.inner, x, open_, controlled), rest])


def matches(e, bag: dict, open_: bool = False) -> bool:
    """By derivatives; symbols may occur more than once in e."""
    controlled = frozenset(symbols(e))
    for x, n in sorted(bag.items(), key=lambda i: repr(i[0])):
        for _ in range(n):
            e = derive(e, x, open_, controlled)
            if e is FAIL:
                return False
    return nullable(e)


class _Numbers:
    """Arithmetic of intervals on ints."""

    @staticmethod
    def pick(cond, a, b):
        return a if cond else b

    low = staticmethod(min)
    high = staticmethod(max)

    @staticmethod
    def up(w, m: int):
        return -(-w // m)

    @staticmethod
    def down(w, m: int):
        return w // m


class _Columns:
    """The same on Columns."""

    @staticmethod
    def pick(cond, a, b):
        return F.when(cond, a).otherwise(b)

    @staticmethod
    def low(a, b):
        return F.least(a, b)

    @staticmethod
    def high(a, b):
        return F.greatest(a, b)

    @staticmethod
    def up(w, m: int):
        return F.floor((w + (m - 1)) / m).cast("bigint")

    @staticmethod
    def down(w, m: int):
        return F.floor(w / m).cast("bigint")


def _interval(e, count: Callable, one: Callable, ops):
    """(n, m); empty if n is INF or more, or above m. one: a constant as the kind of number in use."""
    if isinstance(e, Empty):
        return one(0), one(INF)
    if isinstance(e, Sym):
        w = count(e.name)
        if e.high is None:
            n = ops.pick(w == 0, one(0), one(1))
        elif e.high == 0:
            n = ops.pick(w == 0, one(0), one(INF))
        else:
            n = ops.up(w, e.high)
        return n, one(INF) if e.low == 0 else ops.down(w, e.low)
    if isinstance(e, And):
        n, m = one(0), one(INF)
        for p in e.parts:
            a, b = _interval(p, count, one, ops)
            n, m = ops.high(n, a), ops.low(m, b)
        return n, m
    if isinstance(e, Or):
        n, m, bad = one(0), one(0), one(0)
        for p in e.parts:
            a, b = _interval(p, count, one, ops)
            bad = ops.high(bad, ops.pick((a >= INF) | (a > b), one(1), one(0)))
            n, m = ops.low(n + a, one(INF)), ops.low(m + b, one(INF))
        return ops.pick(bad == 1, one(INF), n), m
    a, b = _interval(e.inner, count, one, ops)
    total = one(0)
    for s in sorted(symbols(e), key=repr):
        total = total + count(s)
    void = (a >= INF) | (a > b)
    any_or_none = one(INF) if e.low == 0 or nullable(e.inner) else one(0)
    if e.high is None and e.low == 0:
        n, m = one(1), one(INF)
    elif e.high is None and e.low == 1:
        n, m = one(1), b
    else:
        lo, hi = ops.high(a, one(e.low)), ops.low(b, one(INF if e.high is None else e.high))
        bad = lo > hi
        n, m = ops.pick(bad, one(INF), one(1)), one(1)
    return ops.pick(total == 0, one(0), ops.pick(void, one(INF), n)), ops.pick(total == 0, any_or_none, ops.pick(void, one(0), m))


def interval_matches(e, bag: dict, open_: bool = False) -> bool:
    """By intervals; for expressions in which each symbol occurs once."""
    if not open_ and any(n and x not in symbols(e) for x, n in bag.items()):
        return False
    if not any(bag.get(s, 0) for s in symbols(e)):
        return nullable(e)
    n, m = _interval(e, lambda s: bag.get(s, 0), int, _Numbers)
    return n < INF and n <= 1 <= m


def interval_column(e, count: Callable[[object], Column]) -> Column:
    """Whether counts given as Columns match."""
    own = sorted(symbols(e), key=repr)
    if not own:
        return F.lit(True)
    total = sum((count(s) for s in own[1:]), count(own[0]))
    n, m = _interval(e, count, lambda x: F.lit(x).cast("bigint"), _Columns)
    return F.when(total == 0, F.lit(nullable(e))).otherwise((n < INF) & (n <= 1) & (m >= 1))
