"""Random patterns for property tests: a sequence, quantifiers, and constraints whose bounds the value range makes neither empty nor idle."""

from __future__ import annotations

import random

from .spec import Pattern, pattern

QUANTIFIERS = ("", "", "+", "*", "?", "{2}", "{2,}", "{1,2}", "{,2}")


def value_range(name: str, low: float, high: float, size: int) -> tuple[float, float]:
    """Range of a Kleene function over sequences of up to ``size`` values between ``low`` and ``high``."""
    if name == "sum":
        return min(low, low * size), max(high, high * size)
    if name in ("increasing", "decreasing", "non_increasing", "non_decreasing"):
        return -1.0, 1.0
    if name == "count":
        return 0.0, float(size)
    return low, high


def random_pattern(seed: int, types: str = "abc", low: float = 0.0, high: float = 9.0, within: float = 9.0, key: str | None = None, strategy: str = "stam") -> Pattern:
    """A pattern of two or three variables over ``types`` with up to three constraints: on elements, steps, functions, between variables, on times."""
    r = random.Random(seed)
    names = "ABC"[: r.choice((2, 3, 3))]
    quantified = {n: r.choice(QUANTIFIERS) for n in names}
    if all(q in ("*", "?", "{,2}") for q in quantified.values()):
        quantified[names[0]] = ""
    if strategy != "stam":
        quantified = {n: "" if strategy == "stnm" else q for n, q in quantified.items()}
    kleene = [n for n in names if quantified[n]]
    single = [n for n in names if not quantified[n]]
    where: list[str] = []
    for _ in range(r.randrange(4)):
        kind = r.choice(("element", "step", "function", "cross", "time"))
        mid = round(r.uniform(low + 0.2 * (high - low), high - 0.2 * (high - low)), 1)
        if kind == "element" and kleene:
            where.append(f"{r.choice(kleene)}[i] {r.choice(('>=', '<='))} {mid}")
        elif kind == "step" and kleene:
            n = r.choice(kleene)
            where.append(f"{-mid} <= {n}[i] - last({n}) <= {mid}")
        elif kind == "function" and kleene:
            f = r.choice(("sum", "average", "min", "max", "increasing", "non_decreasing", "first", "last"))
            a, b = value_range(f, low, high, 3)
            where.append(f"{f}({r.choice(kleene)}) {r.choice(('>=', '<='))} {round(r.uniform(a + 0.2 * (b - a), b - 0.2 * (b - a)), 2)}")
        elif kind == "cross" and len(single) >= 2:
            a, b = r.sample(single, 2)
            where.append(f"{a} - {r.choice((1, 0.5))} * {b} {r.choice(('>=', '<='))} {round(mid / 4, 1)}")
        elif kind == "time":
            where.append(f"last_time({names[-1]}) - first_time({names[0]}) {r.choice(('>=', '<='))} {r.randrange(2, 7)}")
    return pattern(" ".join(n + quantified[n] for n in names), {n: tuple(r.sample(types, r.choice((1, 1, 2)))) for n in names}, tuple(where), within, key, strategy)
