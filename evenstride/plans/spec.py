"""Pattern specifications: immutable values that the planner compiles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .expr import Constraint, parse

STRATEGIES = ("stam", "stnm", "strict", "contiguous")


@dataclass(frozen=True)
class Var:
    """A pattern variable. ``least``/``most``: how many events (most None: no bound); ``kleene``: a sequence, else a single event.

    ``types``: event types it takes, empty for all; ``negated``: all but those.
    """

    name: str
    types: tuple[str, ...] = ()
    least: int = 1
    most: int | None = 1
    kleene: bool = False
    strategy: str = "stam"
    negated: bool = False


@dataclass(frozen=True)
class Pattern:
    """Variables in order, constraints, window in seconds (last - first <= within) and the column that partitions the stream, if any.

    ``unions``: names for the events of several variables, in arrival order, which constraints may apply functions to.
    ``max_candidates``: beyond so many candidates a Kleene variable without step constraints raises; None: all its subsets are built.
    ``expand_unconstrained`` False: a skip-till-any Kleene variable that no constraint names stays its whole run instead of every subset.
    """

    vars: tuple[Var, ...]
    where: tuple[Constraint, ...] = ()
    within: float | None = None
    key: str | None = None
    max_gap: float | None = None
    max_candidates: int | None = 20
    unions: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    expand_unconstrained: bool = True

    def __post_init__(self) -> None:
        names = [v.name for v in self.vars]
        if len(set(names)) != len(names) or not names:
            raise ValueError(f"variables must be there and differ: {names}")
        for v in self.vars:
            if v.strategy not in STRATEGIES:
                raise ValueError(f"{v.name}: unknown strategy {v.strategy!r}; known: {STRATEGIES}")
            if v.least < 0 or v.most is not None and v.most < max(v.least, 1):
                raise ValueError(f"{v.name}: impossible quantifier {{{v.least},{v.most}}}")
        for u, members in self.unions:
            if set(members) - set(names) or u in names:
                raise ValueError(f"SUBSET {u} = {members} must name variables of the pattern and have a name of its own")
        for c in self.where:
            if unknown := self.needs(c) - set(names):
                raise ValueError(f"{c.text!r} names unknown variables {sorted(unknown)}")
            if any(n.kind in ("var", "elem", "prev") and n.name in dict(self.unions) for n in c.nodes()):
                raise ValueError(f"{c.text!r}: of a SUBSET only functions can be tested")

    def needs(self, c: Constraint) -> set[str]:
        """Variables that must be bound before a constraint can be tested: those it names, and the members of unions it names."""
        members = dict(self.unions)
        return {m for x in c.variables for m in members.get(x, (x,))}

    def var(self, name: str) -> Var:
        return next(v for v in self.vars if v.name == name)


_ITEM = re.compile(r"\s*([A-Za-z_]\w*)(\+|\*|\?|\{\s*\d*\s*,?\s*\d*\s*\})?\s*,?")


def quantifier(q: str | None) -> tuple[int, int | None, bool]:
    """(least, most, kleene) of '', '+', '*', '?', '{n}', '{n,}', '{n,m}', '{,m}'."""
    if not q:
        return 1, 1, False
    if q in "+*?":
        return {"+": (1, None, True), "*": (0, None, True), "?": (0, 1, True)}[q]
    a, comma, b = q[1:-1].replace(" ", "").partition(",")
    if not comma:
        n = int(a)
        return n, n, True
    return int(a or 0), int(b) if b else None, True


def pattern(regex: str, types: dict[str, str | tuple[str, ...]], where: tuple[str | tuple[str, str], ...] = (), within: float | None = None, key: str | None = None, strategy: str | dict[str, str] = "stam", **more) -> Pattern:
    """A pattern from text such as ``'A{2,} B C+'``. ``types``: event type(s) of each variable ('!t' for all but t); ``where``:
    constraint texts, or (text, 'run') for one that is tested on the whole run; ``strategy``: for all or by variable."""
    out, pos = [], 0
    while pos < len(regex.rstrip()):
        m = _ITEM.match(regex, pos)
        if not m or m.end() == pos:
            raise ValueError(f"cannot read pattern at {regex[pos:]!r}")
        least, most, kleene = quantifier(m[2])
        t = types.get(m[1], ())
        t = (t,) if isinstance(t, str) else tuple(t)
        neg = any(x.startswith("!") for x in t)
        s = strategy if isinstance(strategy, str) else strategy.get(m[1], "strict")
        out.append(Var(m[1], tuple(x.lstrip("!") for x in t), least, most, kleene, s, neg))
        pos = m.end()
    cs = tuple(parse(w) if isinstance(w, str) else parse(*w) for w in where)
    return normalise(Pattern(tuple(out), cs, within, key, **more))


def normalise(p: Pattern) -> Pattern:
    """Equal constraints once; ``count(K)`` bounds become quantifier bounds (the tighter of both holds)."""
    seen, keep, vars_ = set(), [], {v.name: v for v in p.vars}
    for c in p.where:
        sign = (c.parts, c.scope)
        if sign in seen:
            continue
        seen.add(sign)
        bound = _count_bound(c)
        if bound and vars_[bound[0]].kleene and c.scope == "match":
            name, low, high = bound
            v = vars_[name]
            most = high if v.most is None else v.most if high is None else min(v.most, high)
            vars_[name] = replace(v, least=max(v.least, low), most=most)
        else:
            keep.append(c)
    return replace(p, vars=tuple(vars_[v.name] for v in p.vars), where=tuple(keep))


def _count_bound(c: Constraint) -> tuple[str, int, int | None] | None:
    low, high, name = 0, None, None
    for a, op, b in c.parts:
        if a.kind == "num" and b.kind == "call":
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}[op]
        if a.kind != "call" or a.name not in ("count", "size") or b.kind != "num" or name not in (None, a.args[0]) or b.value != int(b.value):
            return None
        name, n = a.args[0], int(b.value)
        if op in (">=", ">", "="):
            low = max(low, n + (op == ">"))
        if op in ("<=", "<", "="):
            high = n - (op == "<") if high is None else min(high, n - (op == "<"))
    if high is not None and high < max(low, 1):
        return None
    return (name, low, high) if name else None
