"""Formats of links between nodes: alternatives are narrowed from both ends and settled once, before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from ..errors import EmptyLink, Unfixable

DEFAULTS = {"dtype": {"tensor": "f32", "raster": "f64"}, "count": 1, "chunk": 256}


@dataclass(frozen=True)
class Choice:
    """What a field may be: anything (values None, least None), one of some values in order of preference, or at least a number."""

    values: tuple | None = None
    least: int | None = None

    def meet(self, o: Choice) -> Choice | None:
        if self.values is None and o.values is None:
            bounds = [x for x in (self.least, o.least) if x is not None]
            return Choice(least=max(bounds)) if bounds else Choice()
        mine, other = (self, o) if self.values is not None else (o, self)
        kept = tuple(v for v in mine.values if (other.values is None and (other.least is None or v >= other.least)) or (other.values is not None and v in other.values))
        return Choice(kept) if kept else None

    def settled(self, default):
        if self.values is not None:
            return self.values[0]
        return max(self.least, default) if self.least is not None and default is not None else self.least if self.least is not None else default


def one_of(*values) -> Choice:
    return Choice(tuple(values))


def at_least(n: int) -> Choice:
    return Choice(least=n)


@dataclass(frozen=True)
class Format:
    """kind: raster, points, vector or tensor; count: bands or channels; resolution: an inclusive range that stays a range."""

    kind: str
    dtype: Choice = field(default_factory=Choice)
    count: Choice = field(default_factory=Choice)
    crs: Choice = field(default_factory=Choice)
    chunk: Choice = field(default_factory=Choice)
    resolution: tuple[float, float] = (0.0, float("inf"))

    def meet(self, o: Format) -> Format | None:
        if self.kind != o.kind:
            return None
        out = {}
        for name in ("dtype", "count", "crs", "chunk"):
            if (m := getattr(self, name).meet(getattr(o, name))) is None:
                return None
            out[name] = m
        low, high = max(self.resolution[0], o.resolution[0]), min(self.resolution[1], o.resolution[1])
        return Format(self.kind, **out, resolution=(low, high)) if low <= high else None

    def settled(self) -> Settled:
        crs = self.crs.settled(None)
        if crs is None:
            raise Unfixable(f"the CRS of a {self.kind} link is not known")
        return Settled(self.kind, self.dtype.settled(DEFAULTS["dtype"].get(self.kind)), self.count.settled(DEFAULTS["count"]), crs, self.chunk.settled(DEFAULTS["chunk"]), self.resolution)


@dataclass(frozen=True)
class Settled:
    kind: str
    dtype: str | None
    count: int
    crs: int
    chunk: int
    resolution: tuple[float, float]

    def fingerprint(self) -> str:
        """Names a stored table of this format."""
        import hashlib

        return hashlib.sha256(repr([getattr(self, f.name) for f in fields(self)]).encode()).hexdigest()[:16]


def meet_any(a: list[Format], b: list[Format]) -> list[Format]:
    """Alternatives that both sides accept, in the first side's order."""
    out: list[Format] = []
    for x in a:
        for y in b:
            if (m := x.meet(y)) is not None and m not in out:
                out.append(m)
    return out


def through(given: list[Format], passes: tuple[str, ...], made: Format) -> list[Format]:
    """Output formats of a node that passes some fields of its input on and makes the rest."""
    out = []
    for g in given:
        f = replace(made, **{name: getattr(g, name) for name in passes})
        if f not in out:
            out.append(f)
    return out


def link(made: list[Format], wanted: list[Format], between: str) -> list[Format]:
    if not (out := meet_any(made, wanted)):
        raise EmptyLink(f"no common format between {between}")
    return out
