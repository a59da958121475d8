"""How the values of a property are merged: overwrite, update, init, union, min and max, by property."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import compare_key, empty

KINDS = ("overwrite", "update", "init", "union", "min", "max")


@dataclass(frozen=True)
class Criteria:
    """Kinds of named properties, and the kind of all others (None: they stay as they are)."""

    specific: tuple[tuple[str, str], ...] = ()
    default: str | None = None

    @classmethod
    def parse(cls, text: str, namespaces: dict[str, str] | None = None) -> Criteria:
        """``overwrite *``, ``union p1, p2 init *`` and the like; later rules for a property don't replace earlier ones."""
        rules: dict[str, str] = {}
        default, kind = None, None
        for word in text.replace(",", " ").split():
            if word.lower() in KINDS:
                kind = word.lower()
            elif kind is None:
                raise ValueError(f"kind expected before {word!r}")
            elif word == "*":
                default = default or kind
            else:
                prefix, _, local = word.partition(":")
                name = word[1:-1] if word.startswith("<") else (namespaces or {}).get(prefix, prefix + ":") + local
                rules.setdefault(name, kind)
        if kind is None:
            raise ValueError("empty criteria")
        return cls(tuple(rules.items()), default)

    def __str__(self) -> str:
        parts = []
        for kind in KINDS:
            names = [f"<{p}>" for p, k in self.specific if k == kind]
            if names:
                parts.append(f"{kind} {', '.join(names)}")
        if self.default:
            parts.append(f"{self.default} *")
        return " ".join(parts)

    def merge(self, name: Column, old: Column, new: Column) -> Column:
        """Values of the property ``name``; ``new`` null (the property is not in the new record) leaves ``old``."""
        out = combine(self.default, old, new) if self.default else F.coalesce(old, empty())
        for prop, kind in reversed(self.specific):
            out = F.when(name == prop, combine(kind, old, new)).otherwise(out)
        return F.when(new.isNull(), F.coalesce(old, empty())).otherwise(out)


def combine(kind: str, old: Column, new: Column) -> Column:
    """Arrays of terms merged by one kind; null arrays count as empty. Values keep set semantics."""
    o, n = F.coalesce(old, empty()), F.coalesce(new, empty())
    if kind == "overwrite":
        return n
    if kind == "update":
        return F.when(F.size(n) > 0, n).otherwise(o)
    if kind == "init":
        return F.when(F.size(o) > 0, o).otherwise(n)
    if kind == "union":
        return F.array_union(o, n)
    if kind in ("min", "max"):
        keyed = F.transform(F.array_union(o, n), lambda t: F.struct(compare_key(t).alias("k"), t.alias("t")))
        pick = (F.array_min if kind == "min" else F.array_max)(keyed)["t"]
        return F.when(pick.isNull(), empty()).otherwise(F.array(pick))
    raise ValueError(f"unknown criteria {kind}")
