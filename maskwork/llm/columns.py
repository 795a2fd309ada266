"""Keep callers' columns apart from an operator's own, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head_of(docs: DataFrame) -> str:
    """The columns of ``docs`` as a schema that others can be added to."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def set_aside(docs: DataFrame, needed: list[str], made: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with its other columns under numbered names; those names; and columns that restore all in order.

    Columns that the operator makes are left out, in upper or lower case, as they are replaced.
    """
    made_low = {m.lower() for m in made}
    keep = [c for c in docs.columns if c.lower() not in made_low]
    named = {c: c if c in needed else f"_other{i}" for i, c in enumerate(keep)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    return renamed, list(named.values()), [F.col(n).alias(c) for c, n in named.items()]
