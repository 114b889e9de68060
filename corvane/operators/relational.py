"""Logical nodes as DataFrames. Columns keep their unique names until the last step."""

from __future__ import annotations

from functools import reduce, singledispatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import all_present, ordered
from ..plans.binding import Filtered, Grouped, Joined, Limited, Node, Projected, Scan, Sorted
from ..types import widened


@singledispatch
def frame(node: Node) -> DataFrame:
    raise TypeError(type(node))


@frame.register
def _(node: Scan) -> DataFrame:
    """The columns that the query uses; Catalyst would prune the others anyway, at the cost of analysing them."""
    source = node.table.frame
    fields = zip(node.table.fields, node.output, strict=True)
    return source.select(*[widened(F.col(f"`{f.name}`"), f.dataType).alias(o.id) for f, o in fields if o.id in node.used])


@frame.register
def _(node: Joined) -> DataFrame:
    """An equi-join without hints: Spark broadcasts a side whose size it knows to be small, and splits skewed keys."""
    return frame(node.left).join(frame(node.right), F.col(node.left_id) == F.col(node.right_id), node.kind)


@frame.register
def _(node: Filtered) -> DataFrame:
    """Null tests of all columns and the predicate as it is: both reach the scan as pushed filters."""
    present = all_present(F.col(i) for i in node.predicate.ids)
    return frame(node.input).where(node.predicate.raw if present is None else present & node.predicate.raw)


_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


@frame.register
def _(node: Grouped) -> DataFrame:
    """Partial aggregation before the one shuffle. Equal keys are grouped by once."""
    columns = [(F.count(F.lit(1)) if arg is None else _AGGREGATES[f](arg.column)).alias(out.id) for f, arg, out in node.aggregates]
    keys = [b.column.alias(o.id) for b, o in node.keys]
    grouped = frame(node.input).groupBy(*keys)
    return grouped.agg(*columns) if columns else frame(node.input).select(*keys).distinct()


@frame.register
def _(node: Projected) -> DataFrame:
    return frame(node.input).select(*[c.alias(o.id) for c, o, _ in node.items])


@frame.register
def _(node: Sorted) -> DataFrame:
    """Constants do not order; a following limit makes Spark keep the first rows only (TakeOrderedAndProject)."""
    keys = [ordered(b.column, descending) for b, descending in node.keys if b.ids]
    return frame(node.input).orderBy(*keys) if keys else frame(node.input)


#: The most that Spark's own limit takes.
LARGEST_LIMIT = 2**31 - 1


@frame.register
def _(node: Limited) -> DataFrame:
    """A limit that Spark's own can't take counts its input first: mostly there is nothing to cut."""
    source = frame(node.input)
    if node.n <= LARGEST_LIMIT:
        return source.limit(node.n)
    left = node.n if source.count() > node.n else 0
    if not left:
        return source
    parts = []
    while left > 0:
        parts.append(source.limit(min(left, LARGEST_LIMIT)))
        source, left = source.offset(LARGEST_LIMIT), left - LARGEST_LIMIT
    return reduce(DataFrame.unionAll, parts)


def lower(node: Node) -> DataFrame:
    """The query's DataFrame, under the names that the query gives its columns."""
    if isinstance(node, Projected):
        return frame(node.input).select(*[c.alias(o.name) for c, o, _ in node.items])
    return frame(node).toDF(*[o.name for o in node.output])
