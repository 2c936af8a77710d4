"""Exact quantiles of many columns and many parts of a table, without melting it.

One wide aggregation keeps a mergeable KLL sketch per column and part; the sketch only says between which two values a
wanted rank lies.  Further wide aggregations count the rows below, on and between these two values, and sketch what lies
between while it is more than ``FEW`` rows; then the few rows between are counted value by value.  A rank that a bracket
misses widens the bracket, so a result is exact or is not given.  What reaches the driver grows with columns and parts,
never with rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .align import quoted

SKETCH = 4096
MARGIN = 0.006  # brackets reach this share of the ranks to both sides, over four times the sketch's error
FEW = 20_000    # rows between the ends of a bracket that are counted value by value
AT_ONCE = 400   # aggregates of one scan


@dataclass(eq=False)
class _Bracket:
    """Where the values of two neighbouring ranks of a column of a part lie."""

    cell: int
    ranks: tuple[int, int]
    low: float
    high: float
    whole: tuple[float, float]
    name: str
    weight: float
    values: dict[int, float] = field(default_factory=dict)
    below: int = 0
    between: int = 0
    margin: float = 0.0


def _aggregated(rows: DataFrame, wanted: list[Column]) -> list:
    """The values of any number of aggregates, so many to a scan."""
    out: list = []
    for at in range(0, len(wanted), AT_ONCE):
        out += list(rows.agg(*[c.alias(f"a{i}") for i, c in enumerate(wanted[at:at + AT_ONCE])]).first())
    return out


def wide_quantiles(df: DataFrame, columns: list[str], parts: dict[str, Column], probs: dict[str, float]) -> dict[tuple[str, str], dict[str, float]]:
    """(part, column) -> the linearly interpolated quantiles by name; parts without values are left out.

    ``parts`` are conditions on rows; nulls and NaN are left out, as in pandas.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    rows = df.select(*[F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(columns, names)],
                     *[F.coalesce(cond, F.lit(False)).alias(f"_p{i}") for i, cond in enumerate(parts.values())])
    cells = [(part, c, F.when(F.col(f"_p{i}"), F.col(n))) for i, part in enumerate(parts) for c, n in zip(columns, names)]

    def sketch(values: Column, ranks: list[float]) -> list[Column]:
        at = F.array(*[F.lit(r) for r in ranks])
        cuts = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(values, F.lit(SKETCH)), at)  # an error without values
        return [F.count(values), F.min(values), F.max(values), F.when(F.count(values) > 0, cuts)]

    ends = [min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-MARGIN, MARGIN)]
    found = _aggregated(rows, [a for _, _, v in cells for a in sketch(v, ends)])
    brackets = []
    for i in range(len(cells)):
        n, low, high, cuts = found[4 * i:4 * i + 4]
        for k, (name, p) in enumerate(probs.items()):
            if not n:
                continue
            at = (n - 1) * p
            start, end = cuts[2 * k] if p > MARGIN else low, cuts[2 * k + 1] if p < 1 - MARGIN else high
            brackets.append(_Bracket(i, (math.floor(at), math.ceil(at)), start, end, (low, high), name, at - math.floor(at)))

    open_ = brackets
    while open_:
        wanted = []
        for b in open_:
            v = cells[b.cell][2]
            wanted += [F.count_if(v < b.low), F.count_if(v == b.low), F.count_if((v > b.low) & (v < b.high)), F.count_if((v == b.high) & F.lit(b.low < b.high))]
        counts, wide = _aggregated(rows, wanted), []
        for i, b in enumerate(open_):
            b.below, on_low, b.between, on_high = counts[4 * i:4 * i + 4]
            first = b.below + on_low
            for r in set(b.ranks) - set(b.values):
                if r < b.below or r >= first + b.between + on_high:
                    wide.append(b)  # the sketch was off: look at all values
                elif r < first:
                    b.values[r] = b.low
                elif r >= first + b.between:
                    b.values[r] = b.high
            b.below = first
        for b in wide:  # and trust its next sketch less, so that this ends
            b.low, b.high, b.values, b.margin = *b.whole, {}, min(0.25, 4 * max(b.margin, MARGIN, 0.001))
        large = [b for b in open_ if b not in wide and set(b.ranks) - set(b.values) and b.between > FEW]
        narrower = _aggregated(rows, [a for b in large for a in _narrowed(cells[b.cell][2], b)])
        for i, b in enumerate(large):
            low, high = narrower[2 * i:2 * i + 2]
            b.low, b.high, b.values = low, high, {}
        open_ = [b for b in open_ if b in wide or b in large]

    left = [b for b in brackets if set(b.ranks) - set(b.values)]
    if left:
        inside = F.array(*[F.struct(F.lit(i).alias("b"), F.when((v > b.low) & (v < b.high), v).alias("v")) for i, b in enumerate(left) for v in [cells[b.cell][2]]])
        counted = rows.select(F.inline(F.filter(inside, lambda x: x["v"].isNotNull()))).groupBy("b", "v").agg(F.count("*").alias("n"))
        at = [b.below for b in left]
        for i, v, n in sorted(tuple(r) for r in counted.collect()):
            for r in left[i].ranks:
                if at[i] <= r < at[i] + n:
                    left[i].values[r] = v
            at[i] += n
    out: dict[tuple[str, str], dict[str, float]] = {}
    for b in brackets:
        part, c, _ = cells[b.cell]
        low, high = b.values[b.ranks[0]], b.values[b.ranks[1]]
        out.setdefault((part, c), {})[b.name] = low + (high - low) * b.weight
    return out


def _narrowed(values: Column, b: _Bracket) -> list[Column]:
    """Ends of a narrower bracket, from a sketch of the values between the ends of this one."""
    inside = F.when((values > b.low) & (values < b.high), values)
    sketch = F.kll_sketch_agg_double(inside, F.lit(SKETCH))
    share, margin = [(r - b.below) / b.between for r in b.ranks], max(MARGIN, b.margin)
    low, high = max(0.0, min(1.0, share[0] - margin)), max(0.0, min(1.0, share[1] + margin))
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(low)) if low > 0 else F.lit(b.low),
            F.kll_sketch_get_quantile_double(sketch, F.lit(high)) if high < 1 else F.lit(b.high)]
