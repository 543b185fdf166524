"""Operators on the dense panel (one row per date and ticker, null for missing).

An operator takes the panel and columns (or numbers) and gives a column.  ``Panel.let`` names an intermediate column, as
a window may not stand inside another one; the panel plans all of them together.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
OPERATORS: dict[str, Callable] = {}


def operator(*names: str):
    """Register a function under these names of the expression language."""

    def register(f: Callable) -> Callable:
        for name in names:
            OPERATORS[name] = f
        return f

    return register


#: What a column's windows are partitioned by.
HISTORY, SECTION, GROUP = "history", "section", "group"


class Named(NamedTuple):
    """An intermediate column that waits to be computed.

    ``stage`` counts the changes between histories and sections on the way to it, ``wave`` the windows on windows inside
    the stage; ``windows`` tells what its own are partitioned by.
    """

    name: str
    value: Column
    windows: frozenset[str]
    stage: int
    wave: int


class Panel:
    """A frame that grows by the intermediate columns of expressions, which are computed when it is asked for.

    Histories (windows by entity) and sections (by time, and by time and group) want the rows dealt in different ways.  So
    columns get stages: even ones for histories, odd ones for sections, each column the first of its kind that is not before what
    it needs.  A stage takes one exchange, however many columns and expressions it serves; in it columns are added in
    waves, those of one partitioning side by side, so that Spark gives them one window node.
    """

    def __init__(self, df: DataFrame, time: str = "date", entity: str = "ticker"):
        self._df, self.time, self.entity, self._n = df, time, entity, 0
        self._waiting: list[Named] = []
        self._at: dict[str, tuple[int, int]] = {}  # stage and wave of what waits
        self._used: set[str] = set()  # windows asked for since the last column was named
        self._needs: set[str] = set()  # columns that the present operator has been given or has named
        self._row: str | None = None

    @property
    def history(self):
        self._used.add(HISTORY)
        return Window.partitionBy(self.entity).orderBy(self.time)

    @property
    def section(self):
        self._used.add(SECTION)
        return Window.partitionBy(self.time)

    def last(self, n: int):
        return self.history.rowsBetween(-(int(n) - 1), 0)

    def group(self, by: Column):
        self._used.add(GROUP)
        return Window.partitionBy(self.time, by)

    def call(self, operator: Callable, *args) -> Column:
        """The value of an operator as a column, which needs its arguments and nothing else that waits."""
        self._needs, self._used = {c for a in args if isinstance(a, Column) for c in self._names_in(a)}, set()
        value = self.let(operator(self, *args))
        self._needs = set()
        return value

    def _names_in(self, value: Column) -> set[str]:
        """The waiting columns that an argument refers to: it is one of them, or the negative of one."""
        text = str(value)
        return {n for n in self._at if n in text}

    def let(self, value: Column) -> Column:
        return F.col(self._name(column(value)))

    def _name(self, value: Column) -> str:
        self._n += 1
        name = f"_v{self._n}_"
        stage, wave = max((self._at[n] for n in self._needs if n in self._at), default=(0, 0))
        windows = frozenset(self._used)
        if windows:
            kinds = {0 if w == HISTORY else 1 for w in windows}
            before = stage
            stage += min((k - stage) % 2 for k in kinds)
            wave = wave + 1 if stage == before else 1
        self._waiting.append(Named(name, value, windows, stage, wave))
        self._at[name] = (stage, wave)
        self._needs.add(name)
        self._used = set()
        return name

    def in_histories(self, df: DataFrame) -> bool:
        """Whether the frame is still ``df`` and all that waits is done by entity."""
        return self._df is df and all(c.stage == 0 for c in self._waiting)

    @property
    def df(self) -> DataFrame:
        """The frame with all columns named so far."""
        waiting, self._waiting, self._at = self._waiting, [], {}
        for stage in sorted({c.stage for c in waiting}):
            here = [c for c in waiting if c.stage == stage]
            self._deal(here)
            for wave in sorted({c.wave for c in here}):
                now = [c for c in here if c.wave == wave]
                for windows in sorted({c.windows for c in now if c.windows}, key=_order):
                    self._add([c for c in now if c.windows == windows])
                self._add([c for c in now if not c.windows])
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df

    def _deal(self, columns: list[Named]) -> None:
        """Deal by time where a stage's first windows are of groups and others of the whole section follow."""
        first = min((c.wave for c in columns if c.windows), default=0)
        early = {w for c in columns if c.wave == first for w in c.windows}
        if early == {GROUP} and any(SECTION in c.windows for c in columns):
            self._df = self._df.repartition(self.time)

    def _add(self, columns: list[Named]) -> None:
        """One projection for columns that do not need each other; plain ones may, in the order they were named."""
        while columns:
            now, held = [], []
            for c in columns:
                text = str(c.value)
                (held if any(o.name in text for o in [*now, *held]) else now).append(c)
            self._df = self._df.select("*", *[c.value.alias(c.name) for c in now])
            columns = held

    def row(self) -> Column:
        """Number of the session in the entity's history."""
        if self._row is None:
            needs, used = self._needs, self._used
            self._needs, self._used = set(), set()
            self._row = self._name(F.row_number().over(self.history))
            self._needs, self._used = needs, used
        self._needs.add(self._row)
        return F.col(self._row)

    def when_full(self, n: int, value: Column) -> Column:
        return F.when(self.row() >= int(n), value)


def _order(windows: frozenset[str]) -> tuple:
    """Sections before groups: what is dealt by time serves its groups, too."""
    return tuple(sorted((HISTORY, SECTION, GROUP).index(w) for w in windows))


def column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# -- elementwise ---------------------------------------------------------------------------------------------------


@operator("abs")
def absolute(p, x):
    return F.abs(x)


@operator("add")
def add(p, x, y):
    return column(x) + y


@operator("subtract", "sub")
def subtract(p, x, y):
    return column(x) - y


@operator("multiply", "mul")
def multiply(p, x, y):
    return column(x) * y


@operator("reverse")
def reverse(p, x):
    return -x


@operator("sign")
def sign(p, x):
    return F.signum(x)


@operator("divide", "div")
def divide(p, x, y):
    return F.when(column(y) != 0, column(x) / y)


@operator("inverse")
def inverse(p, x):
    return F.when(x != 0, 1 / x)


@operator("log")
def log(p, x):
    return F.when(x > 0, F.ln(x))


@operator("sqrt")
def sqrt(p, x):
    return F.when(x >= 0, F.sqrt(x))


def _number(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


@operator("power", "pow")
def power(p, x, y):
    return _number(F.pow(column(x), column(y)))


@operator("signed_power")
def signed_power(p, x, y):
    return _number(F.signum(x) * F.pow(F.abs(x), column(y)))


@operator("max")
def larger(p, x, y):
    return F.when(column(x).isNotNull() & column(y).isNotNull(), F.greatest(column(x), column(y)))


@operator("min")
def smaller(p, x, y):
    return F.when(column(x).isNotNull() & column(y).isNotNull(), F.least(column(x), column(y)))


@operator("densify")
def zero_filled(p, x):
    return F.coalesce(x, F.lit(0.0))


@operator("is_nan")
def is_missing(p, x):
    return x.isNull().cast("double")


@operator("if_else")
def if_else(p, c, t, f):
    return F.when(c > 0, column(t)).when(c.isNotNull(), column(f))


def _true(x) -> Column:
    return F.coalesce(column(x) > 0, F.lit(False))


@operator("and_")
def both(p, x, y):
    return (_true(x) & _true(y)).cast("double")


@operator("or_")
def either(p, x, y):
    return (_true(x) | _true(y)).cast("double")


@operator("not_")
def negated(p, x):
    return (~_true(x)).cast("double")


def _comparison(test: Callable, missing: bool = False) -> Callable:
    return lambda p, x, y: F.coalesce(test(column(x), column(y)), F.lit(missing)).cast("double")


operator("equal")(_comparison(lambda x, y: x == y))
operator("not_equal")(_comparison(lambda x, y: x != y, missing=True))
operator("less")(_comparison(lambda x, y: x < y))
operator("greater")(_comparison(lambda x, y: x > y))
operator("less_equal")(_comparison(lambda x, y: x <= y))
operator("greater_equal")(_comparison(lambda x, y: x >= y))


# -- rolling, per entity -------------------------------------------------------------------------------------------


@operator("ts_delay")
def ts_delay(p, x, d):
    return F.lag(x, int(d)).over(p.history) if d > 0 else x


@operator("ts_delta")
def ts_delta(p, x, d):
    x = p.let(x)
    return x - ts_delay(p, x, d)


def _rolling(aggregate: Callable) -> Callable:
    return lambda p, x, n: p.when_full(n, aggregate(x).over(p.last(n)))


ts_mean = operator("ts_mean")(_rolling(F.avg))
ts_sum = operator("ts_sum")(_rolling(F.sum))
ts_std = operator("ts_std", "ts_std_dev")(_rolling(F.stddev_pop))
ts_min = operator("ts_min")(_rolling(F.min))
ts_max = operator("ts_max")(_rolling(F.max))
operator("ts_count_nans")(_rolling(lambda x: F.sum(x.isNull().cast("double"))))


@operator("ts_zscore")
def ts_zscore(p, x, n):
    x = p.let(x)
    mean, spread = ts_mean(p, x, n), ts_std(p, x, n)
    return F.when(spread > TINY, (x - mean) / spread)


@operator("ts_product")
def ts_product(p, x, n):
    x = p.let(x)
    return p.when_full(n, F.when(F.count(x).over(p.last(n)) == int(n), F.product(x).over(p.last(n))))


def _since(pick: Callable, sign: int) -> Callable:
    def run(p, x, n):
        x, row = p.let(x), p.row()
        # of equal extremes the earliest counts, which is the one of the smallest row
        at = pick(F.when(x.isNotNull(), row), F.when(x.isNotNull(), F.struct(x.alias("x"), (sign * row).alias("r")))).over(p.last(n))
        return p.when_full(n, (row - at).cast("double"))

    return run


operator("ts_arg_min")(_since(F.min_by, 1))
operator("ts_arg_max")(_since(F.max_by, -1))


@operator("ts_rank")
def ts_rank(p, x, n):
    x = p.let(x)
    seen = p.let(F.collect_list(x).over(p.last(n)))
    below, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    share = F.when(x.isNull(), 0.0).otherwise((below + 0.5 * same) / F.size(seen))
    return p.when_full(n, F.when(F.size(seen) > 0, share))


def _moments(p, x, y, n):
    x, y, w = p.let(x), p.let(y), p.last(n)
    return x, y, p.let(F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w))


@operator("ts_corr")
def ts_corr(p, x, y, n):
    x, y, cov = _moments(p, x, y, n)
    a, b = p.let(F.stddev_pop(x).over(p.last(n))), p.let(F.stddev_pop(y).over(p.last(n)))
    return p.when_full(n, F.when((a > TINY) & (b > TINY), cov / (a * b)))


@operator("ts_covariance")
def ts_covariance(p, x, y, n):
    return p.when_full(n, _moments(p, x, y, n)[2])


@operator("ts_regression")
def ts_regression(p, y, x, n):
    x, y, cov = _moments(p, x, y, n)
    spread = p.let(F.var_pop(x).over(p.last(n)))
    return p.when_full(n, F.when(spread > TINY, cov / spread))


@operator("ts_quantile")
def ts_quantile(p, x, n, q=0.5):
    return p.when_full(n, F.percentile(x, F.lit(float(q))).over(p.last(n)))


@operator("ts_decay_linear")
def ts_decay_linear(p, x, n):
    """Weights 1 to n by age; a missing value takes its weight with it.  Two plain sums, the weight being linear in the row."""
    x, row, w = p.let(x), p.row(), p.last(n)
    there = x.isNotNull().cast("double")
    shift = int(n) - row
    top = F.sum(row * x).over(w) + shift * F.sum(x).over(w)
    weight = F.sum(row * there).over(w) + shift * F.sum(there).over(w)
    return p.when_full(n, F.when(weight > 0, top / weight))


@operator("ts_decay_exp")
def ts_decay_exp(p, x, n):
    x, row = p.let(x), p.row()
    seen = p.let(F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("x"), row.alias("r")))).over(p.last(n)))
    keep = 1 - 1 / int(n)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    both = F.aggregate(
        seen,
        zero,
        lambda acc, v: F.struct(
            (acc["s"] + v["x"] * F.pow(F.lit(keep), row - v["r"])).alias("s"), (acc["w"] + F.pow(F.lit(keep), row - v["r"])).alias("w")
        ),
    )
    return p.when_full(n, F.when(both["w"] > 0, both["s"] / both["w"]))


@operator("ts_backfill")
def ts_backfill(p, x, n, strict=0):
    """The last value known; without limit for n >= 2 (``strict`` keeps to n rows), as fills feed later fills."""
    if int(n) < 2:
        return x
    w = p.last(n) if strict else p.history.rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(w)


@operator("last_diff_value")
def last_diff_value(p, x):
    """The latest earlier value unlike the present one; where there is none, the one found before."""
    x = p.let(x)
    known = p.let(F.last(x, ignorenulls=True).over(p.history.rowsBetween(Window.unboundedPreceding, -1)))
    turned = p.let(F.when(x.isNotNull() & known.isNotNull() & (x != known), known))
    return F.last(turned, ignorenulls=True).over(p.history.rowsBetween(Window.unboundedPreceding, 0))


@operator("trade_when")
def trade_when(p, trigger, alpha, leave):
    trigger, alpha, leave = p.let(column(trigger)), p.let(column(alpha)), p.let(column(leave))
    move = F.when(leave > 0, F.struct(F.lit(None).cast("double").alias("v"))).when(trigger > 0, F.struct(alpha.alias("v")))
    return F.last(move, ignorenulls=True).over(p.history.rowsBetween(Window.unboundedPreceding, 0))["v"]


@operator("hump")
def hump(p, x, threshold=0.01):
    """Hold a value until it is left by more than threshold * (1 + |held|): sequential, one entity at a time."""
    df, time, entity = p.df, p.time, p.entity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        held, out = None, []
        for v in pdf["_x"].tolist():
            if v is not None and v == v and (held is None or abs(v - held) > threshold * (1 + abs(held))):
                held = v
            out.append(held)
        return pd.DataFrame({entity: pdf[entity], time: pdf[time], "_held": pd.array(out, dtype="Float64")})

    kinds = dict(df.dtypes)
    held = df.select(entity, time, x.alias("_x")).groupBy(entity).applyInPandas(run, f"{entity} {kinds[entity]}, {time} {kinds[time]}, _held double")
    p.df = df.join(held, [entity, time])
    value = p.let(F.col("_held"))
    p.df = p.df.drop("_held")
    return value


# -- cross-section and group ---------------------------------------------------------------------------------------


def _rank(p, x, w):
    x = p.let(x)
    # one window, ordered with nulls last: ordinals of values are not disturbed by missing ones
    ordered = w.orderBy(x.asc_nulls_last(), F.col(p.entity))
    return F.when(x.isNotNull(), F.row_number().over(ordered)), F.count(x).over(w), x


@operator("rank")
def rank(p, x):
    ordinal, n, _ = _rank(p, x, p.section)
    return ordinal / n


@operator("quantile")
def quantile(p, x, k):
    ordinal, n, _ = _rank(p, x, p.section)
    return F.least(F.floor((ordinal - 1) * int(k) / n), F.lit(int(k) - 1)).cast("double")


def _zscore(p, x, w):
    x = p.let(x)
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > TINY, (x - F.avg(x).over(w)) / spread)


def _scale(p, x, w):
    x = p.let(x)
    centred = p.let(x - F.avg(x).over(w))
    size = F.sum(F.abs(centred)).over(w)
    return F.when(size > TINY, centred / size)


@operator("zscore")
def zscore(p, x):
    return _zscore(p, x, p.section)


@operator("scale")
def scale(p, x):
    return _scale(p, x, p.section)


@operator("normalize")
def normalize(p, x):
    x = p.let(x)
    return x - F.avg(x).over(p.section)


@operator("winsorize")
def winsorize(p, x, share=0.01):
    x = p.let(x)
    low, high = (F.percentile(x, F.lit(q)).over(p.section) for q in (float(share), 1 - float(share)))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


@operator("group_rank")
def group_rank(p, x, g):
    ordinal, n, _ = _rank(p, x, p.group(g))
    return ordinal / n


@operator("group_zscore")
def group_zscore(p, x, g):
    return _zscore(p, x, p.group(g))


@operator("group_mean")
def group_mean(p, x, g):
    return F.avg(x).over(p.group(g))


@operator("group_scale")
def group_scale(p, x, g):
    return _scale(p, x, p.group(g))


@operator("group_neutralize")
def group_neutralize(p, x, g):
    x = p.let(x)
    return x - F.avg(x).over(p.group(g))


@operator("group_backfill")
def group_backfill(p, x, g):
    x = p.let(x)
    return F.coalesce(x, F.avg(x).over(p.group(g)))


@operator("sector_neutralize")
def sector_neutralize(p, x, g):
    """As group_neutralize, but groups of one and nameless groups are left alone."""
    x = p.let(x)
    w = p.group(g)
    named = g.isNotNull() & ~g.isin("Unknown", "", "nan")
    return F.when(named & (F.count(x).over(w) >= 2), x - F.avg(x).over(w)).otherwise(x)
