"""Books of many factors at once: a date's ranks give each book's cuts, and the cuts give each ticker's side where its history lies.

So a date's values are dealt once, whatever the number of books, and nothing is dealt back to the tickers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import staged

#: Fewest names that make a book; cost of a move and of its size, of borrowing, and the money that is moved.
LEAST, BPS, SLIPPAGE, BORROW_BPS, CAPITAL = 10, 5.0, 2.0, 50.0, 100_000.0
LONG, SHORT = 1, 2
#: Two bits of a code for each book.
MOST = 31


def _known(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (NaN for null) and which are there."""
    return column.to_numpy(), column.is_valid().to_numpy()


def _cut_points(tickers: pa.Array, factors: list[tuple[np.ndarray, np.ndarray]], fwd: tuple[np.ndarray, np.ndarray], books: list[tuple[int, float]]) -> dict:
    """A date's figures: of each book its names on both sides and the last of them by (factor, ticker), of each factor its IC.

    Rows are ordered by ticker.  The IC is that of ordinal ranks among the rows with factor and return.
    """
    by_fwd = np.argsort(fwd[0], kind="stable")
    ic, orders = [], []
    for x, there in factors:
        order = np.argsort(x, kind="stable")
        orders.append(order[there[order]])
        pair = there & fwd[1]
        n = int(pair.sum())
        rank = np.empty((2, len(x)))
        for r, o in zip(rank, (order, by_fwd), strict=True):
            r[o[pair[o]]] = np.arange(n)
        a, z = rank[:, pair] - (n - 1) / 2
        ic.append(float((a * z).mean() / ((n * n - 1) / 12)) if n >= 3 else 0.0)
    out = {"ic": ic, "longs": [], "shorts": [], "high": [], "low": [], "high_at": [], "low_at": []}
    for k, top in books:
        order, n = orders[k], len(orders[k])
        share = np.arange(1, n + 1) / n if n >= LEAST else np.empty(0)
        long = int((share >= 1 - top).sum())
        short = min(int((share <= top).sum()), len(share) - long)
        for count, edge, at, place in ((long, "high", "high_at", n - long), (short, "low", "low_at", short - 1)):
            row = order[place] if count else None
            out[edge].append(None if row is None else float(factors[k][0][row]))
            out[at].append(None if row is None else tickers[row].as_py())
        out["longs"].append(long)
        out["shorts"].append(short)
    return out


def _cuts(f: DataFrame, by: list[str], names: list[str], books: list[tuple[int, float]]) -> DataFrame:
    """``by`` and the figures of :func:`_cut_points`, with ``paid``: whether any row has a return."""
    kinds = dict(f.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", ic array<double>, longs array<long>, shorts array<long>, high array<double>, low array<double>, high_at array<{kinds['ticker']}>, low_at array<{kinds['ticker']}>, paid boolean"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("ticker", "ascending")], null_placement="at_start"))
        tickers = rows.column("ticker").combine_chunks()
        fwd = _known(rows.column("fwd"))
        found = _cut_points(tickers, [_known(rows.column(n)) for n in names], fwd, books)
        kind = {"ic": pa.float64(), "high": pa.float64(), "low": pa.float64(), "longs": pa.int64(), "shorts": pa.int64(), "high_at": tickers.type, "low_at": tickers.type}
        arrays = {c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=True)}
        arrays |= {c: pa.array([found[c]], pa.list_(kind[c])) for c in ("ic", "longs", "shorts", "high", "low", "high_at", "low_at")}
        return pa.table(arrays | {"paid": pa.array([bool(fwd[1].any())])})

    return f.select(*by, "ticker", *names, "fwd").groupBy(*by).applyInArrow(run, schema)


def _code(names: list[str], books: list[tuple[int, float]]) -> Column:
    """The sides of a row in all books, two bits each."""
    code = F.lit(0).cast("long")
    for i, (k, _) in enumerate(books):
        x, high, low = F.col(names[k]), F.col("high")[i], F.col("low")[i]
        long = (x > high) | ((x == high) & (F.col("ticker") >= F.col("high_at")[i]))
        short = (x < low) | ((x == low) & (F.col("ticker") <= F.col("low_at")[i]))
        code = code + F.when(long, F.lit(LONG << 2 * i).cast("long")).when(short, F.lit(SHORT << 2 * i).cast("long")).otherwise(F.lit(0).cast("long"))
    return code


def _moves(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's rows by date and book; ``weights`` are those of date, book and side."""
    dates, books, _ = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_row = np.zeros((3, books, dates)), False
        for batch in batches:
            no, before, code, held, fwd, money = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("no", "before", "code", "held", "fwd", "money"))
            any_row = any_row or len(no) > 0
            with np.errstate(invalid="ignore", divide="ignore"):
                for i in range(books):
                    now = weights[no, i, code >> 2 * i & 3]
                    delta = np.abs(now - weights[before, i, held >> 2 * i & 3])
                    part = np.where(money > 0, 100 * delta * CAPITAL / money, 0.0)
                    for total, x in zip(sums, (np.where(np.isnan(fwd), 0.0, now * fwd), delta, delta * SLIPPAGE * np.sqrt(part) / 10_000), strict=True):
                        total[i] += np.bincount(no, weights=x, minlength=dates)
        if any_row:
            book, no = (x.ravel().astype("i4") for x in np.indices((books, dates)))
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(book), *[pa.array(s.ravel()) for s in sums]], ["no", "book", "pnl", "moved", "slipped"])

    return run


def book_days(f: DataFrame, books: dict[str, tuple[str, float]], by: list[str], key: str = "strategy") -> DataFrame:
    """``by``, ``key``, k, size, moved, net and ic of each of ``books``: its name, a column of factors and the share of names on either side.

    ``f`` has ``by`` (the last of them the date), ticker, the factors, fwd, close and volume, and lies by ticker; it is made
    twice, once for the dates' cuts and once for the tickers' moves.  What returns to the driver is a row for each date.
    """
    names = list(dict.fromkeys(c for c, _ in books.values()))
    listed = [(names.index(c), top) for c, top in books.values()]
    assert len(books) <= MOST
    numbered = Window.partitionBy(F.lit(0)).orderBy(*by)
    cuts = staged(_cuts(f, by, names, listed), tidy=True)
    cuts = staged(cuts.withColumn("no", (F.row_number().over(numbered) - 1).cast("int")))  # a row for each date
    weights = np.zeros((max(1, cuts.count()), len(books), 4))
    for r in cuts.select("no", "longs", "shorts").toLocalIterator():
        for i, (a, z) in enumerate(zip(r.longs, r.shorts, strict=True)):
            weights[r.no, i, [LONG, SHORT]] = 1 / a if a else 0.0, -1 / z if z else 0.0

    edges = F.broadcast(cuts.select(*[F.col(c).alias(f"_{c}") for c in by], "no", "high", "low", "high_at", "low_at"))
    at = f.join(edges, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    own = Window.partitionBy(*by[:-1], "ticker").orderBy(by[-1])
    at = at.select(*by, "ticker", "no", _code(names, listed).alias("code"), "fwd", (F.col("close") * F.col("volume")).alias("money"))
    at = at.withColumn("held", F.coalesce(F.lag("code").over(own), F.lit(0).cast("long"))).withColumn("before", F.coalesce(F.lag("no").over(own), F.lit(0)))
    rows = at.where("code <> 0 or held <> 0").select("no", "before", "code", "held", "fwd", "money")
    parts = rows.mapInArrow(_moves(weights), "no int, book int, pnl double, moved double, slipped double")
    sums = staged(parts.groupBy("no", "book").agg(*[F.sum(c).alias(c) for c in ("pnl", "moved", "slipped")]), tidy=True)

    each = F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("factor")) for n, (k, _) in zip(books, listed, strict=True)])).alias("book", "b")
    days = cuts.select(*by, "no", "ic", "shorts", "paid", each)
    days = days.join(sums, ["no", "book"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    lent = F.when(F.col("shorts")[F.col("book")] > 0, 1.0).otherwise(0.0) * BORROW_BPS / (10_000 * 252)
    days = days.select(*by, F.col("b.name").alias(key), F.when(F.col("paid"), zero("pnl")).alias("pnl"), zero("moved").alias("moved"), zero("slipped").alias("slipped"), lent.alias("lent"), F.col("ic")[F.col("b.factor")].alias("ic"))
    line = Window.partitionBy(*by[:-1], key).orderBy(by[-1])
    net = F.lag("pnl").over(line) - F.lag(F.col("moved") * BPS / 10_000).over(line) - F.lag("slipped").over(line) - F.lag("lent").over(line)
    size = F.count("*").over(Window.partitionBy(*by[:-1], key))
    return staged(days.select(key, *by, (F.row_number().over(line) - 1).alias("k"), size.alias("size"), "moved", net.alias("net"), "ic"))
