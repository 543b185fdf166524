"""Books that are sequential in time: one strategy's or account's rows at a time, in order, as small helpers of Spark groups."""

from __future__ import annotations

import math

import pandas as pd


def rebalance(cash: float, nav: float, held: dict, targets: dict, prices: dict, bps: float) -> dict:
    """One rebalancing of a share book: ``held`` (ticker: [quantity, mean cost, last price, realized]) is changed in place.

    Quantities are whole shares of the value before; names held without a target go to zero; sales come before
    purchases, which stop where the cash does; a name without a price is left unfilled.
    """
    rate = bps / 10_000
    value = cash + sum(q * (prices.get(t) or last or 0.0) for t, (q, _, last, _) in held.items())
    value = value if value > 0 else nav
    plans, unfilled = [], 0
    for t in {**targets, **{t: 0.0 for t, h in held.items() if h[0] > 0 and t not in targets}}:
        price = prices.get(t)
        if not price or price <= 0:
            unfilled += 1
            continue
        want = max(0, math.floor(value * targets.get(t, 0.0) / price))
        plans.append((want - held.get(t, [0])[0], t, price))
    traded = fees = 0.0
    for delta, t, price in sorted(plans, key=lambda p: (p[0] >= 0, p[1])):
        own = held.setdefault(t, [0, 0.0, None, 0.0])
        if delta > 0:
            delta = min(delta, max(0, math.floor(cash / (price * (1 + rate)))))
        else:
            delta = -min(-delta, own[0])
        worth = abs(delta) * price
        fee = worth * rate
        if delta < 0:
            cash += worth - fee
            own[3] += -delta * (price - own[1]) - fee
        elif delta > 0:
            cash -= worth + fee
            own[1] = (own[0] * own[1] + worth + fee) / (own[0] + delta)
        own[0] += delta
        own[1], own[2] = (own[1] if own[0] else 0.0), price
        traded, fees = traded + worth, fees + fee
    after = cash + sum(q * (last or 0.0) for q, _, last, _ in held.values())
    return {"cash": cash, "nav": after, "ret": after / nav - 1 if nav else 0.0, "turnover": traded / nav if nav else 0.0, "fees": fees, "unfilled": unfilled, "n_positions": sum(h[0] > 0 for h in held.values())}


def share_book(rows: pd.DataFrame, start: float = 100_000.0, bps: float = 10.0) -> pd.DataFrame:
    """A strategy's fills over time: rows (fill_date, ticker, weight or null, price or null), one frame per strategy."""
    cash = nav = start
    held: dict = {}
    out = []
    for day, part in rows.sort_values(["fill_date", "ticker"]).groupby("fill_date", sort=True):
        prices = {t: p for t, p in zip(part["ticker"], part["price"], strict=True) if p == p and p is not None}
        targets = {t: w for t, w in zip(part["ticker"], part["weight"], strict=True) if w == w and w is not None}
        got = rebalance(cash, nav, held, targets, prices, bps)
        cash, nav = got["cash"], got["nav"]
        out.append({"fill_date": day, **got, "cumulative": nav / start - 1})
    return pd.DataFrame(out, columns=["fill_date", "cash", "nav", "ret", "turnover", "fees", "unfilled", "n_positions", "cumulative"])


def apply_fills(rows: pd.DataFrame, start: float = 50_000.0, fee: float = 1.0) -> pd.DataFrame:
    """An account's fills (order_id, ticker, side, qty, price) in order: status, cash and position after each, and what it realized.

    A purchase needs the cash for it and its fee, a sale the shares; else it is rejected.  Buying moves the mean cost,
    selling realizes against it.
    """
    cash = start
    held: dict = {}
    out = []
    for order, ticker, side, qty, price in rows.sort_values("order_id")[["order_id", "ticker", "side", "qty", "price"]].itertuples(index=False):
        have, cost = held.get(ticker, (0, 0.0))
        status, gain = "filled", 0.0
        if price is None or price != price:
            status = "unfilled"
        elif side == "buy":
            if cash < price * qty + fee:
                status = "no_cash"
            else:
                cash -= price * qty + fee
                held[ticker] = (have + qty, (have * cost + qty * price) / (have + qty))
        elif have < qty:
            status = "oversell"
        else:
            cash += price * qty - fee
            gain = (price - cost) * qty
            held[ticker] = (have - qty, cost if have > qty else 0.0)
        now, mean = held.get(ticker, (0, 0.0))
        out.append((order, ticker, status, gain, cash, now, mean))
    return pd.DataFrame(out, columns=["order_id", "ticker", "status", "realized", "cash", "position", "mean_cost"])
