"""Signals of option chains (columns of ``sources.chains``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.operators.joins import shared_rank
from sparkfolio.operators.technical import clipped

#: The rate, the notional of a contract, and the band beyond which exposure pins or moves a price.
RATE, CONTRACT, BAND = 0.045, 100, 5e8
_D1 = f"(ln(spot / strike) + ({RATE} + 0.5 * iv * iv) * tau) / (iv * sqrt(tau))"
#: Black-Scholes gamma; degenerate contracts count nothing.
GAMMA = f"CASE WHEN spot > 0 AND strike > 0 AND iv > 0 AND tau > 0 THEN exp(-0.5 * power({_D1}, 2)) / sqrt(2 * pi()) / (spot * iv * sqrt(tau)) ELSE 0 END"


def put_call(chain: DataFrame) -> DataFrame:
    """ticker, z of a chain of one expiry: put volume over call volume, and the percentile of mean implied volatility among tickers, each bent by tanh.

    Missing volumes are zero; without any volume z is 0.
    """
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.coalesce("volume", F.lit(0.0))).otherwise(0.0)).alias(kind)
    c = chain.groupBy("ticker").agg(of("put"), of("call"), F.round(F.avg("iv"), 9).alias("iv"))
    n = F.greatest(F.lit(1), F.col("n") - 1)
    p = shared_rank(c, "iv", "place").join(F.broadcast(c.agg(F.count("*").alias("n")))).withColumn("rank", 100 * (F.col("place") - 1) / n)  # one row
    z = (-F.tanh((F.col("put") / F.greatest("call", F.lit(1.0)) - 1) * 1.5) - F.tanh((F.col("rank") - 50) / 30)) / 2 * 2
    return p.select("ticker", F.when(F.col("put") + F.col("call") == 0, 0.0).otherwise(clipped(z)).alias("z"))


def gamma_exposure(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """ticker, signed (notional), regime, n_strikes of a chain with tau and of prices (ticker, spot): gamma times open interest, calls less puts.

    Tickers without any gamma are left out.
    """
    g = chain.join(spot, "ticker").withColumn("weight", F.expr(GAMMA) * F.col("open_interest"))
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("weight")).otherwise(0.0))
    s = g.groupBy("ticker").agg(side("call").alias("calls"), side("put").alias("puts"), F.first("spot").alias("spot"), F.count("*").alias("n_strikes")).where("calls <> 0 or puts <> 0")
    x = s.withColumn("signed", (F.col("calls") - F.col("puts")) * CONTRACT * F.col("spot") * F.col("spot"))
    return x.select("ticker", "signed", F.when(F.col("signed") > BAND, "pinned").when(F.col("signed") < -BAND, "volatile").otherwise("mixed").alias("regime"), "n_strikes")
