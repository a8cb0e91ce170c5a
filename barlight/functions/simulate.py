"""Simulated paths from a counter-based generator.

A draw is a hash of (seed, simulation, step), so a path does not depend on
partitioning, retries or the order of rows, and no task keeps a generator.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from enum import Enum
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


class Process(Enum):
    GBM = "gbm"
    OU = "ou"
    FRW = "frw"


class Innovations(Enum):
    GAUSSIAN = "gaussian"
    STUDENT_T = "student_t"
    BOOTSTRAP = "bootstrap"


def uniform(seed: int, *parts: Column, stream: int = 0) -> Column:
    """A number in (0, 1) for each value of the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *parts), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def normal(seed: int, *parts: Column, stream: int = 0) -> Column:
    """A standard normal number for each value of the parts (Box-Muller)."""
    u, v = uniform(seed, *parts, stream=2 * stream + 1), uniform(seed, *parts, stream=2 * stream + 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def student_t(seed: int, df: int, *parts: Column) -> Column:
    """Student's t with a whole number of degrees of freedom above 2, scaled to variance 1."""
    if df <= 2 or df != int(df):
        raise ValueError("df must be a whole number above 2")
    square = sum((F.pow(normal(seed, *parts, stream=i + 2), 2) for i in range(1, int(df))), F.pow(normal(seed, *parts, stream=2), 2))
    return normal(seed, *parts, stream=1) / F.sqrt(square / df) / math.sqrt(df / (df - 2))


def _grid(spark: SparkSession, n_simulations: int, n: int, seed: int) -> DataFrame:
    rows = spark.range(n_simulations * n)
    return rows.select(F.floor(F.col("id") / n).alias("simulation"), F.lit(seed).cast("long").alias("seed"), (F.col("id") % n).alias("step"))


def _noise(df: DataFrame, seed: int, innovations: Innovations | Callable[[Column, Column], Column], dof: int, residuals: list[float] | None) -> DataFrame:
    at = (F.col("simulation"), F.col("step"))
    if callable(innovations) and not isinstance(innovations, Innovations):
        return df.withColumn("_z", innovations(*at))
    if innovations is Innovations.GAUSSIAN:
        return df.withColumn("_z", normal(seed, *at))
    if innovations is Innovations.STUDENT_T:
        return df.withColumn("_z", student_t(seed, dof, *at))
    if not residuals:
        raise ValueError("the bootstrap needs residuals")
    table = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(residuals)], "_i long, _z double")
    return df.withColumn("_i", F.floor(uniform(seed, *at) * len(residuals))).join(F.broadcast(table), "_i").drop("_i")


def _path() -> WindowSpec:
    return Window.partitionBy("simulation").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)


def monte_carlo(spark: SparkSession, process: Process | Callable[..., Any], n_simulations: int, n: int, seed: int = 0, innovations: Innovations | Callable[[Column, Column], Column] = Innovations.GAUSSIAN, df: int = 5, residuals: list[float] | None = None, **args: Any) -> DataFrame:
    """(simulation, seed, step, price or value): n steps of each path, step 0 the start.

    Process GBM takes base, drift, vol, dt; OU theta, mu, sigma, x0, dt,
    geometric; FRW hurst, base, scale. A callable process gets (n, seed) and
    args, returns n values, and runs in Python once a path.
    """
    if n_simulations < 1 or n < 1:
        raise ValueError("n_simulations and n must be 1 or more")
    if process is not Process.GBM and innovations is not Innovations.GAUSSIAN:
        raise NotImplementedError("only GBM takes other innovations")
    if process is Process.GBM:
        return _gbm(_noise(_grid(spark, n_simulations, n, seed), seed, innovations, df, residuals), **args)
    if process is Process.OU:
        return _ou(spark, n_simulations, n, seed, **args)
    if process is Process.FRW:
        return _frw(spark, n_simulations, n, seed, **args)
    return _called(spark, process, n_simulations, n, seed, args)


def _gbm(rows: DataFrame, base: float = 100.0, drift: float = 0.0, vol: float = 0.2, dt: float = 1 / 252) -> DataFrame:
    step = F.when(F.col("step") == 0, 0.0).otherwise((drift - vol**2 / 2) * dt + vol * math.sqrt(dt) * F.col("_z"))
    total = F.sum(step).over(_path())
    return rows.select("simulation", "seed", "step", F.exp(math.log(base) + total).alias("price"))


def _ou(spark: SparkSession, n_simulations: int, n: int, seed: int, theta: float = 1.0, mu: float = 0.0, sigma: float = 1.0, x0: float = 0.0, dt: float = 1 / 252, geometric: bool = False) -> DataFrame:
    """Exact steps of the mean-reverting process, as a fold over the path's own noise (a prefix sum would underflow on long paths)."""
    a = math.exp(-theta * dt)
    s = sigma * math.sqrt((1 - a * a) / (2 * theta)) if theta > 0 else sigma * math.sqrt(dt)
    rows = _grid(spark, n_simulations, n, seed).withColumn("_z", normal(seed, F.col("simulation"), F.col("step")))
    start = math.log(x0) if geometric else x0

    def run(frame):
        frame = frame.sort_values("step")
        x, out = start, []
        for i, z in enumerate(frame["_z"].to_numpy()):
            x = start if i == 0 else mu + (x - mu) * a + s * z
            out.append(math.exp(x) if geometric else x)
        frame["value"] = out
        return frame[["simulation", "seed", "step", "value"]]

    out = rows.groupBy("simulation").applyInPandas(run, "simulation long, seed long, step long, value double")
    return out.withColumnRenamed("value", "price") if geometric else out


def _circulant(n: int, hurst: float) -> np.ndarray:
    """Square roots of the eigenvalues of the circulant that embeds the covariance of fractional noise."""
    k = np.arange(n + 1, dtype=float)
    gamma = 0.5 * ((k + 1) ** (2 * hurst) - 2 * k ** (2 * hurst) + np.abs(k - 1) ** (2 * hurst))
    return np.sqrt(np.maximum(np.fft.fft(np.concatenate([gamma, gamma[-2:0:-1]])).real, 0))


def _frw(spark: SparkSession, n_simulations: int, n: int, seed: int, hurst: float = 0.5, base: float = 100.0, scale: float = 1.0) -> DataFrame:
    """A walk whose increments are fractional noise: independent at hurst 0.5, else by Davies and Harte."""
    if not 0 < hurst < 1:
        raise ValueError("hurst must lie between 0 and 1")
    if hurst == 0.5:
        rows = _grid(spark, n_simulations, n, seed).withColumn("_z", F.when(F.col("step") > 0, normal(seed, F.col("simulation"), F.col("step"))).otherwise(0.0))
        return rows.select("simulation", "seed", "step", (base + scale * F.sum("_z").over(_path())).alias("price"))
    root = _circulant(n, hurst)

    def path(n: int, seed: int) -> np.ndarray:
        rng, m = np.random.default_rng(seed), len(root)
        noise = np.fft.fft(root * (rng.standard_normal(m) + 1j * rng.standard_normal(m))).real / math.sqrt(m)
        return base + scale * np.concatenate([[0.0], np.cumsum(noise[: n - 1])])

    return _called(spark, path, n_simulations, n, seed, {}).withColumnRenamed("value", "price")


def _called(spark: SparkSession, process: Callable[..., Any], n_simulations: int, n: int, seed: int, args: dict[str, Any]) -> DataFrame:
    def run(frames):
        import pandas as pd

        for frame in frames:
            for i in frame["id"]:
                values = np.asarray(process(n, int(np.random.SeedSequence([seed, int(i)]).generate_state(1)[0]), **args), dtype=float)
                yield pd.DataFrame({"simulation": int(i), "seed": seed, "step": np.arange(n), "value": values})

    return spark.range(n_simulations).mapInPandas(run, "simulation long, seed long, step long, value double")


def geometric_brownian_motion(spark: SparkSession, n: int, seed: int = 0, **args: float) -> DataFrame:
    return monte_carlo(spark, Process.GBM, 1, n, seed, **args).select("step", "price")


def ornstein_uhlenbeck(spark: SparkSession, n: int, seed: int = 0, **args: Any) -> DataFrame:
    return monte_carlo(spark, Process.OU, 1, n, seed, **args).drop("simulation", "seed")


def fractional_random_walk(spark: SparkSession, n: int, seed: int = 0, **args: float) -> DataFrame:
    return monte_carlo(spark, Process.FRW, 1, n, seed, **args).select("step", "price")


def fitted_paths(returns: DataFrame, n_simulations: int, horizon: int, seed: int = 0, r: str = "return", innovations: Innovations = Innovations.GAUSSIAN, df: int = 5) -> DataFrame:
    """Paths from 1.0 over horizon steps, with the mean and deviation of the log returns."""
    log = F.log1p(r)
    mean, std = (x or 0.0 for x in returns.agg(F.avg(log), F.stddev_samp(log)).first())
    residuals = None
    if innovations is Innovations.BOOTSTRAP:
        if std == 0:
            raise ValueError("returns without variation leave no residuals")
        residuals = [row[0] for row in returns.where(F.col(r).isNotNull()).select((log - mean) / std).collect()]
    return monte_carlo(returns.sparkSession, Process.GBM, n_simulations, horizon + 1, seed, innovations, df, residuals, base=1.0, drift=mean + std**2 / 2, vol=std, dt=1.0)


def simulate_metric(metric: str, returns: DataFrame, n_simulations: int = 10_000, horizon: int = 21, alpha: float = 0.05, **args: Any) -> float:
    """var or cvar of the simulated returns over the horizon."""
    if metric not in ("var", "cvar"):
        raise ValueError("only var and cvar are simulated")
    ends = fitted_paths(returns, n_simulations, horizon, **args).where(F.col("step") == horizon).select((F.col("price") - 1).alias("return"))
    if metric == "var":
        return ends.agg(F.percentile("return", alpha)).first()[0]
    from .metrics import cvar_historical

    return cvar_historical(ends, alpha=alpha).first()[0]


def percentile_bands(paths: DataFrame, alpha: float = 0.05, column: str = "price") -> DataFrame:
    """(step, low, median, high): nearest-rank quantiles of the paths at each step."""
    ranked = F.sort_array(F.collect_list(column))
    at = lambda q: F.element_at("_v", (F.rint((F.size("_v") - 1) * F.lit(q)) + 1).cast("int"))
    return paths.groupBy("step").agg(ranked.alias("_v")).select("step", at(alpha / 2).alias("low"), at(0.5).alias("median"), at(1 - alpha / 2).alias("high")).orderBy("step")
