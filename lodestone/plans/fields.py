"""Differential operators on gridded fields, by central differences between neighbours' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shifted(df: DataFrame, axes: list[str], axis: str, by: int, value: str, out: str) -> DataFrame:
    """``value`` of the cell ``by`` steps along an axis, by an equi join on the moved index."""
    other = df.select(*((F.col(a) - by if a == axis else F.col(a)).alias(a) for a in axes), F.col(value).alias(out))
    return df.join(other, axes, "left")


def derivative(df: DataFrame, axes: list[str], axis: str, value: str, step: float, out: str) -> DataFrame:
    """(f(x + h) - f(x - h)) / 2h; null at the rim."""
    both = shifted(shifted(df, axes, axis, 1, value, "__up"), axes, axis, -1, value, "__down")
    return both.withColumn(out, (F.col("__up") - F.col("__down")) / (2 * step)).drop("__up", "__down")


def gradient(df: DataFrame, axes: list[str], value: str, steps: list[float]) -> DataFrame:
    for a, h in zip(axes, steps, strict=True):
        df = derivative(df, axes, a, value, h, f"d_{a}")
    return df.withColumn("gradient", F.array(*(f"d_{a}" for a in axes))).drop(*(f"d_{a}" for a in axes))


def divergence(df: DataFrame, axes: list[str], components: list[str], steps: list[float]) -> DataFrame:
    for a, c, h in zip(axes, components, steps, strict=True):
        df = derivative(df, axes, a, c, h, f"__d_{a}")
    total: Column = F.lit(0.0)
    for a in axes:
        total = total + F.col(f"__d_{a}")
    return df.withColumn("divergence", total).drop(*(f"__d_{a}" for a in axes))


def heat_step(df: DataFrame, axes: list[str], value: str, steps: list[float], dt: float, diffusivity: float = 1.0) -> DataFrame:
    """One explicit Euler step of the heat equation; the rim keeps its values."""
    out, change = df, F.lit(0.0)
    for k, (a, h) in enumerate(zip(axes, steps, strict=True)):
        out = shifted(shifted(out, axes, a, 1, value, f"__u{k}"), axes, a, -1, value, f"__d{k}")
        change = change + (F.col(f"__u{k}") - 2 * F.col(value) + F.col(f"__d{k}")) / (h * h)
    moved = F.coalesce(F.col(value) + diffusivity * dt * change, F.col(value))
    return out.withColumn(value, moved).select(*df.columns)
