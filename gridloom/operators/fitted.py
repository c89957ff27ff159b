"""Fits apart from their use: what a fit learns is a few small tables, which are saved, loaded and applied to other rows.

Each kind holds one row for each column, component, node or group of rows, never rows of the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import models as M
from gridloom.operators.ranking import _wide_medians, filled_from, quantiles


@dataclass
class Fitted:
    """A fit: its kind, settings, and small tables by name."""

    kind: str
    settings: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Tables as Parquet below ``path``, then the settings; without these a fit can't be loaded, so half of one isn't."""
        for name, table in self.tables.items():
            table.coalesce(1).write.mode("error").parquet(f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        spark.createDataFrame([(self.kind, json.dumps(self.settings), sorted(self.tables))], "kind string, settings string, tables array<string>").coalesce(1).write.mode("error").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        row = spark.read.parquet(f"{path}/settings").first()
        return Fitted(row["kind"], json.loads(row["settings"]), {n: spark.read.parquet(f"{path}/{n}") for n in row["tables"]})

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` with the columns of the fit replaced or added; other columns stay."""
        return APPLY[self.kind](self, df)


def fit_imputer(df: DataFrame, families: dict[str, str], state: str, month: str) -> Fitted:
    """Medians that ``models.impute`` fills with: of state and month, of the state, and of all rows.

    ``families``: column -> detection (filled by 0), weather, context or other.
    """
    measured = [c for c, f in families.items() if f != "detection"]
    levels = [[state, month], [state], []]
    tables = {}
    if measured:
        found = quantiles(df, measured, levels, [0.5])
        tables = {f"level{i}": _wide_medians(found, measured, i, level, f"_m{i}_") for i, level in enumerate(levels)}
    else:
        tables["level2"] = df.sparkSession.createDataFrame([], "nothing int")
    return Fitted("imputer", {"families": families, "state": state, "month": month}, tables)


def _impute(fit: Fitted, df: DataFrame) -> DataFrame:
    families, state, month = (fit.settings[k] for k in ("families", "state", "month"))
    by = lambda *kinds: [c for c, f in families.items() if f in kinds]
    names = df.columns
    out = df.fillna(0, subset=by("detection")) if by("detection") else df
    row = fit.tables["level2"].first()
    total = {f"_m_{c}": row and row[f"_m2_{c}"] for c in by("weather", "context", "other")}
    table = lambda i, keys, columns: fit.tables[f"level{i}"].select(*keys, *(f"_m{i}_{c}" for c in columns))
    if columns := by("weather"):
        out = filled_from(out, columns, [[state, month], [state]], [table(0, [state, month], columns), table(1, [state], columns)], total).select(*names)
    if columns := by("context"):
        only = fit.tables["level1"].select(state, *(F.col(f"_m1_{c}").alias(f"_m0_{c}") for c in columns))
        out = filled_from(out, columns, [[state]], [only], total).select(*names)
    return filled_from(out, columns, [], [], total).select(*names) if (columns := by("other")) else out


def fit_standard(df: DataFrame, columns: list[str]) -> Fitted:
    """Mean and population deviation of each column; a column without any, or without values, has deviation 1 and mean 0."""
    s = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
    rows = [(c, float(s[f"m_{c}"] or 0.0), float(s[f"s_{c}"] or 1.0)) for c in columns]
    return Fitted("standard", {"columns": columns}, {"columns": df.sparkSession.createDataFrame(rows, "column string, mean double, deviation double")})


def _by_column(fit: Fitted) -> dict:
    return {r["column"]: r for r in fit.tables["columns"].collect()}


def _standardize(fit: Fitted, df: DataFrame) -> DataFrame:
    known = _by_column(fit)
    return df.withColumns({c: (F.col(c) - known[c]["mean"]) / known[c]["deviation"] for c in fit.settings["columns"]})


def fit_ranges(df: DataFrame, columns: list[str]) -> Fitted:
    """Least and largest value of each column, which become 0 and 1."""
    s = df.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "l"), (F.max, "h")))).first()
    rows = [(c, s[f"l_{c}"], s[f"h_{c}"]) for c in columns]
    return Fitted("ranges", {"columns": columns}, {"columns": df.sparkSession.createDataFrame(rows, "column string, least double, largest double")})


def _scale(fit: Fitted, df: DataFrame) -> DataFrame:
    """Values beyond the fitted range go beyond 0 and 1; a column of one value becomes one half, one without values null."""
    known = _by_column(fit)

    def scaled(c: str) -> Column:
        low, high = known[c]["least"], known[c]["largest"]
        if low is None:
            return F.lit(None).cast("double")
        return (F.col(c) - low) / (high - low) if high > low else F.when(F.col(c).isNotNull(), 0.5 + F.col(c) - low)

    return df.withColumns({c: scaled(c) for c in fit.settings["columns"]})


def fit_components(df: DataFrame, columns: list[str], k: int | None = None, least: float | None = None) -> Fitted:
    """The first k components, or as many as reach the share ``least`` of the variance; means, loadings and variances."""
    _, variance, loadings = M.components(df, columns, k or len(columns))
    kept = k if least is None else M.pick_components(variance, least)
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    rows = [(c, float(means[c])) for c in columns]
    small = lambda t: df.sparkSession.createDataFrame([tuple(r) for r in t.filter(F.col("component") <= kept).collect()], t.schema)
    return Fitted("components", {"columns": columns, "components": kept}, {"columns": df.sparkSession.createDataFrame(rows, "column string, mean double"), "variance": small(variance), "loadings": small(loadings)})


def _project(fit: Fitted, df: DataFrame) -> DataFrame:
    """Adds PC1, PC2 and so on; a row with a null among the columns gets nulls."""
    means = {c: r["mean"] for c, r in _by_column(fit).items()}
    weights: dict[int, dict[str, float]] = {}
    for r in fit.tables["loadings"].collect():
        weights.setdefault(r["component"], {})[r["feature"]] = r["loading"]
    columns = fit.settings["columns"]
    row = F.array(*(F.col(c).cast("double") - means[c] for c in columns))
    dot = lambda w: F.aggregate(F.zip_with(F.col("_row"), F.array(*(F.lit(w[c]) for c in columns)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("_row", row).withColumns({f"PC{k}": dot(w) for k, w in sorted(weights.items())}).drop("_row")


def fit_map(df: DataFrame, columns: list[str], width: int, height: int, epochs: int = 10) -> Fitted:
    """A self-organising map: its nodes with their weights."""
    som = M.SelfOrganisingMap(width, height, columns, epochs=epochs).fit(df)
    rows = [(i, *map(float, w)) for i, w in enumerate(som.weights)]
    nodes = df.sparkSession.createDataFrame(rows, ", ".join(["node long", *(f"`{c}` double" for c in columns)]))
    return Fitted("map", {"columns": columns, "width": width, "height": height, "errors": som.errors}, {"nodes": nodes})


def as_map(fit: Fitted) -> M.SelfOrganisingMap:
    columns = fit.settings["columns"]
    som = M.SelfOrganisingMap(fit.settings["width"], fit.settings["height"], columns)
    som.weights = np.array([[r[c] for c in columns] for r in fit.tables["nodes"].orderBy("node").collect()])
    som.errors = list(fit.settings["errors"])
    return som


APPLY = {"imputer": _impute, "standard": _standardize, "ranges": _scale, "components": _project, "map": lambda fit, df: as_map(fit).assign(df)}


def apply_all(fits: list[Fitted], df: DataFrame) -> DataFrame:
    """Fits one after another, as they were fitted."""
    for fit in fits:
        df = fit.apply(df)
    return df
