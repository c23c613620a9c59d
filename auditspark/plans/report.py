"""Result tables, the report and its bundle. All figures come from tables."""

from __future__ import annotations

import html
import json
import platform
import time
import zipfile
from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from io import StringIO
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.config import CONFIG


def against_hypothesis(measured: DataFrame, supposed: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Each measured rung with its hypothesis, the difference, and whether the prediction held (empty where there is none)."""
    both = measured.join(F.broadcast(supposed), "rung", "left")  # one row a rung
    difference = F.col("measured") - F.col("hypothesised")
    held = F.when(difference.isNull(), "").when(F.abs(difference) <= tolerance, "yes").otherwise("NO")
    return both.select("rung", "hypothesised", "measured", difference.alias("difference"), held.alias("prediction_held"))


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def save_table(df: DataFrame, folder: str, name: str, caption: str = "") -> None:
    """A result table as CSV, and who made it."""
    df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    meta = {"table": name, "caption": caption, "columns": df.columns, "config": CONFIG.digest(), "written": time.time()}
    write_text(df.sparkSession, f"{folder}/{name}.meta.json", json.dumps(meta).encode())


def load_table(spark: SparkSession, name: str, *folders: str) -> DataFrame | None:
    """The table from the first folder that has it."""
    for folder in folders:
        if exists(spark, f"{folder}/{name}"):
            return spark.read.csv(f"{folder}/{name}", header=True, inferSchema=True)
    return None


def environment(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism), "config": CONFIG.digest()}


class Clock:
    """Wall times of named steps."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, seconds double")


def _section(title: str, table: pd.DataFrame | None, most: int) -> str:
    if table is None:
        return f"<section class='notrun'><h2>{html.escape(title)}</h2><p>NOT RUN: there is no result table.</p></section>"
    note = f"<p>First {most} of {len(table)} rows.</p>" if len(table) > most else ""
    return f"<section><h2>{html.escape(title)}</h2>{table.head(most).to_html(index=False, border=0)}{note}</section>"


def key_figures(tables: Mapping[str, pd.DataFrame | None]) -> dict[str, float]:
    """The report's headline numbers, each from a table; those whose table is missing are left out."""
    out: dict[str, float] = {}

    def mean(name: str, by: str, value: str = "auprc") -> pd.Series:
        t = tables.get(name)
        if t is None or not {by, value} <= set(t.columns):
            return pd.Series(dtype=float)
        return t.groupby(by)[value].mean().dropna()

    rungs = mean("T1", "rung")
    if len(rungs):
        first, last = rungs.sort_index().iloc[0], rungs.sort_index().iloc[-1]
        out |= {"auprc_all_leaks_open": first, "auprc_all_closed": last, "auprc_drop": first - last}
        if first:
            out["share_of_performance_lost"] = (first - last) / first
    models = mean("T3", "model")
    if len(models):
        out["best_auprc_closed"] = models.max()
    full = mean("T4", "ablation")
    if "full" in full.index and len(full) > 1:
        out["largest_ablation_cost"] = full["full"] - full.drop("full").min()
    for name, column, key in (("T1b_attribution", "leakage_share_of_drop", "leakage_share_of_drop"), ("T6", "worst_drop", "worst_monotone_drop"), ("F3", "js", "largest_drift")):
        t = tables.get(name)
        if t is not None and column in t.columns and t[column].notna().any():
            out[key] = t[column].max()
    return {k: float(v) for k, v in out.items()}


def build(tables: Mapping[str, DataFrame | None], title: str = "Leakage audit", most: int = 50) -> tuple[str, dict]:
    """(HTML, summary) of small result tables with their key figures and pictures; a missing table is a box that says so."""
    from auditspark.plans import figures

    small = {k: None if t is None else t.limit(most + 1).toPandas() for k, t in tables.items()}
    keys = key_figures(small)
    summary = {"config": CONFIG.digest(), "key_figures": keys, "tables": {k: None if t is None else json.loads(t.head(most).to_json(orient="records")) for k, t in small.items()}}
    out = StringIO()
    out.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>")
    if keys:
        out.write("<section><h2>Key figures</h2><ul>" + "".join(f"<li>{html.escape(k)}: {v:.4f}</li>" for k, v in keys.items()) + "</ul></section>")
    for k, t in small.items():
        out.write(_section(k, t, most))
    for f in figures.FIGURES:
        if (t := small.get(f.table)) is not None and (picture := figures.svg(f, t)):
            out.write(f"<figure>{picture}</figure>")
    out.write("</body></html>")
    return out.getvalue(), summary


def bundle(path: str, files: Iterable[tuple[str, bytes]], docs: str | None = None) -> list[str]:
    """A ZIP of small files, of the text files of the folder ``docs`` under their names, and of the manifest."""
    names = []
    if docs:
        files = [*files, *((f"docs/{p.name}", p.read_bytes()) for p in sorted(Path(docs).glob("*.md")))]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
            names.append(name)
        z.writestr("MANIFEST.txt", "\n".join(names) + "\n")
    return names
