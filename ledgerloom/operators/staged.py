"""Enrichment in stages that can stop and go on: answers are kept in a table a stage, and only rows without one are asked.

A run asks each open row once. A request that fails is halved until the rows that make it fail are alone; these, and rows that
an answer leaves out, count as tried and are asked again by later runs, up to a bound, after which defaults stand in.
Answers are appended when a run ends, so a run that dies leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.enrich import BATCH, halves

ATTEMPTS = 3


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Stages:
    """The stage tables below a path in a shared store, of rows told apart by keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _table(self, stage: str) -> DataFrame | None:
        where = f"{self.path}/{stage}"
        return self.spark.read.parquet(where) if exists(self.spark, where) else None

    def answered(self, stage: str) -> DataFrame | None:
        """Keys and answers of a stage so far; None before its first run."""
        made = self._table(stage)
        return made.filter("_ok").drop("_ok", "_error") if made is not None else None

    def open_rows(self, df: DataFrame, stage: str, where: Column | None = None, attempts: int = ATTEMPTS) -> DataFrame:
        """Rows of df that a stage would ask now, with _attempt, the number of the attempt: those for which where holds, that have
        no answer and were tried fewer than attempts times."""
        rows = df.filter(F.coalesce(where, F.lit(False))) if where is not None else df
        made = self._table(stage)
        if made is None:
            return rows.withColumn("_attempt", F.lit(1))
        tried = made.groupBy(*(F.col(k).alias(f"_k_{k}") for k in self.keys)).agg(F.bool_or("_ok").alias("_done"), F.count(F.lit(1)).alias("_tries"))
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        met = rows.join(tried, on, "left").filter(~F.coalesce("_done", F.lit(False)) & (F.coalesce("_tries", F.lit(0)) < attempts))
        return met.withColumn("_attempt", (F.coalesce("_tries", F.lit(0)) + 1).cast("int")).select(*rows.columns, "_attempt")

    def run(self, df: DataFrame, stage: str, text_col: str, provider: Callable[[pd.DataFrame], pd.DataFrame], answers: str, where: Column | None = None, attempts: int = ATTEMPTS, batch: int = BATCH) -> int:
        """Ask a provider once for every open row; how many rows are still open then.

        The provider gets frames of keys, text and _attempt, and gives frames of keys and answers (DDL answers); a row that it leaves
        out or that it fails on stays open."""
        keys, names = self.keys, [a.split()[0] for a in answers.split(", ")]
        asked = self.open_rows(df, stage, where, attempts).select(*keys, F.col(text_col).alias("text"), "_attempt")
        kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame.reset_index(drop=True)
                request, said, errors = np.full(len(frame), -1), [], np.full(len(frame), "no answer", object)

                def ask(part: pd.DataFrame, request=request, said=said, errors=errors) -> None:
                    try:
                        answer = provider(part.reset_index(drop=True))
                    except Exception as error:
                        if len(part) > 1:
                            middle = len(part) // 2
                            ask(part.iloc[:middle])
                            ask(part.iloc[middle:])
                        else:
                            errors[part.index[0]] = str(error)[:500]
                        return
                    request[part.index.to_numpy()] = len(said)
                    said.append(answer[[*keys, *names]].assign(_request=len(said)))

                for a in range(0, len(frame), batch):
                    for part in halves(frame.iloc[a : a + batch], "text"):
                        ask(part)
                # One merge a frame: that of each request would cost more than many a request does.
                met = [x for x in said if len(x)]
                if met:
                    every = pd.concat(met).drop_duplicates([*keys, "_request"]).assign(_ok=True)
                    out = frame[keys].assign(_request=request).merge(every, on=[*keys, "_request"], how="left")
                    out["_ok"] = out["_ok"].eq(True)
                else:
                    out = frame[keys].assign(**dict.fromkeys(names), _ok=False)
                out["_error"] = pd.Series(errors, dtype=object).where(~out["_ok"], None)
                yield out[[*keys, *names, "_ok", "_error"]]

        asked.mapInPandas(each, f"{kinds}, {answers}, _ok boolean, _error string").write.mode("append").parquet(f"{self.path}/{stage}")
        return self.open_rows(df, stage, where, attempts).count()

    def complete(self, df: DataFrame, stage: str, text_col: str, provider: Callable[[pd.DataFrame], pd.DataFrame], answers: str, where: Column | None = None, attempts: int = ATTEMPTS, batch: int = BATCH) -> int:
        """Runs until no row is open, at most attempts of them; the number of runs. Nothing is asked where all is answered."""
        if not self.open_rows(df, stage, where, attempts).take(1):
            return 0
        for n in range(1, attempts + 1):
            if not self.run(df, stage, text_col, provider, answers, where, attempts, batch):
                return n
        return attempts

    def result(self, df: DataFrame, stage: str, defaults: dict[str, object] | None = None) -> DataFrame:
        """df with the answers of a stage in columns of theirs, over columns of the same names, and defaults where there is none."""
        made, defaults = self.answered(stage), defaults or {}
        if made is None:
            return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d) for c, d in defaults.items()})
        names = [c for c in made.columns if c not in self.keys]
        side = made.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), *(F.col(c).alias(f"_a_{c}") for c in names))
        rows = df.join(side, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys], "left")
        have = lambda c: [F.col(c)] if c in df.columns else []
        rows = rows.withColumns({c: F.coalesce(F.col(f"_a_{c}"), *have(c), F.lit(defaults.get(c))) for c in names})
        return rows.drop(*(f"_k_{k}" for k in self.keys), *(f"_a_{c}" for c in names))
