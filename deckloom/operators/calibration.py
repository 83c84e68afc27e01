"""Fitting the weights of the fitness model to ratings by a repeatable random search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.functions import score as S

#: The parameters with the range that is searched: exponents (made to sum to one), weights of the load's terms, its threshold.
RANGES = {"alpha": (0.1, 0.6), "beta": (0.1, 0.7), "gamma": (0.05, 0.4), "w_element": (0.4, 2.0), "w_text": (0.4, 2.2), "w_visual": (0.2, 1.6), "w_split": (0.6, 2.4), "theta": (1.0, 3.5)}
PRIOR = (S.ALPHA, S.BETA, S.GAMMA, S.W_ELEMENT, S.W_TEXT, S.W_VISUAL, S.W_SPLIT, S.THETA)
FEATURES = ("e", "element", "text", "visual", "split", "c", "y")
#: Slides and candidates that are multiplied at once: some MB of numbers.
SLIDES_AT_ONCE, CANDIDATES_AT_ONCE = 512, 1024


def candidates(n: int, seed: int = 0) -> np.ndarray:
    """(n + 1, 8) parameter sets: the prior, then ``n`` from a seeded generator; the same for the same seed."""
    low, high = np.array(list(RANGES.values())).T
    drawn = low + (high - low) * np.random.Generator(np.random.PCG64(seed)).random((n, len(RANGES)))
    found = np.vstack((PRIOR, drawn))
    found[:, :3] /= found[:, :3].sum(axis=1, keepdims=True)
    return found


def predicted(rows: np.ndarray, params: np.ndarray) -> np.ndarray:
    """(slides, candidates): the fitness that each candidate gives each slide (columns of ``FEATURES``)."""
    z = rows[:, 1:5] @ params[:, 3:7].T - params[:, 7]
    left = 1.0 - 1.0 / (1.0 + np.exp(-z))
    logs = np.log(np.maximum(rows[:, :1], 1e-6)) * params[:, 0] + np.log(np.maximum(left, 1e-6)) * params[:, 1] + np.log(np.maximum(rows[:, 5:6], 1e-6)) * params[:, 2]
    return np.exp(logs)


def calibrated(rated: DataFrame, n: int = 4000, seed: int = 0) -> DataFrame:
    """One row: candidate, rmse, prior_rmse, slides and the parameters of the candidate (0: the prior) with the least root mean square error on the rated slides (``FEATURES``), the first on a tie.

    The candidates, 64 bytes each, go to all tasks; each sums every candidate's squared errors over the slides it has, in blocks, and those sums, a row a task and candidate, meet. So the ratings never
    move and nothing is paired. No row if there are no ratings; slides with a null are left out.
    """
    spark = rated.sparkSession
    params = spark.sparkContext.broadcast(candidates(n, seed))
    names = ["candidate", "error", "slides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(params.value)), 0
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]).astype(float)
            for at in range(0, len(rows), SLIDES_AT_ONCE):
                part = rows[at : at + SLIDES_AT_ONCE]
                for k in range(0, len(total), CANDIDATES_AT_ONCE):
                    total[k : k + CANDIDATES_AT_ONCE] += ((predicted(part, params.value[k : k + CANDIDATES_AT_ONCE]) - part[:, 6:]) ** 2).sum(axis=0)
            seen += len(rows)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), seen))], names=names)

    errors = rated.select(*FEATURES).dropna().mapInArrow(run, "candidate long, error double, slides long").groupBy("candidate").agg(F.sum("error").alias("error"), F.sum("slides").alias("slides"))
    rmse = F.sqrt(F.col("error") / F.col("slides"))
    best = errors.agg(F.min_by("candidate", F.struct(rmse, "candidate")).alias("candidate"), F.min(rmse).alias("rmse"), F.max(F.when(F.col("candidate") == 0, rmse)).alias("prior_rmse"), F.max("slides").alias("slides")).where("candidate IS NOT NULL")
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(candidates(n, seed))], "_candidate long, " + ", ".join(f"{p} double" for p in RANGES))
    # one row beside one row a candidate
    return table.join(F.broadcast(best), F.col("_candidate") == F.col("candidate")).select("candidate", "rmse", "prior_rmse", "slides", *RANGES)


def rated_slides(slides: DataFrame, ratings: DataFrame) -> DataFrame:
    """``FEATURES`` of the slides (doc_id, slide_no, title, bullets) of rated documents (doc_id, y), y scaled to 0..1 by the least and largest rating. Concepts that earlier slides of the deck had are no news."""
    from deckloom.operators.scoring import fitness_parts

    span = ratings.agg(F.min("y").alias("low"), F.max("y").alias("high"))
    scaled = ratings.join(F.broadcast(span)).select("doc_id", F.coalesce(F.try_divide(F.col("y") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)).alias("y"))
    return fitness_parts(slides).join(scaled, "doc_id").select("doc_id", "slide_no", *FEATURES)
