"""Scoring by an outside model as an injected function, row by row or all questions of a state at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_batches(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str, retries: int = 2) -> DataFrame:
    """Calls score on each Arrow batch; a batch that keeps failing gives its rows with the error in column `error`.

    schema: columns that score returns, among them the input's key columns; `error string` is added. score must return
    one row per input row in order.
    """
    names = T._parse_datatype_string(schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            problem = None
            for _ in range(retries + 1):
                try:
                    out = score(f)
                    if len(out) != len(f):
                        raise ValueError(f"{len(f)} rows in, {len(out)} out")
                    yield out[names].assign(error=None)
                    break
                except Exception as e:  # noqa: BLE001  the row carries it
                    problem = f"{type(e).__name__}: {e}"
            else:
                yield f.assign(**{n: None for n in names if n not in f})[names].assign(error=problem)

    return df.mapInPandas(run, schema + ", error string")


def score_states(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], state: str, qid: str, columns: list[str], answer: str = "answer string", retries: int = 2) -> DataFrame:
    """One request per state with all its questions: score gets rows (state, questions: a list of (qid, columns..)) and returns
    as many lists `answers` of (qid, answer) . Back come rows (state, qid, answer, error); a question that is not answered
    has the error "no answer", a failing request gives its error to all its questions. A state's questions are as few as one
    request holds; they are gathered per state."""
    name, kind = answer.split()
    requests = df.groupBy(state).agg(F.array_sort(F.collect_list(F.struct(qid, *columns))).alias("questions"))
    kinds = dict(df.dtypes)
    schema = f"{state} {kinds[state]}, questions array<struct<{qid}:{kinds[qid]},{','.join(f'{c}:{kinds[c]}' for c in columns)}>>, answers array<struct<{qid}:{kinds[qid]},{name}:{kind}>>"
    got = score_batches(requests, score, schema, retries)
    given = F.map_from_entries(F.coalesce("answers", F.array().cast(f"array<struct<{qid}:{kinds[qid]},{name}:{kind}>>")))
    each = got.select(state, "error", given.alias("_a"), F.explode(F.coalesce("questions", F.array().cast(dict(got.dtypes)["questions"]))).alias("_q"))
    found = F.try_element_at("_a", F.col("_q")[qid])
    return each.select(state, F.col("_q")[qid].alias(qid), found.alias(name), F.coalesce("error", F.when(found.isNull(), "no answer")).alias("error"))
