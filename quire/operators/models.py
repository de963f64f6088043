"""Places for models that this engine does not have: embedders, rerankers, extractors.  A caller gives the function; it runs on
Arrow batches, and a failing batch is tried again before its rows get an error instead of a value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], size: int, batch: int = 16, tries: int = 3) -> DataFrame:
    """``rows`` with ``vector`` (null on failure) and ``error``."""
    kind = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        vectors, errors = [], []
        for at in range(0, len(texts), batch):
            part = [t or "" for t in texts.iloc[at : at + batch]]
            for attempt in range(tries):
                try:
                    out = model(part)
                    if len(out) != len(part) or any(len(v) != size for v in out):
                        raise ValueError("the model's answer has another shape")
                    vectors += [list(map(float, v)) for v in out]
                    errors += [None] * len(part)
                    break
                except Exception as e:  # noqa: BLE001  whatever a model raises becomes a value of its rows
                    if attempt == tries - 1:
                        vectors += [None] * len(part)
                        errors += [f"{type(e).__name__}: {e}"] * len(part)
        return pd.DataFrame({"vector": vectors, "error": errors})

    return rows.withColumn("__e", run(F.col(text))).select(*rows.columns, "__e.vector", "__e.error")


def rerank(candidates: DataFrame, query: str, text: str, id: str, scorer: Callable[[list[tuple[str, str]]], list[float]], chars: int = 1000, k: int | None = None) -> DataFrame:
    """Candidates by the score of (query, first characters of the text), best first."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(scorer([(query, (t or "")[:chars]) for t in part]), dtype="float64")

    out = candidates.withColumn("score_rerank", score(F.col(text))).orderBy(F.desc("score_rerank"), id)
    return out.limit(k) if k else out


def extract(acts: DataFrame, text: str, model: Callable[[str], str], schema: str) -> DataFrame:
    """``acts`` with ``raw`` (what the model said) and ``record`` (read with the schema after repair; null if it is no JSON)."""
    from quire.functions.similarity import repair_json

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else model(t))

    out = acts.withColumn("raw", run(F.col(text)))
    return out.withColumn("record", F.from_json(repair_json(F.col("raw")), schema))


def call_tiered(rows: DataFrame, prompt: str, tiers: list[tuple[str, Callable[[str], str], float, float]], dry_run: bool = False) -> DataFrame:
    """``rows`` and tier, answer, errors, tokens_in, tokens_out, cost: the first tier that answers, in order; what failed before
    it is kept.  ``tiers`` are (name, model, price in, price out) by the million tokens.  A dry run calls nobody and prices the
    first tier's question."""
    from quire.operators.ledger import cost

    @F.pandas_udf("struct<tier:string,answer:string,errors:array<string>>")
    def call(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            errors, got = [], (None, None)
            for name, model, *_ in [] if dry_run or text is None else tiers:
                try:
                    got = name, model(text)
                    break
                except Exception as e:  # noqa: BLE001  whatever a model raises is that tier's failure
                    errors.append(f"{name}: {e}")
            out.append((*got, errors))
        return pd.DataFrame(out, columns=["tier", "answer", "errors"])

    called = rows.withColumn("__c", call(prompt)).select(*rows.columns, "__c.*")
    if dry_run:
        called = called.withColumn("tier", F.lit(tiers[0][0]))
    called = called.withColumns({"tokens_in": tx.token_estimate(F.coalesce(prompt, F.lit(""))), "tokens_out": tx.token_estimate(F.coalesce("answer", F.lit("")))})
    price = F.lit(0.0)
    for name, _, a, b in tiers:
        price = F.when(F.col("tier") == name, cost(F.col("tokens_in"), F.col("tokens_out"), a, b)).otherwise(price)
    return called.withColumn("cost", price)
