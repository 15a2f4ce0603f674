"""Taggers: from a text to scored character spans, by name. Models plug in as functions on batches of texts."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,score:double>>"


class Tagger(Protocol):
    """A column of texts to a column of spans (start, end exclusive, score), ordered by start; null for null."""

    def __call__(self, text: Column) -> Column: ...


TAGGERS: dict[str, Tagger] = {}


def register(name: str, tagger: Tagger) -> Tagger:
    if name in TAGGERS:
        raise ValueError(f"{name} is taken")
    TAGGERS[name] = tagger
    return tagger


def listed_words(words: list[str]) -> Tagger:
    """Each line as a span, its score the share of its words (between blanks) that are listed. Stays in the JVM."""

    def tag(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(a, line):
            w = F.split(F.lower(line), " ")
            score = F.size(F.filter(w, lambda x: x.isin(*words))) / F.size(w)
            span = F.struct(a["at"].alias("start"), (a["at"] + F.length(line)).alias("end"), score.alias("score"))
            return F.struct((a["at"] + F.length(line) + 1).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

        return F.when(text.isNotNull(), F.aggregate(F.split(text, "\n"), start, step)["spans"])

    return tag


def of_model(predict) -> Tagger:
    """A tagger of a function from a list of texts to a list of lists of (start, end, score), in Arrow batches."""

    def tag(text: Column) -> Column:
        @F.pandas_udf(SPANS)
        def run(t: pd.Series) -> pd.Series:
            some = t.notna().to_numpy()
            found = iter(predict(t[some].tolist()))
            return pd.Series([[{"start": a, "end": b, "score": float(s)} for a, b, s in next(found)] if ok else None for ok in some])

        return run(text)

    return tag


def tagged(df: DataFrame, text: str, taggers: list[str]) -> DataFrame:
    """df with a column of spans for each named tagger."""
    return df.withColumns({n: TAGGERS[n](F.col(text)) for n in taggers})


register("second_person", listed_words(["you", "your", "yours", "u"]))
