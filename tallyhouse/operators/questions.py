"""Tagging typed questions with what they ask for, by keyword."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keywords, matched anywhere in the lower-case text, first rule first.
HELP = ["ajuda", "help", "exemplos"]
TRIPS = ["viagem"]
REVENUE = ["€", "euro", "dinheiro", "ganho", "receita"]
KM = ["km", "quil", "kil"]
WORST = ["pior", "piores", "menor"]
RANK = ["melhor dia", "pior dia", "top", "melhores", "maiores", "pior", "piores", "menor"]
COMPARE = ["compar", "mês anterior", "mes anterior"]


def tag_questions(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``intent``, ``metric``, ``n`` and ``ascending`` to a table of messages.

    ``n`` and ``ascending`` are set for rankings only, and a ranking that names no
    metric is about trips. The whole text is searched, in one projection.
    """
    p = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    month = _any(p, ["mês", "mes"])
    intent = (
        F.when(_any(p, HELP), "help")
        .when(_any(p, RANK), "rank")
        .when(_any(p, ["total"]) & _any(p, ["ano"]), "year_total")
        .when(_any(p, ["média"]) & _any(p, ["ano", "por dia"]), "daily_avg")
        .when(_any(p, ["resumo"]) & month, "month_summary")
        .when(_any(p, COMPARE), "compare")
        .otherwise("unknown")
    )
    metric = (
        F.when(_any(p, TRIPS), "trips").when(_any(p, REVENUE), "revenue").when(_any(p, KM), "km")
    )
    tagged = messages.withColumn("intent", intent).withColumn("metric", metric)
    is_rank = F.col("intent") == "rank"
    return tagged.withColumns(
        {
            "metric": F.when(is_rank, F.coalesce("metric", F.lit("trips"))).otherwise(
                F.col("metric")
            ),
            "n": F.when(is_rank, F.when(p.contains("5"), 5).otherwise(1)),
            "ascending": F.when(is_rank, _any(p, WORST)),
        }
    )


def _any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(word) for word in words])
