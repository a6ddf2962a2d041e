import pytest

from tallyhouse.operators.questions import tag_questions


@pytest.mark.parametrize(
    "text, intent, metric, n, ascending",
    [
        ("ajuda", "help", None, None, None),
        ("HELP me with top 5", "help", None, None, None),
        ("melhor dia do ano em viagens", "rank", "trips", 1, False),
        ("pior dia do ano em € ganho", "rank", "revenue", 1, True),
        ("  TOP 5 dias por km\n", "rank", "km", 5, False),
        ("os 15 maiores em receita", "rank", "revenue", 5, False),
        ("menor viagem em euro", "rank", "trips", 1, True),
        ("piores dias por quilómetro", "rank", "km", 1, True),
        ("total do ano", "year_total", None, None, None),
        ("total de dinheiro no ano", "year_total", "revenue", None, None),
        ("média por dia", "daily_avg", None, None, None),
        ("Média do ano em km", "daily_avg", "km", None, None),
        ("media por dia", "unknown", None, None, None),
        ("resumo do mês", "month_summary", None, None, None),
        ("resumo deste mes", "month_summary", None, None, None),
        ("comparar com o mês anterior", "compare", None, None, None),
        ("e no mes anterior?", "compare", None, None, None),
        ("olá", "unknown", None, None, None),
        ("", "unknown", None, None, None),
        (None, "unknown", None, None, None),
    ],
)
def test_tags(rows, text, intent, metric, n, ascending):
    r = tag_questions(rows("text string", (text,))).head()
    assert (r.intent, r.metric, r.n, r.ascending) == (intent, metric, n, ascending)
