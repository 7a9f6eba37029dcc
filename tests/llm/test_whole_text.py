"""Garbled words that look ordinary."""

import pytest

from bindery.llm import mojibake

WORDS = {"“The": 2000, "gauge”": 900, "—": 4000, "más": 600, "máquina": 700, "…": 1500, "à": 300, "À": 300, "señal": 500, "forêt": 500, "Mädchen": 400, "français": 400}


@pytest.fixture(scope="module")
def model():
    # a few of the garbled forms are so frequent that they are counted as words
    return mojibake.Model(WORDS | {"ìThe": 5, "mßs": 3, "ó": 6}).cleaned()


@pytest.mark.parametrize("garbled, text", [("ìThe weather log and the gaugeî ó Portraflunsu.", "“The weather log and the gauge” — Portraflunsu."), ("no mßs", "no más"), ("la mßquina", "la máquina"), ("das Mõdchen", "das Mädchen"), ("le franþais", "le français")])
def test_garbled_words_that_look_ordinary(model, garbled, text):
    assert model.restore(garbled) == text


def test_ordinary_words_stay(model):
    for text in ["à la forêt", "À Naitädraipis", "Bisdobavú und Draizunmilaö", "(Suáegormor)", "Кругом лес", "nеw а"]:
        assert model.restore(text) is None
