import random

import pytest

from graphloom.llm import language

LINES = {
    "en": ["The loader reads the list of all neighbours again.", "Each task keeps the edges of the hub because the buffer was full.", "Nobody has updated the page about this change.", "We found many matches on the small graph, but only a few on the large one."],
    "de": ["Der Lader liest die Liste aller Nachbarn noch einmal.", "Jede Aufgabe behält die Kanten, weil der Puffer voll war.", "Niemand hat die Seite über diese Änderung angepasst.", "Wir fanden im kleinen Graphen viele Treffer, im großen aber nur wenige."],
    "ru": ["Загрузчик снова читает список всех соседей.", "Каждая задача сохраняет рёбра, потому что буфер был полон.", "Никто не обновил страницу об этом изменении.", "Мы нашли много совпадений на малом графе, а на большом мало."],
    "zh": ["加载程序会重新读取邻居列表。", "每个任务会保留中心顶点的边。", "没有人更新介绍这个修改的页面。", "我们在小图上找到了很多匹配。"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    labelled = []
    for i in range(400):
        lang = rng.choice(sorted(LINES))
        text = " ".join(rng.choice(LINES[lang]) for _ in range(3))
        labelled.append((text + f" {i}", lang if rng.random() > 0.15 else rng.choice(sorted(LINES))))
    return language.fit(labelled)


@pytest.mark.parametrize("lang", sorted(LINES))
def test_one_language(model, lang):
    found = language.identify(model, " ".join(LINES[lang]))
    assert (found.lang, found.sentences, len(found.stretches)) == (lang, 4, 1)
    assert found.confidence > 0.9


def test_stretches_within_a_line_and_over_wrapped_lines(model):
    text = f"1. {LINES['en'][0]} {LINES['en'][1]} {LINES['de'][0]}\n{LINES['zh'][0]}{LINES['zh'][1]}\n\n- {LINES['de'][1]}".replace("because the", "because\nthe")
    assert [(s[0], s[2]) for s in language.identify(model, text).stretches] == [("en", 2), ("de", 1), ("zh", 2), ("de", 1)]
    assert language.identify(model, text).lang == "en"  # of three languages with two sentences each the one with most words


def test_a_foreign_word_changes_nothing(model):
    text = "Each task keeps the edges of the hub because the Nachbarn buffer (граф) was full."
    assert [s[0] for s in language.identify(model, text).stretches] == ["en"]


@pytest.mark.parametrize("text", [None, "", " \t\n", "　", "t 1 2\ne 3 4", "0xf9b54a4b  a7a181243889dc4b", "for (ui k = 0; k < n_; ++k) x[k] += y[k];", "���  c8 c8 c8", "12345 " * 50, "γ γ ≥ γ", "!?…"])
def test_no_sentence(model, text):
    assert language.identify(model, text).lang is None


def test_code_between_sentences(model):
    text = f"{LINES['en'][0]}\n\n#define KAFO (1u << 3)\nt 77 88\n\n{LINES['en'][1]}"
    assert [(s[0], s[2]) for s in language.identify(model, text).stretches] == [("en", 2)]


def test_misread_bytes_case_and_spacing(model):
    assert language.repaired("drücken Jede Änderung".encode().decode("latin-1")) == "drücken Jede Änderung"
    assert language.repaired("Мы нашли".encode().decode("latin-1")) == "Мы нашли"
    assert language.repaired("déjà vu à côté") == "déjà vu à côté"
    for change in (str.upper, str.lower, lambda t: t.replace(" ", "   "), lambda t: t.encode().decode("latin-1")):
        assert language.identify(model, change(LINES["de"][1])).lang == "de"


def test_unseen_words_by_their_letters(model):
    assert model.backed_off("nachbarschaft")[0].argmax() == model.languages.index("de")
    assert model.backed_off("соседний")[0].argmax() == model.languages.index("ru")


def test_very_long_text(model):
    assert language.identify(model, " ".join(LINES["en"]) * 3000).lang == "en"
    language.identify(model, "x" * 500_000)
    language.identify(model, "Ã" * 200_000)


def test_table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(LINES))
        rows.append((i, " ".join(rng.sample(LINES[lang], 3)), rng.choice([lang, f" {lang.upper()} ", lang]), 0.5, "k"))
    rows += [(1000, LINES["en"][0], "de", 0.1, "k"), (1001, LINES["de"][0], None, 0.1, "k"), (1002, None, "de", 0.1, "k"), (1003, "", "", 0.1, "k"), (1004, LINES["de"][0] + " " + LINES["ru"][0] + " " + LINES["de"][1], " De", 0.1, "k"), (1001, LINES["de"][0], None, 0.1, "k"), (None, LINES["zh"][0], "??", 0.1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double, label_lang string")
    codes = spark.createDataFrame([(x, x) for x in LINES] + [(None, "en"), ("xx", None)], "code string, lang string")
    got = sorted(map(tuple, language.found_languages(docs, codes).collect()), key=repr)
    assert got == sorted([(1000, 0, "en"), (1001, 0, "de"), (1001, 0, "de"), (1004, 1, "de"), (1004, 2, "ru"), (1004, 3, "de"), (None, 0, "zh")], key=repr)
    every = language.languages(docs, codes)
    assert every.where("seg_no = 0").count() == len(rows)
    assert language.found_languages(docs.where("false"), codes).count() == 0
    assert language.found_languages(docs, codes.where("false")).count() == 0
