import random

import pytest

from quarrylens.llm.languages import Classifier, document_languages, identify, label_cases, sentences, train

PARTS = {
    "en": (["The parser", "Our indexer", "The search service", "Every worker"], ["fails with a timeout in", "reads the whole of", "no longer touches", "returns the wrong caller for"],
           ["because nobody checked the limits", "after the last release", "while the session is still open", "as described in the ticket"]),
    "de": (["Der Zerleger", "Unser Indexer", "Der Suchdienst", "Jeder Prozess"], ["bricht mit Zeitüberschreitung ab in", "liest vollständig ein", "fasst nicht mehr an", "liefert den falschen Aufrufer für"],
           ["weil niemand die Grenzen geprüft hat", "seit der letzten Veröffentlichung", "während die Sitzung noch offen ist", "wie im Ticket beschrieben"]),
    "es": (["El analizador", "Nuestro indexador", "El servicio de búsqueda", "Cada proceso"], ["falla por tiempo agotado en", "lee por completo", "ya no toca", "devuelve el llamador equivocado para"],
           ["porque nadie comprobó los límites", "desde la última versión", "mientras la sesión sigue abierta", "como se describe en el ticket"]),
    "ru": (["Разборщик", "Наш индексатор", "Служба поиска", "Каждый процесс"], ["завершается по времени в", "читает целиком", "больше не трогает", "возвращает неверного вызывающего для"],
           ["потому что никто не проверил пределы", "после последнего выпуска", "пока сеанс ещё открыт", "как описано в задаче"]),
    "ja": (["解析器は", "索引は", "検索サービスは", "各プロセスは"], ["時間切れで失敗します", "全体を読み込みます", "もう触りません", "誤った呼び出し元を返します"],
           ["誰も上限を確認しなかったので", "前回の公開以来", "セッションが開いている間", "チケットに書かれている通り"]),
}
NAMES = [("en", "en"), ("English", "en"), ("de", "de"), ("de-AT", "de"), ("es", "es"), ("ru", "ru"), ("ja", "ja")]
DOC = "doc_id long, text string, lang string, label_lang string, passages int"


def sentence(rng, lang):
    a, b, c = (rng.choice(x) for x in PARTS[lang])
    name = rng.choice(["loadSession()", "src/a/B.java", "`scan`", "fooBar"])
    return f"{a}{c}{name}{b}。" if lang == "ja" else f"{a} {b} {name}, {c}."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [(lang, " ".join(sentence(rng, lang) for _ in range(4))) for lang in PARTS for _ in range(60)]


def test_sentences_leave_out_code_and_titles():
    text = "# Big Title 2\n\nThe parser fails in `x y z`. It said \"alles kaputt hier\" twice!\n```\nlet code = here;\n```\n- First item of list\n- see src/a/B.ts and fooBar()\nwrapped line."
    bare = [s for _, _, s, _ in sentences(text)]
    assert bare == ["the parser fails in", "it said twice", "first item of list", "see and wrapped line"]
    text = "Eins zwei. Drei?"
    assert [text[a:b] for a, b, _, _ in sentences(text)] == ["Eins zwei.", "Drei?"]
    assert sentences("") == [] and sentences("\n\n# T\n") == []


def test_held_out_accuracy(corpus):
    rng = random.Random(9)
    model = Classifier(train(corpus))
    right = asked = 0
    for lang in PARTS:
        for _ in range(60):
            (_, _, bare, _), = sentences(sentence(rng, lang))
            got, _ = model.language(bare)
            asked += got is not None
            right += got == lang
    assert right / 300 >= 0.97 and right / asked >= 0.99
    assert model.language("ok")[0] is None


def test_noisy_labels_do_not_spoil_training(corpus):
    noisy = [(("es" if i % 9 == 0 else lang), text) for i, (lang, text) in enumerate(corpus)]
    model = Classifier(train(noisy))
    got = [model.language(sentences(t)[0][2])[0] == lang for lang, t in corpus]
    assert sum(got) / len(got) > 0.97


def test_passages_and_cases(spark, corpus):
    rng = random.Random(4)
    mixed = sentence(rng, "de") + " " + sentence(rng, "de") + "\n\n" + sentence(rng, "es")
    upper = sentence(rng, "de").upper()
    lost = sentence(rng, "es").replace("ú", "u").replace("í", "i").replace("ó", "o")
    rows = [(i, t, lang, "x", 1) for i, (lang, t) in enumerate(corpus)]
    extra = [(1001, mixed, "de-AT", None, None), (1002, sentence(rng, "ru"), None, None, None), (1003, sentence(rng, "ja"), "und", "x", 1), (1004, sentence(rng, "en"), "es", "x", 1),
             (1005, upper, " DE ", "x", 1), (1006, lost, "es", "x", 1), (1007, None, "en", "x", 1), (1008, "", "", "x", 1), (1009, "x = 1;", None, "x", 1),
             (1010, (sentence(rng, "de") + " ") * 3000, "English", "x", 1), (1002, sentence(rng, "ru"), None, None, None)]
    names = spark.createDataFrame(NAMES, "label string, lang string")
    found = identify(spark.createDataFrame(rows + extra, DOC), names)
    got = {(r["doc_id"], r["lang"]) for r in label_cases(found).collect()}
    assert got == {(1001, "de"), (1001, "es"), (1002, "ru"), (1003, "ja"), (1004, "en"), (1010, "de")}
    p = found.filter("doc_id = 1001").first()["passages"]
    assert [(x["lang"], x["n_sentences"]) for x in p] == [("de", 2), ("es", 1)] and mixed[p[1]["start_char"]:p[1]["end_char"]] == mixed.split("\n\n")[1]
    assert all(0 < x["confidence"] <= 1 for x in p) and document_languages(found).filter("doc_id = 1010").first()["n_sentences"] == 3000
    empty = identify(spark.createDataFrame([], DOC), names)
    assert label_cases(empty).count() == 0
    assert label_cases(identify(spark.createDataFrame(extra, DOC), names.limit(0))).count() == 0
