import random

import pytest

from quarryline.llm import quality

PROSE = "The change makes that cache safer because it copies one value only once. We have seen it fail when nobody asks the owner, so please check it before you merge."
KINDS = {
    "prose": [PROSE, PROSE.upper(), PROSE.replace(" ", "\n", 40), "Wenn der leere Puffer fehlt, muss man den alten Kanal von Hand setzen. Bitte nicht vergessen: der neue Zeiger ist noch nicht bereit.", "请注意，共享的函数和嵌套的语法树并不相同。如果嵌套的快照不存在，那么稀疏的锁就会泄漏。"],
    "other": [
        "\n".join(f"- drop the queue of part {i}" for i in range(20)),
        "a,b,c\n" * 30,
        "\n".join(f"key_{i} = {i * 7}" for i in range(20)),
        "\n".join(f"2025-01-02T03:04:{i:02d} INFO [x-{i}] done=1" for i in range(20)),
        "int main() {\n  return f(x) + 1;\n}\n" * 8,
        "Home\nLog in\nRead more\nNext\nPage 2\nTerms of use\nHome\n" * 3,
        (PROSE + "\n") * 12,
        "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 30,
    ],
    "empty": ["", " \n\t ", None],
}


def test_kinds(spark):
    rows = [(i, t, k, 0) for i, (k, t) in enumerate((k, t) for k, texts in KINDS.items() for t in texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, words int").withColumnRenamed("kind", "key")
    got = {r.doc_id: r.kind for r in quality.text_statistics(df).collect()}
    assert got == {i: k for i, _, k, _ in rows}
    assert {r.doc_id for r in quality.other_than_prose(df).collect()} == {i for i, _, k, _ in rows if k == "other"}


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunks_change_nothing(spark, chunk):
    pick = random.Random(chunk)
    texts = ["".join(pick.choice(["the ", "word", ".", "\n", " ", "ß", "a,", "\r\n", "  ", "x" * 50, "of"]) for _ in range(pick.randrange(60))) for _ in range(40)] + ["", None, "x" * 500, "\n" * 90, " y" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    columns = ("words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words")
    read = lambda c: {r.doc_id: tuple(r[x] for x in columns) for r in quality.text_statistics(df, chunk=c).collect()}
    whole = read(1 << 16)
    assert read(chunk) == whole
    for i, t in enumerate(texts):
        words = (t or "").split()
        lines = [x.rstrip() for x in (t or "").split("\n") if x.strip()]
        assert whole[i][0] == len(words)
        assert whole[i][1] == (sum(map(len, words)) / len(words) if words else None)
        assert whole[i][3] == (sum(x[-1] in quality.PUNCTUATION for x in lines) / len(lines) if lines else None)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(r.words for r in quality.text_statistics(df).collect()) == [1, 2, 3]
    assert sorted(r.words for r in quality.text_statistics(df, chunk=1).collect()) == [1, 2, 3]
    assert quality.text_statistics(spark.createDataFrame([], df.schema)).count() == 0


@pytest.mark.parametrize(("chunk", "part_lines"), [(7, 1), (100, 3), (1000, 40)])
def test_prose_of_cut_texts(spark, chunk, part_lines):
    """Repetition and neighbouring lines count across the cuts."""
    pick = random.Random(chunk)
    lines = [*PROSE.split(". "), PROSE, PROSE.upper(), "", "a, b", "- drop it", "So we", "is it\tyours? yes. no.", "x = 1;", "请注意，共享的函数和嵌套的语法树并不相同。"]
    texts = [pick.choice(["\n", "\r\n", "\r", "\u2028"]).join(pick.choice(lines) for _ in range(pick.randrange(1, 60))) for _ in range(30)]
    passage = " ".join(f"The part {i} of that plan is so old that we have lost it, and nobody has asked why." for i in range(20))
    texts += ["\n".join([passage] * 10), passage, PROSE + "\n", "\n" * 30]
    df = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "doc_id long, text string")
    read = lambda **kw: sorted((r.doc_id, r.words, r.prose_share or 0, r.kind) for r in quality.text_statistics(df, **kw).collect())
    assert read(chunk=chunk, part_lines=part_lines) == read()
    assert (len(texts) - 4) % 20 in {r.doc_id for r in quality.other_than_prose(df.limit(len(texts) - 3)).collect()}


FURTHER = {
    'fr': "Le gouvernement a annoncé hier que les travaux de la nouvelle ligne seraient terminés avant la fin de l'année. Les habitants du quartier, qui attendent depuis longtemps cette ouverture, ne cachent pas leur joie. Il reste toutefois plusieurs questions sur le prix des billets.",
    'es': 'La semana pasada los vecinos del barrio se reunieron en la plaza para hablar de los problemas del agua. Según el alcalde, las obras no van a terminar hasta el mes de octubre, pero muchos creen que es posible acabar antes si hay dinero.',
    'ru': 'Вчера вечером мы долго говорили о том, как лучше хранить данные. Сначала казалось, что достаточно одной таблицы, но потом стало ясно, что запросы будут слишком медленными. Поэтому решили добавить индекс.',
    'it': "Quando siamo arrivati alla stazione il treno era già partito, e non c'era nessuno che potesse dirci a che ora sarebbe passato il prossimo. Abbiamo aspettato sulla panchina fino a sera.",
    'pt': 'O projeto foi iniciado em março e ainda não está pronto, mas a equipe acredita que vai terminar antes do fim do ano. Os testes mostram que o sistema é mais rápido do que o anterior.',
    'nl': 'De vergadering is verplaatst naar morgen omdat de zaal vandaag niet vrij was. Wie er niet bij kan zijn, moet dat aan het secretariaat laten weten.',
    'pl': 'Wczoraj wieczorem długo rozmawialiśmy o tym, jak przechowywać dane. Najpierw wydawało się, że wystarczy jedna tabela, ale potem okazało się, że zapytania są zbyt wolne.',
    'tr': 'Dün akşam uzun süre verilerin nasıl saklanacağını konuştuk. Önce tek bir tablonun yeterli olacağını düşündük, fakat sonra sorguların çok yavaş olduğu anlaşıldı.',
    'ar': 'في الأسبوع الماضي اجتمع سكان الحي في الساحة للحديث عن مشاكل المياه. وقال رئيس البلدية إن الأعمال لن تنتهي قبل شهر أكتوبر، لكن كثيرين يعتقدون أن ذلك ممكن.',
    'ko': '어제 저녁에 우리는 데이터를 어떻게 저장할지 오랫동안 이야기했다. 처음에는 표 하나로 충분해 보였지만, 나중에 질의가 너무 느리다는 것이 분명해졌다.',
    'EN': 'THE MEETING WAS MOVED TO TOMORROW BECAUSE THE ROOM WAS NOT FREE. IF YOU CANNOT COME, PLEASE LET US KNOW BEFORE NOON SO THAT WE CAN PLAN.',
}
#: Words without order, lists of words, and code.
NO_SENTENCES = [
    "ligne de avant les la travaux qui hier du gouvernement que le des la un une terminés ne annoncé les le la prix pas sur billets de il reste",
    "rouge vert bleu table chaise porte maison arbre chat chien route mer lac",
    "яблоко\nгруша\nслива\nвишня\nдом\nстол",
    "clé = café\nétat = été\nnuméro = 3\nrésumé = présent\n",
    "| état | numéro | été |\n| café | thé | 3 |\n| présent | passé | 4 |",
]


@pytest.mark.parametrize("language", FURTHER)
def test_prose_of_further_languages(language):
    total, prose = quality.prose_characters(FURTHER[language])
    assert prose >= 0.9 * total
    # over short lines too
    words = FURTHER[language].split()
    total, prose = quality.prose_characters("\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8)))
    assert prose >= 0.5 * total


@pytest.mark.parametrize("text", NO_SENTENCES)
def test_no_sentences(text):
    total, prose = quality.prose_characters(text)
    assert prose < 0.5 * total
