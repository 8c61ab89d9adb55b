"""Unicode words: accents, other scripts, stop words."""

from rillwork.operators.chat import unicode_words


def test_words_of_any_script(spark):
    texts = ["Canción, CANCIÓN! a été", "The привет,мир привет", None, "x ½½ 한국어 一个 it's", "no。弹幕!弹幕"]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    got = {r["word"]: r["n"] for r in unicode_words(docs).collect()}
    assert got == {"canción": 2, "été": 1, "привет": 2, "мир": 1, "½½": 1, "한국어": 1, "弹幕": 2}
    assert "мир" not in {r["word"] for r in unicode_words(docs, "lang", extra_stop_words=("мир",)).collect()}
