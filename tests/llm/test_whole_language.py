"""A rare language keeps its texts and words beside large ones."""

from trackloom.llm import language_id


def test_rare_language_keeps_its_texts_and_words(spark):
    large = [(f"river stone meadow walk{k % 900} morning{k % 700} table window", "aa") for k in range(4000)]
    rare = [(f"rivet stonk meadaw wolk{'abcdefghij'[k]} marning tabla windaw", "zz") for k in range(10)]
    frame = spark.createDataFrame(large + rare, "text string, lang string")
    model = language_id.train(frame, max_docs=60, max_words=40, max_grams=200)
    column = model.languages.index("zz")
    assert "windaw" in model.words and "marning" in model.words
    assert model.rows[model.words["windaw"]].argmax() == column
    assert all(model.predict(t)[0] == x for t, x in rare + large[:20])
    assert len(model.words) <= 40 and len(model.grams) <= 5 * 200


def test_copies_do_not_crowd_out(spark):
    rows = [("one two three", "aa")] * 500 + [(f"alpha{'abcdefghij'[k]} beta", "aa") for k in range(10)] + [("uno dos tres", "bb")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), max_docs=12)
    assert "alphaj" in model.words and "dos" in model.words and model.predict("uno dos")[0] == "bb"


def test_words_are_letters_and_marks():
    assert language_id.words("½ ² Ⅷ ١٢ _ 12 ́") == []
    assert language_id.words("हिन्दी été Straße o'clock x2y Ⅷth") == ["हिन्दी", "été", "straße", "o", "clock", "x", "y", "th"]
    assert language_id.words(None) == language_id.words("") == []


def test_scores_against_brute_force(spark):
    """Ties, repeated rows, numerals, clashing columns; every score by the plain formula."""
    import math
    from collections import Counter

    import pytest

    labelled = [("the stone the river", "aa"), ("a river walk", "aa"), ("la piedra rio", "bb"), ("el rio la casa", "bb"), ("el rio la casa", "bb")]
    model = language_id.train(spark.createDataFrame(labelled, "text string, lang string"))
    counts, grams = {"aa": Counter(), "bb": Counter()}, {"aa": Counter(), "bb": Counter()}
    for text, lang in dict.fromkeys(labelled):
        counts[lang].update(text.split())
    for lang, c in counts.items():
        for w, n in c.items():
            t = f"^{w}$"
            for k in range(1, 6):
                for i in range(len(t) - k + 1):
                    grams[lang][t[i : i + k]] += n

    def log(table, key, like):
        keys = {k for c in table.values() for k in c if like(k)}
        return [math.log((table[x][key] + 0.5) / (sum(n for k, n in table[x].items() if like(k)) + 0.5 * (len(keys) + 1))) for x in ("aa", "bb")]

    def predict(text):
        total = [0.0, 0.0]
        for w in text.split():
            if any(w in c for c in counts.values()):
                rows = [log(counts, w, lambda k: True)]
            else:
                t, rows = f"^{w}$", []
                for i in range(len(t)):
                    for k in range(min(5, len(t) - i), 0, -1):
                        if any(t[i : i + k] in c for c in grams.values()):
                            rows.append(log(grams, t[i : i + k], lambda x, k=k: len(x) == k))
                            break
            for x in (0, 1):
                total[x] += sum(r[x] for r in rows) / max(1, len(rows))
        best = 0 if total[0] >= total[1] else 1
        return ("aa", "bb")[best], 1 / sum(math.exp(t - total[best]) for t in total)

    asked = [(1, "the river", "x", 1), (2, "casa piedra", "x", 2), (2, "casa piedra", "x", 2), (3, "rivers rioja stones", "x", 3), (4, "½ 12", "x", 4), (5, None, "x", 5), (6, "elriver", "x", 6)]
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang_pred string, _doc_id long")
    got = language_id.identify(docs, model, keep=docs.columns).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "lang_pred", "score", "of_doc_id", "text", "of_lang_pred", "_doc_id"} and len(got) == 7
    for r in got:
        if r["doc_id"] in (4, 5):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            want = predict(r["text"])
            assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1])
    tied = language_id.Model(["m", "n"], {"w": 0}, {}, __import__("numpy").array([[-1.0, -1.0], [-2.0, -2.0]]))
    assert tied.predict("w") == ("m", 0.5)
