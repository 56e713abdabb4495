import pytest

from turnloom.llm import answers as W
from turnloom.llm.languages import fit

EN = ["the lamp was left in the hall after the class", "she bought a small kite at the market on friday", "who gave the old book to her at the party", "we cancelled the trip and chose the walk instead", "how many of the books does he still have"]
DE = ["die lampe blieb nach dem kurs im flur liegen", "sie hat am freitag auf dem markt einen drachen gekauft", "wer gab ihr das alte buch auf dem fest", "wir haben die reise storniert und machen den spaziergang", "wie viele der bücher hat er noch"]


@pytest.fixture(scope="module")
def found(spark):
    q = [(f"q{i}", t + "?", lang) for lang, ts in (("en", EN), ("de", DE)) for i, t in enumerate(ts, 10 * (lang == "de"))]
    good = [(100 + i, f"q{i}", EN[(i + 1) % 5].capitalize() + ". " + EN[(i + 2) % 5].capitalize() + ".", 20, "stop", "m") for i in range(5)] * 1
    good += [(200 + i, f"q{10 + i}", DE[(i + 1) % 5].capitalize() + ". " + DE[(i + 2) % 5].capitalize() + ".", 20, "stop", "m") for i in range(5)]
    rows = good + [
        (1, "q0", None, 0, "stop", "m"), (2, "q0", " ​", 0, "length", "m"), (3, "q0", "<answer>N/A</answer>", 3, None, None), (4, "q0", "42", 1, "stop", "m"), (5, "q0", "Kavobar", 1, "stop", "m"),
        (6, "q0", EN[0] + "?", 9, "stop", "m"), (7, "q0", "You asked: " + EN[0].upper() + "??", 9, "stop", "m"), (8, "q0", EN[0] + "? It was on the shelf.", 9, "stop", "m"),
        (9, "q1", "I'm sorry, but I can't help with that request.", 9, "content_filter", "m"), (10, "q1", "There is no information about this in the sessions.", 9, "stop", "m"), (11, "q1", "Ann declined the lamp that Bob offered.", 9, "stop", "m"),
        (12, "q1", "She first went to the market and then she saw the", 64, "stop", "m"), (13, "q1", "Two of them.", 512, "LENGTH", "m"), (14, "q1", "It was left in the", 5, "stop", "m"), (15, "q1", "It was left in the hall near the door.", 9, "stop", "m"),
        (16, "q1", "Sie hat das alte Buch auf dem Markt gekauft und machen wir den Spaziergang noch.", 20, "stop", "m"), (17, "none", "Some words here.", 4, "stop", "m"), (18, None, "", 4, "stop", "m"), (1, "q0", None, 0, "stop", "m"),
    ]
    a = spark.createDataFrame([r + ("x",) for r in rows], "answer_no bigint, question_id string, prediction string, completion_tokens int, finish_reason string, answer_model string, lang string")
    got = {}
    for r in W.defective_answers(a, spark.createDataFrame(q, "question_id string, question string, lang string")).collect():
        got.setdefault(r.answer_no, []).append(r.defect)
    return got


def test_empty(found):
    assert found[1] == ["empty", "empty"] and found[2] == ["empty"] and found[3] == ["empty"] and found[18] == ["empty"]
    assert 4 not in found and 5 not in found and 17 not in found


def test_copies(found):
    assert found[6] == found[7] == ["copies_question"] and 8 not in found


def test_refusals(found):
    assert found[9] == ["refusal"] and 10 not in found and 11 not in found


def test_truncated(found):
    assert found[12] == found[13] == found[14] == ["truncated"] and 15 not in found


def test_language(found):
    assert found[16] == ["wrong_language"] and not any(n >= 100 for n in found)


def test_names_do_not_tell_a_language():
    m = fit(EN * 20 + DE * 20, ["en"] * 100 + ["de"] * 100)
    assert (m.scores(["Kavobar Lindström", "42", "", "$18"]) == 0).all()
    assert m.languages[m.scores(["wir haben das buch noch"])[0].argmax()] == "de"


def test_neighbours_over_range_borders_match_a_plain_scan(spark):
    texts = sorted({f"word{i % 7} and word{j} go on to say more {k}" for i in range(7) for j in range(20) for k in range(2)} | {f"word{i} and word{j} go on to" for i in range(7) for j in range(20)})
    df = spark.createDataFrame([(t, t.endswith("on to")) for t in texts], "text string, open boolean")
    got = {r.text for r in W.continued_texts(df, 2).collect()}
    assert got == {t for t in texts if t.endswith("on to") and any(o != t and o.startswith(t) and len(o[len(t) :].split()) >= 2 for o in texts)}


def test_empty_tables(spark):
    a = spark.createDataFrame([], "answer_no bigint, question_id string, prediction string, completion_tokens int, finish_reason string, answer_model string")
    assert W.defective_answers(a, spark.createDataFrame([], "question_id string, question string, lang string")).count() == 0


def test_a_later_text_continues_past_one_that_adds_a_word(spark):
    short = "the red lamp was left"
    df = spark.createDataFrame([(t, t == short) for t in (short, short + " in", short + " in the", short + "s", "the red lamp was lent to her")], "text string, open boolean")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert [r.text for r in W.continued_texts(df, 2).collect()] == [short]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_texts_need_neighbours(spark):
    base = "One two three four five six seven eight "
    rows = [(base + "she left fo", True), ("Later she left for home.", False), (base + "quux zork", True), (base + "he owns the", True), ("the end is near.", False), (base + "they met in Ulm", True), ("He is in Ulm.", False), ("Ulm it is.", False)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "text string, open boolean, long boolean")
    assert {r.text[len(base) :] for r in W.broken_off(df).collect()} == {"she left fo", "he owns the"}


def test_refusals_in_any_sentence():
    assert W.declines("Thanks for asking. You want the tent's price. I'm sorry, but I can't share that.") and not W.declines("Thanks. He declined the tent. She won't be there.")


def test_any_sign_behind_a_text_is_enough_over_range_borders(spark):
    words = sorted({f"w{i:03d}"[:k] for i in range(60) for k in (2, 3, 4)})
    df = spark.createDataFrame([(w, len(w) < 4) for w in words], "text string, open boolean")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {r.text for r in W.continued_texts(df, 0).collect()} == {w for w in words if len(w) < 4}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
