import random

import pytest

from turnloom.llm import mojibake as J

GERMAN = ["Größe", "über", "für", "Zähler", "Bücher", "schön", "möchte", "Straße", "nächste", "Tür", "Küche", "hören"]
FRENCH = ["été", "café", "où", "déjà", "garçon", "fenêtre", "élève", "leçon", "après", "très", "voilà", "hôtel"]
RUSSIAN = ["Завтра", "будет", "дождь", "книга", "сказала", "встречу", "вокзала", "человек", "примерно", "рублей", "начало", "потому"]
PLAIN = ["the", "lamp", "der", "Preis", "pour", "market", "stand", "rest", "of", "und"]


def clean(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        special = rnd.choice([GERMAN, FRENCH, RUSSIAN])
        out.append(" ".join(rnd.choice(special if rnd.random() < 0.5 else PLAIN) for _ in range(30)))
    return out


@pytest.fixture(scope="module")
def case(spark):
    texts = clean(300)
    rnd = random.Random(9)
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "latin-1"), ("koi8-r", "cp1251")]
    garbled = {}
    for i in range(60):
        written, read = chains[i % len(chains)]
        words = texts[i].split()
        start = rnd.randrange(10)
        stretch = " ".join(w for w in words[start : start + 12])
        if written != "utf-8":
            stretch = " ".join(rnd.sample(RUSSIAN, 6))
        raw = stretch.encode(written)
        bad = raw.decode(read, "replace") if read != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
        if bad != stretch:
            before, after = " ".join(words[:start]), " ".join(words[start + 12 :])
            garbled[i] = f"{before} {stretch} {after}"
            texts[i] = f"{before} {bad} {after}"
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "Sella��o caf�", "x"), (903, "GRÖSSE UND MAẞE, ÉTÉ", "x"), (904, "x" * 50_000 + " été", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, repaired_text string")
    return texts, garbled, {r.doc_id: r for r in J.garbled_documents(df).collect()}


def test_garbled_documents_are_found_and_clean_ones_left(case):
    _, garbled, got = case
    assert set(garbled) <= set(got) and set(got) - set(garbled) == {902}


def test_originals_come_back(case):
    _, garbled, got = case
    same = sum(got[i].repaired_text == text for i, text in garbled.items())
    assert same >= 0.9 * len(garbled)
    assert got[902].n_repaired == 0


def test_every_distinct_clean_text_counts_for_the_margin(spark):
    # More than 5,000 documents of one text, then 40 words that are clean but rare.
    texts = ["déjà vu café"] * 6000 + [f"{w} Nr. {i}" for i in range(40) for w in GERMAN]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert J.lead_histogram(df, J.train(df)).sum() == 2 + 40 * len(GERMAN)


def test_round_trip_of_every_chain():
    text = "Größe, déjà – où?"
    for charset in ("latin-1", "cp1252"):
        twice = text
        for _ in range(2):
            twice = "".join(J._CHARS[charset][b] for b in twice.encode("utf-8"))
        assert text in {t for t, _, _ in J.readings(twice)}


def test_empty_table(spark):
    assert J.garbled_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_runs_without_blanks_take_linear_time(spark):
    from time import monotonic

    texts = ["x" * 300_000 + " été", "é" + "x" * 300_000, "Größe " * 50_000]
    began = monotonic()
    assert J.garbled_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).count() == 0
    assert monotonic() - began < 60
