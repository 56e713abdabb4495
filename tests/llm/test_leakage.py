from difflib import SequenceMatcher

from turnloom.llm import leakage as L

INTRO = "Read the following dialogue carefully and reply with a short phrase."
OWN = [
    "One carpenter from Sellabruck soaked Wenettes tiny toolbox inside a sawmill while the parrots watched quietly from their rusty perch.",
    "Melisca barely rinsed neither mirror nor stove above that greenhouse so the observatory smelled of burnt sugar and old paper again.",
    "Following a coin toss the plumber delivered every jacket except his own beyond the windmill until somebody noticed the missing bulbs.",
    "Veyora auctioned nineteen planters beside the bandstand because her niece had promised the mayor forty eight more before sunrise.",
    "Halimar engraved a brass kite beneath the viaduct and grudgingly returned the borrowed ladder to the beekeepers of the valley.",
]
ITEMS = [(i + 1, f"{INTRO} {t}") for i, t in enumerate(OWN)] + [(6, None), (7, ""), (8, f"{INTRO}")]
FILL = "Nothing of note was said that day, but the weather kept changing and everybody talked about the harvest. " * 3


def words(t):
    return t.lower().replace(",", "").replace(".", "").split()


def found(spark, texts, items=ITEMS):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, share string")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id bigint, passage string, doc_id int")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()}


def test_ways_a_passage_leaks(spark):
    w = words(OWN[0])
    edited = " ".join("quite" if k == 6 else x for k, x in enumerate(w))
    texts = [
        FILL + OWN[0] + FILL,
        FILL + OWN[1].upper(),
        "<p>" + OWN[2].replace(" ", " <b> </b>") + "</p>",
        FILL + " ­".join(OWN[3].replace("auctioned", "auc­tioned").split(" ")),
        edited,
        " ".join(w[: len(w) // 2 + 2]),
        " ".join(w[: len(w) // 3]) + " " + FILL + " ".join(w[len(w) // 3 :]),
        OWN[4] + " " + FILL + OWN[0],
    ]
    assert found(spark, texts) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 1), (5, 1), (6, 1), (7, 5), (7, 1)}


def test_what_is_no_leak(spark):
    w = words(OWN[0])
    texts = [INTRO, FILL, None, "", " ".join(w[: len(w) // 3]), " ".join(reversed(w)), " ".join(sorted(w)), "x" * 100_000]
    assert found(spark, texts) == set()


def test_share_against_sequence_matching(spark):
    """Shares of a prefix of growing length follow the plain share of words."""
    w = words(OWN[2])
    texts = [FILL + " ".join(w[:k]) for k in range(1, len(w) + 1)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.share for r in L.leaks(d, spark.createDataFrame([(1, OWN[2])], "item_id bigint, passage string")).collect()}
    for k, text in enumerate(texts):
        blocks = SequenceMatcher(None, w, words(text), autojunk=False).get_matching_blocks()
        plain = max(b.size for b in blocks) / len(w)
        assert (k in got) == (plain >= 0.5) or abs(plain - 0.5) < 2 / len(w)
        assert k not in got or abs(got[k] - plain) < 2 / len(w)


def test_passages_in_blocks_find_the_same(spark, monkeypatch):
    texts = [FILL + t for t in OWN]
    once = found(spark, texts)
    monkeypatch.setattr(L, "BLOCK", 2)
    assert found(spark, texts) == once == {(i, i + 1) for i in range(5)}


def test_empty_tables(spark):
    assert found(spark, []) == set() and found(spark, [OWN[0]], items=[(1, None)]) == set()


SHORT = [(1, "Quilted walrus teapots"), (2, "Fenwick sold ochre barometers near Tolvaborg"), (3, "It is")]


def test_short_passages_are_found_too(spark):
    texts = [FILL + "quilted walrus teapots" + FILL, FILL + "Fenwick sold ochre barometers, near Tolvaborg." + FILL, FILL + "fenwick sold ochre barometer at home", FILL + "quilted", FILL]
    got = found(spark, texts, SHORT)
    assert {(0, 1), (1, 2), (2, 2)} <= got and (4, 1) not in got and (4, 2) not in got and (3, 1) not in got


def test_budget_of_edits_sets_what_is_enough():
    assert L.gram_length(400) == 10 and L.gram_length(60) == 4 and L.gram_length(12) == 0
    assert all(L.bound(n, L.gram_length(n)) >= 1 for n in range(32, 500))


def test_alignments_together_equal_single_ones():
    import random

    import numpy as np

    rnd = random.Random(4)
    jobs = []
    for _ in range(90):
        doc = np.array([rnd.randrange(97, 103) for _ in range(rnd.randrange(20, 200))], "u4")
        a = rnd.randrange(0, len(doc) - 10)
        item = doc[a : a + rnd.randrange(5, 60)].copy()
        item[rnd.randrange(len(item))] = 120
        jobs.append((item, doc, a - rnd.randrange(5, 40), a + rnd.randrange(5, 40)))
    for j, (got, box) in zip(jobs, L.aligned(jobs)):
        alone, single = L.aligned([j])[0]
        assert box == single and (got == alone).all() and got.sum() >= len(j[0]) - 2


def test_crowded_grams_do_not_depend_on_blocks(spark, monkeypatch):
    items = [(k, f"{t} and thereafter every single one of them went home number{k}") for k, t in enumerate(OWN * 3)]
    once = found(spark, [FILL + t for t in OWN], items)
    monkeypatch.setattr(L, "BLOCK", 4)
    assert found(spark, [FILL + t for t in OWN], items) == once and once
