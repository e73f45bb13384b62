import random

from heftmap.llm import decontaminate as D

ITEM = "A train leaves Berlin at 7 and travels 120 km in 3 hours before it stops, says Maria Lopez to Maria."


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def hits(make, spark, docs, items):
    return {(r.doc_id, r.item_id): r.n_changed for r in D.find_leaks(make(docs), benchmark(spark, items)).collect()}


def test_new_parameters_are_caught_and_mixed_slots_are_not(spark, make):
    docs = [
        (1, f"Some words before. {ITEM} And after."),
        (2, "Intro. A train leaves Paris at 9 and travels 300 miles in 5 hours before it stops, says Anna Kern to Anna."),
        (3, "A train leaves Paris at 9 and travels 300 miles in 5 hours before it stops, says Anna Kern to Bob."),
        (4, "A train is a fine thing that leaves the city and travels far before it stops somewhere."),
        (5, ITEM.replace(" ", "\n")),
    ]
    found = hits(make, spark, docs, [(10, ITEM)])
    assert set(found) == {(1, 10), (2, 10), (5, 10)}
    assert found[1, 10] == 0 and found[2, 10] > 0


def test_against_all_windows(spark, make):
    """Plain words: a document holds an item if a third of the item's windows are in it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randrange(9, 40)))) for i in range(30)]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(60)))]
        if i % 3 == 0:
            words = items[rng.randrange(30)][1].split()
            cut = rng.randrange(len(words))
            parts.append(" ".join(words[cut:] if i % 2 else words))
        parts.append(word())
        docs.append((i, " ".join(parts)))

    def windows(text):
        words = text.split()
        return {tuple(words[i:i + 8]) for i in range(len(words) - 7)}

    want = {(d, i) for d, text in docs for i, item in items if len(windows(item) & windows(text)) * 3 >= len(windows(item))}
    assert set(hits(make, spark, docs, items)) == want and want


def test_odd_rows(spark, make):
    items = [(3, ITEM), (2, ITEM), (4, None), (5, ""), (6, "too short"), (7, "1 2 3 4 5 6 7 8 9 10 11 12"), (8, "only five plain words here")]
    docs = [(1, None), (2, ""), (3, ITEM), (3, ITEM), (None, ITEM), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "see only five plain words here now"), (6, f"{ITEM} " * 50)]
    assert set(hits(make, spark, docs, items)) == {(3, 2), (None, 2), (4, 7), (5, 8), (6, 2)}
    assert hits(make, spark, [], items) == {} and hits(make, spark, docs, []) == {}


def changed_copies(rng, n_items=45):
    """Items of 15 to 59 words, and documents that hold one with 1 to 3 of its words changed."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(15 + i))) for i in range(n_items)]
    docs = []
    for i, item in items:
        for n in (1, 2, 3):
            copy = item.split()
            for k in rng.sample(range(len(copy)), n) if i % 2 else [len(copy) * (k + 1) // (n + 1) for k in range(n)]:
                copy[k] = word()
            docs.append((10 * i + n, " ".join([word() for _ in range(20)] + copy + [word()])))
    return items, docs


def test_items_with_changed_words(spark, make):
    items, docs = changed_copies(random.Random(5))
    assert set(hits(make, spark, docs, items)) == {(d, d // 10) for d, _ in docs}


def test_verbatim_copies_of_slots_and_short_items(spark, make):
    items = [(1, "1 2 3 4 5 6 7 8 9 10 11 12"), (2, "The Old Man And The Sea Of Lost Names And Places"), (3, "5 km 3 kg 7 m 12 cm 8 h"), (4, "tiny item"), (5, "Alone")]
    docs = [(i, f"some words before that {text} and after that") for i, text in items]
    assert set(hits(make, spark, docs, items)) == {(i, i) for i, _ in items}


def test_contradicting_slots_leave_the_rest(spark, make):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(55)]
    words[5] = words[40] = "Maria"
    equal = "tom has 3 apples and his sister has 3 oranges so how many pieces of fruit do they both have together at home"
    items = [(1, " ".join(words)), (2, equal)]
    docs = [(1, " ".join([*words[:40], "Anna", *words[41:]])), (2, equal.replace("3", "4", 1).replace("3", "5"))]
    assert set(hits(make, spark, docs, items)) == {(1, 1), (2, 2)}
