from patchlight.llm import decontamination
from tests.llm.helpers import odd_documents, rows_of, table

ITEM = "A train leaves Boston at 9 and travels 60 km per hour towards Chicago while another leaves Chicago at 9 going 45 km per hour"
SHORT = "How many apples does Maria have after giving away 7"


def _found(spark, texts, items):
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + odd_documents()[60:])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", decontamination.F.lit(1))
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows, r.verbatim) for r in decontamination.contaminated(docs, bench).collect()}


def test_copies_and_swapped_values_are_found_inconsistent_ones_are_not(spark):
    filler = "some words that stand before and after it in the text "
    swapped = ITEM.replace("Boston", "Lyon").replace("Chicago", "Paris").replace("9", "7").replace("60", "88").replace("45", "31")
    broken = ITEM.replace("at 9 and", "at 5 and").replace("towards Chicago", "towards Denver")
    texts = [filler + ITEM + " " + filler, filler + swapped, filler + broken, filler * 3, SHORT, SHORT.replace("7", "9").replace("Maria", "Tom"), None, ""]
    got = _found(spark, texts, [(1, ITEM), (2, SHORT), (3, None), (4, "too short"), (None, ITEM)])
    assert got[(0, 1)][0] == got[(0, 1)][1] and got[(0, 1)][2]
    assert got[(1, 1)][0] == got[(1, 1)][1] and not got[(1, 1)][2]
    assert got[(4, 2)] == (1, 1, True) and got[(5, 2)] == (1, 1, False)
    # The windows that hold both changed slots do not correspond; a whole-item match would need them.
    assert (2, 1) not in got or got[(2, 1)][0] < got[(2, 1)][1]
    assert {d for d, _ in got} <= {0, 1, 2, 4, 5}


def test_slots_that_do_not_correspond():
    import numpy as np

    raw = np.array([5, 6, 5, 9, 8, 9, 7, 7], np.uint64)
    slot = np.ones(8, bool)
    one, two, three, four = decontamination.pattern(np.concatenate((raw[:3], raw[3:6], raw[1:4], raw[5:8])), np.ones(12, bool), np.array([0, 3, 6, 9]), 3)
    assert one == two != three and four not in (one, two, three)
    assert len(decontamination.pattern(raw, slot, np.zeros(0, np.int64), 3)) == 0


def test_windows_against_a_plain_version(spark, sf):
    """On texts without numbers or capitals a template is the word sequence itself."""
    import re

    docs = [(r.doc_id, r.text.lower()) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("doc_id < 400").collect()]
    items = [(r.item_id, r.text.lower()) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/benchmark.parquet").collect()]
    cut = lambda t: re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub(r"\d", " ", t))
    docs, items = [(i, re.sub(r"\d", " ", t)) for i, t in docs], [(i, re.sub(r"\d", " ", t)) for i, t in items]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {}
    for j, t in items:
        w = cut(t)
        n = min(13, len(w))
        own = grams(w, n) if n >= 8 else set()
        for i, d in docs:
            if hit := len(own & grams(cut(d), n)) if own else 0:
                want[(i, j)] = (hit, len(own), True)
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want and {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows, r.verbatim) for r in got.collect()} == want


def test_slices_give_the_same_and_clean_keeps_columns(spark, monkeypatch):
    docs = table(spark, [(0, ITEM, "s"), (1, "x " + ITEM, "s"), (2, "plain", "s"), (None, ITEM, "s")])
    bench = spark.createDataFrame([(1, ITEM), (2, SHORT)], "item_id long, text string")
    whole = rows_of(decontamination.contaminated(docs, bench))
    monkeypatch.setattr(decontamination, "SLICE", 3)
    assert rows_of(decontamination.contaminated(docs, bench)) == whole
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0 and decontamination.clean(docs.limit(0), bench).count() == 0


def test_copies_in_another_letter_case_are_found(spark):
    over = "Der Zug fährt über die große Brücke nach Köln und hält später in Österreich an der Straße"
    weak = "Anna met Bob Carl Dora Emil Fritz in Rome Paris London Berlin and Vienna"
    texts = [ITEM.upper(), "x " + ITEM.lower() + " y", ITEM.title(), over.upper(), over.lower(), weak.upper(), weak.lower(), SHORT.upper(), "nothing of it " * 9]
    got = _found(spark, texts, [(1, ITEM), (2, over), (3, weak), (4, SHORT)])
    assert {k for k in got} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 4)}
    assert all(n == whole and verbatim for n, whole, verbatim in got.values())
    # An item in capitals has nothing but names for its template; its copies are found by words.
    assert {d for d, _ in _found(spark, texts, [(1, ITEM.upper())])} == {0, 1, 2}


def test_short_items_are_found_as_whole_sequences(spark):
    texts = ["they ask Why is it so? and go on", "why is IT so", "why is it, so", "why it is so", "Paris", "in Paris, 1999.", "1999", "...", None, "so"]
    got = _found(spark, texts, [(1, "Why is it so"), (2, "paris"), (3, "1999"), (4, "..."), (5, ""), (6, "is it never so")])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2), (5, 3), (6, 3)}
    assert all(v == (1, 1, True) for v in got.values())


def test_folding_keeps_the_tokens():
    import sys

    token = lambda c: all(decontamination._TOKEN[b] for b in c.encode())
    for c in (chr(x) for x in range(sys.maxunicode + 1) if not 0xD800 <= x < 0xE000):
        assert all(token(f) == token(c) for f in c.casefold()) and (c.casefold() == c or not c.isdigit())
