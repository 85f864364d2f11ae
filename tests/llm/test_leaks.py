import random

from mnemora.llm.leaks import Automaton, leaked_passages, passage

ITEM = "The keeper of the north tower counted 245 copper lanterns before dusk, and wrote that only 22 of them would ever burn through one whole winter night again."
ITEMS = [(1, "Question: " + ITEM + " Answer: (b)"), (2, "Q7. Short one."), (3, None), (4, "")]


def test_automaton_finds_all_stretches():
    r = random.Random(2)
    items = [[r.randint(1, 4) for _ in range(30)] for _ in range(3)]
    a = Automaton(items)
    words = [r.randint(1, 5) for _ in range(60)]

    def longest(at):
        n = 0
        while n <= at and any(words[at - n : at + 1] == x[k : k + n + 1] for x in items for k in range(len(x))):
            n += 1
        return n

    for at, length, state in a.stretches(words):
        assert length == longest(at)
        stretch = words[at - length + 1 : at + 1]
        want = {(i, k + length - 1) for i, x in enumerate(items) for k in range(len(x)) if x[k : k + length] == stretch}
        assert set(a.occurrences(state)) == want


def test_lead_ins():
    assert passage("Q8. Read the passage and answer. A b c. Answer: (b)") == "A b c."
    assert passage(None) == ""


def test_documents(spark):
    words = ITEM.split()
    typos = " ".join(w if k % 9 != 4 else w + "x" for k, w in enumerate(words))
    docs = [
        (1, "Before. " + ITEM.upper() + " After."),
        (2, "<b>" + "\n".join(words[:14]) + "\n[0007] " + "  ".join(words[14:]) + "</b>"),
        (3, typos),
        (4, " ".join(words[:12])),  # a short quotation
        (5, None),
        (6, ""),
        (7, "x " * 200_000 + ITEM + " y" * 200_000),
        (8, ITEM.replace("245", "31").replace("copper lanterns", "iron bells").replace("north tower", "old mill").replace("dusk", "noon").replace("22", "9").replace("winter", "summer").replace("burn through", "ring for").replace("wrote", "held")),
        (1, "Before. " + ITEM.upper() + " After."),
    ]
    got = leaked_passages(spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 1)]
    seven = next(r for r in got if r.doc_id == 7)
    assert docs[6][1].encode()[seven.start_byte : seven.end_byte].decode() == ITEM[:-1]


def test_items_that_overlap_or_lie_in_each_other(spark):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)]
    items = [(1, " ".join(words[:40])), (2, " ".join(words[9:35])), (3, " ".join(words[20:60])), (4, " ".join(words[30:52]))]
    docs = [(1, "x " + " ".join(words[:40]) + " y"), (2, " ".join(words[:60])), (3, " ".join(words[12:33])), (4, " ".join(words[:15]))]
    got = leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaked_passages(none, items).count() == 0
    assert leaked_passages(spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), items.filter("false")).count() == 0
