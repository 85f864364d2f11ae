import random

from mnemora.llm.subjects import subjects


def test_subject_with_a_third_of_the_documents(spark):
    r = random.Random(11)
    names = ["large", *(f"small{chr(97 + k)}" for k in range(11))]
    terms = {s: [f"{s}{chr(97 + k)}term" for k in range(8)] for s in names}
    common = [f"frame{chr(97 + k)}" for k in range(20)]
    docs, labels, truth = [], [], {}
    for d in range(1500):
        own = "large" if d % 3 == 0 else names[1 + r.randrange(11)]
        truth[d] = own
        docs.append((d, " ".join(r.choice(terms[own]) if r.random() < 0.4 else r.choice(common) for _ in range(80))))
        if d % 2 == 0:
            labels.append((d, own))
    found = {}
    for x in subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject_id string"), spark.createDataFrame([(s,) for s in names], "subject_id string")).collect():
        found.setdefault(x.doc_id, set()).add(x.subject_id)
    large = [d for d in truth if truth[d] == "large"]
    # every word of the large subject is in about a third of all documents
    assert sum(found.get(d) == {"large"} for d in large) >= 0.95 * len(large)
    assert sum(found.get(d) == {truth[d]} for d in truth) >= 0.9 * len(truth)
