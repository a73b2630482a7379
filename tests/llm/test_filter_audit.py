"""The filter audit against brute force: every order applied to every document, one by one."""

import random
import re
from collections import Counter
from itertools import permutations

from tidemill.llm import filter_audit


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    texts = [t or "" for _, t, _ in docs]
    fails = []
    for (doc_id, _, _), text in zip(docs, texts, strict=True):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        own["E"] = doc_id is not None and any(t == text and i is not None and i < doc_id for (i, _, _), t in zip(docs, texts, strict=True))
        fails.append(own)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows, shapley = [], Counter()
    parts = {s or "" for _, _, s in docs}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = [i for i, (_, _, s) in enumerate(docs) if (s or "") == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shapley[part, f] += len(gone)
                redundant = sum(fails[i][f] for i in mine) - len(gone)
                unique = sum(fails[i][f] and sum(fails[i].values()) == 1 for i in mine)
                rows.append((part, order, step, len(left), len(gone), redundant, unique, sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def counted(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def test_audit_against_brute_force(spark, awkward, nothing):
    rng = random.Random(5)
    long = lambda n, kinds: " ".join(rng.choice(["tide", "Moon", "SEA", "é$", "x|y"][:kinds]) + str(rng.randrange(400)) for _ in range(n))
    texts = [long(rng.choice([3, 199, 200, 201, 400]), rng.randint(1, 5)) for _ in range(30)] + ["word " * 250, "\x0b\fA" + " b" * 200, "a b" * 210, None, "", " \n", "one\ttwo", "x" * 5000]
    docs = [(i, rng.choice(texts), rng.choice(["src0", "src1", None, ""])) for i in range(120)]
    docs += [(None, rng.choice(texts), "src0") for _ in range(6)] + [docs[3]] * 4 + [(7, texts[0], "src1"), (7, texts[1], "src1")] + [(None, None, None)] * 3
    labels = [(rng.randrange(130), rng.randint(0, 1), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, "c", "c", "c") for d in docs], "doc_id long, text string, source string, mask string, words string, n string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert counted(filter_audit.audit(frame, marks)) == brute(docs, labels)
    own = awkward.selectExpr("*", "lang as source")
    assert counted(filter_audit.audit(own, marks)) == brute([(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()], labels)
    assert filter_audit.audit(nothing, marks).count() == 0
    assert counted(filter_audit.audit(frame, marks.limit(0))) == brute(docs, [])


def test_texts_move_once_and_no_cross_join(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = filter_audit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("REPARTITION_BY_COL") == 1
