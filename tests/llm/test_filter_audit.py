import random
import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from tilespan.llm import filter_audit

_DOCS, _LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def _plain(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > least[text],
        }
        rows[lang or ""].append(({f for f in fails if fails[f]}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, of in rows.items():
        shapley, steps = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = of
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = [x for x in of if f in x[0]]
                steps.append((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(x[0] == {f} for x in of), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def _case(seed, n=150):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        k = rng.choice([0, 1, 20, 99, 100, 101, 150])
        words = [rng.choice(["w", "É"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(k)]
        words = [w.upper() if rng.random() < 0.2 else w for w in words] + rng.choice([[], ["#"], ["a|b"], ["ABCDEFGHIJ" * 30]])
        docs.append((i, rng.choice([" ", "\t", " \n\x0b"]).join(words), rng.choice(["en", "fr", None, ""])))
    copies = [(n + i, docs[i % 7][1], "de") for i in range(60)]
    odd = [(None, docs[0][1], "en"), (None, None, "en"), (-1, docs[3][1], "en"), (5, docs[5][1], "en"), (500, None, "fr"), (501, "", "fr"), (502, "🙂" * 9, "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n + 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return docs + copies + odd, labels


def test_every_order_of_every_part(spark):
    docs, labels = _case(1)
    found = filter_audit.audit(spark.createDataFrame(docs, _DOCS).repartition(5), spark.createDataFrame(labels, _LABELS))
    rows = sorted(tuple(r) for r in found.collect())
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows == _plain(docs, labels) and len(rows) == 600 * 5


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = _case(2, 20)
    none = spark.createDataFrame([], _LABELS)
    frame = spark.createDataFrame(docs, _DOCS).withColumn("words", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("a", F.lit(2)).withColumn("subset", F.lit(2))
    assert sorted(tuple(r) for r in filter_audit.audit(frame, none.withColumn("part", F.lit(1))).collect()) == _plain(docs, [])
    assert filter_audit.audit(spark.createDataFrame([], _DOCS), spark.createDataFrame(labels, _LABELS)).collect() == []
