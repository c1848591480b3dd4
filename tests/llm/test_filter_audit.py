from __future__ import annotations

import random
import re
from itertools import permutations

from tests.llm.helpers import SCHEMA, rows
from vacantia.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, n string, mask string"


def table(spark, given):
    """Documents (id, text, lang), with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "x", "x", "x", "x", "x", "x") for i, t, lang in given], SCHEMA + ", mask string, digest string")


def brute(docs, labels):
    """Applies every order to the documents one by one."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    texts = {}
    for i, text, _ in docs:
        if i is not None:
            texts.setdefault(text or "", []).append(i)
    failed = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and min(texts[text]) < i}
        failed.append((lang or "", i, fails))
    out, summed = {}, {}
    for part in {p for p, _, _ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                again = sum(f[x] for _, f in own) - len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), again, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                summed[part, x] = summed.get((part, x), 0) + len(gone)
    return sorted((*key, *v, summed[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def check(spark, docs, labels):
    out = fa.audit(table(spark, docs), spark.createDataFrame([(*x, "y", "y") for x in labels], LABELS))
    expected = brute(docs, labels)
    assert sorted(rows(out)) == expected
    return expected


def test_against_filters_applied_one_by_one(spark):
    random_ = random.Random(3)
    docs = []
    for i in range(150):
        n, vocabulary = random_.choice([5, 150, 250, 400]), random_.choice([3, 5000])
        text = " ".join(random_.choice(["w", "W"] if random_.random() < 0.3 else ["w"]) + str(random_.randrange(vocabulary)) for _ in range(n))
        docs.append((i, text + random_.choice(["", " 5 %", "\n#"]), random_.choice(["en", "de", None, ""])))
    docs += [(500 + i, docs[i % 7][1], random_.choice(["en", "fr"])) for i in range(60)]
    labels = [(i, random_.choice([0, 1, None]), random_.choice([0, 1, None])) for i in range(0, 560, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    assert len(check(spark, docs, labels)) == 4 * 600


def test_odd_rows(spark):
    long_ = "Über Wörter " * 200_000
    docs = [(1, None, None), (2, "", "en"), (2, "", "en"), (1, None, "en"), (None, "", "en"), (None, None, "de"), (3, long_, "en"), (4, long_, "de"),
            (5, "   \x1c a", "en"), (6, "a\x0bb\x0cc\r\n\td", "en"), (7, "E" * 10, "en"), (7, "E" * 10, "en"), (8, "É$", "xx"), (9, " lead and trail ", "xx")]
    check(spark, docs, [(2, 1, 1), (2, 0, 0), (7, 1, 0)])
    check(spark, docs, [])


def test_threshold_ties(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words + words), "en"), (2, " ".join(words + words[:99] + ["w0"]), "en"), (3, " ".join(words + words[:99]), "en"),
            (4, "A" * 3 + "a" * 97, "en"), (5, "A" * 4 + "a" * 96, "en")]
    check(spark, docs, [])


def test_one_text_held_by_most_rows(spark):
    docs = [(i, "the same text", ["en", "de", "fr"][i % 3]) for i in range(3000)] + [(i, f"own {i}", "en") for i in range(3000, 3100)]
    check(spark, docs, [(i, 1, 0) for i in range(0, 3000, 50)])
    counted = fa.failure_counts(table(spark, docs), spark.createDataFrame([], LABELS)).where("mask >= 16").agg({"n": "sum"}).first()[0]
    assert counted == 2999


def test_empty_tables(spark):
    assert rows(fa.audit(table(spark, []), spark.createDataFrame([], LABELS))) == []


def test_potential_of_a_known_game(spark):
    """A game in which two filters remove the same six documents and a third one two of its own."""
    removed = [6 * bool(s & 3) + 2 * bool(s & 4) for s in range(32)]
    game = spark.createDataFrame([(removed,)], "removed array<long>")
    p = fa.potentials(game).first()["potential"]
    values = [(p[31] - p[31 & ~(1 << i)]) / fa.SCALE for i in range(5)]
    assert values == [3, 3, 2, 0, 0]
