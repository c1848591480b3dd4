from __future__ import annotations

from tests.llm.helpers import documents, prose, rows
from vacantia.llm import decontaminate as d

WINDOW = 13


def brute(text, items):
    """Word by word: (n_words, hit places, items)."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, names = word.findall((text or "").translate(lower)), set(), set()
    for item_id, item in items:
        parts = word.findall((item or "").translate(lower))
        size = min(WINDOW, len(parts))
        for i in range(len(parts) - size + 1 if parts else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == parts[i : i + size]:
                    hit |= set(range(k, k + size))
                    names |= {str(item_id)} - {"None"}
    return len(words), len(hit), sorted(names)


def test_equals_brute_force_and_maps_to_the_text(spark):
    item = " ".join(prose(1, 30))
    benchmark_rows = [(7, item), (7, item), (8, "Élan VITAL, ok"), (9, None), (10, " .. "), (None, " ".join(prose(3, 20))), (70, " ".join(prose(1, 14)))]
    texts = [
        None, "", "...", item.upper(), "x " + item.replace(" ", " -- ") + " y", " ".join(prose(2, 400)) + " " + item, "an élan vital ok now", "ÉLAN vital ok",
        " ".join(prose(1, 12)), " ".join(prose(3, 20)), "z" * 200_000, (" ".join(prose(4, 5000)) + " ") * 3 + item,
    ]
    given = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, item)]
    benchmark = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    docs = documents(spark, given)
    for size in (32 << 20, 100):  # one automaton, and one for each of several shares
        out = d.contamination(docs, benchmark, automaton_bytes=size).collect()
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in out)
        expected = []
        for i, t in given:
            n, hit, names = brute(t, benchmark_rows)
            expected.append((str(i), n, hit, names, hit > 0 and 20 * hit >= n))
        assert got == sorted(expected)
    spans = {r["doc_id"]: r["spans"] for r in out}
    a, b = spans[4][0]["start"], spans[4][0]["stop"]
    assert texts[4][a:b] == item.replace(" ", " -- ").rstrip(".") or texts[4][a:b] == item.replace(" ", " -- ")
    kept = d.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 6, 8, 10, 11} - {i for i, t in given if brute(t, benchmark_rows)[1] * 20 >= max(1, brute(t, benchmark_rows)[0])}


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(d.contamination(documents(spark, []), benchmark)) == []
    out = d.contamination(documents(spark, [(1, "a b")]), benchmark.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in out] == [(2, 0, False)]


def test_random_items_and_texts_of_few_words():
    """Items that repeat and hold one another, texts pieced together from parts of items."""
    import random

    random_ = random.Random(3)
    for _ in range(150):
        vocabulary = random_.choice([2, 3, 20, 200])
        items = [(i, " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(random_.choice([0, 1, 3, 7, 12, 13, 14, 20, 27, 40])))) for i in range(random_.randrange(1, 8))]
        parts = []
        for _ in range(random_.randrange(8)):
            words = random_.choice(items)[1].split()
            a = random_.randrange(len(words) + 1)
            parts += words[a : random_.randrange(a, len(words) + 1)] + [f"w{random_.randrange(vocabulary)}" for _ in range(random_.randrange(15))]
        n, hits, names = d.Matcher(items).scan(" ".join(parts))
        assert (n, sum(b - a + 1 for a, b in hits), sorted(names)) == brute(" ".join(parts), items)


def test_memory_of_a_large_benchmark():
    """Ten megabytes of items stay below 300 MB in a worker, measured in a process of its own."""
    import subprocess
    import sys

    code = """
import random, psutil
from vacantia.llm import decontaminate as d
random_ = random.Random(1)
words = [f"{random_.getrandbits(30):x}" for _ in range(150_000)]
items = [(i, " ".join(random_.choice(words) for _ in range(100))) for i in range(12_000)]
assert sum(len(t) for _, t in items) > 10_000_000
before = psutil.Process().memory_info().rss
held = d.Matcher(items)
print((psutil.Process().memory_info().rss - before) / 1e6)
assert held.scan(items[7][1])[2] == {"7"}
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 300


def test_periodic_text_and_many_equal_windows():
    item = "a " * 2000
    n, hits, names = d.Matcher([(1, item), (2, item + "b"), (3, "a a a")]).scan("a " * 50_000 + "c")
    assert (n, hits, names) == (50_001, [(0, 49_999)], {"1", "2", "3"})
