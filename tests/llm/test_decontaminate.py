import os
import random
import re
import subprocess
import sys
import time

import pytest

from itemlens.llm.decontaminate import build, decontaminate, scan, word_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, size=13):
    windows = {}
    for name, t in items:
        ws = WORD.findall(lower(t))
        k = min(size, len(ws))
        for i in range(len(ws) - k + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for d, t in docs:
        ws = WORD.findall(lower(t))
        hit, names = set(), set()
        for w, owners in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    names |= owners
        out.append((d, len(ws), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i}" for i in range(60))
ITEMS = [(1, " ".join(f"w{i}" for i in range(10, 40))), (2, "Short Item"), (2, "é über-all"), (None, "no id here"), (5, None), (6, "..."), (7, "w10 W11,w12")]
DOCS = [
    (1, LONG),
    (2, LONG.upper().replace(" ", ",  ")),
    (3, " ".join(f"w{i}" for i in range(20))),
    (4, "a short\nITEM, twice: short-item " + "x " * 200),
    (5, "É über all é über all"),
    (6, None),
    (7, ""),
    (8, "?!"),
    (8, "no ID here"),
    (None, "w10 w11 w12 " * 3000),
]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_equals_brute_force_in_any_number_of_blocks(spark, frame, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate(frame(DOCS), bench, block_bytes=block)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in found.collect()), key=repr)
    assert got == brute(DOCS, ITEMS)


def test_spans_point_into_the_original(spark, frame):
    bench = spark.createDataFrame([(1, "over all")], "item_id long, text string")
    text = "x É! 😀 Over -- ALL, y. over,all"
    (row,) = decontaminate(frame([(1, text)]), bench).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["Over -- ALL", "over,all"] and row.n_hit == 4
    assert [text[a:b] for a, b in word_spans(text).tolist()] == ["x", "É", "😀", "Over", "ALL", "y", "over", "all"]


@pytest.mark.parametrize("window", [1, 2, 5, 12, 13])
def test_scan_equals_brute_force_on_few_words(window):
    rng = random.Random(window)
    line = lambda n: " ".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(n))
    items = [(str(i % 40), line(rng.randint(0, 30))) for i in range(60)]
    docs = [(i, line(rng.randint(0, 80))) for i in range(60)] + [(100 + i, f"z {t} z {t[:9]}") for i, (_, t) in enumerate(items)]
    known = build(items, window)
    got = []
    for d, t in docs:
        n, runs, names = scan(t, known)
        hit = sum(b - a for a, b in runs)
        got.append((d, n, hit, sorted(names), hit > 0 and 20 * hit >= n))
    assert sorted(got, key=repr) == brute(docs, items, window)


def test_items_that_repeat_one_word_take_linear_time():
    start = time.process_time()
    known = build([(str(i), "a " * 2000) for i in range(20)])
    n, runs, names = scan("a " * 300_000, known)
    assert (n, runs, len(names)) == (300_000, [(0, 300_000)], 20)
    assert time.process_time() - start < 20


def test_memory_of_a_large_benchmark():
    """16 MB of items take less than 600 MB: a node per word and the windows' hashes."""
    code = (
        "import random, resource\n"
        "from itemlens.llm.decontaminate import build, scan\n"
        "rng = random.Random(1)\n"
        "words = [''.join(rng.choices('abcdefghij', k=rng.randint(2, 9))) for _ in range(50_000)]\n"
        "items = [(str(i), ' '.join(rng.choices(words, k=120))) for i in range(21_500)]\n"
        "assert sum(len(t) for _, t in items) >= 16_000_000\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "known = build(items)\n"
        "assert scan('x ' + items[7][1], known) == (121, [(1, 121)], {'7'})\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)\n"
    )
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 600


def test_empty_tables_and_carried_columns(spark, frame):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(frame([(1, "a b")]).limit(0), bench).count() == 0
    kept = decontaminate(frame([(1, "a b")]), bench.limit(0), carry=("doc_id", "text", "lang")).first()
    assert (kept.doc_id, kept.text, kept.lang, kept.contaminated) == (1, "a b", "en", False)
    with pytest.raises(ValueError):
        decontaminate(frame([(1, "a b")]), bench, carry=("doc_id", "n_words"))
