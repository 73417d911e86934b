"""Near copies, lines and components against brute force, and their edge cases."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pultwerk.llm import jaccard, line_dedup, near_dedup, shingles
from pultwerk.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, band string, node string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "b", "n") for i, t in texts], SCHEMA)


def word_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(keys, sets, percent):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def corpus():
    rng = random.Random(5)
    words = ["wort%d" % i for i in range(400)]
    texts, at = [], 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((at, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            at += 1
    # a chain of small edits, and a large group around one base whose copies differ from each other
    chain = [rng.choice(words) for _ in range(120)]
    for i in range(8):
        chain = list(chain)
        chain[i * 12] = "neu%d" % i
        texts.append((at, " ".join(chain)))
        at += 1
    base = [rng.choice(words) for _ in range(200)]
    for i in range(25):
        copy = list(base)
        for j in range(3):
            copy[(i * 7 + j * 60) % 200] = "x%d_%d" % (i, j)
        texts.append((at, " ".join(copy)))
        at += 1
    return texts + [(at, None), (at + 1, ""), (at + 2, " \n\t "), (at + 3, ".")]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    texts = corpus()
    got = {r["doc"]: r for r in near_dedup.classes(table(spark, texts), percent).collect()}
    sets = {i: word_sets(t) for i, t in texts}
    want = groups(list(sets), sets, percent)
    assert {i: r["component"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_repeated_rows_nulls_and_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(3, long), (1, long + " end"), (1, long + " end"), (None, "other words here"), (7, None), (8, "")])
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(True, 1), (True, 7), (True, 8)]
    assert kept.where("doc_id IS NULL").count() == 1


def test_empty_tables(spark):
    none = table(spark, [])
    assert near_dedup.classes(none).collect() == []
    assert near_dedup.kept_documents(none).collect() == []
    assert line_dedup.deduplicated(none).collect() == []
    assert line_dedup.kept_documents(none).columns == none.columns


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (6, 40, 2000):
        agree = []
        for _ in range(60 if n > 40 else 200):
            both = rng.integers(1, 2**63, n, dtype=np.uint64)
            extra = rng.integers(1, 2**63, max(n // 4, 1), dtype=np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate([both, extra]))
            x, y = shingles.one_permutation(a), shingles.one_permutation(b)
            agree.append((x == y).mean() - len(a) / len(b))
        assert abs(np.mean(agree)) < 0.06


def test_long_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (600, 600)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 501: 500}


def normal(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\x0b\f\r"))


def shingles_of(line):
    """Runs of five characters; a shorter line is one of its own kind."""
    return {line[k: k + 5] for k in range(len(line) - 4)} or {("whole", line)}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["silbe%d" % i for i in range(200)] + ["слово%d" % i for i in range(60)] + ["字句%d" % i for i in range(60)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 8, 30, 60]))) for _ in range(40)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.choice([1, 2, 6])):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                cut = rng.randrange(len(line))
                line = line[:cut] + rng.choice("zж行") + line[cut + 1:]
            lines.append(rng.choice(["", "  ", ""]) + (line.upper() if rng.random() < 0.1 else line))
        if rng.random() < 0.2:
            lines += ["Kurz.", ""]
        texts.append((i * 3, "\n".join(lines)))
    texts += [(1000, None), (1001, ""), (1002, "Kurz.\nKurz.")]
    places, sets = [], {}
    for i, t in texts:
        for at, line in enumerate((t or "").split("\n")):
            b = normal(line).encode()
            if len(b) >= line_dedup.MIN_BYTES:
                places.append((i, at, b))
                sets[b] = shingles_of(b.decode())
    names = groups(sorted(sets), sets, 80)
    first = {}
    for i, at, b in places:
        first.setdefault(names[b], (i, at))
    gone = {(i, at) for i, at, b in places if first[names[b]] != (i, at)}
    want = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        left = "\n".join(line for at, line in enumerate(lines) if (i, at) not in gone)
        if left.strip(" \t\n\x0b\f\r") or not any((i, at) in gone for at in range(len(lines))):
            want[i] = None if t is None else left
    out = line_dedup.kept_documents(table(spark, texts))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert out.where("n_chars <> char_length(text)").count() == 0
    counted = line_dedup.deduplicated(table(spark, texts))
    assert counted.agg({"n_gone": "sum"}).first()[0] >= len(gone) - sum(1 for i, at in gone if i not in want)


def test_repeated_rows_keep_the_same_lines(spark):
    line = "a line that is long enough to be compared"
    rows = line_dedup.deduplicated(table(spark, [(1, line), (1, line), (2, f"{line}\nand another line, long enough too"), (None, line)])).collect()
    assert sorted(r["text"] for r in rows if r["doc_id"] == 1) == [line, line]
    assert [r["text"] for r in rows if r["doc_id"] == 2] == ["and another line, long enough too"]


def test_equal_short_lines_are_one_component(spark):
    texts = [(1, "Ja.\nEine Zeile, die lang genug ist.\n\n日本語"), (2, "ja.\n \nNein.\n日本語\n12345678"), (3, "Ja.\nJa."), (4, "}\nNein\n12345679\n}"), (5, "\n")]
    seen, want = set(), {}
    for i, t in texts:
        left = []
        for line in t.split("\n"):
            if not normal(line) or normal(line) not in seen:
                left.append(line)
            seen.add(normal(line))
        want[i] = "\n".join(left)
    del want[3]
    assert {r["doc_id"]: r["text"] for r in line_dedup.kept_documents(table(spark, texts)).collect()} == want


def test_one_changed_character_is_found(spark):
    rng = random.Random(12)
    letters = ["abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрстуфхцчшщ ", "".join(chr(0x4E00 + i) for i in range(900))]
    texts = [(0, "Copyright 2019 Example Media Ltd. All rights reserved worldwide."), (1, "Copyright 2024 Example Media Ltd. All rights reserved worldwide.")]
    for n in range(50, 91, 5):
        for kind in letters:
            line = "x" + "".join(rng.choice(kind) for _ in range(n - 2)) + "y"
            cut = rng.randrange(1, n - 1)
            texts += [(len(texts), line), (len(texts) + 1, line[:cut] + "#" + line[cut + 1:])]
    left = {r["doc_id"] for r in corpus_pipeline.without_repeated_lines(spark, table(spark, texts), "").collect()}
    assert left == set(range(0, len(texts), 2))


def one_bucket_lines():
    """Sets of numbers as payloads: one bucket of two groups and a set between none, seen twice."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(3):
        base = rng.choice(1 << 40, 60, replace=False)
        # each copy lacks other elements, so that some are alike only by way of a third
        sets += [np.delete(base, np.arange(i * 5, i * 5 + 5)) for i in range(6)]
    return [np.sort(s).astype(np.uint64) for s in sets]


def linked_by_bucket(spark, sets, bands):
    members = spark.createDataFrame([(b, i) for b in bands for i in range(len(sets))], "band long, node long")
    payloads = spark.createDataFrame([(i, s.tobytes(), len(s)) for i, s in enumerate(sets)], "node long, payload binary, n long")
    found = jaccard.linked(members, payloads, lambda payloads: [np.frombuffer(p, np.uint64) for p in payloads], 80, by_bucket=True)
    return {i: i for i in range(len(sets))} | {r["node"]: r["component"] for r in found.collect()}


def test_bounded_buckets_are_compared_inside_a_task(spark, monkeypatch):
    sets = one_bucket_lines()
    want = groups(range(len(sets)), [set(s.tolist()) for s in sets], 80)
    with monkeypatch.context() as patched:
        # no table of elements is dealt out for them, however many components remain
        patched.setattr(jaccard, "prefix_pairs", None)
        patched.setattr(jaccard, "confirmed", None)
        assert linked_by_bucket(spark, sets, [7, 8, 9]) == want
    # larger ones take the way over the executors and give the same
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    assert linked_by_bucket(spark, sets, [7, 8]) == want


def test_forest_of_a_bucket_equals_brute_force():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 5, 9, 30):
        bases = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(3)]
        sets = [np.unique(np.append(b[rng.random(40) > rng.random() / 5], rng.integers(0, 1 << 62, 2).astype(np.uint64))) for b in (bases[rng.integers(3)] for _ in range(size))]
        edges = list(jaccard._joined(sets, 80))
        want = groups(range(size), [set(s.tolist()) for s in sets], 80)
        assert len(edges) == size - len(set(want.values()))
        root = list(range(size))
        for a, b in edges:
            root = [root[a] if r == root[b] else r for r in root]
        assert [root.index(r) for r in root] == [want[i] for i in range(size)]


def test_buckets_with_the_same_nodes_are_taken_once(spark):
    rows = [(band, node, 10) for band in (1, 2, 3) for node in (1, 2)] + [(4, 1, 10), (4, 3, 10)]
    members = spark.createDataFrame(rows, "band long, node long, n long")
    nothing = spark.createDataFrame([], "node long, component long")
    found = jaccard._still_open(members, nothing, 80, True).collect()
    assert sorted((r["band"], r["node"], r["its_rows"], r["its_elements"]) for r in found) == [(1, 1, 2, 20), (1, 2, 2, 20), (4, 1, 2, 20), (4, 3, 2, 20)]
