"""Merkle versions, vector search and token alignment against brute force."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pultwerk.llm import alignment, merkle, nearest, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, grp string, row string, pair string"


def documents(spark, rows):
    """rows of (doc_id, source, text)."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, s, None if t is None else len(t), "x", "y", "z", "p") for i, s, t in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(level):
    return [h(*level[i: i + 16]) for i in range(0, len(level), 16)]


def slow_tree(levels_of, at):
    """Siblings level by level of leaf ``at`` and a function that folds a new leaf."""
    steps = []
    for level in levels_of[:-1]:
        first = at // 16 * 16
        run = level[first: first + 16]
        steps.append((run[: at - first], run[at - first + 1:]))
        at //= 16
    return steps


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def slow_manifest(rows):
    def leaf(i, s, t, n):
        lang = None if i is not None and i % 3 == 0 else "en"
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)])

    groups = {}
    for i, s, t in rows:
        n = None if t is None else len(t)
        low = None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups.setdefault(s, []).append(((i is not None, i or 0), leaf(i, s, t, n), leaf(i, s, low, n) if tampered else leaf(i, s, t, n), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: r[:2])
        trees[s] = levels([r[1] for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, old, new, i) in enumerate(groups[s]):
            steps = slow_tree(trees[s], at) + slow_tree(top, k)
            folded = new
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((i, old, trees[s][-1][0], top[-1][0], h(*[d for b, a in steps for d in b + a]), folded))
    return out


def test_manifest_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(100000), "hot", f"Text {i} Ä") for i in range(5000)]
    rows += [(i, f"s{rng.randrange(40)}", "Straße " * rng.randrange(4)) for i in range(400)]
    rows += [(10, "lone", "One"), (11, None, None), (12, None, "Ab" * 50000), (None, "", "no id"), (None, "", "no id"), (5, "lone2", ""), (5, "lone2", ""), (5, "lone2", "B")]
    rows += [(i, "exact", "X") for i in range(256)] + [(i, "sixteen", "X") for i in range(16)] + [(i, "seventeen", "X") for i in range(17)]
    found = merkle.lower_cased_copies(documents(spark, rows)).collect()
    got = sorted(((r["doc"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in found), key=str)
    assert got == sorted(slow_manifest(rows), key=str)
    assert all((r["copied"] is None) == (r["doc"] is None or zlib.crc32(str(r["doc"]).encode()) % 5 != 0) for r in found)
    assert all(r["copied"][-1] == r["folded_root"] and (r["copied"][0] != r["leaf"]) == (r["folded_root"] != r["root"]) for r in found if r["copied"])


def test_versions_share_all_but_their_own_path(spark):
    rows = [(i, "a" if i < 300 else "b", f"Text {i}") for i in range(320)]
    found = merkle.lower_cased_copies(documents(spark, rows))
    heights = {r["doc"]: r["n"] for r in merkle.copied_nodes(found).groupBy("doc").agg(F.count("*").alias("n")).collect()}
    # leaf, levels of the source, one level of subroots
    assert heights == {i: 1 + (3 if i < 300 else 2) + 1 for i in range(320) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.lower_cased_copies(documents(spark, [])).collect() == []
    row = merkle.lower_cased_copies(documents(spark, [(1, None, None)])).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h("")


VECTORS = "id long, vector array<float>, shard string, dim string"


def slow_nearest(rows, k):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            near = []
            for j, c in good:
                if j != i and len(c) == len(q):
                    total = 0.0
                    for a, b in zip(q, c):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), j))
            out += [(i, rank, j, far) for rank, (far, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2500)]
    copies = rng.normal(size=8).tolist()
    rows += [(i, copies) for i in range(2500, 3300)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(4000, 4007)]
    rows += [(5000, None), (5001, []), (5100, [0.0] * 8), (5200, [float("nan")] + [1.0] * 7), (5300, [None] + [1.0] * 7), (5400, [float("inf")] * 8), (None, [1.0] * 8), (7, [1e30] * 8), (7, [1e30] * 8)]
    return rows


@pytest.mark.parametrize("shard_rows", [50, 700, 32768])
def test_nearest_equals_brute_force(spark, shard_rows):
    rows = vectors()
    table = spark.createDataFrame([(i, v, "s", "d") for i, v in rows], VECTORS).repartition(3)
    found = nearest.nearest(nearest.indexed(table, shard_rows), table.where("id % 100 = 0"), 10)
    assert sorted(tuple(r) for r in found.collect()) == slow_nearest(rows, 10)


def test_smaller_factor_prunes_more_and_keeps_most(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 32)) * 3
    points = middles[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32))
    order, radius = nearest.tree_order(points)
    ids, taken, recall = np.arange(6000)[order], {}, {}
    exact = np.argsort(((points[:200, None] - points[None]) ** 2).sum(-1), axis=1)[:, 1:11]
    for factor in (1.0, 0.5, 0.25):
        found = nearest.Found(np.arange(200), np.full(200, np.inf), 10)
        taken[factor] = nearest.search(ids, points[order], radius, points[:200], found, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.rows, exact)])
    assert recall[1.0] == 1 and recall[0.5] >= 0.9
    assert taken[0.25] < taken[0.5] < taken[1.0] < 200 * 6000
    with pytest.raises(ValueError):
        nearest.nearest(spark.createDataFrame([], "dim int, shard long, pos int, id long, vector array<double>, radius double"), spark.createDataFrame([], "id long, vector array<float>"), factor=0)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert nearest.nearest(nearest.indexed(none), none).collect() == []


def slow_alignment(texts):
    a_coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        entries = {v: k for k, v in json.load(file)["model"]["vocab"].items()}
    # the byte alphabet: printable bytes stand for themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    docs, counts = [], {}
    for text in texts:
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in entries[i]) for i in a]
        b_bytes = []
        for i in b:
            piece = b_coder.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode())
        if text and b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            x, y = ([i for i, part in enumerate(parts) for _ in part] for parts in (a_bytes, b_bytes))
        else:
            a, b, x, y = [], [], [], []
        # byte by byte: the token of either side that holds it
        links = sorted(set(zip(x, y)))
        for i, j in links:
            counts[a[i], b[j]] = counts.get((a[i], b[j]), 0) + 1
        groups, lo = [], 0
        for end in range(1, len(x) + 1):
            if end == len(x) or x[end] != x[end - 1] and y[end] != y[end - 1]:
                groups.append(([a[i] for i in sorted(set(x[lo:end]))], [b[j] for j in sorted(set(y[lo:end]))]))
                lo = end
        docs.append((a, b, links, groups))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for a, b, links, groups in docs:
        named = [counts[a[i], b[j]] for i, j in links]
        sha = hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, k))}" for g, k in groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(n == most[b[j]] for n, (_, j) in zip(named, links)), sum(named), sha, sum(len(g) * len(k) for g, k in groups)))
    return out


TEXTS = [
    None, "", " ", "a", "hello world", "  two  spaces\n\nand lines\t\ttabs ", "<s> hello </s> <|endoftext|> <unk>", "Größe, naïve façade – “quoted” … ½", "日本語のテキスト、漢字",
    "emoji 👩‍👩‍👧 🇩🇪 \U0001F600", "▁already marked", "ﬁ ligature ① full width Ａ", "é combining", " nbsp​zero", "x" * 3000, "ab " * 4000, "hello world", "\x00nul\x01", "Привет мир", "العربية", "line\r\nfeed",
]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    with open(public_tokenizers.path("LICENSES.txt"), encoding="utf-8") as file:
        words = file.read().split(" ")
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    docs = documents(spark, rows).repartition(3)
    want = dict(enumerate(slow_alignment(texts)))
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.aligned(docs, *paths)
    counts = alignment.pair_counts(found)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
    assert {r["doc"]: tuple(r[c] for c in columns) for r in alignment.scored(found, counts).collect()} == want
    monkeypatch.setattr(alignment, "small_or_shuffled", lambda table: table)
    assert {r["doc"]: tuple(r[c] for c in columns) for r in alignment.scored(found, counts).collect()} == want
    links = alignment.pair_links(docs, *paths).groupBy("doc").count().collect()
    assert {r["doc"]: r["count"] for r in links} == {i: w[3] for i, w in want.items() if w[3]}
    groups = alignment.pair_links(docs, *paths, shared_groups=True).groupBy("doc").count().collect()
    assert {r["doc"]: r["count"] for r in groups} == {i: w[7] for i, w in want.items() if w[7]}


def test_alignment_of_repeated_rows_null_keys_and_nothing(spark):
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.aligned_and_scored(documents(spark, [(1, "s", "one text"), (1, "s", "one text"), (None, None, "one text")]), *paths).collect()
    assert len(rows) == 3 and len({r["count_sum"] for r in rows}) == 1 and rows[0]["count_sum"] == 3 * rows[0]["n_links"]
    assert alignment.aligned_and_scored(documents(spark, []), *paths).collect() == []


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)

    def sparse(m):
        rows = [np.flatnonzero(r) for r in m]
        return alignment.Rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate([m[i][r] for i, r in enumerate(rows)]))

    def dense(m, columns):
        out = np.zeros((len(m.starts) - 1, columns), np.int64)
        for i in range(len(out)):
            out[i, m.indices[m.starts[i]: m.starts[i + 1]]] = m.values[m.starts[i]: m.starts[i + 1]]
        return out

    for _ in range(20):
        a, b = (rng.integers(0, 4, size) * (rng.random(size) < 0.4) for size in ((9, 13), (7, 13)))
        got = dense(alignment.product(sparse(a), alignment.transposed(sparse(b), 13)), 7)
        assert (got == a @ b.T).all()
        parts = [dense(p, 7) for _, p in alignment.blocks(sparse(a), alignment.transposed(sparse(b), 13), limit=5)]
        assert (np.concatenate(parts) == a @ b.T).all()


def test_registered_queries_of_trees(spark, small):
    vectors_ = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op12_nearest_vectors"](spark, small).collect())
    assert got == slow_nearest([(r["vec_id"], r["embedding"]) for r in vectors_], 10)
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, slow_alignment([r["text"] for r in docs]))}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["n_group_links"]) for r in queries.QUERIES["op13_token_alignment"](spark, small).collect()}
    assert got == want
