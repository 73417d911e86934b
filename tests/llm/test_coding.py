"""Packing, piece coding, fingerprints and sharding against libraries and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from pultwerk.llm import packing, piece_coding, sharding, winnowing
from pultwerk.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, size string, ids string, start string, queue string, shard string"
ODD = [
    "", " ", "a", "  zwei  Blanke", "\n\n", "it's we'll I'D <|endoftext|> x", "日本語テキスト 😀👍🏽 é ﬁ", "x\x00y\u2028z\u3000w\t\r\n ", "1234567890 ٣٤ Ⅷ ½",
    "▁ ▁▁a", "a" * 5000, "<s></s><unk> <0x41>", "  a\n b  ", "…“”‘’—", "\ufeffBOM", "ab " * 3000,
]


def odd_rows():
    rows = [(i, t, ["s0", "s1", None][i % 3]) for i, t in enumerate(ODD)]
    return rows + [(100, None, "s0"), (101, ODD[6], None), (101, ODD[6], None), (None, "null key", "s2")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def check_packed(pieces, texts, window):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at, repeats = 0, {}
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert p["doc_tokens"] == len(ids)
            got = np.frombuffer(p["ids"], "<u4").tolist()
            assert got == ids[p["start"]: p["start"] + p["length"]]
            at += p["length"]
        assert at % len(ids) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or number == len(by_sequence) - 1 and at <= window


@pytest.mark.parametrize("targets", [None, {"s0": 0.5, "s1": 0.3, None: 0.2}])
def test_packing_odd_texts(spark, targets):
    rows = odd_rows()
    pieces = packing.pack(table(spark, rows).repartition(3), RANKS, targets, window=64).collect()
    check_packed(pieces, {k: t for k, t, _ in rows}, 64)


def test_ids_equal_the_tokenizer_as_loaded(spark, tmp_path):
    end = "<|endoftext|>"
    texts = [end, f"hello {end} world", f"{end} x", f"x {end}", f"a{end}b", f"a  {end}  b", f"x\n\n{end}\n y", end + end, f"<{end}>", f"<|endof{end}", "<|endoftext|", f" {end} ", *ODD]
    texts += [None, f"it's{end}'s 日本語{end}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizer.encode(texts[1], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for rows in (QUERIES["op1_packing"](spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, docs, "").collect()):
        assert {r["doc_id"] for r in rows} == set(range(len(texts)))
        for r in rows:
            ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]: r["start"] + r["length"]], "<u4").tobytes())


def test_windows_have_the_target_proportions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    targets = {f"src{i}": 1.0 for i in range(1, 20)} | {"src0": 5.0}
    pieces = packing.pack(docs.repartition(4, "doc_id"), RANKS, targets, window=512).collect()
    totals = defaultdict(int)
    share = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        totals[p["queue"]] += p["length"]
        share[p["sequence_id"]][p["queue"]] += p["length"]
    check_packed(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, 512)
    # until the first queue runs dry every window is near its target: queues whose next
    # tokens fall due together may share the last places of a window unevenly
    rounds = min(totals[q] / w for q, w in ((f"={s}", w) for s, w in targets.items()) if q in totals)
    weights = sum(w for s, w in targets.items() if f"={s}" in totals)
    for number in range(int(rounds * weights / 512) - 1):
        for s, w in targets.items():
            if f"={s}" in totals:
                assert abs(share[number][f"={s}"] - 512 * w / weights) <= 1 + len(totals) * w / weights


def test_taken_equals_serving_token_by_token():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(1, 6)
        totals = [rng.randrange(1, 40) for _ in range(n)]
        mixture = packing.Mixture([rng.choice([1, 1, 2, 3.5, 100]) for _ in range(n)], totals)
        order = sorted((((j + 1) / w, q) for q, (t, w) in enumerate(zip(totals, mixture.weights.tolist())) for j in range(t)))
        for handed in range(sum(totals) + 1):
            want = [sum(q == i for _, q in order[:handed]) for i in range(n)]
            assert mixture.taken(np.array([handed]))[0].tolist() == want


def test_windows_are_cut_in_blocks(monkeypatch):
    mixture = packing.Mixture([3000, 7, 500], [300_000, 700, 50_000])
    asked, taken = [], mixture.taken
    monkeypatch.setattr(mixture, "taken", lambda handed: asked.append(len(handed)) or taken(handed))
    for queue, (starts, ends) in enumerate([(np.arange(0, 300_000, 1500), np.arange(1500, 300_001, 1500)), (np.array([0, 699]), np.array([699, 700])), (np.array([100]), np.array([49_000]))]):
        monkeypatch.setattr(packing, "BLOCK", 10 ** 9)
        whole = packing.cut(mixture, queue, starts, ends, 64)
        asked.clear()
        monkeypatch.setattr(packing, "BLOCK", 50)
        for x, y in zip(whole, packing.cut(mixture, queue, starts, ends, 64)):
            assert x.tolist() == y.tolist()
        assert len(asked) > 50 and max(asked) <= 51


@pytest.mark.parametrize("check", ["segments", "texts"])
def test_pieces_equal_the_library(spark, check):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_rows()
    rng = random.Random(4)
    rows += [(1000 + i, "".join(chr(rng.choice([32, 32, 97, 101, 110, 228, 0x3B1, 0x4E00 + rng.randrange(900), 0x1F600, 10])) for _ in range(rng.randrange(80))), "s") for i in range(150)]
    got = defaultdict(set)
    for r in piece_coding.coded(table(spark, rows), PIECES, check=check).collect():
        got[r["doc_id"]].add((bytes(r["ids"]), r["decoded"]))
    for key, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[key] == {(np.array(ids, "<u4").tobytes(), library.decode(ids))}


def test_agenda_joins_best_then_leftmost():
    pieces = piece_coding.pieces(PIECES)
    library = pieces.library
    for word in ["the", "internationalisation", "aaaaaaaaa", "ñandú", "qzxqzx", "ererererer"]:
        assert "".join(pieces.agenda(word)) == word
        assert library.encode("\n" + word)[2:] == pieces.encode_segment(word)


def slow_fingerprint(text, k, w):
    hashes = winnowing.gram_hashes(winnowing.code_points(text), k)
    cut = [int(h) >> 24 for h in hashes]
    w, chosen = min(w, len(cut)), set()
    for i in range(len(cut) - w + 1 if cut else 0):
        least = min(cut[i: i + w])
        chosen.add(max(j for j in range(i, i + w) if cut[j] == least))
    return [(j, cut[j]) for j in sorted(chosen)]


def test_winnowing_equals_the_definition():
    rng = random.Random(6)
    for k, w in ((1, 1), (3, 4), (5, 8), (25, 76)):
        for n in (0, 1, 2, 5, 30, 200, 700):
            text = "".join(rng.choice("ab 😀ñ") for _ in range(n))
            at, hashes = winnowing.fingerprint(text, k, w)
            assert list(zip(at.tolist(), hashes.tolist())) == slow_fingerprint(text, k, w)
    # equal grams have equal hashes wherever they stand
    h = winnowing.gram_hashes(winnowing.code_points("abcdeXabcde"), 5)
    assert h[0] == h[6] and len(set(h.tolist())) == 6


def test_shared_passages_are_found(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.W - 1))
    for _ in range(20):
        a, b = ("".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(300))) + passage + "".join(rng.choice("qrstuv ") for _ in range(200)) for _ in range(2))
        assert winnowing.likeness(winnowing.fingerprint(a), winnowing.fingerprint(b)) > 0


def test_half_edited_short_texts_are_alike():
    rng = random.Random(10)
    for n in (60, 80, 100, 150, 200):
        found = []
        for _ in range(100):
            text, after = ("".join(rng.choice("abcdefgh ijklmnop") for _ in range(n)) for _ in range(2))
            found.append(winnowing.likeness(winnowing.fingerprint(text), winnowing.fingerprint(winnowing.edited(text, after))))
        assert min(found) > 0.05 and np.mean(found) > 0.25


def test_next_documents_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(i * 7 - 300, "".join(rng.choice("abcd efg") for _ in range(rng.choice([0, 1, 30, 400]))), "s") for i in range(120)]
    rows[5] = (rows[5][0], None, "s")
    got = {r["doc_id"]: r for r in winnowing.next_compared(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (key, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        changed = winnowing.edited(text or "", after or "")
        assert got[key]["edited_text"] == changed
        assert got[key]["near_next"] == winnowing.likeness(winnowing.fingerprint(text or ""), winnowing.fingerprint(after or ""))
        assert got[key]["fingerprint"] == winnowing.written(winnowing.fingerprint(text or ""))


def test_next_documents_of_small_and_repeated_tables(spark):
    assert winnowing.next_compared(table(spark, [])).collect() == []
    (one,) = winnowing.next_compared(table(spark, [(5, "abcd", "s")])).collect()
    assert (one["edited_text"], one["near_next"]) == ("abab", 1.0)
    assert winnowing.next_compared(table(spark, [(5, "x", "s"), (5, "x", "s"), (None, "y", "s")])).count() == 3


def test_shards_are_level_and_gapless(spark):
    rows = [(i, "x" * (i * 37 % 1000), "s") for i in range(3000)] + [(9000, None, "s"), (9000, None, "s"), (None, "n", "s"), (9001, "y" * 3000, "s")]
    docs = table(spark, rows)
    placed = sharding.shard_documents(docs, 24).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in placed:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sum(sizes.values()) == sum(len((t or "").encode()) + 8 for _, t, _ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 3008
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["text_crc32"]) for r in placed} == {(k, zlib.crc32((t or "").encode())) for k, t, _ in rows}
    assert sharding.shard_documents(table(spark, []), 24).collect() == []


def test_rebalancing_moves_little(spark, tmp_path):
    loads = [(s, (s * 7919) % 500 + 1, 3) for s in range(2048)]
    first = sharding.first_map(loads, 24, 2048)
    assert sharding.rebalanced(first, loads, 24) == first
    grown = sharding.rebalanced(first, loads, 25)
    moved = sum(size for s, size, _ in loads if grown[s] != first[s])
    total = sum(size for _, size, _ in loads)
    assert moved < 1.2 * total / 25 and {grown[s] for s in grown if grown[s] != first[s]} == {24}
    fewer = sharding.rebalanced(first, loads, 20)
    assert set(fewer.values()) == set(range(20))
    sharding.write_map(spark, first, loads, str(tmp_path), 1)
    sharding.write_map(spark, grown, loads, str(tmp_path), 2)
    assert {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path), 1).collect()} == first
    assert {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path), 2).collect()} == grown


def test_queries_over_the_small_tables(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in QUERIES["op4_sentencepiece"](spark, small).collect():
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    keys = sorted(texts)
    after = dict(zip(keys, keys[1:] + keys[:1]))
    for r in QUERIES["op8_fingerprints"](spark, small).collect():
        assert r["edited_sha256"] == hashlib.sha256(winnowing.edited(texts[r["doc_id"]], texts[after[r["doc_id"]]]).encode()).hexdigest()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for r in QUERIES["op1_packing"](spark, small).collect():
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]: r["start"] + r["length"]], "<u4").tobytes())
    placed = QUERIES["op10_sharding"](spark, small).collect()
    assert {r["law"] for r in placed} == {"bytes"} and len(placed) == len(texts)
