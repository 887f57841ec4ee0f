import hashlib
import random
import sys
import zlib

import numpy as np
from callproof.llm import _common, bpe, packing
from tokenizers import Tokenizer

PATH = bpe.vocabulary()
LETTERS = "abcdefghijklmnopqrstuvwxyz'  \n\t  éßÀŹΣςσİǅ12٣Ⅷ½🙂ﬁ한글ひら\x1c\x85​́!?<|>#$-_\x00H̱"
PIECES = ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "the", "ing", " <|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) if rng.random() < 0.05 else rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*out, "", None, "a" * 3000, "word " * 30_000, "same", "same"]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def frame(spark, values):
    return spark.createDataFrame([(k if k % 7 else None, t, "clash", 1) for k, t in enumerate(values)], "doc_id long, text string, ids string, length int")


def test_encoding_and_decoding_equal_the_library(spark):
    t = library()
    values = texts(3000)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in values]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for i in ids)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(frame(spark, values), PATH).collect())
    assert got == want


def test_failing_words_only_are_merged_exactly():
    b = bpe.Bpe(PATH)
    b.encode("the the the and of")
    assert b.exact_words == 0
    rng = random.Random(2)
    words = {"".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))) for _ in range(2000)}
    t = library()
    assert all(b.encode(w).tolist() == t.encode(w, add_special_tokens=False).ids for w in words)
    assert 0 < b.exact_words < len(words)


def test_new_words_are_merged_together(monkeypatch):
    """Failing words and pairs not judged before go through numpy in few steps; only words of many letters are merged alone."""
    alone = []
    monkeypatch.setattr(bpe.Bpe, "merge", lambda self, symbols, f=bpe.Bpe.merge: alone.append(len(symbols)) or f(self, symbols))
    b, t, rng = bpe.Bpe(PATH), library(), random.Random(8)
    words = sorted({"".join(rng.choices("abcdeinorstéßς한", k=rng.randint(1, 10))) for _ in range(3000)})
    text = " ".join(words)
    assert b.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert b.exact_words > 100 and not alone
    long = " ".join("".join(rng.choices("abcdeinorst", k=k)) for k in range(1, 140))
    assert b.encode(long).tolist() == t.encode(long, add_special_tokens=False).ids
    assert alone and min(alone) > bpe.ROW_LETTERS


def test_merging_together_equals_merging_alone(monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 7)
    b, rng = bpe.Bpe(PATH), random.Random(5)
    words = [[rng.choice(b"aeinorsthx\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 9, 31, 32, 33, 64, 65, 90]))] for _ in range(300)] + [[97] * 32, [97] * 31]
    for w in words:
        w[-1] += bpe.LAST
    ids, counts = b.merge_all(np.array([c for w in words for c in w]), np.array([*map(len, words)]))
    want = [b.merge([b.code_symbols[c] for c in w]) for w in words]
    assert counts.tolist() == [*map(len, want)] and ids.tolist() == [i for w in want for i in w]
    empty = b.merge_all(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(empty[0]) == len(empty[1]) == 0


def test_numbers_by_numbers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 5000, 3000))
    table = bpe.Numbers(keys, np.arange(len(keys)))
    want = dict(zip(keys.tolist(), range(len(keys)), strict=True))
    asked = np.arange(-2, 6000)
    assert table.get(asked).tolist() == [want.get(k, -1) for k in asked.tolist()]
    assert bpe.Numbers(keys[:0], keys[:0]).get(asked).max() == -1


def test_long_words_merge_as_short_ones():
    b = bpe.Bpe(PATH)
    word = "abcabcinthethere" * 3
    assert b.merge(b.symbols(word)) == b.merge_long(b.symbols(word))


def test_tables_stay_right_when_they_are_full(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 40)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 200)
    b, t = bpe.Bpe(PATH), library()
    table = bpe.ChunkTable(b.chunks, lambda c: map(tuple, b.encode_chunks(c)))
    values = texts(400, seed=9)[:-6] + ["the quick brown fox"] * 20
    for text, got in zip(values, table.texts(values), strict=True):
        assert [i for v in got for i in v] == t.encode(text, add_special_tokens=False).ids


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1]
    assert packing.piece_lengths(2048) == [2048]
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert all(sum(packing.piece_lengths(n)) == n and all(x & (x - 1) == 0 and x <= 2048 for x in packing.piece_lengths(n)) for n in range(1, 9000, 7))


def test_packing_against_the_library(spark):
    t = library()
    values = texts(600, seed=4)
    got = packing.packed(frame(spark, values), PATH).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    want = []
    for x in values:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want.append((at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), ids[at : at + n].tolist()))
            at += n
    assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]) for r in got) == sorted(want)
    assert packing.packed(frame(spark, values).limit(0), PATH).count() == 0
    drawn = packing.batches(packing.packed(frame(spark, values), PATH), tokens=4096)
    sizes = drawn.groupBy("batch").agg({"length": "sum", "bucket": "max"}).collect()
    assert all(r["sum(length)"] <= 4096 for r in sizes)


def test_ids_of_packing_stay_right_when_tables_are_full(monkeypatch):
    monkeypatch.setattr(packing, "PARTS_KEPT", 20)
    table, t = packing.IdTable(PATH, 40), library()
    values = texts(400, seed=12)[:-6] + ["the quick brown fox"] * 20
    for text in [*values, None, "", "tab\x7f\x00end <|endoftext|>x<|startoftext|>"]:
        assert np.frombuffer(table.ids(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
    assert len(table.parts) <= 20


def test_packing_asks_once_for_the_ids_of_a_piece():
    """Each piece is looked up in one table, and a new one goes through the model once; marks at its end do not make a new word."""
    table = packing.id_table(PATH)
    asked = []
    table.tokenize = lambda w, f=table.tokenize: asked.append(w) or f(w)
    text = " ".join(f"qzx{'abcdefghij'[k % 10]}v{mark}" for k in range(200) for mark in ("", ".", "$$$", ","))
    table.ids(text)
    assert len(asked) <= 40 + 3
    before = len(asked)
    table.ids(text)
    assert len(asked) == before
    _common.KEPT.clear()


def test_packing_without_ids_equals_packing_with(spark):
    docs = frame(spark, texts(200, seed=6))
    with_ids = packing.packed(docs, PATH)
    without = packing.packed(docs, PATH, with_ids=False)
    assert without.columns == with_ids.drop("ids").columns and without.exceptAll(with_ids.drop("ids")).count() == 0 and without.count() == with_ids.count()


def test_tables_of_other_uses_are_dropped():
    table = packing.id_table(PATH)
    table.ids("kept for later tasks")
    assert packing.id_table(PATH) is table and "later" in table
    _common.give_back()
    assert not _common.KEPT and packing.id_table(PATH) is not table


def test_a_worker_s_table_of_pieces_is_small():
    """It holds no vocabulary and merges beside the library's, and when full it takes tens of MB."""
    table = packing.id_table(PATH)
    assert not hasattr(table.split, "ranks") and not hasattr(table.split, "vocab")
    table.made = lambda words: bytes(12)
    for k in range(0, 800_000, 1000):
        table.ids(" ".join(map("piece{}".format, range(k, k + 1000))))
    held = [*table.items(), *table.old.items()]
    _common.KEPT.clear()
    assert sum(sys.getsizeof(x) for row in held for x in row) + sys.getsizeof(table) + sys.getsizeof(table.old) < 60_000_000
