import base64
import cProfile
import hashlib
import pstats
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestack.llm import bpe, packing

RANKS = public.path("byte_bpe_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")
ODD = list("aaabcdefgh  \n\t.,'’s1234\x1c\x85 éß漢🙂​　ÉΣİ") + ["'s", "'re", "the ", "ing ", "    ", "é", "<|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", "a" * 5000, "ab" * 3000, "  ", "x ", "\n\n a", " a", "the the", "word " * 20000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(reference):
    codec = bpe.ByteBpe(RANKS, public.PATTERN)
    some = texts(2000)
    for text, packed in zip(some, codec.encode(some)):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_a_full_cache_changes_nothing():
    codec, small = bpe.ByteBpe(RANKS, public.PATTERN), bpe.ByteBpe(RANKS, public.PATTERN)
    small.cache.most = 5
    some = texts(50, 2)
    assert codec.encode(some) == [small.encode([t])[0] for t in some]


def test_digests_of_a_table(spark, reference):
    rows = [(1, "Hello there, world", 9), (1, "Hello there, world", 9), (2, None, 9), (None, "", 9), (4, "x " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.digests(df, RANKS, public.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), RANKS, public.PATTERN).count() == 0


def test_encode_then_decode_a_table(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_documents(df, RANKS, public.PATTERN), RANKS, public.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: b"one two", 2: b""}


def test_word_bpe_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), packing.WordBpe(WORDS)
    some = texts(1500, 3)
    for text, packed in zip(some, own.encode(some)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_bpe_with_a_full_cache_and_words_of_all_lengths():
    """Words are replayed by columns up to a length, and otherwise one by one; what the cache forgets is made again."""
    rng = random.Random(11)
    library, own = Tokenizer.from_file(WORDS), packing.WordBpe(WORDS)
    own.cache.most = 40
    for k in range(12):
        some = ["".join(rng.choices("aabéthe-1ñ", k=n)) for n in (*range(1, 60), 300)] + ["a" * n for n in range(1, 60)] + ["ab" * n for n in range(1, 30)]
        some = [" ".join(rng.choices(some, k=40)) for _ in range(20)] + ["漢" * 30, "", " \n ", "the the", f" {k}"]
        for text, packed in zip(some, own.encode(some)):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert [own.encode(x) for x in ([], [""], [" "])] == [[], [b""], [b""]]
    own.cache.keep(10)
    assert len(own.cache) <= 10 and own.encode(some) == packing.WordBpe(WORDS).encode(some)


def test_word_bpe_spelt_in_parts(monkeypatch):
    some = [*texts(300, 4), "", "", "one two three"]
    whole = packing.WordBpe(WORDS).encode(some)
    for most in (1, 7, 100):
        monkeypatch.setattr(packing, "SPELT_WORDS", most)
        assert packing.WordBpe(WORDS).encode(some) == whole


def test_word_bpe_takes_no_call_for_each_word():
    """Words are looked up, cut and replayed together: calls for each of them made half of the time."""
    rng = random.Random(7)
    words = list(dict.fromkeys(f"{rng.choice(['th', 'é', 'ou'])}{rng.getrandbits(40):x}," for _ in range(30_000)))
    own, profile = packing.WordBpe(WORDS), cProfile.Profile()
    profile.runcall(own.encode, [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
    assert pstats.Stats(profile).total_calls < len(words)


def check_packing(rows, pieces, window):
    library = Tokenizer.from_file(WORDS)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and (at == window or s == len(by_seq) - 1)
    return by_seq


def test_packing_is_whole_and_proportional(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 300))), "abc"[min(2, i % 5)]) for i in range(200)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "long " * 9000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = [r.asDict() for r in packing.with_crc(packing.pack(df, WORDS, window=512, quantum=32)).collect()]
    by_seq = check_packing(rows, pieces, 512)
    total = sum(p["length"] for p in pieces)
    for source in "abc":
        share = sum(p["length"] for p in pieces if p["source"] == source) / total
        for s, ps in by_seq.items():
            if s < len(by_seq) - 1:
                held = sum(p["length"] for p in ps if p["source"] == source)
                assert abs(held - share * 512) <= 4 * 32


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7)], "doc_id long, text string, source string, part int")
    pieces = packing.pack(df, WORDS).collect()
    assert sorted((p.sequence_id, p.offset, p.length) for p in pieces) == [(0, 0, 3), (0, 3, 3)]
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_packing_with_targets_keeps_every_token(spark):
    rows = [(i, "one two three four " * 50, "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = [r.asDict() for r in packing.with_crc(packing.pack(df, WORDS, window=256, quantum=16, targets={"a": 3.0, "b": 1.0})).collect()]
    by_seq = check_packing(rows, pieces, 256)
    assert abs(sum(p["length"] for p in by_seq[0] if p["source"] == "a") - 192) <= 32
