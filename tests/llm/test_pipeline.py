"""The corpus pipeline as a whole, against each stage by brute force on the stage's own input."""

import random

import pytest
import xxhash

import corpus_pipeline
from lodestack.llm import paragraphs, quality

D = "/root/testdata/sf0.001"


def fingerprint(text):
    ws = text.encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def first_of_components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {i for i in ids if root[i] == i}


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = corpus_pipeline.classify(spark, docs, D)
    scored = quality.classify(docs, spark.read.parquet(f"{D}/labels.parquet")).collect()
    before = texts_of(good)
    assert good.columns == docs.columns and set(before) == {r.doc_id for r in scored if r.predicted}

    kept = corpus_pipeline.near_copies(spark, good, D)
    left = texts_of(kept)
    prints = {i: fingerprint(t) for i, t in before.items()}
    ids = sorted(before)
    once = first_of_components(ids, [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    sets = {i: paragraphs.shingles(before[i].lower().split(), 5) for i in once if before[i].split()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(left) == first_of_components(sorted(once), near) and kept.columns == docs.columns

    cut = corpus_pipeline.passages(spark, kept, D)
    clean, known = texts_of(cut), {}
    assert set(clean) == set(left) and cut.columns == docs.columns
    for i in sorted(left):
        ws, gone = left[i].lower().split(), set()
        for k in range(len(ws) - 49):
            where, at = known.setdefault(tuple(ws[k : k + 50]), (i, k))
            if where != i or k - at >= 50:
                gone |= set(range(k, k + 50))
        want, got = [w for k, w in enumerate(ws) if k not in gone], clean[i].lower().split()
        # Near copies of whole lines may go as well; nothing else does, and no verbatim passage stays.
        assert len(got) <= len(want) and (gone or len(want) - len(got) == 0 or len(want) - len(got) >= 50)
    assert any(clean[i] != left[i] for i in left)
    assert {r.doc_id: r.n_chars for r in cut.collect() if clean[r.doc_id] != left[r.doc_id]} == {i: len(clean[i]) for i in left if clean[i] != left[i]}

    pieces = corpus_pipeline.pack(spark, cut, D).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(clean)
    for ps in by_doc.values():
        ends = [0]
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == ends[-1]
            ends.append(p.start + p.length)
        assert ends[-1] == ps[0].doc_tokens
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096

    run = sorted(tuple(r) for r in corpus_pipeline.run(spark, D).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect())
    assert [(i, n, m) for i, n, m in run] == sorted((i, ps[0].doc_tokens, ps[0].doc_tokens) for i, ps in by_doc.items())


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (2, ""), (None, "a b c"), (3, " ".join(random.Random(1).choices("abcdefgh", k=70))), (3, "x")]])
def test_stages_take_nulls_empty_and_repeated_rows(spark, tmp_path, rows):
    """Nulls, empty texts, repeated rows and an empty table go through every stage; a clashing column is left behind."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score_ string"
    docs = spark.createDataFrame([(i, t, "en", None, None, "s") for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert good.columns == docs.columns[:5]
    for f in (corpus_pipeline.near_copies, corpus_pipeline.passages):
        out = f(spark, docs.drop("score_"), str(tmp_path))
        assert out.columns == good.columns and out.count() <= len(rows)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert len({p.doc_id for p in packed}) == len({i for i, _ in rows}) and all(p.length > 0 for p in packed)
