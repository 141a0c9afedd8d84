import base64
import hashlib
import zlib

import numpy as np
import pytest

from lodestack.llm import licenses, quality, quotations, warc


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "First thing.\nSecond thing here."),
        (1, 1, "assistant", "> First thing.\n\nAn answer."),
        (1, 2, "user", ">> first THING\n> An answer.\nAnd on."),
        (1, 3, "user", "> no such words\nNew."),
        (1, 4, "assistant", "> First\n> thing. Second thing here.\nWrapped anew."),
        (1, 5, "user", None),
        (2, 0, "user", "> First thing.\nOther conversation."),
        (None, 0, "user", "> a\nb"),
        (2, 1, "user", ""),
        (1, 1, "assistant", "> First thing.\n\nAn answer."),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")
    got = {(r.conv_id, r.turn): r for r in quotations.link(df).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 1].text == "\nAn answer." and got[1, 1].thread_root == 0
    assert got[1, 2].reply_to == 1 and got[1, 2].quote_depth == 2 and got[1, 2].thread_root == 0 and got[1, 2].text == "And on."
    assert got[1, 2].linked_passages == 2
    assert got[1, 3].reply_to is None and got[1, 3].quoted_lines == 1 and got[1, 3].thread_root == 3
    assert got[1, 4].reply_to == 0 and got[1, 4].text == "Wrapped anew."
    assert got[1, 5].text is None and got[1, 5].quoted_lines == 0
    assert got[2, 0].reply_to is None and got[None, 0].text == "b" and got[2, 1].text == ""
    assert quotations.link(df).count() == len(rows)
    assert quotations.link(df.limit(0)).count() == 0


def test_chain_of_replies(spark):
    rows = [(1, t, "user", (f"> message {t - 1}\n" if t else "") + f"message {t}") for t in range(30)]
    got = quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread_root == 0 and r.reply_to == (r.turn - 1 if r.turn else None) for r in got)


def test_license_scan(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"]
    filler = " ".join(f"w{i}" for i in range(4000))
    rows = [
        (1, f"{filler}\nReleased under the MIT License.\n{filler}"),
        (2, gpl.upper().replace(",", " --")),
        (3, filler + " " + gpl.replace("work is", "work, though, is")),
        (4, "licensed under the"),
        (5, None),
        (6, ""),
        (7, filler + " Licensed under the Apache License, Version 2.0. " + gpl),
        (8, "This work is licensed under the General Public License"),
        (1, "again"),
    ]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")).collect()}
    assert sorted(got) == [(1, "MIT"), (2, "GPL-3.0"), (7, "Apache-2.0"), (7, "GPL-3.0")]
    assert got[2, "GPL-3.0"].containment == 1.0 and got[1, "MIT"].first_word > 3990
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"x": "too short"})


def test_license_containment_equals_plain_search(spark):
    import random

    rng = random.Random(1)
    words = [f"t{i}" for i in range(60)]
    templates = {f"T{n}": " ".join(rng.choices(words, k=n)) for n in (5, 9, 14, 30)}
    rows = []
    for i in range(60):
        text = rng.choices(words, k=rng.randint(0, 80))
        for t in rng.sample(sorted(templates), 2):
            part = templates[t].split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = part
        rows.append((i, " ".join(text)))
    want = set()
    for i, text in rows:
        w = text.split()
        sh = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for t, body in templates.items():
            need = licenses.template_shingles(body)
            c = 1
            while c < len(need):
                c *= 2
            if any(len(set(need) & set(sh[k : k + 2 * c])) >= 0.8 * len(need) for k in range(0, len(sh), c)):
                want.add((i, t))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == want and len(want) > 60


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "<p>one</p>"), (3, "http://b/", "<p>one</p>"), (9, "http://c/é\r\nX: y", "zwei ß"), (10, None, None), (11, "u", ""), (None, "v", "zwei ß"), (3, "http://b/", "<p>one</p>"), (12, "w", "long " * 400000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(df)
    got = {(r.page_id, r.record_type): r for r in warc.read_archives(index).collect()}
    for i, url, html in rows:
        body = (html or "").encode()
        r = next(x for k, x in got.items() if k[0] == i)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload is None or bytes(r.payload) == body
    assert {k: r.refers_to for k, r in got.items() if k[1] == "revisit"} == {(5, "revisit"): 3, (None, "revisit"): 9, (11, "revisit"): 10}
    some = warc.read_archives(index.where("page_id = 12")).collect()
    assert [bytes(r.payload) for r in some] == [b"long " * 400000]
    assert warc.round_trip(df).count() == len(rows) and warc.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(df, least_bytes=1000).collect()} == {"response"}


def test_warc_notices_damage(spark, tmp_path):
    spark.range(1)
    page = warc.record(1, "u", b"abc", "WRONG", None, "2024-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(page)
    index = spark.createDataFrame([(1, str(tmp_path / "a.warc.gz"), 0, len(page), "u", "WRONG", "response", None)], warc.INDEX_DDL)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(index).collect()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    size = quality.STATISTICS + quality.BUCKETS
    m = quality.Machine(0.3, rng.standard_normal(size), rng.standard_normal((size, quality.FACTORS)) * 0.3)
    made = [quality.features(t) for t in ("one two three two", "", None, "A $$ b\n9")]
    starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in made])[:-1]))
    got = m.logits(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), starts)
    for (idx, val), z in zip(made, got):
        want = m.bias + float((m.linear[idx] * val).sum())
        for a in range(len(idx)):
            for b in range(a):
                want += float(m.factors[idx[a]] @ m.factors[idx[b]]) * float(val[a]) * float(val[b])
        assert abs(z - want) < 1e-6


def test_quality_learns_and_handles_odd_rows(spark):
    import random

    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + "$$" if bad else w for w in words), 1))
        labels.append((i, 0 if bad else 1))
    docs += [(1000, None, 1), (1001, "", 1), (None, "plain words", 1), (5, docs[5][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    y = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = [r.asDict() for r in quality.classify(d, y).collect()]
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert "score" in quality.keep_good(d, y).columns
    assert all(r.predicted == 1 for r in quality.classify(d, y.limit(0)).collect())
    assert quality.classify(d.limit(0), y).count() == 0


def test_warc_notices_records_that_differ_from_the_index(spark, tmp_path):
    page = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, "2024-01-01T00:00:00Z")
    again = warc.record(2, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 1, "2024-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(page + again)
    rows = lambda first, refers: [(first, str(tmp_path / "a.warc.gz"), 0, len(page), "u", "", "", None), (2, str(tmp_path / "a.warc.gz"), len(page), len(again), "u", "", "", refers)]
    assert warc.read_archives(spark.createDataFrame(rows(1, 1), warc.INDEX_DDL)).count() == 2
    for first, refers in ((3, 1), (1, 5), (1, None)):
        with pytest.raises(Exception, match="not what the index says"):
            warc.read_archives(spark.createDataFrame(rows(first, refers), warc.INDEX_DDL)).collect()


def test_warc_archives_open_with_a_description(spark):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "v", "x"), (2, "v", "x"), (None, "w", "x")], "page_id long, url string, html string"))
    first = min(index.collect(), key=lambda r: (r.file, r.offset))
    at, path = first.offset, first.file.removeprefix("file://")
    with open(path, "rb") as f:
        fields, _, _ = warc.parse(f.read(at))
    assert fields["warc-type"] == "warcinfo" and fields["warc-filename"] == path.rpartition("/")[2]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(index).collect()) == [("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("None", "revisit", 1)]
