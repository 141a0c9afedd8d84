import random
import re

import numpy as np
import pytest
import xxhash

from lodestack.llm import common, jaccard, paragraphs, queries, simhash
from lodestack.llm.components import components


def brute_components(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    return root


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    want = brute_components(261, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "a b"]
    base = [" ".join(rng.choices(vocabulary, k=150)) for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(40)]
    for i in range(40, 160):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "X"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (203, "one"), (204, "one two"), (None, base[0]), (205, "tok\x0bA b\tc " * 3000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    root = brute_components(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(set(root)) < len(set(fps))


def test_links_in_long_lists_are_exact(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    fps = np.array(sorted({rng.getrandbits(9) << 7 for _ in range(220)}), np.uint64)
    few = simhash._links_in_list(fps, 2)
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    many = simhash._links_in_list(fps, 2)
    place = {int(f): i for i, f in enumerate(fps)}
    as_roots = lambda links: brute_components(len(fps), [(place[a], place[b]) for a, b in links])
    assert as_roots(few) == as_roots(many)
    assert all(bin(a ^ b).count("1") <= 2 for a, b in many)


def test_keep_first_keeps_one_of_each_group(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text, 1), (1, text, 1), (2, "else where is it", 1)], "doc_id long, text string, fp int")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 2]
    assert simhash.keep_first(df.limit(0)).count() == 0


def words(rng, n):
    return [f"v{rng.randrange(5000)}" for _ in range(n)]


def plain_removals(rows, threshold=0.8, k=5, min_words=50):
    paras = []
    for place, (doc, text) in enumerate(rows):
        nth = 0
        for line, x in enumerate((text or "").split("\n")):
            if x.split():
                paras.append((doc, place, line, nth, x.lower().split()))
                nth += 1
    sets = [paragraphs.shingles(p[4], k) for p in paras]
    links = [(a, b) for a in range(len(paras)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    root = brute_components(len(paras), links)
    key = lambda p: (p[0] is not None, p[0] or 0, p[1], p[2])
    first = {}
    for p, r in zip(paras, root):
        first[r] = min(first.get(r, key(p)), key(p))
    out = {i: [] for i in range(len(rows))}
    run = []

    def flush():
        if sum(len(p[4]) for p in run) >= min_words:
            out[run[0][1]] += [p[2] for p in run]
        run.clear()

    for p, r in zip(paras, root):
        if run and run[-1][1] != p[1]:
            flush()
        if key(p) != first[r]:
            run.append(p)
        else:
            flush()
    flush()
    return out


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(4)
    shared = [words(rng, n) for n in (60, 70, 12, 45)]
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randint(1, 40)) for _ in range(4)]
        pick = rng.randrange(4)
        if pick == 0:
            lines.insert(2, shared[0])
        elif pick == 1:  # a near copy
            near = list(shared[1])
            near[rng.randrange(len(near))] = "changed"
            lines.insert(1, near)
        elif pick == 2:  # a passage of several short lines, with a blank one among them
            lines[1:1] = [shared[2], [], shared[3]]
        else:
            lines.insert(0, shared[2])  # a short line that recurs stays
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " ".join(words(rng, 30000)))]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], "doc_id long, text string, place_ string, facts_ int").coalesce(1)
    got = {r.doc_id: r for r in paragraphs.remove_repeats(df).collect()}
    want = plain_removals(rows)
    assert {i: got[i].removed_lines for i, _ in rows} == {i: want[k] for k, (i, _) in enumerate(rows)}
    for k, (i, text) in enumerate(rows):
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[k])
        assert got[i].text == left and got[i].place_ == "c"
    assert sum(map(len, want.values())) > 20
    assert paragraphs.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_keep_one_passage(spark):
    text = " ".join(words(random.Random(5), 60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string").coalesce(1)
    left = sorted((r.doc_id is None, r.text) for r in paragraphs.remove_repeats(df).collect())
    assert left == [(False, ""), (False, ""), (True, text)]


@pytest.mark.parametrize("j", [0.8, 0.9])
def test_bands_reach_the_recall(j):
    b = paragraphs.bands_for(0.8)
    assert 1 - (1 - j**paragraphs.ROWS) ** b >= paragraphs.RECALL


def test_passages_within_lines_go(spark, tmp_path):
    """Copied passages that begin and end inside lines, against brute force over runs of 50 words."""
    rng = random.Random(6)
    shared = words(rng, 66)
    rows = []
    for i in range(12):
        a, z = words(rng, rng.randint(30, 90)), words(rng, rng.randint(30, 90))
        part = shared if i % 3 else shared[: rng.choice([49, 50, 51])]
        one = " ".join([*a, *part[:20]]) + ("\n" if i % 2 else " ") + " ".join([*part[20:], *z])
        rows.append((i, one.title() if i == 5 else one))
    rows += [(20, "again and " * 150), (21, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_paragraphs(spark, str(tmp_path)).collect()}
    known = {}
    for i, text in rows:
        ws = (text or "").lower().split()
        gone = set()
        for k in range(len(ws) - 49):
            where, at = known.setdefault(tuple(ws[k : k + 50]), (i, k))
            if where != i or k - at >= 50:
                gone |= set(range(k, k + 50))
        assert (got[i].text or "").lower().split() == [w for k, w in enumerate(ws) if k not in gone], i
        assert bool(got[i].removed_lines) == bool(gone)
    assert got[21].text is None and got[20].text.split() == ["again", "and"] * 25


def test_pipeline_drops_similar_documents(spark):
    """Near copies at a five-word similarity of 0.8 or more, which SimHash at two bits lets pass."""
    import corpus_pipeline

    rng = random.Random(7)
    rows = []
    for g in range(15):
        base = words(rng, 200)
        rows.append((100 * g, base))
        for i in range(1, 4):
            near = list(base)
            for at in rng.sample(range(200), 3 if i < 3 else 30):
                near[at] = "changed"
            rows.append((100 * g + i, near))
    rows += [(9000, []), (9001, ["one"])]
    sets = [paragraphs.shingles(ws, 5) for _, ws in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] and rows[b][1] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = brute_components(len(rows), links)
    want = [i for k, (i, _) in enumerate(rows) if root[k] == k]
    df = spark.createDataFrame([(i, " ".join(ws), "en", "s", 1) for i, ws in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()) == want
    assert len(want) < len(rows) - 15


def as_set(ws, k=5):
    return sorted({int.from_bytes(xxhash.xxh3_64_digest(" ".join(x)), "little", signed=True) for x in paragraphs.shingles(ws, k)})


def test_buckets_go_by_distinct_shingles(spark):
    """A line of repeated words is long in words and small in distinct shingles."""
    first = [f"w{i}" for i in range(79)]
    rows = [(1, first), (2, [f"x{i}" for i in range(100)]), (3, first[:74] * 2)]
    df = spark.createDataFrame([(5, i, as_set(ws), False) for i, ws in rows], "key long, cls long, sh array<long>, crowd boolean")
    with common.Scratch(spark, "test") as scratch:
        assert [sorted(r) for r in jaccard.similar_links(df, 0.8, scratch).collect()] == [[1, 3]]


@pytest.mark.parametrize("tile", [16, 512])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, tile):
    """Large buckets (centres, prefixes, tiles) against all pairs: near copies, half copies and strangers."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(25)]
    rows = []
    for i in range(160):
        ws = list(base)
        kind = i % 4
        if kind == 0:  # differs at one end
            ws[rng.choice([0, 1, 23, 24])] = f"x{rng.randrange(6)}"
        elif kind == 1:  # a tail of its own
            n = rng.randrange(2, 12)
            ws[25 - n :] = [f"y{rng.randrange(4)}_{j}" for j in range(n)]
        elif kind == 2:
            ws = [f"z{rng.randrange(3)}_{j}" for j in range(rng.randrange(3, 30))]
        rows.append(ws)
    sets = [set(as_set(ws)) for ws in rows]
    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = brute_components(n, links)
    df = spark.createDataFrame([(key, i, sorted(x), True) for key in (1, 2) for i, x in enumerate(sets)], "key long, cls long, sh array<long>, crowd boolean")
    with common.Scratch(spark, "test") as scratch:
        got = [(r.u, r.v) for r in jaccard.similar_links(df, 0.8, scratch).collect()]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in got)
    assert brute_components(n, got) == want and 3 < len(set(want)) < n - 10


def test_near_members_out_of_reach_are_not_spread(spark, monkeypatch):
    """Of a crowded bucket only those members meet by shingles that can link with one that the centre does not reach."""
    asked = []

    def prefixes(members, threshold, put=jaccard._prefixes):
        asked.extend(r.cls for r in members.select("cls").collect())
        return put(members, threshold)

    monkeypatch.setattr(jaccard, "_prefixes", prefixes)
    base = list(range(100))
    rows = [(1, base), *[(i, [*base[:98], 1000 + i]) for i in range(2, 30)], (30, base[:84]), (31, base[:75]), (32, list(range(500, 550)))]
    df = spark.createDataFrame([(5, i, x, True) for i, x in rows], "key long, cls long, sh array<long>, crowd boolean")
    with common.Scratch(spark, "test") as scratch:
        got = {tuple(sorted((r.u, r.v))) for r in jaccard.similar_links(df, 0.8, scratch).collect()}
    assert sorted(asked) == [30, 31, 32] and (30, 31) in got and {(1, i) for i in range(2, 31)} <= got


def test_arrays_and_sets_join_the_same_parts():
    rng = random.Random(12)
    for n in (2, 12, 60):
        sets = sorted((sorted(rng.sample(range(26), rng.randrange(1, 25))) for _ in range(n)), key=len)
        for near in ([False] * n, [rng.random() < 0.3 for _ in range(n)]):
            start = [i for i in range(n) if near[i]]
            links = [(a, b) for a in range(n) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
            want = brute_components(n, [*links, *zip(start, start[1:])])
            for way in (jaccard._links_of_few, jaccard._links_of_many):
                got = way(list(range(n)), near, [np.array(x, np.int64) for x in sets], 0.8)
                assert {tuple(sorted(x, reverse=True)) for x in got} <= set(links)
                assert brute_components(n, [*got, *zip(start, start[1:])]) == want
    assert len(set(want)) > 3


@pytest.mark.parametrize(("members", "elements"), [(4096, 1 << 20), (4096, 1000), (200, 1 << 20)])
def test_only_buckets_too_large_for_a_task_are_spread(spark, monkeypatch, members, elements):
    """A bucket of 300 near copies is compared in one task unless its members or their elements are too many; links are the same."""
    spread = []

    def crowded(rows, *more, put=jaccard._crowded):
        spread.append(rows.count())
        return put(rows, *more)

    monkeypatch.setattr(jaccard, "_crowded", crowded)
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "ELEMENTS", elements)
    rng = random.Random(13)
    sets = [set(range(40)) for _ in range(300)]
    for x in sets:
        for _ in range(rng.randrange(8)):
            x.discard(rng.randrange(40))
            x.add(rng.randrange(100, 120))
    want = brute_components(300, [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(7, i, sorted(x), True) for i, x in enumerate(sets)], "key long, cls long, sh array<long>, crowd boolean")
    with common.Scratch(spark, "test") as scratch:
        got = [(r.u, r.v) for r in jaccard.bucket_links(df, 0.8, scratch).collect()]
    assert brute_components(300, got) == want and 1 < len(set(want)) < 300
    assert spread == ([] if (members, elements) == (4096, 1 << 20) else [300])


def test_passages_with_changed_words_and_hot_ones(spark, monkeypatch):
    """Copies join across a changed word; passages of many copies are counted by aggregations, with the same result."""
    rng = random.Random(9)
    shared = words(rng, 160)
    rows = []
    for i in range(14):
        own = list(shared) if i % 2 or not i else shared[20:90]
        if i in (3, 5):
            own[80] = "changed"
        rows.append((i, "\n".join([" ".join(words(rng, 41)), " ".join([*words(rng, 25), *own, *words(rng, 30)])])))
    df = spark.createDataFrame([*rows, (50, None)], "doc_id long, text string")
    left = {}
    for hot in (4096, 2):
        monkeypatch.setattr(paragraphs, "HOT", hot)
        left[hot] = {r.doc_id: r.text for r in paragraphs.remove_repeats(df, within_lines=True).collect()}
    assert left[4096] == left[2]
    known = {}
    for i, text in rows:
        ws = text.lower().split()
        gone = set()
        for k in range(len(ws) - 49):
            if known.setdefault(tuple(ws[k : k + 50]), i) != i:
                gone |= set(range(k, k + 50))
        kept = left[2][i].lower().split()
        if i in (3, 5):
            assert "changed" not in kept
            gone |= {ws.index("changed")}
        assert kept == [w for k, w in enumerate(ws) if k not in gone], i


def test_anchors_are_the_least_places():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, w in ((30, 26), (300, 26), (300, 7), (64, 64), (90, 33)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(int(rng.integers(0, 40)))
        high = a >> np.uint64(24)
        want = [s + int(np.argmin(high[s : s + w])) for s in range(n - w + 1)]
        assert paragraphs._least(a, w).tolist() == want == paragraphs._least(a, w, step=50).tolist()
    h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    h[120:170] = h[10:60]
    for n in (1, 7, 50):
        got = paragraphs._stretch_hashes(h, n)
        assert len(got) == 201 - n and got[120] == got[10] and len(set(got.tolist())) == 201 - n - (51 - n)


def test_scratch_tables_go(spark):
    import os

    with common.Scratch(spark, "test") as scratch:
        staged = scratch.stage(spark.range(5), "numbers")
        assert staged.count() == 5 and os.listdir(scratch.path.removeprefix("file://"))
        scratch.stage(spark.range(2), "others")
        scratch.drop("numbers")
        assert [n.split("-")[0] for n in os.listdir(scratch.path.removeprefix("file://")) if not n.startswith(".")] == ["others"]
    assert not os.path.exists(scratch.path.removeprefix("file://"))


def test_filters_lose_nothing(spark):
    rng = random.Random(10)
    kept = spark.createDataFrame([(rng.randrange(10**6),) for _ in range(200)], "x long")
    rows = spark.createDataFrame([(rng.randrange(10**6), "r") for _ in range(3000)] + [(r.x, "k") for r in kept.collect()] + [(None, "n")], "x long, what string")
    maybe = common.Maybe(kept, bits=12)
    inside, beside = maybe.of(rows, "x"), maybe.beside(rows, "x")
    assert inside.columns == rows.columns == beside.columns and inside.count() + beside.count() == rows.count()
    assert beside.where("what = 'k'").count() == 0 and beside.count() > 2000
