"""Near copies, repeated passages, vectors, packing, mixing and the pipeline, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, components, jaccard, mixing, packing, repeats, vectors
from factloom.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    words = t.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "sig": F.lit("s"), "label": F.lit(2), "h": F.lit(None).cast("long")})


# Near copies


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, len(sets[i]), lowest[find(i)]) for i, (d, _) in enumerate(rows))


def near_rows(rng):
    rows = [text(rng, rng.randint(0, 60)) for _ in range(60)]
    base = text(rng, 120)
    rows += [edited(rng, base, rng.randint(0, 4)) for _ in range(50)]  # a group larger than the heavy threshold
    rows += [base] * 5
    line = text(rng, 14)
    rows += [f"{line} {text(rng, 60)}" for _ in range(40)]  # a common line alone links nothing
    for n in (5, 8, 9, 10, 11, 12, 14, 20):  # sets about the small sizes
        short = text(rng, n + 4)
        rows += [short, f"{short} x", f"y {short} z", short.upper(), short.replace(" ", "\t\n")]
    rows += ["", " \t ", "a b c", "A b  C", "a b c d", "é É", "x" * 10_000]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "slots", "bits"), [(1, 1 << 23, 1 << 28), (2, 1, 1 << 28), (3, 64, 0)])
def test_near_copies(spark, monkeypatch, seed, slots, bits):
    """Also where all shingles share one slot, or a few, with a heavy one, and where there are too many ids for a filter."""
    monkeypatch.setattr(jaccard, "SLOTS_MOST", slots)
    monkeypatch.setattr(common, "FILTER_MOST", bits)
    rows = near_rows(random.Random(seed))
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows)


@pytest.mark.parametrize(("dealt", "bits"), [(1 << 14, 1 << 14), (16, 64), (50, 1 << 14)])
def test_near_copies_without_their_original(spark, monkeypatch, dealt, bits):
    """Many are linked with no star; pairs stay in proportion to the group, and links are all found also with sketches that tell nothing."""
    rng = random.Random(5)
    base = text(rng, 150)
    other = edited(rng, base, 5)
    rows = [edited(rng, base, rng.choice((2, 3, 3, 3, 4))) for _ in range(240)] + [edited(rng, other, 1) for _ in range(60)]
    rows += [t.rsplit(" ", rng.randint(1, 20))[0] for t in rows[:40]]  # of other sizes
    rows = list(enumerate(rows))
    made, write = [], jaccard.materialise

    def counted(df, tag):
        out = write(df, tag)
        made.append(out.count() if df.columns == ["a", "b"] else 0)
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    for name, value in (("DEALT", dealt), ("SKETCH_MOST", bits)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows)
    if dealt > len(rows):
        assert sum(made) < 10 * len(rows)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 60, 130, 300):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: -(n // 9) or None], rng.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        a, b = (np.frombuffer(jaccard.sketch(s, 1 << 10), np.uint64) for s in (x, y))
        if len(b) > len(a):
            assert len(b) == 2 * len(a)
            b = b[: len(a)] ^ b[len(a) :]
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_near_copies_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(5, t), (5, t), (None, t), (7, None), (None, None), (8, "solo text of more than five words")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 6, 5), (5, 6, 5), (None, 6, 5), (7, 0, 7), (None, 0, None), (8, 3, 8)], key=str)
    assert jaccard.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_subsets_and_prefixes_are_enough():
    for n in range(1, 60):
        for m in range(n, 5 * n // 4 + 1):
            c = jaccard.shared(n, m)
            assert (c - 1) * 9 < 4 * (n + m) <= c * 9
            if m <= 16:
                assert c in jaccard.subset_sizes(n, 16) and c in jaccard.subset_sizes(m, 16)


def test_id_filter(spark):
    rng = np.random.default_rng(0)
    ids = rng.integers(-(2**63), 2**63, 30_000)
    words = common.id_filter(spark.createDataFrame(pd.DataFrame({"at": ids[:10_000]})), "at")
    assert common.in_filter(words, ids[:10_000]).all() and common.in_filter(words, ids[10_000:]).mean() < 0.03
    assert len(words) * 64 >= 16 * 10_000 and common.in_filter(None, ids).all()


def test_scratch(spark):
    made = common.materialise(spark.range(3).toDF("x"), "some tag")
    assert made.count() == 3
    common.discard(made)
    import os

    assert not os.path.exists(made.written_at)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (200, 201), (201, 200)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated passages


def plain_repeats(rows):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            first[s] = min(first.get(s, (d, i)), (d, i))
    out = []
    for d, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (d, i):
                covered[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((d, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(7)
    passages = [text(rng, rng.randint(10, 60)) for _ in range(6)]
    rows = [" ".join([text(rng, rng.randint(0, 50)), rng.choice(passages), text(rng, rng.randint(0, 50)), rng.choice(passages)]) for _ in range(60)]
    rows += ["ab" * 200, "ab" * 60, "é" * 120, "x" * 99, "x" * 100, "x" * 101, "x" * 150, "", None, rows[0], rows[0], "To To " * 300]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_repeats(rows)


def test_repeats_in_long_texts(spark, monkeypatch):
    """Pieces of a long text lose no window, also where they cut a passage or a run."""
    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(11)
    passage = text(rng, 160)
    rows = [(1, text(rng, 900) + passage + text(rng, 500)), (2, text(rng, 33) + passage), (3, passage * 3), (4, "ab" * 3_000), (5, text(rng, 777) + passage[13:]), (6, text(rng, 20))]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_repeats(rows)


def test_repeats_odd_rows(spark):
    t = "p" * 50 + "".join(chr(97 + i % 26) for i in range(300))
    got = repeats.remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, None), (1, "short")])).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed > 0) for r in got), key=str) == sorted([(1, 350, True), (1, 350, True), (None, 350, True), (2, 0, False), (1, 5, False)], key=str)
    own = [r for r in got if r.doc_id is None][0]
    assert own.n_removed < 350 and all(r.n_removed == 350 for r in got if r.doc_id == 1 and r.n_bytes == 350)
    assert repeats.remove_repeats(frame(spark, []).limit(0) if False else frame(spark, [(1, "")]).limit(0)).count() == 0


# Vectors

VECTORS = "vec_id long, embedding array<float>"


def vector_rows(rng, n, dims=16):
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[1] = x[2] = x[3]
    x[n // 2 : n // 2 + 40] = x[5]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def odd_vectors(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10**6, None), (10**6 + 50, [float("nan")] * x.shape[1]), (10**6 + 100, [float("inf")] + [0.0] * (x.shape[1] - 1)), (10**6 + 150, [None] * x.shape[1]), (None, x[0].tolist())]
    return spark.createDataFrame(rows, VECTORS).withColumns({"copy": F.lit("c"), "pair": F.lit(1), "n": F.lit(2)})


def plain_top(score, ids, queries, k):
    out = []
    for q in queries:
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-score[q][j], ids[j]))[:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), score[q][j]) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [8_192, 300])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", max(8, block // 64))
    x = vector_rows(np.random.default_rng(3), 900)
    ints = np.floor(256 * x.astype(float)).astype(np.int64)
    want = plain_top((ints @ ints.T).tolist(), np.arange(900), range(0, 900, 50), 5)
    got = vectors.exact_top_k(odd_vectors(spark, x), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == want


def test_cover_tree_covers():
    """Each child within half its parent's radius, centres further apart than that, every row in one child, the parent's centre among them."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(6, 1, 1, 8)) * 90 + rng.normal(size=(6, 6, 1, 8)) * 9 + rng.normal(size=(6, 6, 100, 8)) * 0.5).reshape(-1, 8)
    depths = []

    def walk(node, depth):
        depths.append(depth)
        d = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1))
        assert d.max() <= node.radius + 1e-9 and d.min() == 0
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            centres = np.array([c.centre for c in node.children])
            assert (centres[0] == node.centre).all() and node.apart == node.radius / 2
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
            assert apart.min() > node.apart
            for c in node.children:
                assert c.radius <= node.apart
                walk(c, depth + 1)

    walk(vectors.cover_tree(x), 0)
    assert max(depths) >= 2


def test_far_pairs_are_not_scored():
    """On clustered vectors both levels of the search leave most products out, and none that matters."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 300
    x = np.floor((centres[:, None] + rng.normal(size=(30, 400, 16)) * 5).reshape(-1, 16))
    q = x[::50]
    ids, q_ids = np.arange(len(x)), np.arange(len(x))[::50]
    best = vectors.Best(q_ids, np.full(len(q), vectors.NONE), 5)
    vectors.dual_tree(best, q, vectors.cover_tree(q, None, vectors.QUERY_LEAF), x, ids, vectors.cover_tree(x))
    s = (q @ x.T).astype(np.int64)
    s[np.arange(len(q)), q_ids] = vectors.NONE
    assert (best.found == np.lexsort((np.broadcast_to(ids, s.shape), -s.astype(float)), axis=1)[:, :5]).all()
    assert best.scored < 0.35 * s.size
    pivots = vectors.pivots_of(x[::7], 30)
    own, far = vectors._nearest(x, pivots)
    radii = {int(p): float(far[own == p].max()) for p in np.unique(own)}
    worst = {g: (float(far[::50][own[::50] == g].max()), int(np.sort(s[own[::50] == g], 1)[:, -5].min())) for g in np.unique(own[::50]).tolist()}
    met = vectors.met_groups(pivots, len(pivots), radii, worst)
    assert sum(map(len, met.values())) < 0.2 * len(met) * len(radii)
    for i, found in enumerate(best.found):
        assert set(own[found].tolist()) <= set(met[int(own[::50][i])])


@pytest.mark.parametrize("block", [8_192, 2])
def test_large_components(spark, monkeypatch, block):
    """Products beyond doubles and beyond 64 bits: exact, then the nearest 64-bit number."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    big = 2.0**40
    rows = [(0, [1.0, 2.0]), (50, [big, 3.0]), (1, [big, 3.5]), (2, [-big, 1.0]), (3, [1e17, 1.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0]), (6, [1e308, 0.0]), (7, [0.5, 0.25]), (100, [1e300, -1e300])]
    ints = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if i != 6}
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = []
    for q in (0, 50, 100):
        scored = sorted((-clip(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    found = vectors.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == want
    near = vectors.ann_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, share=1.0).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 0][:3] == [6, 4, 3]


def test_ann(spark):
    x = vector_rows(np.random.default_rng(4), 1_500, 32)
    y = x.astype(float)
    got = vectors.ann_search(odd_vectors(spark, np.vstack([x, np.zeros((1, 32), np.float32)])), F.col("vec_id") % 20 == 0).collect()
    want = plain_top((y @ y.T).tolist(), np.arange(1_500), range(0, 1_500, 20), 20)
    worst = {q: s for q, r, _, s in want if r == 20}
    assert sum(r.score >= worst[r.query_id] - 1e-9 for r in got) >= 0.9 * len(want) and len(got) == len(want)
    by_query = pd.DataFrame([r.asDict() for r in got]).sort_values(["query_id", "rank"])
    for q, part in by_query.groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, 21)) and part["vec_id"].is_unique and (part["vec_id"] != q).all()
        assert list(zip(-part["score"], part["vec_id"], strict=True)) == sorted(zip(-part["score"], part["vec_id"], strict=True))
        assert np.allclose(part["score"], y[part["vec_id"]] @ y[q], atol=1e-12)


def test_ann_with_a_common_vector(spark):
    """Copies of one vector, several of one id, don't crowd out other candidates; ties go by id."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1_200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[400:] = x[10]
    ids = np.concatenate([np.arange(1_000), np.full(200, 500)])
    got = vectors.ann_search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    have: dict = {}
    for r in got:
        have.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    right = total = 0
    for q in range(0, 400, 20):
        want = sorted((-float(x[j] @ x[q]), int(ids[j])) for j in range(1_200) if ids[j] != q)[:20]
        assert sorted(r for _, _, r in have[q]) == list(range(1, 21))
        right += len({(i, round(s, 9)) for s, i in want} & {(i, round(s, 9)) for s, i, _ in have[q]})
        total += len({(i, round(s, 9)) for s, i in want})
    assert right >= 0.9 * total
    assert len(have[500]) == 20 * 201 and all(i != 500 for _, i, _ in have[500])


def test_vectors_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.5, 0.5]), (7, [0.0, 1.0])], VECTORS)
    assert [tuple(r) for r in vectors.exact_top_k(few, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()] == [(0, 1, 100, 128 * 256), (0, 2, 7, 0), (100, 1, 0, 128 * 256), (100, 2, 7, 128 * 256)]
    assert vectors.ann_search(few, F.col("vec_id") % 20 == 0).count() == 4
    assert vectors.exact_top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vectors.ann_search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5])], VECTORS)
    assert sorted((r.query_id, r.vec_id) for r in vectors.exact_top_k(twins, F.col("vec_id") % 50 == 0).collect()) == [(0, 1), (0, 1)]


# Packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(9)
    texts = [None, "", " ", "Hello, World! it's 42 <|endoftext|> \x1c É́ ﬁ", "don't!!stop?", "a" * 9000, text(rng, 6000), "日本語 テスト"]
    texts += [text(rng, int(rng.paretovariate(0.6) * 20) % 3000) for _ in range(300)]
    docs = frame(spark, [*enumerate(texts), (None, "null id")])
    got = packing.pack_documents(docs.repartition(5), tokenizer_path()).toPandas()
    assert len(got[got.doc_id.isna()]) == 1
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 4096))) and own.start.tolist() == list(range(0, len(ids), 4096))
        for p in own.itertuples():
            part = ids[p.start : p.start + p.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32 and len(part) == p.length
    used = 0
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == np.concatenate([[0], np.cumsum(seq.length)])[:-1].tolist()
        assert seq.length.sum() <= 4096
        used += 1
    assert used <= 1.05 * -(-int(got.length.sum()) // 4096) + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_best_fit():
    loads = np.array([5, 5, 4, 3, 3, 10, 7, 3])
    bins = packing.best_fit(loads, 10)
    assert np.bincount(bins, loads).max() <= 10 and bins.max() + 1 == 4


# Mixing


def test_rake_meets_its_targets():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 1000))) for i in range(5) for j in range(3) for k in range(4)], columns=["source", "lang", "topic", "tokens"])
    goals = [mixing.tempered(cells.groupby(m)["tokens"].sum().to_dict(), 0.5) for m in mixing.MARGINS]
    w = mixing.rake(cells, goals)
    for m, goal in zip(mixing.MARGINS, goals, strict=True):
        have = cells.assign(w=w).groupby(m)["w"].sum()
        assert all(abs(have[k] - v) < 1e-6 for k, v in goal.items())
    own = cells["tokens"].to_numpy(float) / cells["tokens"].sum()
    p = mixing.keep_probability(own, w, 0.4)
    assert p.max() <= 1 and own @ p == pytest.approx(0.4, abs=1e-6)


NAMES = ("__mix_source", "__mix_lang", "__mix_topic")


def test_mixing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randint(0, 60)), rng.choice(["en", "fr", None]), rng.choice(["a"] * 8 + ["b", None]), "x") for i in range(3_000)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")
    found = mixing.probabilities(docs, 0.6, 0.5)
    small = found.groupBy(*NAMES).agg(F.avg("__mix_probability").alias("p"), F.sum("__mix_tokens").alias("n")).toPandas()
    assert (small.n * small.p).sum() / small.n.sum() == pytest.approx(0.6, abs=0.01)
    drawn = mixing.mix(docs, 0.6, 0.5)
    assert drawn.columns == docs.columns and 0.5 < drawn.where("text <> ''").select(F.sum(F.size(F.split("text", " ")))).first()[0] / small.n.sum() < 0.7
    assert sorted(r.doc_id for r in drawn.where("doc_id is not null").collect()) == sorted(r.doc_id for r in mixing.mix(docs.repartition(3), 0.6, 0.5).where("doc_id is not null").collect())
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)  # the fit as joins
    wide = {tuple(r)[:3]: r.p for r in mixing.probabilities(docs, 0.6, 0.5).groupBy(*NAMES).agg(F.avg("__mix_probability").alias("p")).collect()}
    for r in small.itertuples():
        if r.n:
            assert wide[r[1], r[2], r[3]] == pytest.approx(r.p, abs=2e-3)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n_margins", [1, 2, 4])
def test_mixing_is_the_same_on_driver_and_as_joins(spark, monkeypatch, n_margins):
    """Cells without tokens, targets of absent values, and skewed shares that take many rounds."""
    rng = random.Random(n_margins)
    rows = [(i, text(rng, rng.randint(1, 30)), rng.choice("ab"), rng.choice("xy"), rng.choice("pq"), rng.choice("uv")) for i in range(300)]
    rows += [(300 + i, text(rng, 400), "a", "x", "p", "u") for i in range(3)] + [(400, "", "empty", "x", "p", "u"), (401, None, "a", None, "p", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, m3 string, m4 string").coalesce(2)
    margins = dict(list({m: F.col(m) for m in ("source", "lang", "m3", "m4")}.items())[:n_margins])
    targets = {"source": {"a": 0.3, "absent": 0.5}, "lang": {"x": 0.9}}

    def fitted():
        found = mixing.probabilities(docs, 0.5, 0.5, targets, margins).collect()
        return {r["doc_id"]: (r["__mix_weight"], r["__mix_probability"]) for r in found}

    def margin(m, value):
        part = [(w * n, getattr(r, m) == value) for r, n, w in ((r, len((r.text or "").split()), wide[r.doc_id][0]) for r in docs.collect())]
        return sum(x for x, own in part if own) / sum(x for x, _ in part)

    driver = fitted()
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    wide = fitted()
    assert driver.keys() == wide.keys() and len(wide) == len(rows)
    assert all(wide[k] == pytest.approx(driver[k], abs=1e-7) for k in driver)
    assert wide[400] == (1.0, 0.5)
    assert margin("source", "a") == pytest.approx(0.3, abs=1e-7) and (n_margins == 1 or margin("lang", "x") == pytest.approx(0.9, abs=1e-7))


def test_margins_that_cannot_be_met_are_reported(spark):
    """Two cells on a diagonal cannot have different shares of source and language."""
    cells = pd.DataFrame([("a", "x", 5), ("b", "y", 5)], columns=["source", "lang", "tokens"])
    goals = [{"a": 0.3, "b": 0.7}, {"x": 0.6, "y": 0.4}]
    with pytest.warns(RuntimeWarning, match="a margin is still off by"):
        mixing.rake(cells, goals, ("source", "lang"), rounds=3)
    targets = spark.createDataFrame([(m, v, g) for m, goal in zip(("source", "lang"), goals, strict=True) for v, g in goal.items()], "margin string, value string, goal double")
    with pytest.warns(RuntimeWarning, match="a margin is still off by"):
        mixing.rake_cells(spark.createDataFrame(cells), 10.0, targets, ("source", "lang"), rounds=3)


def test_share_is_kept_where_some_cells_are_barred():
    own, fitted = np.array([0.2, 0.5, 0.3]), np.array([0.0, 0.9, 0.1])
    assert own @ mixing.keep_probability(own, fitted, 0.7) == pytest.approx(0.7, abs=1e-9)
    assert mixing.keep_probability(own, fitted, 0.9).tolist() == [0, 1, 1]


def doubled(docs):
    """Covered starts ``doc_id, at`` by prefix doubling over every byte position, as Spark joins: ranks of 25, 50, then 100 bytes; unique positions go."""
    starts = docs.where("octet_length(text) >= 25").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    starts = starts.select("doc_id", "b", F.explode(F.sequence(F.lit(0), F.length("b") - 25)).alias("at"))
    ranked = starts.select("doc_id", "at", F.xxhash64(F.substring(F.col("b"), F.col("at") + 1, F.lit(25))).alias("x"), F.lit(0).cast("long").alias("y"))
    for h in (25, 50, None):
        classes = ranked.groupBy("x", "y").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        kept = ranked.join(classes, ["x", "y"]).select("doc_id", "at", "first", F.xxhash64("first").alias("rank"))
        if h is None:
            return kept.where("doc_id <> first.doc_id or at <> first.at").select("doc_id", "at")
        after = kept.select("doc_id", (F.col("at") - h).alias("at"), F.col("rank").alias("y"))
        ranked = kept.select("doc_id", "at", F.col("rank").alias("x")).join(after, ["doc_id", "at"])


def test_repeats_agree_with_prefix_doubling(spark):
    """The dealt method, which is too dear for whole tables, on a small one."""
    rng = random.Random(17)
    passage = text(rng, 50)
    rows = [(i, f"{text(rng, 20)} {passage if i % 3 else ''} {text(rng, 20)}") for i in range(12)] + [(20, "xyz" * 60)]
    docs = frame(spark, rows)
    want: dict = {}
    for r in doubled(docs).collect():
        want.setdefault(r.doc_id, set()).update(range(r.at, r.at + 100))
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert got == {i: len(want.get(i, ())) for i, _ in rows} and sum(got.values()) > 500


def test_query_meets_the_target_weights(spark):
    """The calibrated weights of the registered query give each language its target share of tokens."""
    from conftest import SMALL

    from factloom.llm.queries import MIX_TARGETS, op5_source_mixing

    found = op5_source_mixing(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    found["w"] = found["weight"] * found["n_tokens"]
    have = found.groupby(found["lang"].fillna("(null)"))["w"].sum() / found["w"].sum()
    given = {k: v for k, v in MIX_TARGETS["lang"].items() if k in have.index}
    assert set(given) and all(have[k] == pytest.approx(v / (sum(given.values()) if set(have.index) <= set(given) else 1), abs=1e-6) for k, v in given.items())
