"""Operators 11 to 13 against plain versions, on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumtrail.llm import bottomk, merkle, negatives, sha
from sumtrail.llm.folders import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_groups(rows, percent=85):
    """Size and least id of its component, for each row of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    part = [i for i, _ in rows]
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    return sorted((i, len(s), p, p == i) for (i, _), s, p in zip(rows, sets, part, strict=True))


def near_copies():
    r, rows = random.Random(3), []
    for base in range(3):
        words = [f"w{r.randrange(500)}" for _ in range((40, 260, 900)[base])]
        for k in range(14):
            own = words.copy()
            for _ in range(r.randrange(len(own) // 20)):
                own[r.randrange(len(own))] = f"new{r.randrange(30)}"
            rows.append((1000 * base + 7 * k, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one Two"), (5004, "ONE\ttwo"), (5005, "one two three"), (5006, "x" * 5000), (5007, "é a b " * 900)]
    return rows + [rows[0], (5005, "another text of this id"), (5, "another text of this ID"), (rows[3][0], rows[20][1])]


def test_near_duplicates(spark):
    rows = near_copies()
    table = spark.createDataFrame([(*x, 7, "c") for x in rows] + [(None, "no id", 7, "c")], "doc_id bigint, text string, n int, component_id string")
    got = bottomk.near_duplicates(table.repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows)
    assert bottomk.near_duplicates(table.filter("false")).count() == 0


def test_near_duplicates_of_many_like_texts(spark):
    r, words, rows = random.Random(4), [f"w{k}" for k in range(150)], []
    for k in range(120):
        own = words.copy()
        for _ in range(r.randrange(9)):
            own[r.randrange(150)] = f"new{r.randrange(9)}"
        rows.append((k, " ".join(own)))
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(x) for x in got) == brute_groups(rows)


def test_near_duplicates_compare_few_pairs(spark, monkeypatch):
    r, words, rows, seen = random.Random(8), [f"w{k}" for k in range(150)], [], {}
    edits = r.sample(range(150), 16)
    for k in range(60):
        own = words.copy()
        for at in r.sample(edits, r.randrange(9)):
            own[at] = f"new{at}"
        rows.append((k, " ".join(own)))

    def kept(df, name):
        seen.setdefault(name, []).append(out := written(df, name))
        return out

    monkeypatch.setattr(bottomk, "written", kept)
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(x) for x in got) == brute_groups(rows)
    # Each pair once, and none of components that the first comparison has joined.
    pairs, joined = seen["candidates"][0], seen["closest"][0].select(F.col("a").alias("c"), F.col("b").alias("d"))
    assert joined.count() and pairs.count() == pairs.distinct().count()
    assert pairs.join(joined, ["c", "d"]).count() == 0


def test_pairs_of_many_shared_lists_meet_once(spark):
    r, rows = random.Random(9), []
    # Components of one set each but for 90 to 94; sets 7, 8 and 9 are too far from the others.
    part = {k: 90 if 90 <= k < 95 else k for k in (*range(20), *range(90, 95))}
    bits = {k: [-1 if k in (7, 8, 9) else 1 << k % 3] * bottomk.LONGS for k in part}
    lists = {h: r.sample(sorted(part), 16) for h in range(30)} | {100 + h: [3, 4, 7] for h in range(2)} | {200: [90, 91], 201: [5]}
    for h, nodes in lists.items():
        rows += [(h, k, part[k], 100, *bits[k]) for k in nodes]
    member = spark.createDataFrame(rows, "h bigint, node bigint, c bigint, n bigint, " + ", ".join(f"b{k} bigint" for k in range(bottomk.LONGS)))
    got = [(x.c, x.d, x.a, x.b) for x in bottomk._facing(member.repartition(3), 85).collect() if x.one]
    expected, short = set(), 0
    for h, nodes in lists.items():
        alone = [k for k in nodes if [part[x] for x in nodes].count(part[k]) == 1]
        pairs = {(part[a], part[b], a, b) for a in alone for b in alone if part[a] < part[b] and (a in (7, 8, 9)) == (b in (7, 8, 9))}
        expected |= pairs
        short += len(pairs) if len(nodes) <= bottomk.PIVOTS else 0
    assert set(got) == expected and len(got) == len({x for x in got}) + short
    wide = {(part[a], part[b]) for nodes in lists.values() for a in nodes for b in nodes if part[a] < part[b] and 90 in (part[a], part[b]) and [part[x] for x in nodes].count(90) > 1}
    assert {(x.c, x.d) for x in bottomk._facing(member, 85).collect() if not x.one} == wide


def test_union_matches_equal_the_sketch_of_the_union():
    r = random.Random(5)
    for _ in range(200):
        pool = [r.getrandbits(40) for _ in range(r.randrange(1, 60))]
        a, b = ({x for x in pool if r.random() < 0.7} for _ in range(2))
        size, found = bottomk.union_matches([np.array(sorted(a)[:8], np.int64)], [np.array(sorted(b)[:8], np.int64)], 8)
        union = sorted(a | b)
        union = union if len(a) < 8 and len(b) < 8 else union[:8]
        assert (size[0], found[0]) == (len(union), len([x for x in union if x in a and x in b]))


def test_least_matches():
    needs = bottomk.least_matches(85, 128)
    assert needs[:110].tolist() == [-(-85 * n // 100) for n in range(110)]
    r = np.random.default_rng(1)
    for n in (150, 400, 2000):
        union = 100 * n // 85
        drawn = r.hypergeometric(-(-85 * union // 100), union - -(-85 * union // 100), 128, 20_000)
        assert needs[n] <= drawn.min() and needs[-1] <= needs[n] < 109


def test_sha_states_resume():
    message = bytes(random.Random(6).randrange(48, 58) for _ in range(320))
    blocks = np.frombuffer(message, np.uint8).reshape(5, 64)
    state = np.tile(sha.START, (2, 1))
    for block in blocks:
        state = sha.compress(state, sha.words_of(np.tile(block, (2, 1))))
    assert [bytes(x).decode() for x in sha.finish(state, np.array([5, 5]))] == [hashlib.sha256(message).hexdigest()] * 2


def sha256(data):
    return hashlib.sha256(data.encode()).hexdigest()


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def brute_path(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((k % 16, level[k // 16 * 16 : k // 16 * 16 + 16]))
        k //= 16
    return out


@pytest.mark.parametrize("sizes", [[1], [2, 1, 17], [16, 256, 257], [4100, 1, 33] + [1] * 20])
def test_manifest(spark, sizes):
    groups = [None, "", "é", "a", "B", *[f"g{k:02}" for k in range(20)]]
    rows = [(k, groups[g], sha256(f"{g} {k}"), sha256(f"new {k}") if k % 3 == 0 else None, 5) for g, n in enumerate(sizes) for k in range(n)]
    rows += [rows[-1], (None, groups[0], sha256("null"), None, 5)]  # a repeated row, a null key
    table = spark.createDataFrame(rows, "key bigint, group string, leaf string, now string, g int").repartition(3)
    manifest = merkle.build_manifest(table)
    got = merkle.fold_manifest(manifest, spark).collect()
    by = {}
    for key, group, leaf, now, _ in rows:
        by.setdefault(group, []).append((key is not None, key or 0, leaf, now))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = brute_tree([trees[s][-1][0] for s in names])
    expected = []
    for k, s in enumerate(names):
        for i, (known, key, leaf, now) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = brute_path(trees[s], i) + brute_path(top, k)
            proof = sha256("".join(x for slot, run in steps for j, x in enumerate(run) if j != slot))
            root = now or leaf
            for slot, run in steps:
                root = sha256("".join([*run[:slot], root, *run[slot + 1 :]]))
            expected.append((str(key) if known else "", leaf, trees[s][-1][0], proof, root))
    assert manifest.root == top[-1][0]
    assert sorted((r["key"] or "", *tuple(r)[1:]) for r in got) == sorted(expected)


def test_manifest_of_nothing(spark):
    table = spark.createDataFrame([], "key bigint, group string, leaf string, now string")
    manifest = merkle.build_manifest(table)
    assert manifest.root is None and merkle.fold_manifest(manifest, spark).count() == 0


def test_leaf_digest(spark):
    row = spark.createDataFrame([(7, None, "é", "", 3)], "doc_id bigint, source string, lang string, text string, n_chars bigint")
    found = row.select(merkle.digest([row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])).first()[0]
    assert found == sha256("1:7-2:é1:30:")


def brute_negatives(rows):
    kept = [(i, v, c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    scaled = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], c) for i, v, c in kept]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, v, c in scaled:
        if i % 100:
            continue
        others = sorted((-score(v, w), j, d) for j, w, d in scaled if j != i and len(w) == len(v))
        for s, p, d in [x for x in others if x[2] == c][:5]:
            fit = [x for x in others if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def vector_rows(seed, n, length=6):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, length))
    rows = []
    for k in range(n):
        v = centers[r.integers(5)] * r.choice([0.5, 1, 3]) + r.normal(size=length) * r.choice([0.02, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(3))))
    return rows


@pytest.mark.parametrize("references", [0, 16])
def test_negatives(spark, references):
    rows = vector_rows(1, 400) + [(1000 + k, [0.0] * 6, k % 2) for k in range(4)] + [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [1.0, 1.9], 0), (2100, [], 1), (2101, [], 1), (2102, [], 0)]
    rows += [(3000, None, 1), (3001, [1.0] * 6, None), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3100, [float("nan")] * 6, 1), (3200, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(5, rows[5][1], rows[5][2]), (500, rows[0][1], 2)]  # a repeated row, an equal vector
    table = spark.createDataFrame([(*x, "r") for x in rows], "vec_id bigint, embedding array<float>, label int, rank string")
    got = negatives.mine_negatives(table.repartition(3), references=references).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)
    assert negatives.mine_negatives(table.filter("false")).count() == 0


def test_bounds_hold_and_leave_out():
    r = np.random.default_rng(2)
    values = np.floor(256 * np.concatenate((r.normal(size=(200, 8)), 4 + 0.05 * r.normal(size=(200, 8)), -4 + 0.05 * r.normal(size=(200, 8)))))
    unit = values[[250, 450]] / np.linalg.norm(values[[250, 450]], axis=1)[:, None]
    row = type("Row", (), negatives._packed(np.arange(600), np.arange(600) % 2, values, {8: unit}))
    pack = negatives.Pack(row)
    for a in range(0, 600, 7):
        low, high = pack.bounds(pack.angles[a], pack.norms[a])
        exact = values @ values[a]
        assert (low <= exact).all() and (exact <= high).all()
    wanted = {300: [(1, int(values[300] @ values[301]))]}
    found, scored = negatives.best_negatives(pack, pack, wanted)
    # The vectors on the other side can't reach the window.
    assert found and scored < 250


def test_too_large_vectors_are_an_error():
    row = type("Row", (), negatives._packed(np.arange(1), np.arange(1), np.full((1, 4), 2.0**31), {}))
    with pytest.raises(ValueError, match="64 bits"):
        negatives.Pack(row)
