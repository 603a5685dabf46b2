"""Queries and operators do the whole job: cases that a filter, cap or rounding would lose."""

import itertools
import math
from datetime import date

import numpy as np
import pytest

from probity.operators import authors, similarity, text
from probity.operators import statistics as S
from probity.plans import catalog, views


def test_links_hold_every_order(spark, tmp_path):
    rows = [(10 * k + j, k) for k in range(1, 101) for j in range(2)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in views.view(spark, str(tmp_path), "v_links").collect()}
    assert got == set(rows)


def test_grimmer_and_sprite_decide_every_row(spark, tmp_path):
    rows = [(k, 7 * k, date(2020, 1, 1)) for k in range(1, 701, 3)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    means = views.view(spark, str(tmp_path), "v_means").collect()
    q = catalog.queries()
    assert {r.id: r.consistent for r in q["grimmer"](spark, str(tmp_path)).collect()} == {r.id: S.grimmer(r["mean"], r.sd, r.n) for r in means}
    assert {r.id for r in q["sprite"](spark, str(tmp_path)).collect()} == {r[0] for r in rows}


def test_statistics_by_brute_force():
    sd_of = lambda c, n: math.sqrt(max((sum(x * x for x in c) - sum(c) ** 2 / n) / (n - 1), 0))
    for n in (3, 4):
        for total in range(13):
            sds = {sd_of(c, n) for c in itertools.product(range(total + 1), repeat=n) if sum(c) == total}
            scale = {sd_of(c, n) for c in itertools.product(range(1, 8), repeat=n) if sum(c) == total}
            for k in range(0, 500, 7):
                assert S.grimmer(total / n, k / 100, n) == any(abs(x - k / 100) <= 0.005 for x in sds)
                assert S.sprite(total / n, k / 100, n) == any(abs(x - k / 100) <= 0.005 for x in scale)


def test_exact_index_compares_whole_hashes(spark, tmp_path):
    far = [1.0] * 8 + [-1.0] * 56
    rows = [(1, [1.0] * 64), (2, [2.0] * 64), (3, far), (4, far[:-1] + [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.queries()["exact_hash_index"](spark, str(tmp_path)).collect()
    assert [(r.phash, r.figures, r.papers, r.first_figure) for r in got] == [("f" * 16, 2, 2, 1)]


def test_phrases_of_all_lengths_and_whole_texts(spark):
    words = [f"w{k}" for k in range(70)]
    p = spark.createDataFrame([(" ".join(words[:n]),) for n in range(1, 71)], "phrase string")
    assert text.phrase_hits(spark.createDataFrame([(1, " ".join(words))], "id long, text string"), p, "id").count() == 70
    late = spark.createDataFrame([(1, "x" * 600_000 + " with p = 0.04 and 2.5 there")], "id long, text string")
    assert [r.value for r in text.extract_p_values(late).collect()] == [0.04]
    assert [r.value for r in text.extract_decimals(late).collect()] == [0.04, 2.5]


def test_pairs_at_wide_distances_are_compared_in_blocks(spark):
    r = np.random.default_rng(5)
    for digits, most in ((20, 24), (16, 20), (5, 7)):
        codes = [int(x) & ((1 << 4 * digits) - 1) for x in (int(r.integers(0, 1 << 62)) << 22 ^ int(r.integers(0, 1 << 62)) for _ in range(120))]
        rows = [(f"f{k % 100:03d}", None if k % 9 == 0 else f"p{k % 5}", f"{c:0{digits}x}") for k, c in enumerate(codes)]  # 20 figures have two hashes
        rows += [(f"g{k}", "p1", rows[3][2]) for k in range(40)] + [(None, "p1", rows[3][2]), ("h", "p1", None), ("i", "p1", "ab")]
        frame = spark.createDataFrame([*rows, *rows[:30]], "figure_id string, paper_id string, phash string")
        own = [(f, p, int(h, 16)) for f, p, h in rows if f and h and len(h) == digits]
        met = {(f, p, g, q, (x ^ y).bit_count()) for f, p, x in own for g, q, y in own if f != g and (x ^ y).bit_count() <= most}
        for across in (None, True):
            want = {x for x in met if across is None or None not in (x[1], x[3]) and x[1] != x[3]}
            new = frame.filter("figure_id < 'f050'")
            for asked, some in ((None, {x for x in want if x[0] < x[2]}), (new, {x for x in want if x[0] < "f050"})):
                found = similarity.similar_pairs(frame, digits, most, across, asked)
                got = [tuple(x) for x in found.collect()]
                assert len(got) == len(some), "a pair comes once"
                assert set(got) == some
                assert "Join" not in found._jdf.queryExecution().executedPlan().toString(), "no join brings most pairs together row by row"


@pytest.mark.parametrize("name", ["new_matches", "cross_paper_duplicates", "similar_pairs", "top_matches"])
def test_queries_over_pairs_compare_codes_in_blocks(spark, tmp_path, name):
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 64))
    x[200:] = x[:100] + r.normal(size=(100, 64)) / 3
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    on = x > 0
    pairs = [(i, i % 50, j, j % 50, int((on[i] != on[j]).sum())) for i in range(300) for j in range(i + 1, 300)]
    pairs = [p for p in pairs if p[4] <= 20]
    want = {
        "new_matches": {p for p in pairs if p[0] % 2},
        "cross_paper_duplicates": {p for p in pairs if p[1] != p[3]},
        "similar_pairs": set(pairs),
        "top_matches": set(sorted(pairs, key=lambda p: (p[4], p[0], p[2]))[:50]),
    }[name]
    got = catalog.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan, "slices bring most pairs together at this distance"
    found = got.select(*similarity.PAIR).collect()
    assert len(found) == len(want)
    assert {tuple(p) for p in found} == want


def test_clusters_keep_stars_of_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b), int(d)) for a, b, d in zip(r.integers(0, 400, 500), r.integers(0, 400, 500), r.integers(1, 9, 500), strict=True)]
    edges = [(a + 1000 * (a % 3), b - b % 3 + a % 3 + 1000 * (a % 3), d) for a, b, d in edges] + [(9000, 9000, 7)]
    label = {n: n for a, b, _ in edges for n in (a, b)}
    for _ in label:
        moved = False
        for a, b, _ in edges:
            if (least := min(label[a], label[b])) != max(label[a], label[b]):
                label[a] = label[b] = least
                moved = True
        if not moved:
            break
    least = {c: min(d for a, _, d in edges if label[a] == c) for c in label.values()}
    want = {(c, list(label.values()).count(c), d) for c, d in least.items()}
    pairs = spark.createDataFrame(edges, "figure_id_a long, figure_id_b long, distance int").repartition(3)
    for most in (7, 1_000_000):
        monkeypatch.setattr(similarity, "EDGES", most)
        assert {(x.component, x.figures, x.min_distance) for x in similarity.hash_clusters(pairs).collect()} == want
        assert {(x.node, x.component) for x in similarity.connected_components(pairs, "figure_id_a", "figure_id_b").collect()} == set(label.items())
    clique = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "a long, b long").coalesce(2)
    assert similarity.stars(clique, "a", "b").count() <= 2 * 59, "rounds don't carry every pair of a dense cluster"


def test_communities_leave_no_move_that_raises_modularity(spark):
    r = np.random.default_rng(4)
    n = 120
    met = {(min(x), max(x)): 1 + sum(x) % 3 for x in r.integers(0, n, (900, 2)).tolist()}
    a, b, w = (np.array(x) for x in zip(*[(i, j, k) for (i, j), k in met.items()], strict=True))
    table = np.zeros((n, n))
    np.add.at(table, (a, b), w)
    np.add.at(table, (b, a), w)
    total, degree = table.sum(), table.sum(axis=0)
    quality = lambda part: sum(table[np.ix_(part == c, part == c)].sum() / total - (degree[part == c].sum() / total) ** 2 for c in set(part.tolist()))
    one = a != b
    src, dst, weight = np.concatenate([a[one], b[one]]), np.concatenate([b[one], a[one]]), np.concatenate([w[one], w[one]]).astype("f8")
    own = authors._moved(n, src, dst, weight, table.diagonal().copy(), total)
    for v in range(n):
        for c in set(own.tolist()):
            other = own.copy()
            other[v] = c
            assert quality(other) <= quality(own) + 1e-9
    part = authors.divided(n, a, b, w)
    assert quality(part) >= quality(own) - 1e-9, "merging communities raises it too"
    assert all(part[v] == np.flatnonzero(part == part[v]).min() for v in range(n))
    edges = [(10 * g + i, 10 * g + j, 1) for g in range(30) for i in range(8) for j in range(i)] + [(10 * g, 10 * g + 10, 1) for g in range(29) if g % 10 != 9]
    got = authors.communities(spark.createDataFrame(edges, "author_a long, author_b long, weight long")).collect()
    assert len(got) == 240
    assert {(x.author_id, x.community) for x in got} == {(10 * g + i, 10 * g) for g in range(30) for i in range(8)}
