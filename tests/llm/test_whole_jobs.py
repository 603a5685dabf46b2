"""Training-data operators do the whole job: cases that a filter, cap or rounding would lose."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probity.llm import blocks, mixing, neardup, ngrams, toxicity


def test_mixing_keeps_to_exact_weights():
    weights = {"a": 0.70004, "b": 0.29986, "c": 0.0001}
    blocks = {"a": 30_000, "b": 12_000, "c": 5, "zero": 3}
    plan = mixing.plan_phases(blocks, weights | {"zero": 0.0})
    assert sorted(p[5] + x for p in plan for x in p[7]) == list(range(sum(blocks.values())))
    for s, phase, first, end, n, _, size, slots, share in plan:
        assert end - first == n == len(slots)
        if phase == 0:
            assert share == weights[s] / sum(weights.values())
            for k, t in enumerate(slots):  # the k blocks before the slot, and the one in it
                assert abs(k - t * share) < 1
                assert abs(k + 1 - (t + 1) * share) < 1
            assert abs(n - size * share) < 1


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<datalist><option value=x><option value=y>why</datalist><p>Article.</p>", ["Article."]),
        ("<datalist><option>a</option><option>b</datalist><p>Article.</p><select><option>z</option></select>", ["Article."]),
        ("<option value=x><p>Article.</p>", ["Article."]),
        ("<svg width='1'/><p>Article.</p><svg><text>no</text></svg><p>More.</p>", ["Article.", "More."]),
        ("<iframe src='a'/><p>Article.</p>", ["Article."]),
        ("<iframe src='a'><p>Article.</p>", ["Article."]),
        ("<noscript>Turn it on.<p>Article.</p>", ["Turn it on.", "Article."]),
        ("<p>One.</p><p>For all x < 5 it holds", ["One.", "For all x < 5 it holds"]),
        ("<p>x < 5 holds <a href", ["x < 5 holds"]),
        ("<p>Article.</p><script>var a = 1;", ["Article."]),
        ("<p>if 5 < 6 then go on reading", ["if 5 < 6 then go on reading"]),
        ("<p title=5\" tall>First para text.", ["First para text."]),
        ("<p title='5 tall>First para text.</p>", ["First para text."]),
        ("<p>1 < 2</p></ x><p>a </> b</p><!-- c > --><p>d<!e>f</p>", ["1 < 2", "a b", "df"]),
    ],
)
def test_pages_arent_cut(page, texts):
    assert [b.text for b in blocks.leaf_blocks(page)] == texts


def test_trigram_scores_by_brute_force_and_partitions(spark):
    texts = ["a b c a b d", "a b c", "b c a b c", "d", "", None, "a b e f", "c a b"] * 2 + ["once only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = [[*(t or "").split(), " "] for t in texts]
    one = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip([" ", *t], t, strict=False))
    three = Counter(p for t in tokens for p in zip([" ", *t], t, t[1:], strict=False))
    cut = lambda c: sum(x == 1 for x in c.values()) / sum({1: 1, 2: 2}.get(x, 0) for x in c.values())
    kinds2, kinds3 = Counter(p[0] for p in two), Counter(p[:2] for p in three)

    def score(t):
        out = 0.0
        for i, w in enumerate(t):
            h = t[i - 1] if i else " "
            p = (one[w] + 1) / (sum(one.values()) + len(one) + 1)
            p = (max(two[h, w] - cut(two), 0) + cut(two) * kinds2[h] * p) / one[h]
            if i:
                g = (t[i - 2] if i > 1 else " ", h)
                p = (max(three[(*g, w)] - cut(three), 0) + cut(three) * kinds3[g] * p) / two[g] if kinds3[g] else p
            out += math.log10(p)
        return out

    for parts in (1, 40):
        frame = docs.repartition(parts)
        got = {r.doc_id: r.score for r in ngrams.score(frame, ngrams.train(frame), ["doc_id"]).collect()}
        assert got == {k: pytest.approx(score(t), abs=1e-3 * len(t)) for k, t in enumerate(tokens)}


def test_frequent_words_are_divided(spark):
    """A word before half of all tokens fills several shards; scores stay those of the definition."""
    r = random.Random(7)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"w{r.randrange(60)}")) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    model = ngrams.train(docs)
    firsts = Counter(b // model["bases"][-1] for b in model["borders"])
    assert max(firsts.values()) >= 4
    tokens = [[*t.split(), " "] for t in texts]
    one, two, three = Counter(w for t in tokens for w in t), Counter(), Counter()
    for t in tokens:
        two.update(zip([" ", *t], t, strict=False))
        three.update(zip([" ", *t], t, t[1:], strict=False))
    cut = lambda c: sum(x == 1 for x in c.values()) / sum({1: 1, 2: 2}.get(x, 0) for x in c.values())
    kinds2, kinds3 = Counter(p[0] for p in two), Counter(p[:2] for p in three)
    d2, d3 = (cut(c) if 1 in c.values() and 2 in c.values() else 0.5 for c in (two, three))
    assert model["discounts"] == pytest.approx((d2, d3))
    for row in ngrams.score(docs, model, ["doc_id"]).collect():
        t, out = tokens[row.doc_id], 0.0
        for i, w in enumerate(t):
            h = t[i - 1] if i else " "
            p = (one[w] + 1) / (sum(one.values()) + len(one) + 1)
            p = (max(two[h, w] - d2, 0) + d2 * kinds2[h] * p) / one[h]
            if i:
                g = (t[i - 2] if i > 1 else " ", h)
                p = (max(three[(*g, w)] - d3, 0) + d3 * kinds3[g] * p) / two[g]
            out += math.log10(p)
        assert row.score == pytest.approx(out, abs=1e-3 * len(t))


def test_stages_carry_a_text_once(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["gruk", "tari", "molen", "susu"]) + r.choice("abc") for _ in range(12)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(texts)], "doc_id long, Text string, more array<long>")
    labels = spark.createDataFrame([(k, int("gruka" in t)) for k, t in enumerate(texts) if t], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    model = toxicity.fit_on_labels(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    low = {x.doc_id for x in toxicity.score_toxicity(docs, model, ["doc_id"]).collect() if x.score < 0.5}
    assert 0 < len(low) < len(texts)
    assert sorted(map(tuple, kept.collect())) == sorted((k, texts[k], [k]) for k in low)
    assert kept.columns == docs.columns
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(" not in plan(kept), "workers get a text beside the row that holds it"
    single = plan(neardup.drop_near_duplicates(docs))
    assert single.index("Aggregate") < single.index("LeftSemi"), "rows are sorted as a whole for copies, and again for the join"


def test_workers_give_memory_back_at_the_end(monkeypatch):
    class System:
        calls = []

        def __init__(self, _):
            pass

        def malloc_trim(self, left):
            self.calls.append(left)

    monkeypatch.setattr(ngrams.ctypes, "CDLL", System)
    batches = ngrams.giving_back(lambda x: (2 * k for k in x))(iter([1, 2]))
    assert next(batches) == 2
    assert not System.calls
    assert list(batches) == [4]
    assert System.calls == [0]
