"""Similar documents against all pairs, and planted near copies in the pipeline's stage."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402
from faultline.llm import similar  # noqa: E402


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(25):  # a few edited words of a hundred and twenty
        base = fresh(120)
        texts += [base, edited(r, base, 1), edited(r, base, 2), edited(r, base, 9)]
    base = fresh(150)  # a crowd of copies of one text that is not there itself
    texts += [edited(r, base, r.randint(1, 3)) for _ in range(150)]
    passage = fresh(60)  # one passage in many texts
    texts += [passage + fresh(30) for _ in range(80)]
    texts += [fresh(3), fresh(5), fresh(6), texts[0], []]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "one two three"), (None, None)]


def groups_of(rows):
    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_groups_equal_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in similar.near_duplicates(df).collect())
    want = groups_of(rows)
    assert got == sorted((str(d), str(c)) for (d, _), c in zip(rows, want, strict=True))
    assert want[:8] == [0, 0, 0, 3, 4, 4, 4, 7]  # two edits are one group, nine are not


def test_stage_drops_planted_near_copies(spark, rows):
    some = rows[:100]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(some, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(groups_of(some)) and kept.columns == ["doc_id", "text"]
    assert similar.near_duplicates(kept.limit(0)).count() == 0


def test_every_simhash_link_is_kept(spark, rows):
    from faultline.llm import simhash

    line = [f"l{i}" for i in range(11)]  # eleven shingles a line, repeated: they outvote the rest of a text
    tails = [" ".join(f"{t}{i}" for i in range(40)) for t in "abcd"]
    texts = [" ".join(line * 100) + " " + t for t in tails] + [tails[0]]
    more = [(1000 + i, t) for i, t in enumerate(texts)] + rows[:200]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    root, near = ({r.doc_id: r.root for r in f(df).collect()} for f in (similar.near_duplicates, simhash.near_duplicates))
    assert len({near[1000 + i] for i in range(4)}) == 1 and len(set(groups_of(more[:4]))) == 4  # two bits apart, yet of few common shingles
    assert len({root[1000 + i] for i in range(4)}) == 1 and root[1004] != root[1000]
    by = {}
    for i, r in near.items():
        assert by.setdefault(r, root[i]) == root[i]
    kept = corpus_pipeline.near_duplicates(spark, df.filter("doc_id >= 1000"), "")
    assert {r.doc_id for r in kept.collect()} == {1000, 1004}


@pytest.mark.parametrize("kind", ["golay", "similar"])
def test_repeated_ids_with_different_texts(spark, kind):
    from faultline.llm import simhash

    ways = {"golay": {}, "similar": {"groups": similar.near_duplicates, "printed": similar.text_node}}[kind]
    t, u, v = (" ".join(f"{x}{i}" for i in range(40)) for x in "tuv")
    rows = [(1, t), (2, t), (2, u), (3, v), (3, v), (4, v), (None, t), (None, "only here once more and again"), (None, "only here once more and again")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **ways)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", t), ("2", u), ("3", v), ("None", rows[-1][1])])
    unlike = spark.createDataFrame([(7, t), (7, u), (7, u)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_duplicates(unlike, **ways).collect()) == [t, u]
