from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import jaccard_join, shingles
from tabloom.llm.components import components
from tabloom.llm.jaccard_join import keep_one, near_duplicates
from tabloom.llm.shared import words
from tabloom.llm.shingles import shingle_sets, word_hashes


def plain_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain(rows):
    """{doc_id: (class_id, copy_of, n_copies, n_links)} by comparing all pairs that share a shingle."""
    sets = plain_sets([t for _, t in rows])
    holders, common, links, root = defaultdict(list), Counter(), Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        common.update(combinations(h, 2))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in common.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups, copies = defaultdict(list), defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
        copies[sets[i] or (i,)].append(i)
    least = lambda of: min((rows[k][0] for k in of if rows[k][0] is not None), default=None)
    return sorted(str((rows[i][0], least(groups[find(i)]), least(copies[sets[i] or (i,)]), len(copies[sets[i] or (i,)]), links[i])) for i in range(len(rows)))


def got(df):
    return sorted(str((r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links)) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab cÉ.é\n", max_size=40), max_size=6))
def test_hashed_shingles_are_as_many_and_as_equal_as_plain_ones(texts):
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(words(t)) for t in texts] and len(set(hashes.tolist())) == len({w for t in texts for w in words(t)})
    sets, want = shingle_sets(texts, 5), plain_sets(texts)
    assert [len(s) for s in sets] == [len(s) for s in want]
    for (a, x), (b, y) in combinations(list(zip(sets, want, strict=True)), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_words_are_hashed_alike_in_chunks(monkeypatch):
    texts = ["one two", None, "", "a" * 50 + " three one", " two ", "x"]
    hashes, counts = word_hashes(texts)
    for chunk in (1, 7, 30):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        again, same = word_hashes(texts)
        assert again.tolist() == hashes.tolist() and same.tolist() == counts.tolist() == [2, 0, 0, 3, 1, 1]
    assert word_hashes([])[0].tolist() == []


def test_documents(documents):
    assert got(near_duplicates(documents)) == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_awkward(awkward, nothing):
    assert got(near_duplicates(awkward)) == plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert near_duplicates(nothing).collect() == []
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and not ids[6] and not ids[7] and ids[4] == 1 and ids[8] == 1 and not ids[9] and ids[1] == ids[2] == ids[3] == 1 and ids[13] == 1 and ids[None] == 1


@pytest.fixture(scope="module")
def crowd(spark):
    """A chain of near copies of one text, and texts that share a passage."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base, passage = rng.choice(vocabulary, 120).tolist(), rng.choice(vocabulary, 60).tolist()
    rows = []
    for i in range(240):
        text = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 4)):
            text[p] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary, 40).tolist() + passage + rng.choice(vocabulary, 40).tolist())) for i in range(150)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_large_buckets_are_split_and_dealt_in_parts(crowd, monkeypatch):
    rows, df = crowd
    monkeypatch.setattr(jaccard_join, "SMALL", 20)
    assert got(near_duplicates(df)) == plain(rows)
    assert keep_one(df).count() == len({r.class_id for r in near_duplicates(df).collect()})


def test_runs_are_repeated_until_the_target_recall(crowd, monkeypatch, caplog):
    rows, df = crowd
    caplog.set_level("INFO", "tabloom.llm.jaccard_join")
    for name, value in {"RUNS": 1, "MORE": 1, "SMALL": 20}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    found = {}
    for target in (0.3, 1.0):
        monkeypatch.setattr(jaccard_join, "TARGET", target)
        caplog.clear()
        links = sum(r.n_links for r in near_duplicates(df).collect())
        runs, recall = next(r.args for r in caplog.records if "recall" in r.msg)
        assert recall >= target
        found[target] = runs, links
    assert found[0.3][0] < found[1.0][0] and found[0.3][1] <= found[1.0][1]
    want = sum(int(x[1:-1].split(", ")[-1]) for x in plain(rows))
    assert found[1.0][1] >= 0.97 * want  # probes are a sample here: 240 of 390 texts
    monkeypatch.setattr(jaccard_join, "MOST", 1)
    caplog.clear()
    near_duplicates(df).count()
    assert [r.levelname for r in caplog.records if "recall" in r.msg] == ["WARNING"]


def test_links_of_probes_are_those_of_all_pairs(crowd):
    texts = [t for _, t in crowd[0]]
    sets = shingle_sets(texts, 5)
    probes = jaccard_join.Probes.of(texts[:30])
    names = {jaccard_join._identity(s) for s in sets[:30]}
    for s, t in zip(sets, plain_sets(texts), strict=True):
        want = {jaccard_join._identity(o) for o, u in zip(sets[:30], plain_sets(texts[:30]), strict=True) if t != u and len(t & u) >= 0.8 * len(t | u)}
        assert set(probes.linked(s)) == want <= names
    assert jaccard_join.Probes.of([]).linked(sets[0]) == [] == probes.linked(sets[0][:0])


def test_parts_of_long_texts(spark, monkeypatch):
    """Near copies of texts with more shingles than a part holds."""
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 5000)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 90_000, 4000)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(rng.integers(0, 4000, 9).tolist())] + [(20, " ".join(base[:500]))]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("a", "b"), ("c", "b"), ("b", "a"), ("d", "d"), (None, "x")] + [("hub", f"s{i}") for i in range(50)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {out[f"{i:03}"] for i in range(61)} == {"000"} and out["c"] == out["b"] == out["a"] == "a" and out["s49"] == "hub" and "x" not in out
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
