import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import decontamination
from tabloom.llm.decontamination import CELLS, Segment, decontaminate, drop_contaminated, index
from tabloom.llm.shared import words

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return W.findall((text or "").translate(FOLD))


def plain(docs, bench):
    windows = defaultdict(set)
    for r in bench:
        w = tokens(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("" if r.item_id is None else str(r.item_id))
    out = defaultdict(Counter)
    for r in docs:
        w, hit, items = tokens(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out[r.doc_id][len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(df):
    out = defaultdict(Counter)
    for r in df.collect():
        out[r.doc_id][r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated] += 1
    return out


@pytest.fixture(scope="module")
def bench(spark):
    rows = [
        (1, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "two three"), (3, None), (None, "naïve été"), (4, ""), (4, "x"), (5, "one TWO three"),
        (6, "word5 and 5 word6 and 6 word7 and 7 word8"), (6, "word5 and 5 word6 and 6 word7 and 7 word8"), (7, "never seen anywhere " * 9),
    ]
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "item_id long, text string, row string")


def test_awkward(awkward, bench, nothing):
    want = plain(awkward.collect(), bench.collect())
    assert got(decontaminate(awkward, bench, ["doc_id"])) == want
    assert got(decontaminate(awkward, bench, ["doc_id"], block_chars=40)) == want  # some blocks
    assert decontaminate(nothing, bench, ["doc_id"]).collect() == []
    assert decontaminate(awkward, bench.where("false"), ["doc_id"]).where("contaminated or n_items > 0").count() == 0


def test_documents(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain(documents.collect(), bench.collect())
    assert got(decontaminate(documents, bench, ["doc_id"])) == want
    clean = {d for d, c in want.items() if not any(k[4] for k in c)}
    assert {r.doc_id for r in drop_contaminated(documents, bench).collect()} == clean


def test_dropping_keeps_clean_rows_and_all_columns(awkward, bench):
    out = drop_contaminated(awkward, bench)
    want = plain(awkward.collect(), bench.collect())
    assert out.columns == awkward.columns
    assert out.count() == sum(n for c in want.values() for k, n in c.items() if not k[4])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "a x x x x b"), (3, "b"), (4, "a")], "doc_id long, text string").coalesce(1)
    row = index(docs, ["doc_id"]).collect()[0]
    segment = Segment({c: bytes(row[c]) for c in CELLS})
    a, b, other = decontamination.hashed(["a b c"])[0]
    both = decontamination.phrases([("i", "a b")], 3)
    assert both.terms.shape == (1, 3) and set(both.vocabulary.tolist()) == {int(a), int(b)}
    assert [len(segment.near(both, n)[0]) for n in (2, 3, 5, 50)] == [0, 1, 2, 2]
    assert np.array_equal(segment.postings(other), []) and np.array_equal(segment.postings(a), [0, 5, 14])
    x = decontamination.hashed(["x"])[0][0]
    assert np.array_equal(segment.postings(x), [1, 2, 6, 7, 8, 9])  # words that no test text has are indexed too


def near_plain(docs, bench, slop, window=10):
    """Items with a window whose words all stand within slop of a place of its rarest word, over all documents one segment."""
    out = defaultdict(Counter)
    texts = [(r.doc_id, tokens(r.text)) for r in docs]
    count = Counter(w for _, t in texts for w in t)
    for doc, t in texts:
        items = set()
        for r in bench:
            w = tokens(r.text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                own = w[i : i + window]
                fewest = min(count[x] for x in own)
                for rare in {x for x in own if count[x] == fewest}:
                    for p in [p for p, x in enumerate(t) if x == rare]:
                        around = set(t[max(0, p - slop) : p + slop + 1])
                        if all(x in around for x in own):
                            items.add((r.item_id, fewest, len({x for x in own if count[x] == fewest})))
        out[doc] = {str(i) for i, _, _ in items}
    return out


def test_near_items(spark):
    rows = [(1, "p q r s t u"), (2, "u t s r q p"), (3, "p q x x x x x x r s t u"), (4, "p q r s"), (5, None), (6, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("i", "p q r s t u"), ("j", "v w"), ("k", "v")], "item_id string, text string")
    for slop in (3, 5, 30):
        got = {r.doc_id: (set(r.near), r.n_near) for r in decontaminate(docs, bench, ["doc_id"], window=6, slop=slop).collect()}
        want = near_plain(docs.collect(), bench.collect(), slop, 6)
        if slop != 3:  # where several words are rarest, either may be the middle
            assert got == {d: (want[d], len(want[d])) for d in got}
    assert got[1] == got[2] == got[3] == ({"i"}, 1) and got[4] == ({*()}, 0) and got[6] == ({"k"}, 1)
    split = {r.doc_id: set(r.near) for r in decontaminate(docs, bench, ["doc_id"], window=6, slop=30, block_chars=3).collect()}
    assert split == {d: n for d, (n, _) in got.items()}


def test_windows_longer_than_any_padding(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.n_hit for r in decontaminate(docs, docs.selectExpr("doc_id item_id", "text").where("item_id = 1"), ["doc_id"], window=2000).collect()}
    assert out == {1: 3000, 2: 0}


def test_the_rarest_lists_are_met_a_bounded_number_at_a_time(awkward, bench, monkeypatch):
    want = got(decontaminate(awkward, bench, ["doc_id"]))
    for step in (1, 7):
        found = decontamination.phrases([(str(r.item_id), r.text) for r in bench.collect()])
        row = index(awkward.coalesce(1), ["doc_id"]).collect()[0]
        segment = Segment({c: bytes(row[c]) for c in CELLS})
        whole = sorted(zip(*(x.tolist() for x in segment.exact(found)), strict=True))
        monkeypatch.setattr(decontamination, "STEP", step)
        assert sorted(zip(*(x.tolist() for x in segment.exact(found)), strict=True)) == whole and whole
    assert want


def test_segments_of_any_size(awkward, bench, monkeypatch):
    want = got(decontaminate(awkward, bench, ["doc_id"]))
    monkeypatch.setattr(decontamination, "TEXT_CHARS", 50)
    small = index(awkward, ["doc_id"], segment_words=3)
    assert small.count() > 5 and sum(len(r["keys"]) for r in small.collect()) == awkward.count()
    assert got(decontaminate(awkward, bench, ["doc_id"])) == want


def test_words():
    assert words("Ab-c É9 _z\x7f") == [b"ab", b"c", "É9".encode(), b"z"] and words(None) == []
