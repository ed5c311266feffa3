import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import repeats
from tabloom.llm.repeats import SEEN, firsts, occurrences, remove_repeats
from tabloom.llm.suffixes import suffix_order, window_classes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffixes_are_sorted(text):
    t = np.array(text, np.int64)
    assert suffix_order(t, 10**9).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2), min_size=1, max_size=150), st.integers(8, 14))
def test_equal_windows_share_a_class(text, length):
    t = np.array(text, np.int64)
    valid = np.arange(len(t)) + length <= len(t)
    places, kinds = window_classes(t, valid, length)
    of = {}
    for p, k in zip(places.tolist(), kinds.tolist(), strict=True):
        of.setdefault(tuple(text[p : p + length]), set()).add(k)
    assert len(places) == valid.sum() and all(len(k) == 1 for k in of.values()) and len(set.union(*of.values(), set())) == len(of)


def plain(rows):
    """Removal by looking at every string, document after document; documents of one id see only smaller ids and themselves."""
    seen, out = set(), Counter()
    groups = {}
    for i, t in rows:
        groups.setdefault((i is None, i), []).append((t or "").encode())
    for (_, i), texts in sorted(groups.items(), key=lambda g: (g[0][0], g[0][1] or 0)):
        new = set()
        for text in texts:
            own, gone = set(), bytearray(len(text))
            for s in range(len(text) - 99):
                x = text[s : s + 100]
                if x in seen or x in own:
                    gone[s : s + 100] = b"\1" * 100
                own.add(x)
            new |= own
            mask = np.frombuffer(bytes(gone), np.uint8)
            kept = bytes(b for b, m in zip(text, gone, strict=True) if not m)
            out[str(i), len(text), int(mask.sum()), int((np.diff(mask, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
        seen |= new
    return out


def got(df):
    return Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_documents(documents):
    assert got(remove_repeats(documents)) == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_awkward(awkward, nothing):
    assert got(remove_repeats(awkward)) == plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert remove_repeats(nothing).collect() == []


def test_texts_of_few_letters_and_periods(spark):
    rng = np.random.default_rng(2)
    unit = "".join(rng.choice(list("ab"), 300).tolist())
    texts = ["a" * 700, "ab" * 300, unit[:150] + unit[40:260], unit, "x" + unit * 2, "é" * 120, "a" * 99, "a" * 100, unit[10:] + "b" * 130] + ["".join(rng.choice(list("ab"), 60).tolist()) + unit[50:190] + "".join(rng.choice(list("ab"), 60).tolist()) for _ in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(remove_repeats(df)) == plain(rows)
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, with_text=True).collect()}
    assert kept[7] == b"" and kept[6] == b"a" * 99


def test_an_anchor_of_many_kinds_is_dealt_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 3)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    shared = " ".join(rng.choice(words, 60).tolist())
    rows = [(i, " ".join(rng.choice(words, 20).tolist()) + " " + shared + " " + " ".join(rng.choice(words, 20).tolist())) for i in range(40)]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_slices_of_a_long_text_have_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 101, 30_000).astype(np.uint8))
    one = occurrences([text], np.array([1]), np.array([2]))
    monkeypatch.setattr(repeats, "SLICE", 7_001)
    cut = occurrences([text], np.array([1]), np.array([2]))
    rows = lambda o: {tuple(int(o[c][i]) for c in ("anchor", "around", "check", "at", "left", "right")) for i in range(len(o["at"]))}
    assert rows(one) == rows(cut)
    assert {n for n, _ in SEEN} == set(firsts(one)[0])


def test_an_anchor_across_a_cut_keeps_the_starts_of_both_slices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    passage, cut = letters(140), repeats.SLICE
    long = letters(cut - 20) + passage + letters(300)
    rows = [(1, long.decode()), (2, (letters(150) + passage + letters(150)).decode())]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 140}

    text = letters(30_000)
    twice = [text, b"x" + text]
    rows = lambda o: sorted(zip(*(o[c].tolist() for c, _ in SEEN), strict=True))
    one = firsts(occurrences(twice, np.array([1, 2]), np.array([2, 3])))[0]
    monkeypatch.setattr(repeats, "SLICE", 7_001)
    assert rows(one) == rows(firsts(occurrences(twice, np.array([1, 2]), np.array([2, 3])))[0])
