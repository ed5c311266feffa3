import numpy as np

from tabloom.llm import nearest
from tabloom.llm.nearest import Coder, Piece, search


def plain(rows, every, k):
    ids = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for i, v in ids:
        if i % every == 0:
            near = sorted((-float((np.array(w) * np.array(v)).sum()), j) for j, w in ids if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 32))
    coder = Coder.learn(rows[:500])
    piece = Piece(coder, rows)
    code = coder.parts(rows[:1])[0]
    differ = np.bitwise_count(piece.codes ^ code).sum(axis=1)
    for radius in (0, 5, 17, 40, 60, 127, 128):
        assert np.array_equal(piece.within(code, radius), np.flatnonzero(differ <= radius))


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    want, have = plain(rows, 20, 20), got(search(table, 20))
    assert have.keys() == want.keys()
    hit = sum(len({j for j, _ in want[q]} & {j for j, _ in have[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    vectors = dict(rows)
    assert all(abs(s - float(np.dot(vectors[q], vectors[j]))) < 1e-12 for q, near in have.items() for j, s in near)


def test_awkward(spark):
    rng = np.random.default_rng(1)
    same = [0.5, -1.0, 0.25, 2.0]
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 60)] + [(i, same) for i in range(100, 190)] + [(100, same), (7, [9.0, 9.0, 9.0, 9.0])]
    bad = [(20, None), (40, [0.0] * 4), (60, [1.0, None, 1.0, 1.0]), (200, [float("nan")] * 4), (220, [float("inf"), 1.0, 1.0, 1.0]), (240, [1.0]), (None, same), (260, [])]
    table = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, embedding array<float>, ids int, vector int")
    have, want = got(search(table, 20, 5)), plain(good, 20, 5)
    assert have.keys() == want.keys()
    for q in want:
        assert [j for j, _ in have[q]] == [j for j, _ in want[q]], q
    few = spark.createDataFrame([(20, same), (21, [1.0, 1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert got(search(few, 20)) == {20: [(21, 1.75)]}
    assert search(table.where("false"), 20).collect() == [] and search(table.where("vec_id = 21"), 20).collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = got(search(table, 2, 3))
    monkeypatch.setattr(nearest, "BLOCK", 7)
    assert got(search(table, 2, 3)) == want
    monkeypatch.setattr(nearest, "PIECE_BYTES", 640)  # pieces of ten vectors
    many = got(search(table, 2, 3))
    assert many.keys() == want.keys() and sum(len({j for j, _ in want[q]} & {j for j, _ in many[q]}) for q in want) >= 0.9 * 3 * len(want)
    assert many == got(search(table.repartition(3), 2, 3))
