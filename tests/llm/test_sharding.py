import zlib
from collections import defaultdict

import numpy as np

from tabloom.llm.sharding import jump, shard_documents


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_follows_the_published_loop_and_moves_little():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 2000)
    for n in (1, 2, 16, 17):
        assert jump(keys, n).tolist() == [plain_jump(int(k) % 2**64, n) for k in keys]
    a, b = jump(keys, 16), jump(keys, 17)
    assert ((a == b) | (b == 16)).all()
    assert 0.02 < (a != b).mean() < 0.1


def check(rows, docs):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by_key = defaultdict(set)
    for r in rows:
        by_key[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())


def test_documents(documents):
    check(shard_documents(documents).collect(), documents)


def test_awkward(awkward, nothing):
    check(shard_documents(awkward).collect(), awkward)
    assert shard_documents(nothing).collect() == []
