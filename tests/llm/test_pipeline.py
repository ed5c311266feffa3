import hashlib
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm.byte_bpe import read_ranks
from tabloom.llm.secrets import redact
from tabloom.llm.toxicity import Hasher, apply, calibrate, pack, train
from tests.llm import test_decontamination, test_jaccard_join, test_secrets

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other_as_plain_python_does(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = train(docs, labels)
    logits = apply(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")), model, ["doc_id", "lang", "key"], as_logit=True)
    model = calibrate(model, logits, labels)
    rows = [r for r in docs.collect() if model.score(pack([r.text], Hasher(model.rows)))[0] < 0.3]
    names = {eval(x)[0]: eval(x)[1] for x in test_jaccard_join.plain([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if names[r.doc_id] == r.doc_id]
    hit = {d for d, c in test_decontamination.plain(rows, bench.collect()).items() if any(k[4] for k in c)}
    rows = [r for r in rows if r.doc_id not in hit]
    assert not any("token" in test_secrets.base(r.text)[2] for r in rows)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out.keys() == {r.doc_id for r in rows}
    for r in rows:
        spans = [dict(zip(("start", "stop"), map(int, s.split(":")[1:]), strict=True)) for s in test_secrets.base(r.text)[2].split(",") if s]
        text = redact(r.text, spans)
        ids = plain.encode_ordinary(text)
        assert (out[r.doc_id].n_tokens, out[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())


def test_stages_keep_columns_and_rows_of_awkward_documents(spark, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        assert name == "byte_bpe" or out.columns == awkward.columns, name
        assert out.count() <= awkward.count()
        assert stage(spark, nothing, SF).count() == 0
    kept = Counter(r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, awkward, SF).collect())
    assert kept == Counter(r.doc_id for r in awkward.collect())
