import hashlib
import re
from collections import Counter, defaultdict

from tabloom.llm.secrets import redact, redact_live, scan_secrets

A = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return tuple(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(text.encode()).hexdigest(), text


def check(docs):
    want = defaultdict(Counter)
    for r in docs.collect():
        want[r.doc_id][base(r.text or "")] += 1
    got = defaultdict(Counter)
    for r in scan_secrets(docs).collect():
        kept = ",".join(s for s in r.spans.split(",") if not s.startswith("token"))
        got[r.doc_id][(r.n_assign, r.n_access, r.n_hex), r.base_sha256, kept] += 1
    assert got == want


def test_base_findings(documents, awkward, nothing):
    check(documents)
    check(awkward)
    assert scan_secrets(nothing).collect() == []


def test_copied_examples_are_told_from_live_values(spark):
    live, copied = "Zq8xT2vLm4Rk7Wp1Ns9B", "Aq1Zw2Sx3Ed4Cr5Fv6Gt"
    rows = [(i, f"see {copied} here", f"src{i}") for i in range(4)] + [(9, f"mine {live} and {copied} KEY api_key='hunter2-Zx81'", "src9"), (10, "token = abc; apiKey: 12345", "src1"), (11, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert got[0].spans == "" and got[0].n_example == 1 and got[0].n_live == 0
    assert got[9].spans.startswith("token:5:25") and copied not in got[9].spans and got[9].n_assign == 1 and got[9].n_live == 2
    assert got[10].n_assign == 0
    out = {r.doc_id: r.text for r in redact_live(docs).collect()}
    assert out[0] == rows[0][1] and live not in out[9] and copied in out[9] and "hunter2" not in out[9] and out[11] is None


def test_redaction_keeps_rows_and_columns(awkward):
    out = redact_live(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert {r.text for r in out.where("doc_id = 10").collect()} == {"[SECRET] and token: abc"}
    assert out.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert redact("abcdef", [{"start": 1, "stop": 3}, {"start": 2, "stop": 4}]) == "a[SECRET]ef"


def test_a_value_of_many_repositories_of_one_owner_is_a_copied_example(spark):
    hot, own = "Aq1Zw2Sx3Ed4Cr5Fv6Gt", "Zq8xT2vLm4Rk7Wp1Ns9B"
    docs = spark.createDataFrame([(i, f"see {hot} here" + (f" and {own}" if i < 5 else ""), "one") for i in range(120)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert got[9].n_example == 1 and got[9].n_live == 0 and got[0].n_live == 1
    assert [(o.n_owners, o.n_repositories) for o in got[0].owned] == [(1, 120), (1, 5)]
    out = {r.doc_id: r.text for r in redact_live(docs).collect()}
    assert hot in out[9] and own not in out[0]
