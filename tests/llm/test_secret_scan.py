import hashlib
import random
import re
import time

from wireloom.llm import secret_scan as S

from .edge import docs, empty

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def slow(text):
    found = [(m.start(), i, m.end(), k) for i, (k, rule, ok) in enumerate(BASE) for m in rule.finditer(text or "") if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def check(df):
    paths, ledger = S.scan(df)
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.digest_columns(S.findings(paths, ledger)).collect()), key=repr)
    want = []
    for r in df.collect():
        f = slow(r.text)
        n = [sum(x.startswith(k) for x in f) for k in ("assign", "access", "hex")]
        want.append((r.doc_id, *n, hashlib.sha256(",".join(f).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_edge_cases(spark):
    check(docs(spark, "spans"))
    paths, ledger = S.scan(empty(spark))
    assert paths.count() == 0 and ledger.count() == 0


def test_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_random_texts():
    draw = random.Random(7)
    parts = ["password", "PassWD", "secret", "toKen", "to\u212aen", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "abcdef", "0123456789ab", "AKIA", "AKIAABCDEFGH", "ABCDEFGHIJKLMNOP", "é", "\n", "\t"]
    for _ in range(5000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        got = [f"{k}:{a}:{b}" for k, a, b in S.spans(t) if k in S.BASE]
        assert got == slow(t), t


def test_extra_rules_add_spans():
    t = "x -----BEGIN RSA PRIVATE KEY----- y ghp_" + "a1" * 18 + " z"
    assert {k for k, *_ in S.spans(t)} >= {"pem", "vcs"}


BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
KEY = [c * 64 for c in "MIab"] + ["QrSt+/12=="]
HEAD = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""]


def keyed():
    """(text, what stays of it) with a private key in it."""
    for br in ("\n", "\r\n", "\\n", "\\r\\n", "\n    ", " ", ""):
        yield f"a word {br.join([BEGIN, *KEY, END])} and more", "a word [pem] and more"
    yield "\n".join(["x", BEGIN, *HEAD, *KEY, END, "rest"]), "x\n[pem]\nrest"
    # without an END line
    for br in ("\n", "\r\n", "\\n", "\n    "):
        yield br.join(["x", BEGIN, *KEY, "two words"]), br.join(["x", "[pem]", "two words"])
        yield br.join(["x", BEGIN, *HEAD, *KEY, "two words"]), br.join(["x", "[pem]", "two words"])
    yield "\n".join([BEGIN, *KEY]), "[pem]"
    yield "\n".join([BEGIN, *KEY, "", "Next"]), "[pem]\n\nNext"
    yield "\n\n".join([BEGIN, *KEY[:4], "Next"]), "[pem]\n\nNext"
    yield f"{BEGIN} {KEY[0]} then words", "[pem] then words"
    yield f"the line {BEGIN} opens a key", "the line [pem] opens a key"
    # one key without an END line before another, and two whole ones
    yield "\n".join([BEGIN, *KEY, "some words", BEGIN, *KEY, END]), "[pem]\nsome words\n[pem]"
    yield "\n".join([BEGIN, *KEY, END, "some words", BEGIN, *KEY, END]), "[pem]\nsome words\n[pem]"


def test_a_private_key_is_one_span_with_its_body():
    for text, want in keyed():
        assert S.mask(text, [s for s in S.spans(text) if s[0] == "pem"]) == want, text


def test_masked_texts_hold_no_key_body(spark):
    texts = [t for t, _ in keyed()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.redacted(rows).collect()}
    assert len(out) == len(texts)
    for t in out.values():
        assert not [k for k in (*KEY, BEGIN, END) if k in t], t


def test_a_key_s_label_may_have_any_length():
    label = "VERY " * 200
    text = f"x -----BEGIN {label}PRIVATE KEY-----\n{KEY[0]}\n-----END {label}PRIVATE KEY----- y"
    assert S.mask(text, S.spans(text)) == "x [pem] y"
    began = time.process_time()
    for part in ("-----BEGIN ", "-----BEGIN " + "A" * 500, "PRIVATE KEY"):
        S.spans("-----BEGIN " + part * (2_000_000 // len(part)))
    assert time.process_time() - began < 10


def test_many_markers_take_linear_time():
    for part in (f"{BEGIN}\n", f"{BEGIN}\nA: b", f"{BEGIN}\n{KEY[0]}\n", "-----END " * 3 + BEGIN):
        began = time.process_time()
        S.spans(part * (2_000_000 // len(part)))
        assert time.process_time() - began < 10


def jwt(text):
    return [s[1:] for s in S.spans(text) if s[0] == "jwt"]


def test_token_segments_of_any_length():
    short, long = "a" * 20, "Z" * 50_000
    for a, b, c in ((long, short, short), (short, long, short), (short, short, long), (long, long, long)):
        token = f"eyJ{a}.eyJ{b}.{c}"
        assert jwt(f"bare {token} end") == [(5, 5 + len(token))]
        assert S.mask(f"bare {token} end", S.spans(f"bare {token} end")) == "bare [jwt] end"


def test_tokens_as_the_rule_finds_them():
    draw = random.Random(11)
    rule = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    parts = ["eyJ", "eyJ", "eyJabcdefgh", "abcdefgh", "abc", "-", "_", ".", ".", ".eyJabcdefgh.", " ", "é", "日"]
    some = 0
    for _ in range(30_000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 16)))
        want = [m.span() for m in rule.finditer(t)]
        some += len(want)
        assert jwt(t) == want, t
    assert some > 300


def test_texts_of_nothing_but_token_starts_take_linear_time():
    for part in ("-eyJ", "eyJ-", "eyJaaaaaaaa.", "-eyJaaaaaaaa.eyJ", ".eyJ", "eyJaaaaaaaa.eyJaaaaaaaa-"):
        began = time.process_time()
        S.spans(".eyJ " + part * (2_000_000 // len(part)))
        assert time.process_time() - began < 10


def test_ledger_is_incremental(spark):
    def table(n):
        return spark.createDataFrame([(i, f"text {i % 5} token=abcdef{i % 5}") for i in range(n)], "doc_id long, text string")

    _, one = S.scan(table(4))
    one = spark.createDataFrame(one.collect(), one.schema)
    paths, two = S.scan(table(10), ledger=one)
    assert one.count() == 4 and two.count() == 5 and paths.count() == 10
    # a poisoned ledger entry shows that seen blobs aren't scanned again
    bad = spark.createDataFrame([(r.blob, r.version, []) for r in one.collect()], one.schema)
    paths, got = S.scan(table(10), ledger=bad)
    assert S.findings(paths, got).filter("size(spans) > 0").count() == 2
    _, other = S.scan(table(10), ledger=one, version="next")
    assert other.count() == 9


def test_two_scans_find_what_one_does_and_scan_no_blob_twice(spark, sf, monkeypatch):
    for df in (docs(spark, "spans"), spark.read.parquet(f"{sf}/documents.parquet")):
        one = sorted(map(tuple, S.digest_columns(S.findings(*S.scan(df))).collect()), key=repr)
        scans, scan = [], S.scan

        def kept(*a, **kw):
            paths, ledger = scan(*a, **kw)
            scans.append(ledger.select("blob").collect())
            return paths, ledger

        monkeypatch.setattr(S, "scan", kept)
        assert sorted(map(tuple, S.digest_columns(S.findings(*S.in_two_scans(df))).collect()), key=repr) == one
        monkeypatch.setattr(S, "scan", scan)
        first, both = ([r.blob for r in x] for x in scans)
        assert 0 < len(first) < len(both) == len(set(both)) and set(first) < set(both)
    assert S.in_two_scans(empty(spark))[0].count() == 0


def test_a_changed_rule_is_a_new_version():
    """The version follows from the rules, so nobody has to remember to change it."""
    import importlib

    before = S.RULES_VERSION
    source = open(S.__file__, encoding="utf-8").read()
    assert importlib.import_module(S.__name__).RULES_VERSION == before
    for old, new in (("{36,}\\b", "{30,}\\b"), ("AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{15,}"), ("ASSIGN_LEAST = 6", "ASSIGN_LEAST = 7")):
        assert old in source
        space = {"__name__": S.__name__, "__package__": S.__package__}
        exec(compile(source.replace(old, new, 1), "changed", "exec"), space)  # noqa: S102
        assert space["RULES_VERSION"] != before


def test_findings_beyond_the_bound_meet_by_an_ordinary_join(spark, monkeypatch):
    want = sorted(map(tuple, S.redacted(docs(spark)).collect()), key=repr)
    monkeypatch.setattr(S, "SKIP_BOUND", 0)
    assert sorted(map(tuple, S.redacted(docs(spark)).collect()), key=repr) == want


def test_short_and_long_lists_of_what_to_scan_give_one_result(spark, sf, monkeypatch):
    """Few new blobs, few known ones, and both beyond the bound; ids and texts null or repeated."""
    df = docs(spark, "spans").union(docs(spark, "spans").limit(3))
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for rows, parts in ((df.select("doc_id", "text"), ("doc_id % 7 = 0", "doc_id is null")), (whole, ("doc_id % 7 > 0",))):
        want = sorted(map(tuple, S.digest_columns(S.findings(*S.scan(rows))).collect()), key=repr)
        for part in parts:
            _, ledger = S.scan(rows.filter(part))
            for bound, buckets in ((0, 8192), (-1, 8192), (-1, 0)):
                monkeypatch.setattr(S, "SKIP_BOUND", bound)
                monkeypatch.setattr(S, "MOST_BUCKETS", buckets)
                paths, after = S.scan(rows, ledger=ledger)
                blobs = [r.blob for r in after.select("blob").collect()]
                assert len(blobs) == len(set(blobs)) == paths.select("blob").distinct().count()
                assert sorted(map(tuple, S.digest_columns(S.findings(paths, after)).collect()), key=repr) == want


def test_redacted(spark):
    out = S.redacted(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == docs(spark).count()
    t = out.filter("doc_id = 7").head()
    assert t.text == "[assign]' and [access] and [hex]" and t.n_chars == len(t.text)
    assert S.redacted(empty(spark)).count() == 0
