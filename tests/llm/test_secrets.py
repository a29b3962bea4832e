"""Secret scans against Python's own regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

from tributary.llm.secrets import RADIUS, scan

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WEAK = {"secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"), "endpoint": re.compile(r"""https?://[^\x00-\x20"'<>]+""")}
KINDS = ("assign", "access", "hex", "secret", "endpoint")


def plain(text):
    text = text or ""
    base = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = [(k, *m.span()) for k, m in base]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    scope = lambda s: sum(b <= s for b in breaks)
    near = lambda a, others: any(abs(a[1] - o[1]) <= RADIUS and scope(a[1]) == scope(o[1]) for o in others)
    weak = {k: [(k, *m.span()) for m in r.finditer(text)] for k, r in WEAK.items()}
    secrets = [s for s in weak["secret"] if near(s, [b for b in base if b[0] == "access"])]
    more = secrets + [e for e in weak["endpoint"] if near(e, secrets)]
    write = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(xs, key=lambda x: (x[1], KINDS.index(x[0]))))
    count = lambda k: sum(b[0] == k for b in base)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(write(base).encode()).hexdigest(), write(base + more)


def got(df):
    return sorted(((r.doc_id, (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans)) for r in df.collect()), key=repr)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(((r.doc_id, plain(r.text)) for r in docs.collect()), key=repr)
    assert sum(w[1][0] + w[1][1] + w[1][2] for w in want) > 20
    assert got(scan(docs)) == want


def test_made_texts(spark):
    rng = random.Random(5)
    parts = ["password=", "Token: ", "api_key='", "APIKEY =\"", "secret", "token", "=", ":", "AKIA", "ABCDEFGH12345678", "abc", "0123456789abcdef", "é😀", "\n", "\n \n", " ", "x" * 150, "A1b+" * 10, "https://h.example/a?b", '"', "k", "İK"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 60)))) for i in range(600)]
    near = "AKIA" + "Z" * 16 + " " + "aB3/" * 10 + " https://x.y/z"
    rows += [(1000, near), (1001, near.replace(" ", "\n\n")), (1002, near.replace(" ", " " * RADIUS)), (1003, "aB3/" * 10), (1004, near * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((d, plain(t)) for d, t in rows), key=repr)
    assert any("secret" in w[1][4] for w in want) and any("endpoint" in w[1][4] for w in want)
    for g, w in zip(got(scan(docs)), want, strict=True):
        assert g == w, dict(rows)[g[0]]


def test_nulls_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef"), (3, "token=abcdef"), (3, "token=abcdef1"), (None, "passwd: 123456"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 kind", "2 start", "'z' base", "3 size")
    assert got(scan(docs)) == sorted(((d, plain(t)) for d, t in rows), key=repr)
    assert scan(docs.limit(0)).count() == 0


def test_secrets_assigned_without_spaces(spark):
    """Of a .env file: the value directly follows '='; places are counted by hand, not by a pattern."""
    value = "aB3/" * 10
    head = "AWS_ACCESS_KEY_ID=AKIA" + "Z" * 16 + "\n"
    rows = [(k, f"{head}{name}={value}\nURL=https://x.y/z\n") for k, name in enumerate(["AWS_SECRET_ACCESS_KEY", "aws_secret_access_key"])]
    rows += [(2, f"{head}k={value}=\n"), (3, f"{head}k=a{value}\n"), (4, f"k={value}\n")]
    got_spans = {r.doc_id: r.spans for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = len(head) + len("AWS_SECRET_ACCESS_KEY=")
    whole = f"access:18:38,secret:{start}:{start + 40},endpoint:{start + 45}:{start + 58}"
    assert got_spans == {0: whole, 1: whole, 2: "access:18:38", 3: "access:18:38", 4: ""}


def test_unspaced_and_very_long_texts(spark):
    """A value right behind '=' is one; a text of some megabytes is searched whole."""
    key, secret = "AKIA" + "Q7" * 8, "aB3/" * 10
    near = f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={secret}\nURL=https://s3.example.com/x\n"
    long = "filler words of a log line, 12\n" * 60_000 + "\n" + near + "\n" + "more of it\n" * 60_000
    rows = [(1, near), (2, long), (3, f"{key} x={secret}="), (4, secret), (5, None)]
    found = got(scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted(((d, plain(t)) for d, t in rows), key=repr)
    spans = {d: v[-1] for d, v in found}
    assert "secret:" in spans[1] and "endpoint:" in spans[1] and spans[2].count(":") == spans[1].count(":")
