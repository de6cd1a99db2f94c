"""Decontamination and secret scans, against plain versions."""

import hashlib
import random
import re

import pytest

from nearfield.llm import decontaminate, queries, secret_scan

SCHEMA = "doc_id bigint, text string, item_id string, spans string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_contamination(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, t in items:
        v = plain_words(t)
        n = min(10, len(v))
        for win in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def test_decontamination_equals_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_decontamination(spark, sf).collect()}
    assert got == {d: plain_contamination(t, items) for d, t in docs}
    assert any(x[-1] for x in got.values())


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 500])
def test_decontamination_odd_tables(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(1)
    word = lambda: r.choice(["a", "b", "A", "ü", "7", "x"])
    docs = [(i, " ".join(word() for _ in range(r.randrange(120))), "q", "s") for i in range(60)]
    docs += [(1, None, None, None), (1, None, None, None), (None, "a b a b", None, None), (2, "", None, None), (3, "a-b.a_b x", None, None), (3, "a-b.a_b x", None, None)]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 10, 11, 14, 2, 5, 5])] + [(20, None), (21, ""), (None, "b b b"), (22, docs[7][1]), (22, docs[7][1]), (23, "zz a"), (24, docs[9][1])]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(d, b, block_bytes=block)
    rows = decontaminate.report(d, b).collect()
    named = [x for x in items if x[0] is not None]
    want = sorted([(i, *plain_contamination(t, named)) for i, t, *_ in docs], key=repr)
    hits = sorted([(i, *plain_contamination(t, items))[:3] for i, t, *_ in docs], key=repr)
    assert sorted([tuple(x)[:3] for x in rows], key=repr) == hits
    assert sorted([tuple(x) for x in decontaminate.report(d, b.where("item_id is not null")).collect()], key=repr) == want
    clean = decontaminate.decontaminated(d, b)
    assert clean.columns == d.columns and clean.count() == sum(not plain_contamination(t, items)[-1] for _, t, *_ in docs)
    assert found.count() == len({(i, t or "") for i, t, *_ in docs if plain_contamination(t, items)[-1]})
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0


# --- secrets --------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, p, group, least in [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]:
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in re.finditer(p, text or "", flags) if len(m[group]) >= least]
    return sorted(out)


def plain_all(text, scope=secret_scan.SCOPE):
    base = plain_base(text)
    parts = [(s, e, k) for s, _, e, k in base]
    if re.search(r"AKIA[A-Z0-9]+", text or "") or re.search(secret_scan.WEAK[0][1], text or "", re.A):
        for kind, p, group, least in secret_scan.WEAK:
            for m in re.finditer(p, text or "", re.A):
                if len(m[group]) >= least and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                    parts.append((m.start(), m.end(), kind))
    names, out = secret_scan.KINDS, []
    for s, e, k in parts:
        near = {k2 for s2, _, k2 in parts if abs(s2 - s) <= scope}
        ids, secrets = near & set(secret_scan.IDENTIFIERS), near & set(secret_scan.SECRETS)
        if names.index(k) < 3 or {"identifier": secrets, "value": ids, "endpoint": ids and secrets}[k]:
            out.append((s, names.index(k), e))
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))


def plain_row(text):
    base = plain_base(text)
    n = lambda kind: sum(k == kind for *_, k in base)
    return n("assign"), n("access"), n("hex"), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in base)), plain_all(text)


TRICKY = [
    "token=abc token==abcdefgh😀 SECRET : 'abcdefghi' api_key=\"k\" apikey:12345678 x",
    "token=\"secret\"=\"abcdefghijk password=passwd=12345678",
    "AKIA AKIAAAAAAAAAAAAAAA AKIAX AKIAAKIA1234567890 é AKIA12345678901234",
    "0" * 31 + " " + "a" * 32 + "g" + "0123456789abcdef" * 3,
    "user_name: alice near Abcd1234" + "xY9" * 12 + " at https://host.example/x?y=1 end",
    "user_name: alice" + " far" * 200 + "Abcd1234" + "xY9" * 12,
    "value only Abcd1234" + "xY9" * 12 + " https://host.example",
    "toKen=Kabcdefgh ſecret=abcdefghi",
    "login=bob@x https://a.example/b",
    "password=" + "a" * 5000 + " " + "token=abcdefgh " * 500,
    "secret =abcdefghij password\n=abcdefghij passwd   :   'abcdefghij'",
]


def test_secret_scan_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op10_secret_scan(spark, sf).collect()}
    assert got == {d: plain_row(t) for d, t in docs}
    assert sum(x[0] for x in got.values())


def test_secret_scan_odd_tables(spark):
    r = random.Random(2)
    bits = ["token", "=", ":", " ", "'", "abcdefgh", "AKIA", "0123456789ABCDEF", "deadbeef" * 4, "login", "😀", "é", "https://h.example/", "Zz9" * 12, "\n", "api_key", " word" * 30]
    docs = [(i, t, None, "x") for i, t in enumerate(TRICKY + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(200)])]
    docs += [(None, None, None, None), (5, "", None, None), (0, TRICKY[0], None, None), (0, TRICKY[0], None, None), (0, TRICKY[1], None, None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = sorted([tuple(x)[:6] for x in secret_scan.report(frame).collect()], key=repr)
    assert got == sorted([(i, *plain_row(t)) for i, t, *_ in docs], key=repr)
    assert secret_scan.report(frame.limit(0)).count() == 0
    kept = secret_scan.redact(frame)
    assert kept.columns == frame.columns and kept.schema == frame.schema
    want = []
    for i, t, *rest in docs:
        spans = [tuple(map(int, x.split(":")[1:])) for x in plain_all(t).split(",") if x]
        out, at, merged = [], 0, []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out.append(t[at:s])
            at = e
        want.append((i, "[SECRET]".join([*out, t[at:]]) if t is not None else None, *rest))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
