"""The scan behind keywords against the scan of every rule, on a text for each alternative of each rule."""

from re import _parser as sre

from annolake.llm import license_scan as L
from pyspark.sql import functions as F


def examples(parsed):
    """Texts that match: each alternative and each optional part once, the others as they come first."""
    parts = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "IN":
            kind, first = value[0]
            parts.append([{"LITERAL": lambda f: chr(f), "RANGE": lambda f: chr(f[0]), "CATEGORY": lambda f: {"CATEGORY_DIGIT": "2", "CATEGORY_SPACE": " "}.get(str(f), "x")}[str(kind)](first)])
        elif name == "BRANCH":
            parts.append([t for branch in value[1] for t in examples(branch)])
        elif name == "SUBPATTERN":
            parts.append(examples(value[-1]))
        else:
            low, high, inner = value
            some = examples(inner)
            parts.append([some[0] * low] + [t * max(1, low) for t in some[low > 0 :] if high])
    out = ["".join(p[0] for p in parts)]
    for k, p in enumerate(parts):
        out += ["".join(q[0] if j != k else t for j, q in enumerate(parts)) for t in p[1:]]
    return out


def scanned(frame):
    return {x["doc_id"]: x for x in L.scan_licenses(frame).collect()}


def test_keywords_lose_no_match(spark, monkeypatch):
    patterns = [p for _, p, _ in (*L.NAMES, *L.NOTICES)]
    texts = sorted({t for p in patterns for t in examples(sre.parse(p))} | {"SPDX-License-Identifier: MIT", "cc+0", "CC--BY"})
    texts = sorted({form for t in texts for form in (t, t.upper(), t.replace(" ", "\n"), t.replace(" ", " \n "))})
    frame = spark.createDataFrame(list(enumerate(f"x {t} 1" for t in texts)), "doc_id long, text string")
    got = scanned(frame)
    plain = L.rules()
    monkeypatch.setattr(L, "_may_match", lambda low: F.lit(True))
    monkeypatch.setattr(L, "rules", lambda: [(label, p, "x", priority, base) for label, p, _, priority, base in plain])
    want = scanned(frame)
    assert len(texts) > 400 and sum(bool(x["labels"]) for x in want.values()) > 0.9 * len(texts)
    assert {texts[i]: got[i] for i in want if got[i] != want[i]} == {}
