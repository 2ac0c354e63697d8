import random

from annolake.operators.lines import text_lines
from annolake.sources import content as C


def times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1, 0, 0, 1, 0, 0)


def interpreted(ops):
    """Step by step, with a stack."""
    ctm, size, lead, stack, tm, lm, out, warned = ONE, 0, 0, [], ONE, ONE, [], 0
    for op, n, text in ops:
        if op == "q":
            stack.append((ctm, size, lead))
        elif op == "Q":
            if stack:
                ctm, size, lead = stack.pop()
            else:
                warned += 1
        elif op == "cm":
            ctm = times(n, ctm)
        elif op == "Tf":
            size = n[0]
        elif op == "TL":
            lead = n[0]
        elif op == "BT":
            tm = lm = ONE
        elif op == "Tm":
            tm = lm = tuple(n)
        elif op in ("Td", "TD", "T*"):
            lead = -n[1] if op == "TD" else lead
            tx, ty = (0, -lead) if op == "T*" else n
            tm = lm = times((1, 0, 0, 1, tx, ty), lm)
        elif op == "k":
            tm = times((1, 0, 0, 1, -n[0] / 1000 * size, 0), tm)
        elif op == "Tj":
            m, wide = times(tm, ctm), 0.5 * len(text) * size
            if text:
                out.append((text, m[4], m[5], wide * (m[0] ** 2 + m[1] ** 2) ** 0.5, size * (m[2] ** 2 + m[3] ** 2) ** 0.5))
            tm = times((1, 0, 0, 1, wide, 0), tm)
        elif op == "?":
            warned += 1
    return out, warned


def stream(r, n):
    number = lambda: r.choice(("1", "2.5", "-3", ".5", "+4", "10", "0"))
    out = []
    for _ in range(n):
        op = r.choice(("q", "q", "Q", "cm", "BT", "ET", "Tf", "TL", "Td", "TD", "Tm", "T*", "Tj", "Tj", "TJ", "'", '"', "rg", "Do", "cm?", "Tj?"))
        operands = {"cm": 6, "Td": 2, "TD": 2, "Tm": 6, "TL": 1, "rg": 3, "cm?": 4}.get(op, 0)
        own = [number() for _ in range(operands)]
        own += {"Tf": ["/F1", number()], "Tj": [r.choice(("(ab)", "()", "(a\\)\\(b)", "(n(es)t)", "<4142>", "(\\101\\n)"))], "TJ": [f"[(x) {number()} (yz) <41> {number()}]"], "'": ["(q)"], '"': ["1", "2", "(dq)"], "Do": ["/Im"]}.get(op, [])
        out.append(" ".join([*own, op.strip("?")]) + r.choice((" ", "\n", " % note (\n", "\r\n")))
    return "".join(out).encode()


def test_items_equal_a_step_by_step_interpreter(spark):
    r = random.Random(6)
    pages = {f"p{i}": stream(r, r.randint(0, 60)) for i in range(40)}
    pages["deep"] = b"q " * 60 + b"2 0 0 1 3 4 cm BT /F 5 Tf (in) Tj ET " + b"Q " * 61 + b"BT (out) Tj ET"
    frame = spark.createDataFrame(list(pages.items()), "page_id string, content binary")
    items, warnings = C.text_items(frame)
    got, told = {}, {}
    for x in sorted(items.collect(), key=lambda x: x["ord"]):
        got.setdefault(x["page_id"], []).append((x["text"], x["x"], x["y"], x["width"], x["height"]))
    for x in warnings.where("ord IS NOT NULL").collect():
        told[x["page_id"]] = told.get(x["page_id"], 0) + 1
    shown = 0
    for page, data in pages.items():
        want, warned = interpreted(C.operators(data))
        own = got.get(page, [])
        shown += len(want)
        assert [x[0] for x in own] == [x[0] for x in want], page
        assert all(abs(a - b) <= 1e-6 * max(1, abs(b)) for x, y in zip(own, want, strict=True) for a, b in zip(x[1:], y[1:], strict=True)), page
        assert told.get(page, 0) == warned
    assert shown > 300 and sum(told.values()) > 50


def test_strings_and_broken_streams():
    told = list(C.operators(b"(a\\\n b\\053\\8(c)) Tj <616> Tj [] TJ (open Tj"))
    assert told == [("Tj", [], "a b+8(c)"), ("Tj", [], "a`")]
    assert list(C.operators(b"1 2 Td 3 cm Tj [(a)] Tj 7 /F Tf")) == [("Td", [1.0, 2.0], None), ("?", [], "cm"), ("?", [], "Tj"), ("?", [], "Tj"), ("Tf", [7.0], None)]
    long = b"(" + b"\\(" * 100_000 + b") Tj"
    assert next(C.operators(long))[2] == "(" * 100_000


def test_lines_labels_and_silent_pages(spark):
    frame = spark.createDataFrame([("a", b"BT /F 10 Tf 12 TL 50 700 Td (One line) Tj T* (and) Tj ( more) Tj ET"), ("b", None), ("c", b"q Q")], "page_id string, content binary")
    items, warnings = C.text_items(frame)
    assert [r["text"] for r in sorted(text_lines(items.select("page_id", "text", "x", "y", "width", "height")).collect(), key=lambda r: r["ord"])] == ["One line", "and more"]
    assert {(w["page_id"], w["warning"]) for w in warnings.collect()} == {("b", "no stream"), ("c", "no text")}
    pages = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "doc_id string, page_index int")
    labels = spark.createDataFrame([("d", 0, "iv"), ("d", 1, ""), ("e", 2, "x")], "doc_id string, page_index int, label string")
    assert sorted(r["label"] for r in C.page_labels(pages, labels).collect()) == ["2", "3", "iv"]
