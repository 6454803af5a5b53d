"""Filter orders against a plain walk over documents, and awkward rows."""

from itertools import permutations

from tidemark.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def test_orders_against_a_plain_walk(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["short", long, long + " $", "word " * 300, "WORD " * 300 + long, long, None, "", None, "A# " * 210, long + " $", "short"]
    rows = [(i, t, ("de", None, "en", "")[i % 4], 1) for i, t in enumerate(texts)] + [(None, long, "de", 1), (None, None, "de", 1), (2, long + " $", "en", 1)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 12, 1) if i != 7] + [(3, 0, 0), (None, 1, 1)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    fails = []
    for i, text, lang, _ in rows:
        t = text or ""
        w = t.split()
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        good, toxic = any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)
        fails.append((lang or "", {k for k, v in bad.items() if v}, good, toxic))
    parts = {p for p, *_ in fails}
    removed = {}
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [(b, g, x) for p, b, g, x in fails if p == part]
                out = [(b, g, x) for b, g, x in here if f in b and not b & set(order[: step - 1])]
                removed[part, f] = removed.get((part, f), 0) + len(out)
                r = got[part, order, step]
                assert (r.kept, r.removed, r.redundant) == (sum(not b & set(order[:step]) for b, _, _ in here), len(out), sum(f in b and bool(b & set(order[: step - 1])) for b, _, _ in here))
                assert (r.unique_fails, r.good_lost, r.toxic_lost) == (sum(b == {f} for b, _, _ in here), sum(g for _, g, _ in out), sum(x for _, _, x in out))
    assert len(got) == 600 * len(parts)
    assert all(r.shapley == removed[part, order[step - 1]] for (part, order, step), r in got.items())


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a", "en", 1)], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert filter_audit.audit(docs, labels.limit(0)).count() == 600
