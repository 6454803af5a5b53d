"""Addresses in other notations, and identifiers at the front of long runs."""

from tidemark.llm import pii


def test_patterns_propose_addresses_without_digits_and_cut_long_runs(spark):
    fill = "one two three four"
    seeds = [f"{fill} please write to jane{chr(97 + i)}@example.org {fill}" for i in range(8)]
    seeds += [f"{fill} from host address 10.0.0.{i} {fill}" for i in range(8)] + [f"{fill} my phone number +1 (555) 010-{1000 + i} {fill}" for i in range(8)]
    unseen = {"please write to": ["jane (at) example.org", "jane.doe at example", "jane at example dot org", "jane @ example.org"], "from host address": ["10 . 0 . 0 . 1", "10[.]0[.]0[.]1"]}
    texts = [(f"{fill} {before} {x} {fill}", x) for before, found in unseen.items() for x in found]
    run = "555-017-4321" + " 1234" * 20
    texts += [(f"{fill} my phone number {run} {fill}", run[:62]), (f"{fill} we look at example.org {fill}", None), (f"{fill} my phone number jane at example.org {fill}", None)]
    docs = spark.createDataFrame(list(enumerate([x for x, _ in texts] + seeds)), "doc_id long, text string")
    found = {r.doc_id: r.found for r in pii.spans_of(docs).collect()}
    for i, (text, want) in enumerate(texts):
        got = [text[s.start : s.stop] for s in found[i]]
        assert got == [want] if want else not got, (text, got)
    masked = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "write to <EMAIL> one" in masked[0] and "address <IP> one" in masked[4]


def test_masking_by_join_equals_masking_in_one_scan(spark, monkeypatch):
    """With more believed patterns than tasks carry; repeated rows, nulls and columns named like the join's own."""
    fill = "one two three four"
    texts = [f"{fill} please write to jane{chr(97 + i)}@example.org {fill}" for i in range(8)] + [f"{fill} please write to jane (at) example.org {fill}", None, "", "no data", "10.0.0.1"]
    rows = [(i, t, i, "x", 0, len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], 3, "x", 0, 0), (None, texts[4], None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, row string, spans int, n_chars int").repartition(3)
    key = lambda r: tuple(map(str, r))
    carried = sorted(pii.redacted(docs).collect(), key=key)
    monkeypatch.setattr(pii, "CARRIED", 0)
    joined = pii.redacted(docs)
    assert joined.columns == docs.columns and sorted(joined.collect(), key=key) == carried
    assert any("<EMAIL>" in (r.text or "") for r in carried) and pii.redacted(docs.limit(0)).collect() == []
