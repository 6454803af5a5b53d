"""Patterns of personal data don't depend on how often a text was copied."""

from tidemark.llm import pii


def test_copies_of_other_followers_leave_a_pattern_alone(spark):
    words = [f"{chr(97 + i)}{chr(98 + i)}word" for i in range(12)]
    seeds = [f"{words[i]} {words[i + 1]} my phone number +1 (555) 010-{1000 + i} {words[i + 2]}" for i in range(8)]
    copies = [f"{words[0]} the phone number is not given in page 12 {words[3]}"] * 200
    unseen = f"{words[4]} our phone number 555-017-4321 {words[5]}"
    texts = [unseen, *seeds, *copies]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.found for r in pii.spans_of(docs).collect()}
    assert [unseen[s.start : s.stop] for s in found[0]] == ["555-017-4321"] and not any(found[i] for i in range(1, len(texts)))
