"""Empty tables, repeated rows, ties and columns whose names clash with those that operators use inside."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embed_dups, htmltext, mixing, near_copies, packing, passages, pii, quality, simhash, warc

DOCS = "doc_id long, text string, source string, n_chars int"
#: Names of columns inside the operators.
CLASHING = ("row", "at", "name", "component_id", "component", "copies", "__copy", "draw", "preference", "spans", "first", "node", "size", "key", "a b")
VOCABULARY = np.array([f"w{i}" for i in range(900)])
STAGES = {"accepted": quality.accepted, "near_dedup": near_copies.near_dedup, "redacted": pii.redacted, "mixed": mixing.mixed_documents, "joined": lambda d: pii._redacted_by_join(d, pii.Bootstrap())}


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def with_clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_carry_columns_of_any_name(spark, name):
    texts = [prose(80, 1), prose(80, 2), prose(80, 1), prose(60, 3) + " mail me@here.org", None, ""]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    plain = STAGES[name](docs)
    wide = STAGES[name](with_clashing(docs))
    assert wide.columns == [*docs.columns, *CLASHING]
    got = wide.collect()
    assert sorted(map(repr, plain.collect())) == sorted(repr(r) for r in wide.select(*docs.columns).collect()) and got
    for r in got:
        assert all(r[c] == f"{c}:{r.doc_id}" for c in CLASHING)
    assert STAGES[name](with_clashing(docs.limit(0))).collect() == []
    kept = {r.doc_id for r in got}
    assert {"accepted": kept == {0, 1, 2, 3}, "near_dedup": kept == {0, 1, 3, 4}}.get(name, 3 in kept)
    if name in ("redacted", "joined"):
        assert kept == set(range(6)) and "me@here.org" not in next(r.text for r in got if r.doc_id == 3)


def test_pages_repeated_missing_and_with_other_columns(spark):
    html = "<html><body><article>" + "".join(f"<p>{prose(40, i)}</p>" for i in range(3)) + "</article></body></html>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (None, "v", html), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = pages.withColumns({c: F.lit(7) for c in ("text", "n_chars", "payload", "digest", "record_type", "n", "least")})
    for run in (htmltext.extract, warc.deduplicate):
        found = run(wide)
        assert "payload" not in found.columns and found.count() == len(rows)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, run(pages).collect()))
        assert run(wide.limit(0)).collect() == []
    by_id = {r.page_id: r for r in warc.deduplicate(wide).where("page_id > 1").collect()}
    assert by_id[2].payload_bytes == by_id[3].payload_bytes == 0 and {r.record_type for r in by_id.values()} == {"response"}
    assert sorted(r.record_type for r in warc.deduplicate(wide).where("page_id = 1 or page_id is null").collect()) == ["response", "revisit", "revisit"]


def test_vectors_repeated_missing_and_with_other_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [None, 1.0]), (7, []), (None, [3.0, 0.0]), (8, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = vectors.withColumns({c: F.lit("x") for c in ("e", "good", "id", "copies", "component_id", "kept", "n_links", "label")})
    found = embed_dups.embedding_classes(wide)
    got = sorted(map(repr, found.collect()))
    assert got == sorted(map(repr, embed_dups.embedding_classes(vectors).collect())) and len(got) == len(rows)
    links = {r.vec_id: (r.n_links, r.component_id) for r in found.where("vec_id is not null").collect()}
    assert links == {1: (3, 1), 2: (3, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}
    assert embed_dups.embedding_classes(wide.limit(0)).collect() == []


def test_ties_and_repeated_rows(spark):
    """Texts of one size, ids given twice: the mix and the packing are the same however the rows are dealt."""
    texts = [" ".join([w] * 60) for w in VOCABULARY[:40]]
    rows = [(i % 35, t, "ab"[i % 2], 0) for i, t in enumerate(texts)] + [(0, texts[0], "a", 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    once, again = (sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert once == again and len(once) == len(rows)
    packed = packing.pack(docs).toPandas()
    assert sorted(packed.drop(columns="sequence_id").itertuples(index=False), key=repr) == sorted(packing.pack(docs.repartition(7)).toPandas().drop(columns="sequence_id").itertuples(index=False), key=repr)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and (g.offset.to_numpy()[1:] == (g.offset + g.length).to_numpy()[:-1]).all()
    classes = simhash.simhash_classes(docs).collect()
    assert len(classes) == len(rows) and len({r.component_id for r in classes if r.doc_id == 0}) <= 2


def test_passages_of_repeated_rows(spark):
    shared = prose(70, 9)
    docs = spark.createDataFrame([(i, f"{prose(40, 50 + i)} {shared} {prose(40, 90 + i)}", "s", 0) for i in range(4)] * 2 + [(9, None, "s", 0)], DOCS)
    for found in (passages.shared_passages(with_clashing(docs)).collect(), passages.shared_passages(docs.repartition(5)).collect()):
        spans = [(r.doc_id, r.start, r.n_words) for r in found] + [(r.ref_doc_id, r.ref_start, r.ref_words) for r in found]
        for i in range(4):  # which document is the one referred to follows from how rows are dealt
            assert any(d == i and start <= 40 and start + n >= 110 for d, start, n in spans)
        assert {d for d, _, _ in spans} == {0, 1, 2, 3}
