"""The corpus operators against brute force and on awkward rows."""

import hashlib
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embed_dups, htmltext, licenses, mixing, packing, passages, pii, quality, simhash, warc

DOCS = "doc_id long, text string, source string, text_hash int"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(4000)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)


AWKWARD = [(None, "some text", "a", 1), (1, None, None, None), (2, "", "b", 2), (3, "word", "b", 3), (3, "word", "b", 3), (4, "\x0b \t\n", None, 4), (5, "naïve \U0001f600 " * 30000, "c", 5)]
RUNS = {
    "quality": quality.repetition_report, "accepted": quality.accepted, "mix": mixing.mix, "mixed": mixing.mixed_documents, "pack": packing.pack, "passages": passages.shared_passages,
    "simhash": simhash.simhash_classes, "dedup": simhash.simhash_dedup, "pii": pii.spans_of, "redacted": pii.redacted, "licenses": licenses.scan,
}
ROW_BY_ROW = ("quality", "mix", "simhash", "pii", "redacted", "licenses")


@pytest.mark.parametrize("name", list(RUNS))
def test_awkward_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    found = RUNS[name](docs).collect()
    if name in ROW_BY_ROW:
        assert len(found) == len(AWKWARD)
    assert RUNS[name](docs.limit(0)).collect() == []


def test_quality_against_plain_counts(spark):
    texts = [prose(80, 1), "a b c " * 40, "x y\n" * 30 + prose(60, 2), prose(49, 3), "#*$ <b> | & %" + prose(60, 4), prose(120, 5) + " " + prose(120, 5)]
    for r in quality.repetition_report(corpus(spark, texts)).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert r.kept == (r.doc_id in (0, 2, 4))  # 14 % of the characters of text 2 are in repeats, half of those of text 5


def test_main_text(spark):
    body = "".join(f"<p>{prose(30, i)}</p>" for i in range(4))
    html = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Menu</a></ul></nav><article><h1>Caf&eacute; &amp; more</h1>{body}</article><div class=comments><p>nice</p></div><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, 0), (2, None, None, 0), (None, "v", "", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert got[1].text == "\n".join(["Café & more", *[prose(30, i) for i in range(4)]]) and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[None].n_chars == 0


def test_mix_meets_targets(spark):
    rows = [(i, prose(50 + i % 40, i), s, 0) for i, s in enumerate(["a"] * 400 + ["b"] * 200 + [None] * 200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert sorted(got.taken) == sorted(mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).toPandas().taken)
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 90


def test_packing_round_trip(spark):
    import zlib

    from tokenizers import Tokenizer

    texts = [prose(n, n) for n in (1, 10, 700, 1500)] + ["", "Café <|endoftext|> 12'S", "a <|startoftext|>b <|ENDOFTEXT|> <| x |> <|endoftext|>", "<|endoftext|>"]
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    got = packing.pack(corpus(spark, texts)).toPandas()
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    assert got.groupby("doc_id").length.sum().tolist() == [len(x) for x in ids]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_warc_round_trip(spark):
    big = "<p>" + "é\r\n" * 60
    pages = [(3, "http://x/a b", big, 1), (1, None, big, 1), (2, "u", "small", 1), (4, "u", "small", 1), (5, "u", None, 1), (6, "u", big + "!", 1)]
    got = {r.page_id: r for r in warc.deduplicate(spark.createDataFrame(pages, "page_id long, url string, html string, row int")).collect()}
    for page, _, html, _ in pages:
        payload = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 1) if page == 3 else ("response", None))


def test_passages_find_exact_and_fuzzy_repeats(spark):
    shared = prose(70, 900).split()
    fuzzy = list(shared)
    for i in (11, 31, 52):
        fuzzy[i] = "changed"
    del fuzzy[42]
    join = lambda a, mid, b: f"{prose(90, a)} {' '.join(mid)} {prose(90, b)}"
    texts = [join(1, shared, 2), join(3, shared, 4), join(5, fuzzy, 6), prose(200, 7), prose(200, 8), prose(200, 8), join(9, shared[:30], 10)]
    got = passages.shared_passages(corpus(spark, texts)).toPandas()
    assert sorted(zip(got.doc_id, got.ref_doc_id, strict=True)) == [(1, 0), (2, 0), (5, 4)]
    first = got[got.doc_id == 1].iloc[0]
    assert (first.start, first.n_words, first.ref_start, first.similarity) == (90, 70, 90, 1.0)
    assert got[got.doc_id == 2].iloc[0].n_words >= 60


def test_chains_are_collinear_and_best():
    pos, ref = np.array([0, 10, 20, 30, 31]), np.array([5, 15, 25, 3, 36])
    assert passages.chains(pos, ref, passages.Chaining())[0] == [0, 1, 2, 4]


def test_simhash_against_all_pairs(spark):
    base = prose(300, 50)
    texts = [prose(80, i) for i in range(150)] + [base, base + " tail", "", None, base.upper(), *[base.replace(base.split()[i], "z", 1) for i in range(20)]]
    got = simhash.simhash_classes(corpus(spark, texts)).toPandas().sort_values("doc_id")
    prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    label = np.arange(len(texts))
    for _ in range(len(texts)):
        label = np.where(near, label[None], len(texts)).min(axis=1)
    assert got.component_id.tolist() == label.tolist()
    kept = simhash.simhash_dedup(corpus(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist())) and kept.columns == ["doc_id", "text", "source", "text_hash"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for k, (kind, form) in enumerate(PLAIN.items()):
        for m in regex.finditer(form, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_fixed_forms_against_the_plain_patterns():
    rng = np.random.default_rng(5)
    pieces = ["a@b.c", "@", ".", "-", " ", "1", "23", "4111111111111111", "+1 (234) 567-8901", "10.0.0.1", "x_y", "é", "9.9.9.9.9", "a.b@c-d.e@f.g", "+", "(", "256"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, 12))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_patterns_find_unseen_identifiers(spark):
    seeds = [f"{prose(20, i)} reach me via phone +1 (555) 010-{1000 + i} {prose(20, 100 + i)}" for i in range(8)]
    unseen = f"{prose(20, 77)} reach me via phone 555-017-4321 {prose(20, 78)}"
    clean = [f"{prose(10, 200 + i)} order {123456 + i} {prose(10, 300 + i)}" for i in range(8)]
    docs = corpus(spark, [*seeds, unseen, *clean])
    got = {r.doc_id: r for r in pii.spans_of(docs).collect()}
    assert [unseen[s.start : s.stop] for s in got[8].found] == ["555-017-4321"] and got[8].base == []
    assert all(got[i].base and not got[i].found for i in range(8)) and all(not got[i].found for i in range(9, 17))
    texts = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "via phone <PHONE>" in texts[8] and "via phone <PHONE>" in texts[0] and texts[9] == clean[0]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((40, 32))
    rows = np.concatenate([centre, centre[:20] + 0.02 * rng.standard_normal((20, 32)), centre[:3]])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(90, None), (91, [0.0] * 32), (92, [None] * 32), (93, [float("nan")] * 32), (94, [])]
    got = embed_dups.embedding_classes(spark.createDataFrame(data, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert got.n_links.loc[range(len(rows))].tolist() == (near.sum(axis=1) - 1).tolist()
    assert got.component_id.loc[range(len(rows))].tolist() == [int(np.flatnonzero(r)[0]) for r in near]
    assert (got.n_links.loc[90:] == 0).all() and got.kept.loc[90:].all()


def brute_licenses(text):
    words = tuple(re.findall(licenses.LICENSE_WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))))
    places, score = set(), 0.0
    for t in licenses.TEMPLATES:
        for s in range(-len(t.words), len(words)):
            at = lambda i, s=s: words[s + i] if 0 <= s + i < len(words) else None
            if all(at(i) == w for i, w in t.fixed):
                places.add((t.base, t.label, s))
                score = max(score, sum(at(i) == w for i, w in enumerate(t.words)) / len(t.words))
    base = sorted(s for b, _, s in places if b)
    labels = lambda keep: ",".join(sorted({x for b, x, _ in places if b or not keep}))
    return len(words), len(base), base[0] if base else None, base[-1] if base else None, labels(True), labels(False), score


def test_licenses_against_every_place(spark):
    texts = ["Licensed under CC BY-NC 4.0. " * 3, "ALL RIGHTS  RESERVED", "MIT License", "Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "rights reserved all", None, "", "All rights. Reserved! " + prose(50, 1) + " ccé by cc by"]
    texts += [" ".join(np.random.default_rng(i).choice("gnu general public license version 3 2 0 cc by nc mit all rights reserved apache x".split(), 60)) for i in range(60)]
    for r in licenses.scan(corpus(spark, texts)).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got[:-1] == brute_licenses(texts[r.doc_id])[:-1] and abs(got[-1] - brute_licenses(texts[r.doc_id])[-1]) < 1e-12


def test_pipeline_stages(spark, tmp_path):
    texts = [prose(100, i) for i in range(30)] + [prose(100, 3), "too short", "a b c " * 60, None, prose(100, 99) + " mail a@b.example"]
    docs = corpus(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    assert sorted(seen["quality_rules"].doc_id) == [*range(31), 34]
    assert sorted(seen["simhash_near_dedup"].doc_id) == [*range(30), 34]
    assert seen["pii"].set_index("doc_id").text[34].endswith("mail <EMAIL>") and len(seen["pii"]) == 31
    mixed = seen["source_mix"].groupby("doc_id").size()
    assert abs(mixed.sum() - 1.5 * 31) <= 1 and mixed.max() == 2
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert pieces[pieces.start == 0].doc_id.value_counts().sort_index().tolist() == mixed.tolist()
