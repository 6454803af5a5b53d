"""Operators held against counts that share no code with them."""


import numpy as np
import xxhash

from tidemark.llm import packing, quality, simhash

DOCS = "doc_id long, text string, source string, text_hash int"
RNG = np.random.default_rng(21)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_classes_against_all_pairs(spark):
    texts = [prose(40 + i % 60, i) for i in range(120)]
    for i in range(60):
        words = texts[i].split()
        words[i % len(words)] = "swapped"
        texts.append(" ".join(words if i % 3 else [w.upper() for w in words]))
    texts += ["", None, "one", "one two", texts[5], texts[5].upper(), "naïve Ärger ÄRGER"]
    prints = [plain_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = {r.doc_id: r for r in simhash.simhash_classes(spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == group and len(set(group)) < len(texts)


def test_repetition_shares_against_plain_counts(spark):
    texts = [prose(200, 1), prose(30, 2) + " " + prose(60, 3) + " " + prose(30, 2), "a b c d " * 30, "\n".join([prose(8, i % 4) for i in range(12)]), "x"]
    limits = quality.Limits()
    report = quality.repetition_report(spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    for r in report:
        words = texts[r.doc_id].split()
        chars = sum(map(len, words))
        shares = []
        for n, most in limits.grams:
            seen, inside = set(), set()
            for i in range(len(words) - n + 1):
                gram = tuple(words[i : i + n])
                if gram in seen:
                    inside.update(range(i, i + n))
                seen.add(gram)
            shares.append(sum(len(words[i]) for i in inside) / chars)
            assert abs(r[f"dup_share_{n}"] - shares[-1]) < 1e-12
        lines = texts[r.doc_id].split("\n")
        repeated = sum(len(x.replace(" ", "")) for i, x in enumerate(lines) if x in lines[:i]) / chars
        assert abs(r.dup_line_share - repeated) < 1e-12
        assert r.kept == (not r.base_failed and repeated < limits.lines and all(s < most for s, (_, most) in zip(shares, limits.grams, strict=True)))


def test_packing_balances_costs(spark):
    """Each sequence costs about as much as any other, and little is left empty."""
    rng = np.random.default_rng(8)
    texts = [prose(int(n), i) for i, n in enumerate(rng.lognormal(4.5, 1, 400).clip(3, 3000))]
    got = packing.pack(spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)).toPandas()
    used = got.groupby("sequence_id").length.sum()
    least = -(-got.length.sum() // packing.CAPACITY)
    assert len(used) <= 1.02 * least + 1 and used.max() <= packing.CAPACITY
    cost = got.assign(cost=packing.LINEAR * got.length + packing.QUADRATIC * got.length**2).groupby("sequence_id").cost.sum()
    full = cost[used > 0.95 * packing.CAPACITY]
    shuffled = []
    order = rng.permutation(len(got))
    lengths, bins = got.length.to_numpy()[order], [[]]
    for n in lengths:
        if sum(bins[-1]) + n > packing.CAPACITY:
            bins.append([])
        bins[-1].append(int(n))
    for b in bins:
        shuffled.append(sum(packing.LINEAR * n + packing.QUADRATIC * n**2 for n in b))
    assert full.std() / full.mean() <= np.std(shuffled) / np.mean(shuffled)
