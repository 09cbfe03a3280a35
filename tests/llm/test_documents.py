"""Document operators against brute-force versions, and on messy tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from graphloom.llm import bpe, decontaminate, langid, minhash, quality, sharding, simhash, toxicity
from graphloom.plans.scratch import Scratch
from tests.llm import messy


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# op1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Least position reachable, by single linkage."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_simhash_rows(spark):
    got = simhash.near_duplicates(messy.documents(spark)).collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{plain_fingerprint(r[1]):016x}" for r in messy.ROWS)
    by = {}
    for i, g in enumerate(groups([plain_fingerprint(r[1]) for r in messy.ROWS], lambda a, b: bin(a ^ b).count("1") <= 2)):
        by.setdefault(g, []).append(messy.ROWS[i][0])
    want = Counter((d, min((x for x in ids if x is not None), default=None)) for ids in by.values() for d in ids)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(messy.documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_links(spark, hot):
    """Pairs and single-bit neighbours give the same components, also for a dense cluster."""
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark)
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch, hot).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in found)
    at = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))
    for a, b in found:
        x, y = sorted((root[at[a]], root[at[b]]))
        root = [x if q == y else q for q in root]
    assert root == groups(fps, lambda a, b: bin(a ^ b).count("1") <= 2)


def test_simhash_tally(spark):
    """Blocks that a pair meets in tell its shared bytes: the key alone admits pairs that the tally rejects."""
    r = random.Random(7)
    base = r.getrandbits(63)
    fps = {base ^ sum(r.randrange(1, 256) << 8 * p for p in r.sample(range(8), n)) for n in (0, 1, 2, 3, 4, 5, 6) for _ in range(6)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in {f & (2**64 - 1) for f in fps})
    met = {(t["u"], t["v"]): t["blocks"] for t in simhash.tally(simhash.postings(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    seen = Counter()
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            shared = sum((a ^ b) >> 8 * p & 255 == 0 for p in range(8))
            assert (met.get((a, b), 0) >= simhash.MIN_BLOCKS) == (shared >= 6)
            seen[shared, met.get((a, b), 0)] += 1
    assert seen[5, 1] and seen[4, 1] and seen[6, 3] and seen[7, 7]


def test_simhash_keeps_texts_of_repeated_ids(spark):
    """Rows of one id in different groups are different documents; a copy goes whatever its id."""
    a, b = "one two three four five six", "nothing of this is like the other text at all"
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b.upper(), "en", "s", 1), (None, a, "en", "s", 1), (None, "x y z", "en", "s", 1), (None, "X Y Z", "en", "s", 1)]
    kept = sorted((r["doc_id"] or 0, r["text"].lower()) for r in simhash.keep_one(messy.documents(spark, rows)).collect())
    assert kept == [(0, "x y z"), (3, a), (5, b)]


def test_simhash_keeps_one(spark):
    docs = messy.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1


# op5


def language_models(spark, samples, **bounds):
    rows = [(k, False, t) for k, texts in samples.items() for t in texts]
    counts = pd.concat(langid._counted(iter([pd.DataFrame(rows, columns=["lang", "part", "text"])])))
    return langid.models_of(spark.createDataFrame(counts), Scratch(spark), **bounds)[0]


def log_p(models, text):
    """Log-probabilities of the last character after the three before it."""
    return models._log_p([np.array([ord(c)], dtype=np.uint64) for c in text[-4:]])[0]


@pytest.mark.parametrize("cells", [1 << 21, 8])
def test_language_models_are_normalised(spark, cells):
    """Also where rare n-grams are left out."""
    m = language_models(spark, {"a": ["abab ba", "aab", "abba abba"], "b": ["bbb cab", "c", "cab cab"]}, max_cells=cells)
    assert cells > 8 or len(m.keys[4]) <= 4
    for head in (" ab", "bbb", "zzz"):
        total = sum(np.exp(log_p(m, head + c)) for c in "abc z")
        assert total == pytest.approx([1, 1], abs=1e-4) and m.alphabet == 5


def test_letters():
    texts = ["", None, "Ab--c1d_e ", "  ²½Été\n", "...", "x"]
    codes, sizes = langid.letters(texts, 3)
    want = [" ".join(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    assert "".join(map(chr, codes)) == "".join("   " + w for w in want) and sizes.tolist() == [len(w) for w in want]
    at = langid._places(sizes, 3)
    assert "".join(chr(codes[i]) for i in at) == "".join(want)


def test_every_script_has_its_characters(spark):
    """Thousands of characters, of several scripts, and none is folded into another."""
    r = random.Random(5)
    scripts = {"zh": range(0x4E00, 0x4E00 + 6000), "ko": range(0xAC00, 0xAC00 + 2000), "ja": range(0x3041, 0x3097), "sux": range(0x12000, 0x12300)}
    m = language_models(spark, {k: ["".join(map(chr, [*v, *r.choices(v, k=3 * len(v))]))] for k, v in scripts.items()})
    assert len(m.keys[1]) == m.alphabet - 1 == sum(map(len, scripts.values()))
    for k, v in scripts.items():
        found = m.predict(["".join(chr(r.choice(v)) for _ in range(80))])
        assert found["lang_pred"][0] == k and found["score"][0] > 0.99


def test_tally_in_parts():
    """Merged and flushed counts add up."""
    t, texts = langid.Tally(), ["abc abd", "abc", "zz"]
    whole = Counter()
    for label, text in enumerate(texts):
        t.add([text], np.array([label % 2]))
        t.merge()
        padded = "   " + text
        whole.update((label % 2, padded[i - 3 : i + 1]) for i in range(3, len(padded)))
    label, first, last, many = t.flush()
    got = {(k, "".join(map(chr, (a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF)))): n for k, a, b, n in zip(*(x.tolist() for x in (label, first, last, many)))}
    assert got == whole and not len(t.flush()[0])


def plain_kneser_ney(texts, order, head, char, alphabet):
    """Textbook recursion over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        padded = " " * (order - 1) + t
        counts[order].update(padded[i - order + 1 : i + 1] for i in range(order - 1, len(padded)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(h, n):
        c = counts[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / max(1, ones + 2 * twos) if ones else 0.5
        same = {g: v for g, v in c.items() if g[:-1] == h}
        total = sum(same.values())
        lower = 1 / alphabet if n == 1 else p(h[1:], n - 1)
        if not total:
            return lower
        return max(c[h + char] - d, 0) / total + sum(min(d, v) for v in same.values()) / total * lower

    return p(head, order)


def test_language_model_values(spark):
    texts = ["abracadabra ba", "cab ab", "banana"]
    m = language_models(spark, {"x": texts})
    for head, char in (("abr", "a"), ("zab", "r"), ("nan", "c"), ("   ", "b")):
        assert log_p(m, head + char)[0] == pytest.approx(math.log(plain_kneser_ney(texts, langid.ORDER, head, char, m.alphabet)), abs=1e-4)


def test_language_rows(spark):
    words = {"en": "the of and that with from are was".split(), "de": "der und nicht auf schön mit über das".split()}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(words[k], k=20)), k, "s", 0) for i in range(120) for k in [("en", "de")[i % 2]]]
    docs = messy.documents(spark, rows + messy.ROWS)
    models = langid.fit(docs)
    found = langid.identify(docs, models).select("doc_id", "text", "lang", "__lang.*").collect()
    assert len(found) == len(rows) + len(messy.ROWS)
    held = [f for f in found if f["text"] and f["doc_id"] is not None and f["doc_id"] > 10 and zlib.crc32(str(f["doc_id"]).encode()) % 4 == 2]
    assert held and all(f["lang_pred"] == f["lang"] and not f["rejected"] for f in held)
    assert all(f["lang_pred"] == "und" and f["score"] == 0 for f in found if not re.search(r"[^\W\d_]", f["text"] or ""))
    assert all(0 <= f["score"] <= 1 for f in found)
    none = langid.fit(messy.documents(spark, []))
    assert {f["lang_pred"] for f in langid.identify(docs, none).select("__lang.*").collect()} == {"und"}


# op6


def test_sharding(spark):
    docs = messy.documents(spark, messy.ROWS + [(i, f"text {i}", "en", "a", 1) for i in range(100, 1300)])
    got = sharding.placed(docs).collect()
    assert len(got) == len(messy.ROWS) + 1200
    texts = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in messy.ROWS)
    assert not texts - Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got)
    slots = {}
    for g in got:
        slots.setdefault(g["shard"], []).append(g["slot"])
        assert g["law"] == "key" and g["grown_shard"] in (g["shard"], 40) and 0 <= g["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    assert len({(g["doc_id"], g["shard"]) for g in got}) == len({g["doc_id"] for g in got})
    assert 10 <= sum(g["grown_shard"] == 40 for g in got) <= 60
    grown = {r["doc_id"]: r["s"] for r in sharding.with_shard(docs, "doc_id", [1.0] * 41, "s").select("doc_id", "s").collect()}
    assert all(grown[g["doc_id"]] == g["grown_shard"] for g in got)
    assert sharding.placed(messy.documents(spark, [])).count() == 0


def xx(value, seed, kind="<q"):
    return xxhash.xxh64(struct.pack(kind, value), seed=seed).intdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_shard(key, shards):
    """The shard of least -ln(u), computed apart from the library; a null key leaves the seed as it is."""
    cost = {s: -math.log(((xx(s, 42 if key is None else xx(key, 42), "<i") >> 11) + 0.5) / 2**53) for s in range(shards)}
    return min(cost, key=lambda s: (cost[s], s))


def test_sharding_by_hand(spark):
    docs = messy.documents(spark, messy.ROWS + [(i * 977, "t", "en", "a", 1) for i in range(150)])
    for g in sharding.placed(docs).collect():
        assert (g["shard"], g["grown_shard"]) == (plain_shard(g["doc_id"], 40), plain_shard(g["doc_id"], 41))


def test_copies_in_slices(spark):
    table = spark.createDataFrame([(1, 7, 0, 0), (2, 1, 0, 0)], "k long, n long, shard int, part int")
    for slice_rows in (100, 3, 1):
        got = sorted((r["k"], r["copy"]) for r in sharding.copies(table, 7, slice_rows).collect())
        assert got == [(1, c) for c in range(7)] + [(2, 0)]


def test_rows_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(sharding.copies, "__defaults__", (3,))
    docs = messy.documents(spark, [(None, None, None, None, None)] * 20 + [(1, "a b c", "en", "a", 1)])
    slots = [g["slot"] for g in sharding.placed(docs).collect() if g["doc_id"] is None]
    assert len(slots) == 20 and len(set(slots)) == 20
    assert Counter(g["doc_id"] for g in minhash.edited_likeness(docs).collect()) == {None: 20, 1: 1}


def test_sharding_weights(spark):
    keys = spark.range(8000)
    share = sharding.with_shard(keys, "id", [1.0, 3.0]).where("shard = 1").count() / 8000
    assert share == pytest.approx(0.75, abs=0.02)
    with pytest.raises(ValueError):
        sharding.with_shard(keys, "id", [1.0, 0.0])


# op7


def shingles(text):
    words = re.split(r"\s+", re.sub(r"[\s]+", " ", (text or "").lower()).strip())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_minhash(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 30, 200, 600]))), "en", "a", 1) for i in range(100, 140)]
    got = minhash.edited_likeness(messy.documents(spark, rows)).collect()
    assert len(got) == 40
    texts = [t for _, t, *_ in rows]
    errors = []
    for g in got:
        i = g["doc_id"] - 100
        t, after = texts[i], texts[(i + 1) % 40]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(g["near_edited"] - len(a & b) / len(a | b))
        assert len(g["fingerprint"]) == 256 and 0 <= g["near_next"] <= 0.1
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.05


def plain_sketch(text):
    """One-permutation MinHash with affine borrowing, step by step."""
    words = re.split(r"\s+", re.sub(r"\s+", " ", (text or "").lower()).strip(" "))
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    least = {}
    for run in [hashes[i : i + 5] for i in range(len(hashes) - 4)] or [hashes]:
        h = 42
        for w in run:
            h = xx(signed(w), h)
        least[h >> 57] = min(h, least.get(h >> 57, h))
    out = []
    for i, (slope, shift) in enumerate(zip(minhash.slopes(), minhash.shifts())):
        b = i if i in least else min(least, key=lambda j: (slope * j + shift) % 131)
        out.append(least[b] & 255)
    return out


def test_minhash_by_hand(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(50)], k=n)), "en", "a", 1) for i, n in enumerate([1, 2, 4, 5, 6, 9, 40, 300, 900])]
    rows += [(20, "", "en", "a", 1), (21, None, "en", "a", 1), (22, "Ärger  mit\tder Zeit im HAUS ", "de", "a", 1)]
    sketches = {i: plain_sketch(t) for i, t, *_ in rows}
    for g in minhash.edited_likeness(messy.documents(spark, rows)).collect():
        a, b = sketches[g["doc_id"]], sketches[g["next_doc_id"]]
        assert g["fingerprint"] == bytes(x ^ 128 for x in a).hex()
        same = sum(x == y for x, y in zip(a, b)) / 128
        assert g["near_next"] == pytest.approx(max(0, (same - 1 / 256) / (1 - 1 / 256)))


def test_minhash_messy(spark):
    got = minhash.edited_likeness(messy.documents(spark)).collect()
    assert Counter(g["doc_id"] for g in got) == Counter(r[0] for r in messy.ROWS)
    prints = {}
    for g in got:
        prints.setdefault((g["doc_id"], g["n_chars"]), set()).add(g["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    one = minhash.edited_likeness(messy.documents(spark, [(1, "a b c d e f g h", "en", "a", 1)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert minhash.edited_likeness(messy.documents(spark, [])).count() == 0


def test_minhash_borrowing():
    """Every bin's order visits all bins."""
    for a, b in zip(minhash.slopes(), minhash.shifts(), strict=True):
        assert len({(a * j + b) % 131 for j in range(minhash.BINS)}) == minhash.BINS


# op8


def test_scan_is_the_recursion():
    r = np.random.default_rng(1)
    a, b, c, d = (r.uniform(0.1, 2, 1000) for _ in range(4))
    want, x = [], 1.0
    for t in range(1000):
        x = (b[t] + x * d[t]) / (a[t] + x * c[t])
        want.append(x)
    assert toxicity.scan(a, b, c, d) == pytest.approx(np.array(want))


def test_marginals_by_enumeration():
    import itertools
    chain = toxicity.Chain()
    chain.weights, chain.bias, chain.start = {"=bad": 2.0, "=x": -1.0}, -0.5, 0.3
    chain.move = np.array([[0.2, -0.4], [0.1, 0.6]])
    words = ["x", "bad", "y", "bad"]
    total, each = 0.0, [0.0] * 4
    for tags in itertools.product((0, 1), repeat=4):
        s = chain.start * tags[0] + sum(chain.emission(w) * t for w, t in zip(words, tags, strict=True)) + sum(chain.move[p, q] for p, q in itertools.pairwise(tags))
        total += math.exp(s)
        for i, t in enumerate(tags):
            each[i] += t * math.exp(s)
    got, bounds = chain.marginals([words, [], ["x"]])
    assert got[:4] == pytest.approx([e / total for e in each]) and bounds.tolist() == [0, 4, 4, 5]


def test_toxicity_held_out(spark):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(400):
        words = r.choices(plain, k=30)
        if i % 4 == 0:
            words.insert(5, r.choice(["idiotic", "moronic", "scummy"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = messy.documents(spark, rows)
    chain = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    found = toxicity.score(docs, chain).select("doc_id", "text", "__tox.*").collect()
    held = [f for f in found if zlib.crc32(str(f["doc_id"]).encode()) % 5 == 0]
    assert held and all((f["score"] >= 0.5) == (f["doc_id"] % 4 == 0) for f in held)
    f = next(f for f in held if f["doc_id"] % 4 == 0)
    assert [f["text"][s["start"] : s["end"]] for s in f["spans"]][0] in ("idiotic", "moronic", "scummy")


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Long texts do not all come to the driver; each class has whole documents, an only one whatever its size."""
    rows = [(i, f"t{i} " + "word " * 200, "en", "a", 1) for i in range(60)] + [(60, "long " * 4000, "en", "a", 1)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda *texts: seen.append(texts))
    docs, marks = messy.documents(spark, rows), [(i, 1, int(i % 2)) for i in range(60)] + [(60, 1, 1)]
    toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), sample_bytes=10_000)
    assert all(3_000 < sum(map(len, t)) <= 5_000 and set(t) <= {r[1] for r in rows} for t in seen[0])
    toxicity.fit(docs, spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (60, 1, 1)], "doc_id long, quality int, toxic int"), sample_bytes=10_000)
    assert seen[1][0] == [rows[60][1]]


def test_toxicity_reads_long_batches_in_blocks(monkeypatch):
    chain = toxicity.Chain()
    chain.weights, chain.bias, chain.beta = {"=bad": 6.0}, -2.0, np.array([0.1, 1.0, 1.0, -0.2])
    texts = ["a bad word", None, "", "x " * 300 + "bad", "bad bad", "no"] * 3
    whole, asked, expected = chain.read(texts), [], chain.expected
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 50)
    monkeypatch.setattr(chain, "expected", lambda t: asked.append(len(t)) or expected(t))
    blocks = chain.read(texts)
    assert blocks["score"].tolist() == pytest.approx(whole["score"].tolist()) and blocks["spans"].tolist() == whole["spans"].tolist()
    assert len(asked) > 3 and sum(asked) == len(texts) and chain.read([]).empty


def test_toxicity_messy(spark):
    docs = messy.documents(spark)
    for marks in (messy.labels(spark), messy.labels(spark, True)):
        found = toxicity.score(docs, toxicity.fit(docs, marks)).select("__tox.*").collect()
        assert len(found) == len(messy.ROWS) and all(0 <= f["score"] <= 1 for f in found)
    none = messy.documents(spark, [])
    assert toxicity.score(none, toxicity.fit(none, messy.labels(spark))).count() == 0


# op4


def test_quality(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        text = ". ".join(" ".join(r.choices(["plain", "words", "here", "again", "reading"], k=8)) for _ in range(6)) if good else " ".join(r.choices(["$$$", "BUY!!!", "%%%", "win###"], k=40))
        rows.append((i, text, "en", f"s{i % 5}", 1))
        marks.append((i, int(good), 0))
    docs = messy.documents(spark, rows)
    c = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    found = quality.score(docs, c, docs.source, docs.lang).collect()
    assert len(found) == 300 and all(f["keep"] == (f["doc_id"] % 3 > 0) for f in found)
    sums = Counter()
    for f in found:
        sums[f["doc_id"] % 5] += f["doc_score"]
    assert all(min(s / 60, 0.66) - 0.05 <= f["host_rate"] <= max(s / 60, 0.66) + 0.05 for f in found for s in [sums[f["doc_id"] % 5]])


def plain_posteriors(found, docs):
    """host_rate, path_rate and score of each row by the formulas of the module, from its classifier's evidence."""
    own = [f["doc_score"] for f in found]
    site, section = [d[3] for d in docs], [(d[3], d[2]) for d in docs]

    def sums(keys):
        n, good = Counter(keys), Counter()
        for k, p in zip(keys, own):
            good[k] += p
        return n, good

    def strength(groups, rate):
        total = sum(n for n, _, _ in groups)
        inner = sum(n * r * (1 - r) for n, _, r in groups)
        spread = sum(n * (g / n - r) ** 2 for n, g, r in groups)
        between = max((spread - sum(r * (1 - r) for _, _, r in groups)) / total, 1e-9)
        return min(max(inner / total / between - 1, 1), 1000)

    n, good = sums(site)
    overall = sum(own) / len(own)
    prior = strength([(n[k], good[k], overall) for k in n], overall)
    host = {k: (good[k] + prior * overall) / (n[k] + prior) for k in n}
    m, fine = sums(section)
    below = strength([(m[k], fine[k], host[k[0]]) for k in m], None)
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for p, k in zip(own, section):
        path = (fine[k] - p + below * host[k[0]]) / (m[k] - 1 + below)
        yield host[k[0]], path, 1 / (1 + math.exp(-(logit(p) + 0.5 * (logit(path) - logit(overall)))))


@pytest.mark.parametrize("rows", [20_000, 1])
def test_quality_posteriors(spark, monkeypatch, rows):
    """Against plain arithmetic, and they alter decisions: doubtful documents follow their site."""
    monkeypatch.setattr(quality, "JOIN_ROWS", rows)
    r = random.Random(11)
    words = {True: "plain words here again reading".split(), False: "$$$ BUY!!! %%% win### click".split()}
    docs, marks = [], []
    for i in range(400):
        source = i % 4
        good = r.random() < (0.05, 0.3, 0.9, 0.97)[source]
        kind = [good if r.random() < 0.62 else not good for _ in range(14)]
        docs.append((i, " ".join(r.choice(words[k]) for k in kind), ("en", "de", None)[i % 3], f"s{source}" if source else None, 1))
        marks.append((i, int(good), 0))
    table = messy.documents(spark, docs)
    c = quality.fit(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    found = sorted(quality.score(table, c, table.source, table.lang).collect(), key=lambda f: f["doc_id"])
    for f, want in zip(found, plain_posteriors(found, docs), strict=True):
        assert (f["host_rate"], f["path_rate"], f["score"]) == pytest.approx(want, abs=3e-6)
    held = [f for f in found if zlib.crc32(str(f["doc_id"]).encode()) % 5 == 0]
    right = lambda key: sum((key(f) >= 0.5) == (marks[f["doc_id"]][1] == 1) for f in held) / len(held)
    assert any((f["score"] >= 0.5) != (f["doc_score"] >= 0.5) for f in held)
    assert right(lambda f: f["score"]) > right(lambda f: f["doc_score"])


def test_quality_messy(spark):
    docs = messy.documents(spark)
    for marks in (messy.labels(spark), messy.labels(spark, True)):
        found = quality.score(docs, quality.fit(docs, marks), docs.source, docs.lang).collect()
        assert len(found) == len(messy.ROWS) and all(0 <= f["score"] <= 1 for f in found)
    none = messy.documents(spark, [])
    assert quality.score(none, quality.Classifier([], []), none.source, none.lang).count() == 0
    assert quality.score(none, quality.fit(none, messy.labels(spark)), none.source, none.lang).count() == 0


# op9

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_agrees_with_the_library(library):
    c = bpe.Codec(PATH, keep_chars=5000)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "the", "'s", "'", "1", "é", "ß", "<|endoftext|>", "<|", "!", " ", " ", "漢", "😀", "\x1c", "\t", " of", " and", "'ll"]
    for n in (0, 1, 5, 60, 900, 4000):
        for _ in range(60 if n < 900 else 8):
            text = "".join(r.choice(parts) for _ in range(n))
            ids = library.encode(text, add_special_tokens=False).ids
            assert c.encode(text) == ids
            assert c.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)
            assert "".join(bpe.spans(text)) == text
    assert c.kept_chars <= 5000 or len(c.kept) == 1


def test_bpe_reuses_chunks():
    r = random.Random(5)
    shared = " ".join(f"word{r.randrange(999)}" for _ in range(2000))
    c = bpe.Codec(PATH)
    list(c.pieces("first start " + shared))
    before = len(c.kept)
    n = len(list(c.pieces("another quite different beginning " + shared)))
    assert n > 20 and len(c.kept) - before <= 3


def test_bpe_rows(spark, library):
    docs = messy.documents(spark)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, PATH).collect())
    want = Counter()
    for row in messy.ROWS:
        text = row[1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want
    round_trip = bpe.with_text(bpe.with_ids(docs, PATH), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in round_trip)


def test_bpe_seams_agree_with_both_sides(library):
    """Each chunk's own encoding and the seams' re-encoding agree up to every boundary of a piece."""
    r = random.Random(8)
    parts = [" ", "  ", "\n", "word", "the", "'s", "1", "é", "!", " of", " and", "漢", " a", " b"]
    for _ in range(60):
        text = "".join(r.choice(parts) for _ in range(1500))
        whole, at = library.encode(text, add_special_tokens=False), 0
        starts = {a for a, _ in whole.offsets}
        for piece in bpe.spans(text):
            assert at in starts
            at += len(piece)
        assert at == len(text)


@pytest.mark.parametrize("change", ["lower", "foreign", "unsorted", "special"])
def test_bpe_other_vocabularies(spark, tmp_path, change):
    """Files whose rules differ are run by the library, and agree with it."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(PATH, encoding="utf-8").read())
    if change == "lower":
        spec["normalizer"] = {"type": "Lowercase"}
    elif change == "foreign":
        spec["model"]["vocab"]["漢字"] = max(spec["model"]["vocab"].values()) + 10
    elif change == "unsorted":
        spec["model"]["merges"] = spec["model"]["merges"][:200]
    else:
        spec["added_tokens"].append({"id": 60_000, "content": "fox", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    assert bpe.Codec(str(path)).library is not None and bpe.Codec(PATH).engine is not None
    got = Counter(tuple(r) for r in bpe.digests(messy.documents(spark), str(path)).collect())
    want = Counter()
    for row in messy.ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want


def test_bpe_special_strings_of_any_form(tmp_path):
    """Special tokens are looked for by their own strings."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"].append({"id": Tokenizer.from_file(PATH).get_vocab_size(), "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "special.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    c, library = bpe.Codec(str(path)), Tokenizer.from_file(str(path))
    text = "before [SEP]after[SEP][SEP] <|endoftext|>x " * 40
    assert c.engine is not None and c.encode(text) == library.encode(text, add_special_tokens=False).ids


# op10


def plain_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, named = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(body))
        k = min(window, len(w))
        runs = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1) if w else ():
            if tuple(words[i : i + k]) in runs:
                hit.update(range(i, i + k))
                named.add(str(item) if item is not None else "null")
    return len(words), len(hit), named


ITEMS = [(1, "a b c d a b c"), (2, "B c D"), (3, None), (4, "--"), (5, "c"), (1, "x y z x y"), (None, "d a b z")]


@pytest.mark.parametrize("block_words", [10_000, 4])
def test_decontamination_is_exact(spark, block_words):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("a b c d x y z".split(), k=r.choice([0, 1, 5, 40]))), "en", "a", 1) for i in range(20, 60)]
    rows += [*messy.ROWS, (90, None, None, None, None)]
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, spans string")
    got = Counter(tuple(g) for g in decontaminate.report(messy.documents(spark, rows), bench, 4, block_words).collect())
    want = Counter()
    for row in rows:
        n, h, named = plain_hits(row[1], ITEMS, 4)
        want[(row[0], n, h, len(named), decontaminate.digest(named), h > 0)] += 1
    assert got == want


def test_decontamination_random_automata():
    r = random.Random(9)
    for _ in range(150):
        items = [(i, " ".join(r.choices("a b c".split(), k=r.randint(0, 9)))) for i in range(r.randint(0, 5))]
        text = " ".join(r.choices("a b c d".split(), k=r.randint(0, 30)))
        a = decontaminate.Automaton([(str(i), decontaminate.words_of(t)) for i, t in items], 4)
        spans, hit = a.find(decontaminate.words_of(text))
        n, h, named = plain_hits(text, items, 4)
        assert (sum(e - b for b, e in spans), hit) == (h, named)


def test_decontamination_cuts(spark):
    docs = messy.documents(spark, [(1, "Start here: one two, three four. End of it all now", "en", "a", 1), (2, "one two three four", "en", "a", 1), (3, "clean  text", "en", "a", 7), (4, None, None, None, None)])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.decontaminate(docs, bench, 4).collect()}
    assert out == {1: ("Start here: . End of it all now", 31), 3: ("clean  text", 7), 4: (None, None)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 4
    assert decontaminate.report(messy.documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("block_words", [10_000, 4])
def test_decontamination_cuts_in_blocks(spark, block_words):
    r = random.Random(10)
    rows = [(i, " ".join(r.choices(["a b c d a", "d a b z", "x Y z x y", "a", "z", *"efghijklmnop"], k=r.choice([0, 1, 5, 40]))), "en", "a", 1) for i in range(60)] + [(None, None, "en", "a", None)]
    items = [i for i in ITEMS if i[0] != 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = decontaminate.Automaton([(str(i), decontaminate.words_of(t)) for i, t in items], 4)
    want = Counter()
    for doc_id, text, *_, n_chars in rows:
        spans, _ = a.find(words := decontaminate.words_of(text))
        if sum(e - b for b, e in spans) <= 0.5 * len(words):
            rest = decontaminate.cut(text, spans) if spans else text
            want[(doc_id, rest, len(rest) if spans else n_chars)] += 1
    out = decontaminate.decontaminate(messy.documents(spark, rows), bench, 4, block_words=block_words)
    assert Counter(tuple(g) for g in out.select("doc_id", "text", "n_chars").collect()) == want
    assert any(text not in [x[1] for x in rows] for _, text, _ in want)
