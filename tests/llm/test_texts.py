"""Operators on documents: small fixtures, brute force, edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitrank.llm import langid, minhash, mixing, outliers, packing, quality, toxicity
from pitrank.llm.common import Hashed, word_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, score string, size int, node string, copies int, toxic string"


def invented(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def corpus():
    rng = np.random.default_rng(3)
    out = []
    for i in range(120):
        lang, letters = [("aa", "aeioubdg"), ("zz", "xyzwkqvj")][i % 2]
        text = invented(rng, letters, int(rng.integers(3, 90)))
        if i % 4 == 0:
            text += " vile" + " scummy vile scummy" * 2
        out.append((i, text, lang, f"s{i % 3}"))
    out += [(200 + i, out[i][1], "aa", None) for i in range(20)]  # copies
    out += [(300 + i, out[40 + i][1] + " more", "aa", "s0") for i in range(20)]  # near copies
    out += [(400, None, None, None), (401, "", "aa", "s1"), (402, " \n\t ", None, "s1"), (403, "12 34 !!", "aa", "s2"), (404, "one", "aa", "s2"),
            (405, "One", "aa", "s2"), (406, "word " * 30_000, "aa", "s2"), (407, "x" * 300_000, "zz", "s2"), (None, "no id at all here", "aa", "s0"), (0, out[0][1], "aa", "s0")]
    return [(*r, "clash", 1, "clash", 2, "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_rolling_hash_equals_for_equal_words_only():
    data = np.frombuffer(b"ab  abc ab\tbca ab", np.uint8)
    starts, ends = word_bounds(data)
    h = Hashed(data).ranges(starts, ends)
    assert len(starts) == 5 and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_language(spark, docs):
    model = langid.fit_language(docs)
    rows = {(r.doc_id, r.text): r for r in langid.identify_language(docs, model).collect()}
    assert len(rows) == len({(r[0], r[1]) for r in corpus()})
    for r in rows.values():
        has_letter = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.score <= 1 and r.size == 1
        assert r.lang_rejected or has_letter
    right = [r.lang_pred == r.lang for r in rows.values() if r.doc_id is not None and r.doc_id < 120]
    assert np.mean(right) > 0.95
    empty = docs.where("false")
    assert langid.identify_language(empty, langid.fit_language(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs, langid.fit_language(empty)).collect()} == {"und"}


def test_toxicity(spark, docs):
    labelled = docs.where("doc_id < 120").drop("toxic").withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    chain = toxicity.fit_chain(labelled, ["toxic"])
    assert chain.categories == ["severe", "frequent", "toxic"]
    out = toxicity.predict_chain(docs, chain).collect()
    assert len(out) == docs.count() and all(isinstance(r.toxic, bool) for r in out)
    bad = [r.toxic == ("scummy" in (r.text or "")) for r in out]
    assert np.mean(bad) > 0.97 and not [r for r in out if not r.text and r.toxic]
    own = toxicity.fit_chain(labelled.withColumn("mild", F.lit(0)), ["mild", "toxic"])
    assert own.categories == ["mild", "toxic"]
    none = toxicity.fit_chain(labelled.where("false"), ["toxic"])
    assert not any(r.toxic for r in toxicity.predict_chain(docs, none).collect())


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(w)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else d for i, (d, _) in enumerate(rows)], [len(s) for s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, n, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(n)
    base = [invented(rng, "abcdefgh", 60).split() for _ in range(3)]
    extra = []
    for i in range(90):  # groups around the threshold: single links, chains, bridges
        words = list(base[i % 3])
        for k in rng.integers(0, 60, int(rng.integers(1, 9 if n == 2 else 4))):
            words[k] = "changed" + str(rng.integers(0, 40))
        extra.append((1000 + i, " ".join(words)))
    rows = [(r[0], r[1]) for r in corpus()] + extra
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table, shingle=n).collect())
    ids, sizes = components(rows, n)
    assert got == Counter((d, s, c, d == c) for (d, _), s, c in zip(rows, sizes, ids))
    left = Counter(r.doc_id for r in minhash.without_near_duplicates(table, shingle=n).collect())
    assert left == Counter({c for c, s in zip(ids, sizes) if s} | {d for (d, _), s in zip(rows, sizes) if not s})
    assert minhash.near_duplicates(table.where("false")).count() == 0


def test_mixing_totals(spark, docs):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        key = r.source_size
        size[key] += r.size
        taken[key] += r.taken
        target[key] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    for k in target:
        largest = max(r.size for r in out if r.source_size == k)
        assert size[k] == k and target[k] <= 2 * k and abs(taken[k] - target[k]) <= largest
    again = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect())
    assert again == Counter((r.doc_id, r.size, r.taken) for r in out)
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    assert mixing.mixed(docs).columns == docs.columns
    assert sum(len(WORD.findall(t or "")) * n for (_, t), n in copies.items()) == sum(taken.values())
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_targets_are_the_fixed_point(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1), ("d", 0), ("e", 500), (None, 30)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint"), (3, 1, 2), 1.5, 2.0).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2]))
    left, free, want = 1.5 * sum(s for _, s in sizes), dict(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * free[s]]
        if not over:
            want |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            want[s] = 2.0 * free.pop(s)
        left = 1.5 * sum(s for _, s in sizes) - sum(want.values())
    assert got == pytest.approx(want)


def test_packing_round_trip(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    odd = [(500 + i, t) for i, t in enumerate(["  a  b ", "a \n b", "tab\tx y", "<|endoftext|> x <|endoftext|>", "nb sp a", "é ü — 漢字 ok", "it's we'll 12 345"])]
    rows = [(r[0], r[1]) for r in corpus()] + odd
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), path).collect()
    whole, windows = {}, {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        whole.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 1024
    for doc, text in rows:
        want = model.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(whole[doc], key=lambda p: p[0])
        if doc != 0:  # two rows have this id
            assert [i for _, ids, _ in pieces for i in ids] == want and {p[2] for p in pieces} == {len(want)}
    assert sum(r.length for r in out) / (1024 * len(windows)) > 0.97
    assert packing.pack_documents(docs.where("false"), path).count() == 0


def test_differencing_is_even():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 150).tolist()
    found = packing.differencing(sizes, 12)
    loads = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(150)) and max(loads) - min(loads) <= 3
    packed = packing.pack_block([600, 600, 600], 1024)  # the count rises
    assert len(packed) == 3


def statistics(text):
    w = WORD.findall(text or "")
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    texts = [r[1] for r in corpus()] + ["a b c a b c", "a a a a a", "x\nx\n \n\nx y\nx", "a#b $% <|>", "a b c d a b c e a b c", "ü ß x 漢 字"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in outliers.text_statistics(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(texts[r.doc_id]), texts[r.doc_id]


def test_robust_quality(spark, docs):
    rng = np.random.default_rng(2)
    rows = [(i, invented(rng, "abcdefgh", int(rng.integers(60, 300))).capitalize(), "aa", "big" if i < 200 else f"s{i}") for i in range(300)]
    rows += [(1000 + i, invented(rng, "abcdefgh", 80).replace(" ", "### "), "aa", "big") for i in range(20)]
    rows += [(2000, None, None, None), (2001, "", "aa", "big"), (2002, "short", "aa", "big")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r for r in outliers.robust_quality(frame).collect()}
    assert all(out[i].kept for i in range(300)) and not any(out[1000 + i].kept for i in range(20))
    assert all(out[i].base_failed and not out[i].kept for i in (2000, 2001, 2002))
    # The estimate of the one large group against numpy, by the same steps.
    z = np.array([[np.log(r.word_chars / r.n_words), np.sqrt(r.n_symbols / r.word_chars), r.n_dup_lines / r.n_lines, r.n_repeat_words / r.n_words,
                   np.sqrt(r.n_upper / r.word_chars)] for r in out.values() if r.source == "big" and r.n_words])
    d2 = np.array([r.d2 for r in out.values() if r.source == "big" and r.n_words])
    floors, factor = np.array(outliers.FLOORS), outliers.consistency(outliers.SHARE, 5)
    bins = np.floor(z * 256)
    quart = [np.quantile(bins, q, axis=0, method="inverted_cdf") for q in (0.25, 0.5, 0.75)]
    mean, w = (quart[1] + 0.5) / 256, np.diag(1 / np.maximum((quart[2] - quart[0]) / 256 / 1.349, floors))
    for _ in range(outliers.STEPS):
        b = np.floor(16 * np.log((((z - mean) @ w.T) ** 2).sum(1) + 1e-3))
        near = np.array([(b < x).sum() < outliers.SHARE * len(b) for x in b])
        mean = z[near].mean(0)
        w = np.linalg.inv(np.linalg.cholesky(np.cov(z[near].T, bias=True) * factor + np.diag(floors ** 2)))
    assert d2 == pytest.approx((((z - mean) @ w.T) ** 2).sum(1), rel=1e-6)
    assert outliers.robust_quality(docs).count() == docs.count() and outliers.robust_quality(docs.where("false")).count() == 0


def test_repeated_lines_or_phrases_are_outliers_of_a_tight_group(spark):
    rng = np.random.default_rng(4)

    def line(n):
        return invented(rng, "abcdefgh", n)
    rows = [(i, "\n".join(line(12) for _ in range(10))) for i in range(150)]
    short = [line(4), line(4)]
    rows += [(1000, "\n".join(short * 3 + [line(20) for _ in range(4)]))]  # 4 of 10 lines, a quarter of the words
    phrase = line(10)
    rows += [(1001, "\n".join(f"{line(7)} {phrase if k < 4 else line(10)}" for k in range(8)))]  # 40 of 136 words, no line
    frame = spark.createDataFrame([(*r, "aa", "big") for r in rows], "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r for r in outliers.robust_quality(frame).collect()}
    assert out[1000].n_dup_lines == 4 and out[1001].n_dup_lines == 0
    for k in (1000, 1001):
        assert not out[k].base_failed and not out[k].kept
    assert all(out[i].kept for i in range(150))


def test_quality_scores(spark, docs):
    labelled = docs.where("doc_id < 120").withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1))
    net = quality.fit_quality(docs, labelled)
    out = quality.score_quality(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    low = [r.score for r in out if r.text and "scummy" in r.text]
    high = [r.score for r in out if r.doc_id is not None and r.doc_id < 120 and "scummy" not in r.text]
    assert np.mean([a < b for a in low for b in high]) > 0.95
    none = quality.fit_quality(docs, labelled.where("false"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_very_long_texts_are_read_in_pieces_and_whole(monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 60_000)]
    text = " ".join(words).encode()
    assert len(minhash.shingle_sets([b"a b", text, b""], 2)[1]) == len(set(zip(words, words[1:])))
    table = rng.normal(size=(1 << 10, 8)).astype(np.float32)
    whole = quality.pooled([text, b"one two"], table)
    monkeypatch.setattr(quality, "CHUNK", 50_000)
    assert np.allclose(quality.pooled([text, b"one two"], table), whole, atol=1e-4)
