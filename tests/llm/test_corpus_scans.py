"""License scan, filter audit and collocations against brute force, on nulls, odd and very long texts, repeated rows, null ids and empty tables."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from repairlens.llm import collocations, filter_audit, licenses
from repairlens.llm import textops as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
low = lambda t: t.encode().translate(LOW).decode()
NOTICE = dict(licenses.TEMPLATES)


def corpus():
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()]
    odd = [None, "", " \n\t", "A", "B b B", "a.b c.d", "#", "é É İ K", "x" * 20_000 + " y", "one two, one two! one\ttwo  one two\none two three", "日本語 の テキスト 日本語", "\x00 \x7f a\x0bb", "mit license MIT-License mıt license apaKe license", "cc by by cc", "GNU general\npublic, LICENSE gnu general public licenses"]
    odd += [" ".join(["q"] * 70) + " " + NOTICE["isc"] + " " + " ".join(["z"] * 70), " ".join(NOTICE["mpl-2.0"].split()[1:]), "lorem ipsum dolor " * 400, "Aa bb " * 90_000]
    out = rows + [(9000 + i, t, None if i % 3 == 0 else "en", None, None) for i, t in enumerate(odd)]
    return out + [(9000, None, "en", "x", 1), (None, "lorem ipsum dolor " * 400, "en", "x", 1), (None, None, None, None, None), rows[3], rows[3], (9100, rows[3][1], "fr", "x", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = {"at": F.lit("x"), "words": F.lit(1), "part": F.lit("y"), "n": F.lit(2), "places": F.lit("z"), "p": F.lit(3), "d1": F.lit(4), "labels": F.lit(5)}
    return spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(3)


def license_row(doc_id, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    met, best = set(), 0.0
    for label, notice in licenses.TEMPLATES:
        t = set(re.findall("[a-z0-9]+", notice.lower()))
        for i in range(0, len(words), 32):
            share = len(t & set(words[i : i + 64])) / len(t)
            if 100 * len(t & set(words[i : i + 64])) >= 90 * len(t):
                met.add(label)
                best = max(best, share)
    base = {label for _, label in found}
    at = [i for i, _ in found]
    return (doc_id, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), 1.0 if found else best)


key = lambda r: tuple((x is not None, x) for x in r)


def test_licenses_equal_brute_force(docs, rows):
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=key)
    assert got == sorted((license_row(r[0], r[1]) for r in rows), key=key)
    by_id = defaultdict(list)
    for r in got:
        by_id[r[0]].append(r)
    assert any("isc" in r[6] for r in got) and any("mpl-2.0" in r[6] for r in got)


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_join_filters_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    letters = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", list(rng.choice(letters, rng.integers(1, 14), replace=False))) for i in range(25)]
    order = [str(x) for x in rng.permutation(letters)]
    sets = [sorted({str(x) for x in rng.choice(letters, rng.integers(1, 28))}, key=order.index) for _ in range(200)]
    for percent in (50, 80, 100):
        posted = licenses.postings(spark, templates, order, percent)
        blocks = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sets)], "at long, block int, words array<string>")
        got = sorted((r["at"], r["template"]) for r in licenses.block_matches(blocks, posted).collect())
        assert got == sorted((i, j) for i, s in enumerate(sets) for j, (_, t) in enumerate(templates) if 100 * len(set(s) & set(t)) >= percent * len(t))


def audit_rows(rows, labels):
    ids = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            ids[r[1] or ""].append(r[0])
    docs = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and doc_id > min(ids[text]) else set()
        docs.append((lang or "", fails, *labels.get(doc_id, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own, shares = [d for d in docs if d[0] == part], Counter()
        for p in permutations("ABCDE"):
            left = own
            for k, c in enumerate(p):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                failing = sum(c in d[1] for d in own)
                out[part, "".join(p), k + 1] = [len(left), len(gone), failing - len(gone), sum(d[1] == {c} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shares[c] += len(gone)
        for p in permutations("ABCDE"):
            for k, c in enumerate(p):
                out[part, "".join(p), k + 1].append(shares[c])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)] + [(9000, 1, None), (9000, None, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    told = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)} | {9000: (1, 1)}
    assert sorted(tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()) == audit_rows(rows, told)
    assert filter_audit.filter_audit(docs.where("false"), labels).collect() == []


def test_measures_equal_plain_python(docs, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["n_distinct"], r["n_capitals"], r["n_points"], r["n_symbols"]) for r in filter_audit.measures(docs).collect()), key=key)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc_id, len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))))
    assert got == sorted(want, key=key)


def test_hash_table_verifies_bytes():
    """All words share one hash: only the bytes tell them apart."""
    words = [b"abcdefghij", b"abcdefghik", b"a", b"abcdefgh", b"abcdefghij", b"a", b"b", b"abcdefghijk"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]), T.NON_SPACE)
    text = np.array([0, 0, 0, 0, 0, 1, 1, 1])
    kept = filter_audit.first_spans(data, starts, ends, text, np.zeros(8, np.uint64))
    assert sorted((int(t), w) for t, w, k in zip(text, words, kept) if k) == sorted({(int(t), w) for t, w in zip(text, words)})


def ngram_counts(rows, most):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def collocation_rows(rows, first, most=3):
    counts, total = ngram_counts(rows, most)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        covered = defaultdict(int)
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        scored = []
        for p, a in found.items():
            if 100 * covered[p] >= 50 * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]
    return sorted(out)


@pytest.mark.parametrize("first, most, mass, bits, threshold_buffer", [(2000, 3, 8_000_000, 28, None), (7, 4, 2_000, 12, 30_000)])
def test_collocations_equal_brute_force(docs, rows, monkeypatch, first, most, mass, bits, threshold_buffer):
    """Once as in production; once with small buffers, many partitions, a bitmap that is nearly full, and a short list."""
    if threshold_buffer:
        monkeypatch.setattr(collocations, "BUFFER", threshold_buffer)
    got = collocations.collocations(docs, most_words=most, first=first, mass_each=mass, filter_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == collocation_rows(rows, first, most)


def test_collocations_of_texts_without_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, "en", "s", 0), (2, " , ", None, "s", 0), (3, "a b", "en", "s", 0)], DOCS)).collect() == []


def test_summary_keeps_every_frequent_key():
    """Whatever the order and the split, no key with the threshold's count is lost, and no counter stands for more than its count."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        keys = rng.zipf(1.3, 4_000).clip(max=900).astype(np.uint32)
        true = Counter(keys.tolist())
        summary = collocations.MisraGries(len(keys) // 10 + 1)
        summary.capacity = max(10, summary.capacity // int(rng.integers(1, 8)))
        threshold = len(keys) // summary.capacity + 1
        for part in np.array_split(keys, rng.integers(1, 30)):
            summary.add(*[x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint32, np.int64))])
            summary.merge()
        assert len(summary.keys) <= summary.capacity and summary.lost * (summary.capacity + 1) <= len(keys)
        assert {k for k, c in true.items() if c >= threshold} <= set(summary.survivors(threshold).tolist())
        assert all(true[k] - summary.lost <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_scores_beyond_64_bits(spark):
    a, l, r = 9 * 10**12 + 7, 10**13 + 1, 10**13 + 3
    ngrams = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, words int, phrase string, f long")
    assert [r["score"] for r in collocations.scored(ngrams).collect()] == [10**6 * a * a // (l * r)]


def test_inner_phrases_go_with_their_longer_ones(spark):
    rows = [("en", 2, "a b", 100), ("en", 2, "b c", 21), ("en", 3, "a b c", 20), ("de", 2, "a b", 30)]
    left = collocations.independent(spark.createDataFrame(rows, "lang string, words int, phrase string, a long")).collect()
    assert sorted((r["lang"], r["phrase"]) for r in left) == [("de", "a b"), ("en", "a b"), ("en", "a b c")]
