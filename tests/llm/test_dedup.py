"""Deduplication operators against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from odspark.llm import near_dedup, quality, suffix_dedup, window_dedup
from tests_llm_texts import messy_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(seed, n=60):
    """Texts that share passages of many lengths, with copies and near copies."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["ñu", "日本", "Eß"]
    passages = [" ".join(r.choice(vocab) for _ in range(r.choice([5, 12, 13, 14, 40, 90, 150]))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts.append(r.choice(passages) if r.random() < .6 else " ".join(r.choice(vocab) for _ in range(r.randrange(60))))
        out.append(r.choice([" ", "\n", "  "]).join(parts))
    out += [out[0], out[1], out[1], None, "", "x" * 1500, "ab" * 700, "x" * 900 + passages[5]]
    return out


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, gram, max_group", [(400, 48, 20_000), (60, 16, 20_000), (60, 16, 3), (30, 30, 2)])
def test_suffix_dedup(docs, length, gram, max_group):
    texts = repeats(length + max_group)
    got = suffix_dedup.remove_repeats(docs(texts, clash=True), length, gram=gram, max_group=max_group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.text or b"")).hexdigest())
            for r in got} == brute_bytes(texts, length)


def test_suffix_dedup_messy_and_empty(docs, empty_docs):
    texts = messy_texts(8, 60)
    got = suffix_dedup.remove_repeats(docs(texts), 40, gram=12).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.text or b"")).hexdigest())
            for r in got} == brute_bytes(texts, 40)
    assert suffix_dedup.remove_repeats(empty_docs).count() == 0


@pytest.mark.parametrize("max_group", [20_000, 1])
def test_suffix_dedup_texts_of_one_polynomial_hash(docs, max_group):
    """Strings made to share the polynomial hash are different texts: nothing of them repeats."""
    import numpy as np
    from odspark.llm import rolling as R
    twins = [("wghwhiigdzjkaiasloljqwdgghqmlpit", "izpblggpdwevvrwslbuzhqnqldysyuxm"),
             ("gtjknecwlbuzxjbnzpaluletzuauancf", "bpgufyovpadpfntwyzmzsnyryzphrixj")]
    for pair in twins:
        h = R.byte_prefix(np.frombuffer("".join(pair).encode(), np.uint8))
        assert len(set(R.byte_span(h, [0, 32], [32, 64]).tolist())) == 1
    r = random.Random(17)
    texts = []
    for _ in range(12):
        a, b = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (r.randrange(400), r.randrange(400, 500)))
        texts += [a + x + b[len(a):] for x in r.choice(twins)]
    want = brute_bytes(texts, 400)
    clean = [k for k, v in want.items() if not v[1]]
    assert len(clean) >= 12
    got = suffix_dedup.remove_repeats(docs(texts), max_group=max_group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.text or b"")).hexdigest())
            for r in got} == want


def test_suffix_dedup_line_repeated_in_a_document(docs, monkeypatch):
    """A line that some documents repeat all over makes a row per document and class, not per place."""
    r = random.Random(18)
    line = "".join(r.choice("abcdefgh ") for _ in range(120))
    texts = [line * 150 + str(k) * 30 for k in range(5)] + ["y" * 900, "y" * 650, None]
    sizes, staged = {}, suffix_dedup.staged

    def counted(df, name):
        out = staged(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(suffix_dedup, "staged", counted)
    got = suffix_dedup.remove_repeats(docs(texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.text or b"")).hexdigest())
            for r in got} == brute_bytes(texts, 400)
    assert sizes["shared-runs"] < 60


def test_runs_in_rows_of_bounded_size(monkeypatch):
    import numpy as np
    monkeypatch.setattr(suffix_dedup, "ROW_RUNS", 7)
    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", 5)
    texts = [b"ab" * 90 + b"c" * 50, b"", b"ab" * 60, b"x"]
    off = np.cumsum([0] + [len(t) for t in texts])
    runs = suffix_dedup._Runs(np.frombuffer(b"".join(texts), np.uint8), off, 40, 12)
    found = []
    for doc, start, n, gram, cls, more in runs.rows():
        assert len(doc) <= 5
        for k, m in enumerate(more.to_pylist()):
            places = [int(start[k]), *np.frombuffer(m, np.int64).tolist()]
            assert len(places) <= 7
            found += [(int(doc[k]), x, int(n[k]), int(gram[k]), int(cls[k])) for x in places]
    assert sorted(found) == sorted(zip(*(getattr(runs, c).tolist() for c in ("doc", "start", "n", "gram", "cls"))))


def test_suffix_sort_order():
    import numpy as np
    from odspark.llm.suffix_sort import Suffixes
    r = random.Random(3)
    data = "".join(r.choice("ab") for _ in range(300)).encode()
    start = [r.randrange(300) for _ in range(120)]
    end = [min(300, s + r.randrange(60)) for s in start]
    group = [r.randrange(3) for _ in start]
    s = Suffixes(np.frombuffer(data, np.uint8), np.array(start), np.array(end), np.array(group))
    key = [(group[i], data[start[i]:end[i]]) for i in s.order]
    assert key == sorted(key)
    for a, b, n in zip(key, key[1:], s.common[1:]):
        if a[0] == b[0]:
            m = 0
            while m < min(len(a[1]), len(b[1])) and a[1][m] == b[1][m]:
                m += 1
            assert m == n


def brute_windows(texts, k=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), d)
    out = {}
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), kept)
    return out


def test_window_dedup(docs, empty_docs):
    for texts in (repeats(21, 120), messy_texts(9, 120)):
        got = window_dedup.remove_repeats(docs(texts, clash=True)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got} == brute_windows(texts)
        untouched = {r.doc_id: r.text for r in got if not r.n_removed}
        assert all(t == texts[d] for d, t in untouched.items())
    assert window_dedup.remove_repeats(empty_docs).count() == 0


def test_window_dedup_many_ranges(docs, monkeypatch):
    monkeypatch.setattr(window_dedup, "HASHES_PER_RANGE", 100)
    monkeypatch.setattr("odspark.llm.chunked.MIN_CHUNK", 4000)
    monkeypatch.setattr("odspark.llm.chunked.MAX_CHUNK", 4000)
    texts = repeats(22, 120)
    got = window_dedup.remove_repeats(docs(texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got} == brute_windows(texts)


def test_window_dedup_same_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t), (3, t), (None, t), (5, t)]
    got = window_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 30), ("3", 30), ("5", 30), ("None", 0)]


def near_texts(seed, n=80):
    r = random.Random(seed)
    bases = [["v%d" % r.randrange(300) for _ in range(r.choice([3, 5, 30, 120]))] for _ in range(10)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = "e%d" % r.randrange(99)
        out.append(r.choice([" ", "\n"]).join(w if r.random() < .7 else w[:-1] or w))
    return out + [None, "", " \n", "Only", "ONLY", "only", "a b c d", "A b\tc d"]


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(docs, block):
    texts = near_texts(31)
    got = near_dedup.near_duplicates(docs(texts, clash=True), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(texts)


def test_near_duplicates_edges(spark, docs, empty_docs):
    assert near_dedup.near_duplicates(empty_docs).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "A B c d e f")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(d).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [
        ("4", None, False), ("4", None, False), ("9", None, False), ("None", None, True)]
    assert near_dedup.one_of_each(d.where("doc_id = 4")).count() == 1


def test_odd_sketch_estimates():
    import numpy as np
    r = np.random.default_rng(1)
    for share in (0.75, 0.85, 0.95):
        n = 400
        common = int(2 * n * share / (1 + share))
        err = []
        for _ in range(60):
            x = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate((x[:common], x[n:])))
            _, s = near_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2)
            differ = np.bitwise_count(s[0] ^ s[1]).sum()
            err.append(float(near_dedup.estimate(differ)) - common / (len(a) + len(b) - common))
        assert abs(np.mean(err)) < 0.03 and np.max(np.abs(err)) < near_dedup.MARGIN


def test_odd_sketch_filter_loses_less_than_the_bands():
    """Exact tail of the estimate at the limit, and a true link whose sketches differ that much."""
    import numpy as np
    n, bits = near_dedup.SAMPLES, near_dedup.SKETCH_BITS
    rng = np.random.default_rng(3)
    sets = [np.arange(100, dtype=np.uint64), np.arange(8, 108, dtype=np.uint64)]
    base = rng.integers(0, 1 << 63, bits // 64).astype(np.uint64)

    def verified(differing):
        flip = sum(1 << k for k in range(differing))
        other = base ^ np.array([flip >> 64 * w & (1 << 64) - 1 for w in range(bits // 64)], np.uint64)
        return near_dedup._links(np.array([1, 2]), sets, np.stack([base, other]), 75) == [(1, 2)]

    widest = max(d for d in range(bits // 2) if verified(d))
    odd, lost = np.zeros(bits + 1), 0.0  # odd bits after two tosses for each differing sample
    odd[0] = 1
    up = (bits - np.arange(bits + 1)) / bits
    for d in range(n + 1):
        lost += math.comb(n, d) * 0.25 ** d * 0.75 ** (n - d) * odd[widest + 1:].sum()
        for _ in range(2):
            odd = np.concatenate(([0], (odd * up)[:-1])) + np.concatenate(((odd * (1 - up))[1:], [0]))
    assert lost < 5e-6


def brute_quality(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            rep[i:i + 3] = [True] * 3
    n_rep = sum(rep)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n_rep,
            len(w) < 50 or 100 * n_rep > 50 * len(w))


def norm(line):
    words = [re.sub("[0-9]", "", w).translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(line)]
    return tuple(w for w in words if w)


def brute_judge(rows, min_docs, share, kept_share):
    """rows: (host, text); verdicts and cleaned texts."""
    hosts, freq = defaultdict(set), defaultdict(set)
    for h, t in rows:
        hosts[h].add(t)
        for x in (t or "").split("\n"):
            if WORD.search(x):
                freq[h, norm(x)].add(t)
    bad = {k for k, v in freq.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for h, t in rows:
        b = brute_quality(t)
        gone = [x for x in (t or "").split("\n") if WORD.search(x) and (h, norm(x)) in bad]
        removed = sum(len(WORD.findall(x)) for x in gone)
        kept = not b[5] and b[0] - removed >= kept_share * b[0]
        clean = "\n".join(x for x in (t or "").split("\n") if not (WORD.search(x) and (h, norm(x)) in bad))
        out.append((b, removed, kept, clean))
    return out


def test_quality(docs, empty_docs):
    r = random.Random(5)
    texts = messy_texts(11, 150)
    common = ["Share this page 12", "share THIS  page 7", "Footer # text | here"]
    for i in range(80):
        lines = [" ".join("z%d" % r.randrange(500) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 5))]
        lines.insert(r.randrange(len(lines) + 1), r.choice(common))
        if i % 5 == 0:
            lines = [" ".join("long%d" % k for k in range(60)), "own words %s" % lines[0]]
        texts.append("\n".join(lines))
    rows = [(f"h{i % 3}" if i % 7 else None, t) for i, t in enumerate(texts)]
    frame = docs(texts, clash=True)
    want = brute_judge(rows, 4, 0.05, 0.5)
    limits = dict(min_docs=4, max_share=0.05, min_kept_share=0.5)
    got = {r.doc_id: r for r in quality.judge_documents(frame, **limits).collect()}
    for i, (b, removed, kept, _) in enumerate(want):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == b, texts[i]
        assert (g.n_line_words_removed, g.kept) == (removed, kept), texts[i]
    assert any(x[1] for x in want) and any(x[1] and not x[2] and not x[0][5] for x in want)
    clean = {r.doc_id: r.text for r in quality.clean_documents(frame, **limits).collect()}
    assert clean == {i: w[3] if w[1] else texts[i] for i, w in enumerate(want) if w[2]}
    assert quality.judge_documents(empty_docs).count() == 0 and quality.clean_documents(empty_docs).count() == 0


def one_hash_pair(a, b, bits=10):
    """Two different lists of 2**bits symbols with one polynomial hash modulo 2**64, whatever its odd base."""
    odd = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return [(a, b)[x] for x in odd], [(b, a)[x] for x in odd]


def test_long_spans_are_told_apart():
    import numpy as np
    import pyarrow as pa

    from odspark.llm import rolling as R
    x, y = ("".join(w) for w in one_hash_pair("a", "b"))
    data, off = R.text_bytes(pa.array([x, y, x]))
    polynomial = R.byte_span(R.byte_prefix(data), off[:-1], off[1:])
    assert polynomial[0] == polynomial[1]  # why the digests are needed
    got = R.word_hashes(data, off[:-1], off[1:])
    assert got[0] == got[2] != got[1]
    runs = np.concatenate([np.array(w, np.uint64) for w in one_hash_pair(3, 11)] * 2)
    at = np.arange(0, 4096, 1024)
    got = R.run_hashes(runs, at, at + 1024)
    assert got[0] == got[2] and got[1] == got[3] and got[0] != got[1]
    short = R.span_hashes(data, R.byte_prefix(data), [0, 2048], [R.LONG - 1, 2048 + R.LONG - 1])
    assert short[0] == short[1]


def test_texts_with_one_polynomial_hash(docs):
    x, y = ("".join(w) for w in one_hash_pair("a", "b"))
    rest = " ".join(f"w{i}" for i in range(12))
    texts = [x, y, f"{rest} {x}", f"{rest} {y}", f"{rest} {x}", f"{x}\n{y}\n{x}"]
    texts += [" ".join(w) for w in one_hash_pair("some", "other")]
    got = near_dedup.near_duplicates(docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(texts)
    got = window_dedup.remove_repeats(docs(texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got} == brute_windows(texts)
    rows = [(f"h{i % 3}" if i % 7 else None, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judge_documents(docs(texts), min_docs=1, max_share=0).collect()}
    for i, (b, removed, kept, _) in enumerate(brute_judge(rows, 1, 0, quality.MIN_KEPT_SHARE)):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == b
        assert (g.n_line_words_removed, g.kept) == (removed, kept)
