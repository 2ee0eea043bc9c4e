"""Each operator against brute force on small tables with the awkward cases: nulls, empty and long texts, ties, repeats."""

import base64
import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries as llm_queries
from graphloom.llm import bpe, common, katz, katz_packed, near_dedup, packing, pretokens, quality_classifier, quality_rules, toxicity, url_filter, vector_search, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    None, "", "   \n\t ", "One two", "one TWO", BASE, BASE, BASE.replace("word60", "other"), BASE + " tail", "a b c d e " * 30,
    "é ü\u00a0x <|endoftext|> 'll don't  12345\n\n\nabc", "!" * 3000 + "aaaaaaaaab" * 200, "Line one\nLine one\n\nLine #$% two | <b>", "x" * 5000,
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or "") if i % 4 else None, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long").repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_of_bytes():
    t = pa.array([None, "", " a", "b ", "é§\u00a0x  Y\n\tz", "\x0b\x0c q"])
    at, found = common.words_of(t)
    assert [found.to_pylist()[at[i] : at[i + 1]] for i in range(len(t))] == [words(x) for x in t.to_pylist()]


@pytest.mark.parametrize("chunk", [1, 40, 4_000_000])
def test_packed_katz_equals_the_tables(spark, docs, real, chunk):
    few = real.where("doc_id < 40").select("doc_id", "text") if chunk == 40 else docs
    few = few.unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate([*["x y"] * 9, *["x y z"] * 8, "x q", "y x"], 1)], "doc_id long, text string"), allowMissingColumns=True)
    held = lambda c: common.fold(c) == 1
    got, want = ({r.doc_id: r for r in f.collect()} for f in (katz_packed.score(few, held, chunk=chunk), katz.score(few, held)))
    assert got.keys() == want.keys() and any(r.held_out for r in got.values())
    for k, r in want.items():
        assert got[k].asDict() == pytest.approx(r.asDict(), rel=1e-9)


def test_packed_katz_keeps_repeats_and_null_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out = katz_packed.score(d, lambda c: c == 5).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in out) == [(0, 1, 1), (1, 3, 3), (1, 3, 3)]
    assert katz_packed.score(d.limit(0), lambda c: c == 5).count() == 0


def test_katz_is_normalised_and_scores_by_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b c a", "a a b", "c", None, "z a"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = {5}
    out = {r.doc_id: r for r in katz.score(d, lambda c: c == 5).collect()}
    train = [t for i, t in rows if i not in held]
    uni, bi, hist = Counter(), Counter(), Counter()
    for t in train:
        s = ["<s>", *words(t), "</s>"]
        uni.update(s[1:])
        bi.update(zip(s, s[1:], strict=False))
        hist.update(s[:-1])

    def disc(c):
        n = Counter(c.values())
        n1, d = n[1], {}
        for r in range(1, 6):
            rest = 6 * n[6] / n1 if n1 else 1
            x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n1 and n[r] and n[r + 1] and rest < 1 else None
            d[r] = max(x if x is not None and 0 < x <= 1 else 1 - (n1 / (n1 + 2 * n[2]) if n1 else 0) / r, 1e-3)
        return lambda k: k * d.get(k, 1)

    total, u, b = sum(uni.values()), disc(uni), disc(bi)
    mass = sum(map(u, uni.values()))
    unk = max(1 - mass / total, 0.5 / (total + 0.5 * (len(uni) + 1)))
    p1 = lambda w: u(uni[w]) * (1 - unk) / mass if w in uni else unk

    def p2(h, w):
        seen = [x for (g, x) in bi if g == h]
        if not seen:
            return p1(w)
        kept = sum(b(bi[h, x]) for x in seen)
        n = hist[h] if hist[h] - kept > 1e-9 * hist[h] else hist[h] + 1
        return b(bi[h, w]) / n if (h, w) in bi else (1 - kept / n) / (1 - sum(map(p1, seen))) * p1(w)

    for h in ["<s>", "a", "b", "z"]:
        assert sum(p2(h, w) for w in [*uni, "unknown"]) == pytest.approx(1)
    for i, t in rows:
        s = ["<s>", *words(t), "</s>"]
        assert out[i].n_tokens == len(s) - 1 and out[i].train_tokens == total
        assert out[i].score == pytest.approx(sum(np.log10(p2(h, w)) for h, w in zip(s, s[1:], strict=False)))
        assert out[i].base_score == pytest.approx(sum(np.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in s[1:]))
        assert out[i].n_known == sum(w in uni for w in s[1:]) and out[i].held_out == (i in held)


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(50)]
    rows += [(2000, None), (2020, [1.0, float("nan")] + [0.0] * 4), (2040, [None] + [1.0] * 5), (2060, [float("inf")] + [1.0] * 5), (2080, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = vector_search.top_k(v, v.where("vec_id % 20 = 0").select("vec_id"), 20).collect()
    x = {i: np.floor(np.float32(e).astype(float) * 64).astype(int) for i, e in rows if e is not None and all(y is not None and np.isfinite(y) for y in e)}
    x[2080] = np.zeros(6, int)
    want = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-int(x[q] @ x[j]), j) for j in x if j != q)[:20]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)


def test_top_k_knows_rows_that_repeat_an_id(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (40, [0.5, 0.5]), (None, [9.0, 9.0])] + [(int(i) % 37, [float(x) for x in rng.normal(size=2)]) for i in range(120)]
    rows += [(100 + i, [3.0, 3.0]) for i in range(60)]  # many copies of a vector that is high for most
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(3)
    index = vector_search.Index(v)
    out = index.search(v.where("vec_id % 20 = 0").select("vec_id"), 4)
    x = [(i, np.floor(np.float32(e).astype(float) * 64).astype(int)) for i, e in rows if i is not None]
    want = []
    for a, (q, own) in enumerate(x):
        if q % 20 == 0:
            best = sorted((-int(own @ e), j) for b, (j, e) in enumerate(x) if b != a)[:4]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == sorted(want)
    assert index.pairs == sum(i % 20 == 0 for i, _ in x) * index.blocks.count() and 0 < index.visits < index.pairs  # the bounds leave annuli out
    assert vector_search.top_k(v.limit(0), v.limit(0).select("vec_id")).count() == 0
    assert vector_search.top_k(v.where("vec_id IS NULL"), v.select("vec_id")).count() == 0


def test_top_k_leaves_most_annuli_of_clustered_vectors_out(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 32)
    monkeypatch.setattr(vector_search, "PAGE", 16)  # several pages
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(20, 24))
    x = centers[rng.integers(20, size=2400)] + rng.normal(size=(2400, 24)) * 0.1
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index = vector_search.Index(v)
    out = index.search(v.where("vec_id % 20 = 0").select("vec_id")).collect()
    x = np.floor(x.astype(np.float32).astype(float) * 64).astype(int)
    s = x @ x.T
    want = [(q, k + 1, j, int(s[q, j])) for q in range(0, 2400, 20) for k, j in enumerate(sorted((j for j in range(2400) if j != q), key=lambda j: (-s[q, j], j))[:20])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want
    assert index.visits < 0.5 * index.pairs


def _groups(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for a, b in {(a, b) for l in by.values() for a in l for b in l if a < b}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, real):
    chain = [(100 + i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 160))) for i in range(12)]  # neighbours link, ends don't
    for d in (docs, real, spark.createDataFrame(chain, "doc_id long, text string")):
        want = _groups({r.doc_id: r.text for r in d.select("doc_id", "text").collect()})
        got = near_dedup.group(d).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.group(docs.limit(0)).count() == 0


def test_near_duplicates_without_any_word(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "  "), (2, "")]
    for d in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[:1], "doc_id long, text string")):
        for r in near_dedup.group(d).collect():
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)


def test_bpe_equals_the_library(spark, docs, real):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in (docs, real.limit(40)):
        texts = {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()}
        rows = bpe.encode_table(d.where(F.col("doc_id").isin(list(texts))), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        assert all(r.ids == e.encode_ordinary(texts[r.doc_id]) and r.decoded.decode() == texts[r.doc_id] for r in rows) and len(rows) == len(texts)
    for r in bpe.digest_table(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = e.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    everything = docs.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in everything.collect()}
    rows = bpe.digest_table(everything, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = e.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_merges_follow_each_pre_token_alone():
    rng = np.random.default_rng(2)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 400:  # any join of two, so ranks needn't grow along a token
        a, b = (list(ranks)[int(i)] for i in rng.choice([97, 98, 99, *range(256, len(ranks))], 2))
        if len(a + b) <= 6 and a + b not in ranks:
            ranks[a + b] = len(ranks)
    order = rng.permutation(np.arange(256, 400)).tolist()
    ranks = {t: r if r < 256 else order[r - 256] for t, r in ranks.items()}

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    pieces = [bytes(rng.choice([97, 98, 99], n).astype(np.uint8)) for n in rng.integers(1, 40, 300)] + [b"a" * 500, b"", b"ab" * 300]
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.Merges(ranks).encode(pieces)] == [plain(p) for p in pieces]
    assert bpe.Merges(ranks).encode([]) == []


@pytest.mark.parametrize("pattern", [P.PATTERN, P.PATTERN + "|x"])
def test_pre_tokens_equal_the_pattern(pattern):
    import regex

    rng, parts = np.random.default_rng(4), ["a", "s", "t", "'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\u00a0", "1", "२", "é", "中", "!", "😀", "\x1c", "\u0301", "<|endoftext|>", "<|"]
    find, plain, own = regex.compile(pattern).findall, pretokens.Cutter(pattern), pretokens.Cutter(pattern, ("<|endoftext|>",))
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(rng.integers(0, 6))]
        column = pa.array(["before", *texts], pa.string()).slice(1)
        split = [regex.split(r"(<\|endoftext\|>)", t or "") for t in texts]
        for cutter, want in ((plain, [find(t or "") for t in texts]), (own, [[x for k, s in enumerate(t) for x in ([s] if k % 2 else find(s))] for t in split])):
            at, pieces = cutter.cut(column)
            assert [[x.decode() for x in pieces.to_pylist()[a:b]] for a, b in zip(at, at[1:], strict=False)] == want


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://b/\nx", "<p>é</p>"), (4, "", ""), (0, "u", "<p>é</p>"), (9, "big", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, common.fresh_path(spark, "warc-test"))
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        if first == i:
            assert got[i].payload == data
    good = warc.record(1, "u", b"x", warc.digest(b"x"), None, False)
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"\r\n\r\nx", b"\r\n\r\ny"))
    with pytest.raises(ValueError):
        list(warc.members((warc.member(good) + b"\0")[:40]))


def test_packing_is_complete_and_near_full(docs, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d in (docs, real):
        pieces, rows = defaultdict(list), packing.pack(d, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
        for r in rows:
            pieces[r.doc_id].append((r.start, r.ids))
        for r in d.select("doc_id", "text").collect():
            ids = [x for _, p in sorted(pieces[r.doc_id]) for x in p]
            assert ids == [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        spans = defaultdict(list)
        for r in rows:
            spans[r.sequence_id].append((r.offset, r.length))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 1024
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack_digests(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert digests[0, 0] == zlib.crc32(np.array([0], "<u4").tobytes())


def test_cuts_are_the_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        at = np.unique(np.concatenate([[0, 60], rng.integers(1, 60, 14), np.arange(0, 61, 8)]))
        penalty = rng.integers(0, 5, len(at))
        found = packing.cuts(at, penalty, 16)
        cost = lambda a, b: (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + packing.PER_WINDOW
        best = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(at[i], at[j]) + penalty[j] for i in range(j) if at[j] - at[i] <= 16)
        index = {p: i for i, p in enumerate(at)}
        assert sum(cost(a, b) + penalty[index[b]] for a, b in zip(found, found[1:], strict=False)) == pytest.approx(best[-1])


def test_url_rules_and_words(spark):
    urls = {
        1: ("http://www.Example.com/en/7x?q", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), 3: ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        4: ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"), 5: (None, "", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"), 7: ("https://telecom/en/", "telecom", "/en/", None, None), 8: ("s://org#/es/", "org", "", None, None),
    }
    pages = spark.createDataFrame([(i, u[0], "<p>free pills and bets and words</p>") for i, u in urls.items()], "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(pages)).collect()}
    for i, (_, host, path, rule, verdict) in urls.items():
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert verdict is None or out[i].verdict == verdict
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "pill": 5, "heap": 5})
    assert s.split("cheappills") == ["cheap", "pills"]


def _base_counts(t):
    w, ws = re.findall(r"[^\x20\x09-\x0d]+", t or ""), defaultdict(list)
    for i in range(len(w) - 4):
        ws[tuple(w[i : i + 5])].append(i)
    cover = {i + k for p in ws.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(docs, real):
    for d in (docs, real):
        texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
        for r in quality_rules.judge(d).collect():
            n = _base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_classifiers_on_held_out_rows(spark, docs):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = common.stored(quality_classifier.measured(d), "measured")
    both = quality_classifier.judge(rows, quality_classifier.train(rows, labels)).join(labels, "doc_id").where(common.fold(F.col("doc_id")) == 0)
    assert both.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95
    model = toxicity.train(d, labels)
    tox = toxicity.score(d, model).join(labels, "doc_id")
    assert tox.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()[0] > 0.93
    assert {r.doc_id for r in toxicity.score(docs, model).collect()} == set(range(len(TEXTS)))
    none = labels.limit(0)
    rows = common.stored(quality_classifier.measured(docs), "measured")
    assert quality_classifier.judge(rows, quality_classifier.train(rows, none)).where("kept").count() == len(TEXTS)
    assert toxicity.score(docs, toxicity.train(docs, none)).where("score >= 0.5").isEmpty()


def test_pipeline_keeps_clean_documents_once(spark):
    d, steps = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        d = common.stored(stage(spark, d, SF), "stage-test")
        steps.append(d)
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in steps[:-1])
    want = {c for _, c in _groups({r.doc_id: r.text for r in steps[1].collect()}, corpus_pipeline.PERCENT).values()}
    assert {r.doc_id for r in steps[2].collect()} == want == {r.doc_id for r in steps[3].select("doc_id").distinct().collect()}


def test_pipeline_dedup_keeps_null_ids(spark):
    own = [" ".join(f"{k}v{i}" for i in range(80)) for k in "abcd"]
    near = own[3] + " tail"
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (None, own[1].upper()), (7, own[2]), (None, own[2]), (None, own[3]), (None, near), (None, ""), (None, None), (8, ""), (9, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id or 0, "none" if r.text is None else r.text.lower()) for r in corpus_pipeline.dedup(spark, d, SF).collect()), key=repr)
    four = {(0, own[3]), (0, near)} & set(got)
    assert len(four) == 1
    assert got == sorted([(0, own[0]), (0, own[1]), (7, own[2]), *four, (0, ""), (0, "none"), (8, ""), (9, "")], key=repr)


def test_near_duplicates_at_another_threshold(spark):
    texts = [" ".join(f"w{k}" for k in range(m, m + 100)) for m in (0, 10)]  # 86 of 106 shingles shared: 0.81
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_dedup.group(d).where("kept").count() == 2
    assert near_dedup.group(d, percent=80).where("kept").count() == 1


def test_near_copies_of_each_version_and_of_null_ids_link(spark):
    a, b, c, e = (" ".join(f"{k}{i}" for i in range(100)) for k in "abce")
    rows = [(5, a), (5, b), (6, a + " tail"), (7, b + " tail"), (None, c), (None, c + " tail"), (None, e), (9, e + " tail"), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.group(d).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (5, 6, 7, 9)} == {(5, 5), (6, 5), (7, 5), (9, 9)}
    null = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(null, key=repr) == sorted([(None, True), (None, False), (9, False)], key=repr)


def test_url_filter_knows_rare_and_long_words(spark):
    long = "q" * 30
    common_words = " ".join(f"{a}{b}{c}{d} {a}{b}{c}{d}" for a in "abcdefghijklm" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop" for d in "abcdefghijklmnop")
    pages = spark.createDataFrame([(1, f"http://zebu{long}.a.com/en/zebu{long}", common_words), (2, None, f"<p>zebu {long}</p>")], "page_id long, url string, html string")
    words = url_filter.vocabulary(pages)
    assert words.count() > 50_000 and words.where(F.col("w").isin("zebu", long)).count() == 2
    rows = {r.page_id: r.tokens for r in url_filter.featured(pages, words).collect()}
    assert rows[1][:2] == ["h:zebu", "h:" + long] and rows[2] == []


def test_url_filter_scores_whole_urls(spark):
    urls = ["http://shop.example.org/casino-bonus", "http://casino/", "http://a.com/en/" + "casino" * 100]
    pages = spark.createDataFrame([(i, u, "<p>casino bonus shop example org com en a</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_filter.featured(pages, url_filter.vocabulary(pages)).collect()}
    assert rows[0].tokens == ["h:shop", "h:example", "h:org", "p:casino", "p:bonus"] and rows[0].known == ["h:shop", "h:example"]
    assert rows[1].tokens == rows[1].known == ["h:casino"]
    assert rows[2].tokens == ["h:a", "h:com", "p:en", *["p:casino"] * 100] and rows[2].known == ["h:a", *["p:casino"] * 100]


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(llm_queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = llm_queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, "one two"), (4, "same words here " * 3), (4, "same words here " * 3), (4, "other words"), (5, "z" * 300_000), (6, "a b c d e f " * 20_000)]


def _awkward(spark, rows):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "w", "t", "score", "digest", "id", "h", "kept", "lines", "y", "_id"):  # names the operators use inside
        d = d.withColumn(c, F.lit("x"))
    return d.repartition(2)


@pytest.mark.parametrize("rows", [[], AWKWARD[:3], AWKWARD], ids=["none", "wordless", "all"])
def test_documents_with_awkward_rows(spark, rows):
    d = _awkward(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, None, None), (4, 5, 5)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("row", F.lit(1))
    n = len(rows)
    assert katz_packed.score(d, lambda c: common.fold(c) == 1).count() == n
    assert near_dedup.group(d).count() == n
    coded = bpe.digest_table(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(coded) == n and all(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest() for r in coded if r.doc_id in (1, 2))
    assert toxicity.score(d, toxicity.train(d, labels)).count() == n
    pieces = packing.pack_digests(d, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sum(r.start + r.length == r.doc_tokens for r in pieces) == n
    measured = common.stored(quality_classifier.measured(d), "measured")
    assert quality_classifier.judge(measured, quality_classifier.train(measured, labels)).count() == n
    judged = quality_rules.judge(d).collect()
    assert len(judged) == n and all(r.base_failed and not r.kept and r.n_words == 0 for r in judged if r.doc_id in (1, 2, 3))


@pytest.mark.parametrize("rows", [[], AWKWARD[:3], AWKWARD], ids=["none", "wordless", "all"])
def test_pipeline_stages_with_awkward_rows(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = _awkward(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        d = common.stored(stage(spark, d, str(tmp_path)), "awkward")
        if name in ("quality", "toxicity"):  # without labels all stay
            assert d.count() == len(rows)
    last = {(r.doc_id, r.doc_tokens) for r in d.where("start = 0").collect()}
    assert {i for i, _ in last} == {i for i, _ in rows}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "x://a.b/c", "h"), (1, "x://a.b/c", "h"), (1, "x://a.b/c", "h"), (2, "no", None), (3, "x://" + "q" * 2_000 + ".com/" + "casino" * 3_000, "")]], ids=["none", "null", "all"])
def test_pages_with_awkward_rows(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("row", "host", "rule", "w", "n", "salt", "digest_hex", "first", "member", "score"):
        pages = pages.withColumn(c, F.lit("x"))
    judged = url_filter.judge(pages, url_filter.train(pages)).collect()
    assert len(judged) == len(rows) and all(r.verdict in ("allow", "block") for r in judged)
    back = warc.read_archives(spark, warc.write_archives(pages, common.fresh_path(spark, "warc-awkward"))).collect()
    assert Counter(r.page_id for r in back) == Counter(r[0] for r in rows)
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in back)


def test_url_odds_equal_brute_force(spark):
    urls = ["http://casino-win.com/en/a", "http://a.net/de/bonus", "http://x.org/es/play", "http://library.info/fr/book", "http://bet.info/fr/a", None]
    pages = spark.createDataFrame([(i, u, "<p>casino win bonus play library book bet info</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = url_filter.featured(pages, url_filter.vocabulary(pages))
    sums = np.zeros((2, url_filter.BUCKETS))
    for r in rows.collect():
        seeded = any(t.startswith("h:") and t[2:] in url_filter.SEEDS for t in r.known)
        if seeded or r.ruling == "allow":
            for t in r.known:
                sums[int(seeded), url_filter.bucket(t)] += 1
    odds, (a, b) = url_filter.fit(rows), sums.sum(1)
    for r in url_filter.scored(rows, odds).collect():
        want = 0.0
        tokens = rows.where(F.col("page_id") == r.page_id).first().tokens
        for t in tokens:
            k, s = url_filter.bucket(t), url_filter.SMOOTHING
            n = sums[0, k] + sums[1, k] + s
            want += np.log((sums[1, k] + s * b / (a + b)) / n) - np.log((sums[0, k] + s * a / (a + b)) / n) - np.log(b / a)
        assert r.score == pytest.approx(want)
        assert r.rule is not None or r.verdict == ("block" if want >= url_filter.THRESHOLD else "allow")


def test_url_filter_survives_words_of_all_lengths_and_a_long_run(spark):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    text = " ".join(letters(n) for n in range(1, 1501)) + " " + " ".join("a" * n for n in range(1, 300))
    inner = letters(900)
    pages = spark.createDataFrame([(1, "http://x.info/fr/" + letters(1500) + inner + "a" * 1600, text + " " + inner), (2, None, f"<p>{inner}</p>")], "page_id long, url string, html string")
    words = url_filter.vocabulary(pages)
    tokens = {r.page_id: r.tokens for r in url_filter.featured(pages, words).collect()}
    assert "p:" + inner in tokens[1] and "p:" + "a" * 299 in tokens[1] and tokens[2] == []


def _all_splits(run, counts, total, longest=9):
    cost = lambda w: -np.log(counts[w] / (total + 1.0)) if w in counts else np.log(total + 1.0) + 2.0 + 3.0 * len(w)
    best = {0: (0.0, [])}
    for j in range(1, len(run) + 1):
        best[j] = min(((best[i][0] + cost(run[i:j]), [*best[i][1], run[i:j]]) for i in range(j)), key=lambda b: b[0])
    return best[len(run)][0], cost


def test_segmentation_equals_the_best_of_all_splits(spark):
    rng = np.random.default_rng(6)
    vocabulary = {w: int(rng.integers(1, 50)) for w in ["the", "then", "he", "hen", "n", "in", "ink", "kin", "nether", "t" * 20, "t" * 18 + "h"]}
    runs = ["".join(rng.choice(["the", "in", "k", "n", "he", "q", "t" * 20], int(rng.integers(1, 6)))) for _ in range(60)]
    words = spark.createDataFrame(list(vocabulary.items()), "w string, n long")
    total = sum(vocabulary.values())
    for r in url_filter.segmented(spark.createDataFrame([(x,) for x in set(runs)], "run string"), words).collect():
        least, cost = _all_splits(r.run, vocabulary, total)
        assert "".join(r.words) == r.run and sum(map(cost, r.words)) == pytest.approx(least)


def test_url_threshold_is_chosen_on_other_urls(spark):
    urls = [f"http://{h}{i}.info/fr/a" if h != "good" else f"http://good{i}.net/de/{i}" for i in range(60) for h in ("casino-", "good")]
    pages = spark.createDataFrame([(i, u, "<p>casino good words</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    model = url_filter.train(pages)
    rows = url_filter.featured(pages, model.words)
    threshold, figures = url_filter.chosen(rows)
    assert figures["blocked_right"] == figures["allowed_right"] == 1.0 and threshold == model.threshold
    assert all((r.verdict == "block") == ("casino" in r.host) for r in url_filter.judge(pages, model).collect())


def test_label_model_step_equals_bayes():
    votes = np.array([[1, 0], [1, 1], [2, 0], [2, 2], [0, 0], [1, 2]])
    m = toxicity.LabelModel.fit(votes, 0.4, rounds=3)
    for row, p in zip(votes, m.posterior(votes), strict=True):
        odds = 0.4 / 0.6 * np.prod([(m.table[j, 1, v] / m.table[j, 0, v]) ** m.weight[j] if v else 1.0 for j, v in enumerate(row)])
        assert p == pytest.approx(odds / (1 + odds))
    assert np.allclose(m.table.sum(2), 1)


def test_co_training_scores_equal_the_model(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = common.stored(quality_classifier.measured(d), "measured")
    model = quality_classifier.train(rows, labels)
    frame = rows.toPandas()
    z = [v.logit(v.matrix(frame)) for v in (model.text, model.meta)]
    want = 1 / (1 + np.exp(-(z[0] * model.mix[0] + z[1] * model.mix[1] + model.mix[2])))
    got = {r.doc_id: r.score for r in quality_classifier.judge(rows, model).collect()}
    assert got == pytest.approx(dict(zip(frame["doc_id"].tolist(), want.tolist(), strict=True)), abs=1e-6)


def test_label_model_equals_em_by_brute_force():
    rng = np.random.default_rng(8)
    truth = rng.random(60) < 0.3
    said = np.where(rng.random((60, 5)) < 0.8, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None])
    votes = np.where(rng.random((60, 5)) < 0.3, 0, said)
    votes[:, 4] = votes[:, 3]  # two that always go together
    prior, weight = 0.3, [1.0] * 5
    p = []
    for row in votes.tolist():
        n = row.count(1)
        p.append(min(0.98, 0.6 + 0.1 * n) if n else 0.02 if 2 in row else 0.2)
    for turn in range(12):
        share = {}
        for j in range(5):
            for c in (0, 1):
                mass = [q if c else 1 - q for q in p]
                for v in range(3):
                    share[j, c, v] = (sum(m for m, row in zip(mass, votes, strict=True) if row[j] == v) + 0.5) / (sum(mass) + 1.5)
        if turn == 9:
            says = [[float(x == 1) for x in row] for row in votes.tolist()]
            mean = [[sum(m * s[j] for m, s in zip(mass, says, strict=True)) / sum(mass) for j in range(5)] for mass in (p, [1 - q for q in p])]
            left = [[s[j] - q * mean[0][j] - (1 - q) * mean[1][j] for j in range(5)] for q, s in zip(p, says, strict=True)]
            dot = lambda i, j: sum(row[i] * row[j] for row in left)
            alike = lambda i, j: min(1.0, max(0.0, dot(i, j) / (dot(i, i) * dot(j, j)) ** 0.5))
            weight = [1 / (1 + sum(a for i in range(5) if i != j and (a := alike(i, j)) >= 0.3)) for j in range(5)]
        odds = [prior / (1 - prior) * np.prod([(share[j, 1, v] / share[j, 0, v]) ** weight[j] for j, v in enumerate(row) if v]) for row in votes.tolist()]
        p = [o / (1 + o) for o in odds]
    model = toxicity.LabelModel.fit(votes, prior, rounds=12)
    assert model.weight == pytest.approx(weight) and weight[3] < 0.6 and model.posterior(votes) == pytest.approx(p)
    assert all(model.table[k] == pytest.approx(s) for k, s in share.items())
    assert ((np.array(p) >= 0.5) == truth).mean() > 0.8


def test_a_round_of_co_training_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "ROUNDS", 1)
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = common.stored(quality_classifier.measured(d), "measured")
    model = quality_classifier.train(rows, labels)
    frame = rows.withColumn("draw", quality_classifier._part(F.col("doc_id"), 10)).toPandas()
    part = np.array([zlib.crc32(str(i).encode()) % 5 for i in frame["doc_id"]])
    gold = {r.doc_id: r.quality for r in labels.collect()}
    y = np.array([gold.get(i, -1) for i in frame["doc_id"]])
    fit, cal, free = (part > 1) & (y >= 0), (part == 1) & (y >= 0), (part > 0) & (y < 0)
    views = [quality_classifier.View.over(frame[fit], quality_classifier.TEXT, {}), quality_classifier.View.over(frame[fit], quality_classifier.META[:1], {"source": quality_classifier.SOURCES, "lang": quality_classifier.LANGS})]
    for v in views:
        v.fit(v.matrix(frame[fit]), y[fit].astype(float))
    want, share = quality_classifier.SHARE * free.sum(), y[fit].mean()
    given = [{}, {}]  # what each view tells the other
    for k, v in enumerate(views):
        for label in (0, 1):
            sure = []
            for i in np.flatnonzero(free):
                row, z, at = frame.iloc[i], v.bias, 0
                for c, edges in v.edges.items():
                    z += sum(w for e, w in zip(edges, v.weights[at:], strict=False) if row[c] >= e)
                    at += len(edges)
                for c, n in v.categories.items():
                    z += v.weights[at + int(row[c])]
                    at += n
                p = 1 / (1 + np.exp(-z))
                if (p > quality_classifier.SURE) if label else (p < 1 - quality_classifier.SURE):
                    sure.append(i)
            most = want * (share if label else 1 - share)
            given[k] |= {i: float(label) for i in sure if frame["draw"].iloc[i] < int(2**20 * min(1.0, most / max(1, len(sure))))}
    assert all(given)
    for k, v in enumerate(views):
        more = list(given[1 - k])
        v.fit(np.concatenate([v.matrix(frame[fit]), v.matrix(frame.iloc[more])]), np.concatenate([y[fit], list(given[1 - k].values())]))
    z = []
    for v, found in zip(views, (model.text, model.meta), strict=True):
        raw = v.matrix(frame[cal]) @ v.weights + v.bias
        slope, offset = quality_classifier.platt(raw, y[cal].astype(float))
        assert found.weights == pytest.approx(v.weights, abs=2e-3) and (found.slope, found.offset) == pytest.approx((slope, offset), abs=2e-3)
        z.append(slope * raw + offset)
    w, c = quality_classifier.logistic(np.column_stack(z), y[cal].astype(float), l2=0.1)
    assert model.mix == pytest.approx((max(0.0, w[0]), max(0.0, w[1]), c), abs=5e-3)
