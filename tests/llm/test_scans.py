"""Personal data, lexical search and periodic runs against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from check_queries import TABLES, compare
from culturelens.llm import catalog, lexical, line_dedup, periodic, pii, quality
from culturelens.sources import store

DATA = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, rank string, score int, term long,"
          " item string, start string")
EMPTY = hashlib.sha256(b"").hexdigest()


def documents(spark, texts):
    """Rows with clashing extra columns; the last is repeated, and one has no id."""
    rows = [(i, t, "en", "r", 1, 2, "x", "s") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, texts[0], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


# Personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    def good(kind, match):
        number = [int(c) for c in match if c.isdigit()]
        if kind == 1:
            return all(int(p) <= 255 for p in match.split("."))
        if kind == 2:
            total = sum(number[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in number[-2::-2])
            return 12 <= len(number) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(number) <= 15

    found = [(*m.span(), k) for k, p in enumerate(PATTERNS)
             for m in re.finditer(p, text) if good(k, m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b-", "7", "41", "255", "256", " ", "-", "+", "(",
                                 ")", "é", "\n", "_", "4111111111111111", "+1 (269) 555-3296",
                                 "1.2.3.4", "x@y.z"]), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text).spans == plain_spans(text)


def test_long_runs_are_scanned_once():
    for part in ("a", "1", "1.", "a@", "+1 ", "@", "1-"):
        pii.base_spans(part * 100_000)


def random_crf(seed, n, length):
    rng = np.random.default_rng(seed)
    emitted = rng.normal(size=(n, length, pii.TAGS))
    move = np.where(pii.allowed(), rng.normal(size=(pii.TAGS + 1, pii.TAGS)), pii.FORBIDDEN)
    return emitted, move


def path_score(emitted, move, path):
    total = move[-1, path[0]] + emitted[0, path[0]]
    return total + sum(move[a, b] + emitted[t + 1, b]
                       for t, (a, b) in enumerate(zip(path, path[1:])))


def test_crf_equals_the_sum_and_the_best_of_all_paths():
    emitted, move = random_crf(0, 2, 4)
    y = np.array([[0, 1, 2, 0], [3, 4, 0, 0]])
    real = np.array([[True] * 4, [True] * 3 + [False]])
    want, best = [], []
    for k in range(2):
        length = int(real[k].sum())
        paths = list(itertools.product(range(pii.TAGS), repeat=length))
        found = [path_score(emitted[k, :length], move, p) for p in paths]
        want.append(np.log(np.sum(np.exp(found))) - path_score(
            emitted[k, :length], move, y[k, :length]))
        best.append(list(paths[int(np.argmax(found))]) + [0] * (4 - length))
    loss, _, _ = pii.crf_loss(emitted, move, y, real)
    assert loss == pytest.approx(np.mean(want))
    assert pii.best_paths(emitted, real.sum(1), move).tolist() == best


def test_tagger_gradient_equals_differences():
    params = pii.initial(3)
    x, y = pii.labelled_windows(["some words to hold it and more of them " * 4] * 2)
    x[1, 60:] = 0
    _, grad = pii.loss_and_gradient(params, x, y)
    for name, value in params.items():
        at = np.unravel_index(np.argmax(np.abs(grad[name])), value.shape)
        sides = []
        for step in (1e-5, -2e-5):
            value[at] += step
            sides.append(pii.loss_and_gradient(params, x, y)[0])
        value[at] += 1e-5
        assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4)


@pytest.fixture(scope="module")
def contexts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(
        "length(text) > 400").select(F.substring("text", 1, 400).alias("t")).limit(700)
    return [r.t for r in rows.collect()]


@pytest.fixture(scope="module")
def tagger(contexts):
    return pii.train(*pii.labelled_windows(contexts[:500] * 2))


def test_tagger_finds_data_that_stands_side_by_side(tagger, contexts):
    rng = random.Random(5)
    cases = [pii.written_into(re.sub("[0-9@]", "", t), rng) for t in contexts[500:]]
    found = pii.tagged(tagger, [t for t, _ in cases])
    right = sum(len(set(d) & set(s)) for d, (_, s) in zip(found, cases))
    assert right >= 0.95 * sum(len(s) for _, s in cases)
    assert right >= 0.95 * sum(map(len, found))
    beside = "Call +1 (269) 555-3296 4524132264652876 today"
    base = pii.base_spans(beside).spans
    assert base == []
    assert pii.with_added(beside, base, pii.tagged(tagger, [beside])[0]) == [
        (5, 22, 3), (23, 39, 2)]


def test_tagged_spans_depend_on_the_text_alone(tagger):
    texts = ["a" * 300 + " 10.0.0.1 " + "b" * 5000 + " x@y.org", "no data", "7" * 700,
             ("word " * 30 + "mail me: a.b@mail.com, ") * 40]
    together = pii.tagged(tagger, texts)
    assert together == [pii.tagged(tagger, [t])[0] for t in texts]


def test_added_spans_never_touch_base_spans_or_cut_numbers():
    text = "1.2.3.4 and 4111111111111111"
    base = pii.base_spans(text).spans
    assert pii.with_added(text, base, [(0, 5, 1), (12, 24, 2), (8, 11, 0)]) == base


def test_personal_data_of_edge_rows(spark):
    texts = [None, "", "no data here", "mail a@b.org and 300.1.1.1",
             "card 4111 1111 1111 1111, phone +49 (30) 1234-5678", "日本 x@y.zz 日本",
             "word " * 20_000 + "a@b.cc", "1.2.3.4 " * 300, "1.2.3.4 " * 300]
    docs, rows = documents(spark, texts)
    found = {}
    for r in pii.find_personal_data(docs).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert sum(map(len, found.values())) == len(rows)
    for doc, text in rows:
        base = plain_spans(text or "")
        for got in found[doc]:
            assert list(got[:4]) == [sum(k == kind for *_, k in base) for kind in range(4)]
            assert got[4] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
            assert set(pii.listed(base).split(",")) <= set(got[5].split(","))
    assert found[2][0] == (0, 0, 0, 0, EMPTY, "")
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    assert pii.find_personal_data(docs.where("doc_id in (0, 1, 2)")).count() == 3


def test_registered_personal_data_keeps_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = catalog.op11_pii(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        if not re.search("[0-9@]", texts[r.doc_id] or ""):
            assert r.spans == ""


# Lexical search


def plain_search(docs, items, top):
    def terms(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    cut = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    df = {w: sum(w in t for _, t in cut) for some in asked.values() for w in some}
    out = []
    for i, some in asked.items():
        scored = []
        for doc, t in cut:
            score = 0
            for w in some:
                if w in t:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 10 + 90 * len(t) * n_docs // n_terms
                    score += weight * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * m))
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_search_of_edge_rows_in_any_number_of_blocks(spark):
    rng = random.Random(4)
    words = ["the", "The", "a-b", "école", "ÉCOLE", "x1", "日本", "zz", "n_n", "q"]
    texts = [None, "", " .,- ", "the", "the the\tthe", "école"] + [
        rng.choice((" ", ", ", "  ")).join(rng.choice(words) for _ in range(rng.randint(1, 30)))
        for _ in range(40)] + ["the zz " * 20_000]
    docs, rows = documents(spark, texts)
    asked = [(1, "The école"), (2, None), (3, ""), (4, "unknown"), (5, "zz zz ZZ q"),
             (5, "x1"), (None, "日本 n"), (6, "the " + " ".join(words))]
    items = spark.createDataFrame([(*a, "x", 1) for a in asked],
                                  "item_id long, text string, doc_id string, rank int")
    want = plain_search(rows, asked, 10)
    for size in (lexical.BLOCK_BYTES, 40):
        got = lexical.search(docs, items, block_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_bests_are_those_of_all_offers():
    rng = np.random.default_rng(2)
    bests, seen = lexical.Bests(3, 4), []
    for _ in range(60):
        docs, nulls = rng.integers(0, 1000, 9), rng.random(9) < 0.1
        scores = rng.integers(-1, 6, (9, 3))
        bests.offer(docs, nulls, scores)
        seen += [(i, -scores[r, i], nulls[r], docs[r]) for r in range(9) for i in range(3)
                 if scores[r, i] > 0]
    bests.prune()
    want = [x for k in range(3) for x in sorted(s for s in seen if s[0] == k)[:4]]
    got = sorted(zip(bests.item, -bests.score, bests.null, bests.doc))
    assert [tuple(map(int, g)) for g in got] == [tuple(map(int, w)) for w in want]


def test_search_equals_its_sql(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.op12_lexical_search(spark, DATA).toPandas()
    assert compare(got, db.execute(catalog.SEARCH_SQL).df()) == "ok"


# Periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


pattern = st.lists(st.sampled_from("abc"), min_size=1, max_size=9)
repeats = st.tuples(pattern, st.integers(1, 9)).map(lambda x: x[0] * x[1])
wordy = st.lists(repeats, max_size=6).map(lambda parts: [w for p in parts for w in p][:150])


@settings(max_examples=400, deadline=None)
@given(st.lists(wordy, min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    coded = [[w.encode() for w in t] for t in texts]
    got = [sorted(map(tuple, runs)) for runs in periodic.texts_runs(coded)]
    assert got == [plain_runs(t) for t in texts]


def test_wavelet_tree_equals_sorting():
    rng = np.random.default_rng(1)
    values = rng.permutation(100)
    tree = periodic.WaveletTree(values)
    low = rng.integers(0, 100, 200)
    high = np.minimum(100, low + rng.integers(1, 60, 200))
    limit = rng.integers(0, 101, 200)
    below = [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, limit)]
    assert tree.below(low, high, limit).tolist() == below
    k = rng.integers(0, high - low)
    assert tree.quantile(low, high, k).tolist() == [
        sorted(values[a:b])[j] for a, b, j in zip(low, high, k)]


def test_long_periods_and_many_repeats():
    unit = [b"%d" % i for i in range(3000)]
    for words in (unit * 4 + unit[:7], [b"a"] * 50_000, [b"x"] + unit[:99] * 60 + [b"y"]):
        runs = periodic.texts_runs([words])[0]
        assert [(r.start, r.length, r.period) for r in runs] == plain_runs_of(words)


def plain_runs_of(words):
    """One run each, by construction."""
    if words[0] == b"x":
        return [(1, len(words) - 2, 99)]
    return [(0, len(words), 1 if words[0] == b"a" else 3000)]


def test_runs_of_edge_rows(spark):
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b " * 9 + "c",
             "x y " * 8, "é è é è é è é è é", "w1 w2 w3 w4 w5 " * 2000, "a b c d " * 3 + "a b c"]
    docs, rows = documents(spark, texts)
    for size in (periodic.WORDS, 5):
        for repeated in (True, False):
            got = periodic.find_runs(docs, repeated=repeated, batch_words=size).collect()
            if repeated:
                want = sorted((plain_row(d, t) for d, t in rows), key=str)
                assert sorted(map(tuple, got), key=str) == want
            assert len(got) == len(rows)
    assert periodic.find_runs(docs.limit(0), repeated=True).count() == 0


def test_registered_runs_equal_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.op13_periodic_runs(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        (plain_row(r.doc_id, r.text) for r in rows), key=str)


# Repaired cases of earlier operators


def test_repeated_words_are_exact_when_all_window_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(quality, "window_hash", lambda *words: F.lit(7).cast("long"))
    texts = ["x y z filler one two three a b c more words x y z", "a b c a b c a b", "u v w", ""]
    rows = quality.quality_counts(
        spark.createDataFrame([(t,) for t in texts], "text string"), "text", (F.col("text"),))
    got = {r.carry_0: r.n_repeat_words for r in rows.collect()}
    for text in texts:
        words = text.split()
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        want = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert got[text] == len(want)


def test_short_lines_that_differ_in_their_last_character_are_found(spark):
    rng = random.Random(6)
    for size in (14, 16, 20, 24, 30, 40):
        lines = ["".join(rng.choice("aeioutnrs ") for _ in range(size - 2)) + "ab"
                 for _ in range(150)]
        rows = [(i, x) for k, line in enumerate(lines)
                for i, x in ((2 * k, line), (2 * k + 1, line[:-1] + "c"))]
        found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        gone = sum(r.n_removed for r in found.select("n_removed").collect())
        assert gone >= 0.95 * len(lines)


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        store.shared_folder(Session())
