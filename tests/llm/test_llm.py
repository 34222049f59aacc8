"""The operators against brute force, exact round trips and held-out accuracy."""

import base64
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check_queries import TABLES, compare
from culturelens.llm import (
    ann, bpe, catalog, chat, components, langid, line_dedup, packing, quality, sharding, simhash,
    token_counts,
)
from culturelens.sources.session import COMPILED, METHOD_LIMIT

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(catalog.RANKS)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string,"
          " n int, component long, words string, place int")


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 9)))
                    for _ in range(words))


def edge_rows():
    base = prose(1, 80)
    near = base.replace(base.split()[40], "changed", 1)
    texts = [None, "", "   \n\t", "one", "two words", base, base, near, base.upper(),
             "the same line of words here\nthe same line of words here\nother", "#$% " * 60,
             "a b c " * 40, "日本語" * 500, "école 'tis  double  space \n end ", prose(3, 30_000)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", 0, "x", 1, 2, "w", 3)
            for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_print(text, width):
    words = (text or "").encode().lower().split()
    runs = ([b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
            if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    return sum(1 << b for b, x in enumerate(bits) if x)


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_bit_slices_find_all_close_pairs():
    rng = np.random.default_rng(0)
    fps = [int(b) ^ (1 << int(rng.integers(64))) ** int(rng.integers(2)) ^ sum(
        1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))
        for b in rng.integers(0, 2**63, 30) for _ in range(6)]
    fps = np.unique(np.array(fps, "<u8"))
    for radius in (0, 1, 2, 3):
        i, j = simhash.close_pairs(fps, radius)
        want = {(a, b) for a, b in itertools.combinations(range(len(fps)), 2)
                if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_large_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(2)
    fps = {0x1234 << 40}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, block=8)
    got = {r.node: r.component for r in
           components.connected_components(edges, "a", "b").collect()}
    want = groups(signed, [(a, b) for a, b in itertools.combinations(signed, 2)
                           if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def test_simhash_matches_brute_force(spark, edge, none):
    rows = [(r[0], r[1]) for r in edge_rows()]
    prints = [shingle_print(t, 3) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = groups(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    want = sorted(((doc is None, doc or 0), prints[i], least[root[i]])
                  for i, (doc, _) in enumerate(rows))
    found = simhash.near_duplicates(edge).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fp % 2**64, r.component_id) for r in found)
    assert got == want
    kept = sorted(r.doc_id for r in simhash.keep_one(edge).collect())
    assert kept == sorted(set(least.values()))
    assert simhash.keep_one(edge).columns == edge.columns
    assert simhash.near_duplicates(none).count() == 0


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
             (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
             (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"),
             (4, 0, "user", "other"), (4, 0, "user", "other"), (5, 0, None, None),
             (None, None, "user", "lost"), (6, 0, "user", "h"), (6, 1, "user", "i")]
    turns += [(7, k, "user", f"t{k}") for k in range(600)]
    turns += [(8, k, "user", f"t{k}") for k in range(300)]
    rows = [(*t, "clash") for t in turns]
    got = {(r.conv_id, r.part): r for r in chat.format_chats(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, block string")).collect()}
    assert {k[0] for k in got} == {2, 4, 5, None, 6, 7}
    assert got[2, 0].n_copies == 2 and got[2, 0].n_turns == 3
    assert got[2, 0].text == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
                              "<|im_start|>user\nmore<|im_end|>\n")
    assert got[5, 0].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[7, 0].n_parts == 3 and [got[7, p].text.count("im_start") for p in range(3)] == [
        256, 256, 88]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0


def test_chat_cuts_blocks_by_rows(spark, monkeypatch):
    """Lost ids, null turns and one repeated turn number: no block holds over ROWS turns."""
    monkeypatch.setattr(chat, "ROWS", 50)
    lost = [(None, k % 8, "user", f"lost {k:04d}") for k in range(700)]
    null_turns = [(1, None, "user", f"null {k:04d}") for k in range(300)]
    again = [(2, 3, "user", f"again {k:04d}") for k in range(300)] + [(2, 4, "user", "end")]
    copy = [(3, *t[1:]) for t in again] + [(4, *t[1:]) for t in again[:200]]
    repeated = [(5, 0, "user", "same")] * 200
    turns = lost + null_turns + again + copy + repeated
    got = {}
    for r in chat.format_chats(spark.createDataFrame(
            turns, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, {})[r.part] = r
    assert set(got) == {None, 1, 2, 5}
    for conv, rows in ((None, lost), (1, null_turns), (2, again), (5, repeated[:1])):
        parts = [got[conv][p] for p in range(len(got[conv]))]
        assert {(r.n_parts, r.n_turns) for r in parts} == {(len(parts), len(rows))}
        assert all(r.text.count("<|im_start|>") <= 50 for r in parts)
        assert "".join(r.text for r in parts) == "".join(
            f"<|im_start|>user\n{t[3]}<|im_end|>\n" for t in sorted(rows, key=lambda t: t[1:]))
    assert got[2][0].n_copies == 2


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 8)).astype(np.float32)
    vectors[40:60] = vectors[40]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(500, None, "x"), (550, [0.0] * 8, "x"), (600, [float("nan")] * 8, "x"),
             (None, rows[0][1], "x"), (650, [None] + [1.0] * 7, "x"), (700, [1.0], "x"), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann.nearest(frame).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact = vectors.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    assert set(got) == set(range(0, 300, 50))
    for q, found in got.items():
        score = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert [found[k][0] for k in range(1, 6)] == want
        assert np.allclose([found[k][1] for k in range(1, 6)], score[want], atol=1e-9)
    assert ann.nearest(frame.where("vec_id in (0, 1, 2)")).count() == 2
    assert ann.nearest(frame.where("false")).count() == 0


def test_nearest_keeps_recall_where_leaves_are_many(spark, monkeypatch):
    """Over 4,000 leaves in all: a hundred of them hold few of the neighbours."""
    monkeypatch.setattr(ann, "LEAF", 8)
    vectors = np.random.default_rng(6).standard_normal((4000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(frame).collect()}
    want = {(q, int(i)) for q in range(0, 4000, 50)
            for i in np.argsort(-(unit @ unit[q]), kind="stable")[1:6]}
    assert len(got) == len(want) == 400 and len(got & want) >= 0.9 * len(want)
    fixed = {(r.query_id, r.vec_id) for r in ann.nearest(frame, probes=100).collect()}
    assert len(fixed & want) < 0.9 * len(want)


def test_leaves_come_from_one_queue_in_order_of_their_margins():
    """Against every leaf priced by itself: the greatest margin on the wrong side of its path."""
    rng = np.random.default_rng(3)
    points = rng.standard_normal((400, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for depth in (0, 1, 4):
        forest = ann.grow(points, 3, depth)
        for q in rng.standard_normal((20, 6)):
            margins = forest.directions @ (q / np.linalg.norm(q)) - forest.thresholds
            price = {}
            for tree, leaf in itertools.product(range(3), range(1 << depth)):
                node, worst = leaf + (1 << depth) - 1, 0.0
                while node:
                    above, is_right = (node - 1) // 2, node % 2 == 0
                    margin = margins[tree, above]
                    worst = max(worst, abs(margin) if is_right != (margin > 0) else 0.0)
                    node = above
                price[(tree << depth) + leaf] = worst
            order = list(ann.best_first(forest, margins))
            assert sorted(order) == sorted(price)
            assert [price[x] for x in order] == sorted(price.values())
            wanted = rng.integers(0, 1 << depth, (5, 3)) + (np.arange(3) << depth)
            assert ann.places_met(iter(order), wanted) == sorted(
                min(order.index(x) for x in row) for row in wanted.tolist())


def test_language_model_matches_a_plain_fit(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    words, grams = {}, {}
    for _, text, lang in rows:
        for word in regex.findall(r"\p{L}+", (text or "").lower()) if lang else ():
            words.setdefault(lang, Counter())[word] += 1
            marked = f"^{word}$"
            grams.setdefault(lang, Counter()).update(
                marked[i:i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1))
    assert max(map(len, words.values())) < langid.WORDS
    assert max(Counter(map(len, g)).most_common(1)[0][1] for g in grams.values()) < langid.GRAMS
    model = langid.fit(docs, "doc_id", "text", "lang")
    langs = sorted(words)
    total = {lang: sum(words[lang].values()) for lang in langs}
    assert model.languages == langs

    def logs(counts, key):
        return [math.log((counts[lang][key] or langid.UNSEEN) / total[lang]) for lang in langs]

    known, parts = set().union(*words.values()), set().union(*grams.values())
    assert model.words.keys() == known and model.grams.keys() == parts
    for counts, index, table in ((words, model.words, model.word_scores),
                                 (grams, model.grams, model.gram_scores)):
        assert all(np.allclose(table[i], logs(counts, key)) for key, i in index.items())

    def score(word):
        if word in known:
            return logs(words, word)
        marked = f"^{word}$"
        for n in (4, 3, 2, 1):
            cut = [marked[i:i + n] for i in range(len(marked) - n + 1)]
            cut = [logs(grams, x) for x in cut if x in parts]
            if cut:
                return np.mean(cut, axis=0)
        return np.zeros(len(langs))

    asked = [(i, f"{(t or '')[:300]} unzweifelhaft quixotry zzyzx", None) for i, t, _ in rows[:60]]
    frame = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in langid.predict(frame, model).collect()}
    for i, text, _ in asked:
        mean = np.mean([score(w) for w in regex.findall(r"\p{L}+", text.lower())], axis=0)
        best = int(np.argmax(mean))
        assert got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(1 / np.exp(mean - mean[best]).sum())


def test_language_id_on_held_out_documents(spark, edge, none):
    found = catalog.op4_language_id(spark, DATA).toPandas().merge(
        spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas())
    tested = found[found.held_out]
    assert (tested.lang == tested.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    model = langid.fit(edge, "doc_id", "text", "lang")
    rows = langid.predict(edge, model).collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.row.text or ""))
               for r in rows) and len(rows) == edge.count()
    assert langid.predict(edge, langid.fit(none, "doc_id", "text", "lang")).where(
        "lang_pred = 'und' and score = 0").count() == edge.count()


def test_words_back_off_to_shorter_grams():
    model = langid.Model(["a", "b"], {"sun": 0}, {"^so": 0, "n$": 1},
                         np.array([[-1.0, -5.0]]), np.array([[-2.0, -3.0], [-4.0, -1.0]]))
    assert model.scores(["sun", "soon", "in", "x"]).tolist() == [
        [-1, -5], [-2, -3], [-4, -1], [0, 0]]


def test_quality_counts_match_brute_force(edge, none):
    got = quality.judged(edge, "text", (F.col("doc_id"),)).collect()
    by_text = {r[0]: r[1] or "" for r in edge_rows()}
    for r in got:
        text = by_text[r.carry_0]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = list(zip(words, words[1:], words[2:]))
        places = {}
        for i, w in enumerate(windows):
            places.setdefault(w, []).append(i)
        covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert len(got) == edge.count() and quality.judged(none).count() == 0
    good = quality.keep_good(edge)
    assert good.columns == edge.columns and good.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("name", sorted(catalog.llm_oracles()))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.llm_queries()[name](spark, DATA).toPandas()
    assert compare(got, db.execute(catalog.llm_oracles()[name]).df()) == "ok"


def best_count(word, scores):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + scores[word[s:end]], best[s][1] - 1)
                        for s in range(end) if word[s:end] in scores))
    return -best[-1][1]


def test_token_counts_match_brute_force(edge, none):
    scores, _ = token_counts.unigram_scores(RANKS)
    pattern = token_counts.Cutter(public_tokenizers.PATTERN).pattern
    want = {}
    for doc, text, *_ in edge_rows():
        pieces = pattern.findall((text or "")[:4000])
        want[doc] = sum(best_count(p.encode(), scores) for p in pieces)
    cut = edge.withColumn("text", F.substring("text", 1, 4000))
    got = token_counts.count_tokens(cut, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == edge.count()
    assert token_counts.count_tokens(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokens_are_looked_for_only_as_far_as_bytes_end_one():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    scores = {bytes([x]): -3 for x in range(256)} | {b"ab": -4, b"q" * 40: -5}
    words = [b"xyzab" * 8, b"q" * 40, b"q" * 39, b"aab"]
    found = token_counts.trie_counts(
        words, scores, 40, Counted(token_counts.all_endings(scores)))
    assert found == {w: best_count(w, scores) for w in words}
    assert Counted.asked < 40 * 41 // 2 + 4 * 40    # the run of q; elsewhere two or three a byte


def test_token_counts_of_whole_texts_with_a_small_cache(edge, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 5)
    monkeypatch.setattr(token_counts, "TEXTS", 2)
    scores, _ = token_counts.unigram_scores(RANKS)
    pattern = token_counts.Cutter(public_tokenizers.PATTERN).pattern
    want, known = [], {}
    for doc, text, *_ in edge_rows():
        pieces = pattern.findall(text or "")
        for p in set(pieces) - known.keys():
            known[p] = best_count(p.encode(), scores)
        want.append((-1 if doc is None else doc, len(pieces), sum(known[p] for p in pieces)))
    got = token_counts.count_tokens(edge.coalesce(1), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_pieces, r.n_tokens)
                  for r in got) == sorted(want)


def test_shards_are_even_and_slots_gapless(spark, edge, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    copies = docs.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).select(
        (F.col("copy") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars")
    for frame, shards in ((docs.unionByName(copies), 7), (edge, 3)):
        rows = sharding.shard_documents(frame, shards, catalog.DIMENSIONS).toPandas()
        assert len(rows) == frame.count()
        total = rows.groupby("shard")["size"].sum()
        assert abs(total - rows["size"].sum() / shards).max() <= 3 * rows["size"].max()
        for _, part in rows.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        want = {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                for r in frame.collect() if r.doc_id is not None}
        have = rows.dropna(subset="doc_id")
        assert set(zip(have.doc_id, have["size"], have.text_crc32)) == want
    assert sharding.shard_documents(none, 4, catalog.DIMENSIONS).count() == 0


def plain_shards(rows, shards, first=0):
    """{id: shard} by a plain k-d tree over (id, size, keys): exact weighted medians."""
    if shards == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = [max(r[2][k] for r in rows) - min(r[2][k] for r in rows) for k in range(len(rows[0][2]))]
    rows = sorted(rows, key=lambda r: r[2][spread.index(max(spread))])
    want, n = sum(r[1] for r in rows) * (shards // 2) / shards, 0
    while n < len(rows) and rows[n][1] <= want:
        want -= rows[n][1]
        n += 1
    n += n < len(rows) and want > rows[n][1] / 2
    return (plain_shards(rows[:n], shards // 2, first)
            | plain_shards(rows[n:], shards - shards // 2, first + shards // 2))


def test_shards_match_a_plain_tree(spark):
    rng = random.Random(12)
    rows = [(i, prose(i, rng.choice([3, 30, 400])), rng.choice([None, "de", "en", "en", "fr"]),
             f"s{min(rng.randrange(40), 25)}") for i in range(600)]
    rows.append((600, None, "en", None))

    def unit(own, all_values):
        order = [(v is not None, v or "") for v in all_values]
        own = (own is not None, own or "")
        return (sum(v < own for v in order) + order.count(own) / 2) / len(order)

    units = {c: {v: unit(v, [r[c] for r in rows]) for v in {r[c] for r in rows}} for c in (2, 3)}

    def key(value, text):
        tie = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return (math.floor(value * ((1 << 30) - 1)) << 32) | tie >> 32

    plain = []
    for i, text, lang, source in rows:
        size = len((text or "").encode()) + 16
        plain.append((i, size, (key(math.log(size) / math.log(2) / 64, text),
                                key(units[2][lang], text), key(units[3][source], text))))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for shards in (2, 7, 40):
        got = sharding.shard_documents(frame, shards, catalog.DIMENSIONS, tolerance=0.0)
        assert {r.doc_id: r.shard for r in got.collect()} == plain_shards(plain, shards)


def test_bpe_matches_tiktoken(spark, edge, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    rng = random.Random(4)
    encode = bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)
    parts = ["the", " ", "ing", "  ", "\n", "'s", "12", ",,", " \n", "日", "é", "aaaa", "=-" * 30]
    for k in range(400):
        text = "".join(rng.choice(parts if k % 2 else "aehtonis ") for _ in range(k % 90))
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert encode.codec.decode(ids) == text.encode()
    rows = bpe.decode_ids(bpe.encode_texts(edge, RANKS, public_tokenizers.PATTERN), RANKS)
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    for r in rows.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.data) == texts[r.doc_id].encode()
    assert bpe.encode_texts(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_line_dedup_matches_brute_force(spark, none):
    lines = [prose(k, 30) for k in range(6)]
    edited = lines[0].replace(lines[0].split()[15], "edited", 1)
    texts = ["\n".join(lines[:3]), "\n".join([edited, "", lines[3]]), lines[1],
             "\n".join([lines[4], lines[4], "short", "short"]), None, "", " \n ", lines[5],
             "short"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, lines[5], "x"), (None, "short", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, gone string")

    def shingles(line):
        return set(re.findall(line_dedup.PATTERN.replace("(?s)", ""), line, re.S))

    places = sorted({((i is not None, i or 0), k, x) for i, t, _ in rows
                     for k, x in enumerate((t or "").split("\n")) if x.strip()})
    kept_lines, stays = [], set()
    for doc, k, line in places:
        own = shingles(line)
        if not any(line == x or len(own & shingles(x)) >= 0.8 * len(own | shingles(x))
                   for x in kept_lines):
            stays.add((doc, k))
        kept_lines.append(line)
    want = sorted((i is not None, i or 0, None if t is None else "\n".join(
        x for k, x in enumerate(t.split("\n"))
        if not x.strip() or ((i is not None, i or 0), k) in stays) or "") for i, t, _ in rows)
    found = line_dedup.dedup_lines(frame).collect()
    got = sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.new_text) for r in found)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert {g for g in got if g[2] is not None} == {w for w in want if w[2] is not None}
    assert {(r.row.doc_id, r.emptied) for r in found} >= {(2, True), (8, True), (7, False),
                                                          (1, False)}
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_finds_small_edits_of_ordinary_lines(spark):
    """One character or one word of lines of 8 to 30 words; a mark at the end."""
    texts, edits = [], {}
    for k, n in enumerate(range(8, 31, 2)):
        words = prose(900 + k, n).split()
        line, at = " ".join(words), n // 2
        other = [f"{line}!", " ".join([*words[:at], words[at][:-1] + "X", *words[at + 1:]])]
        if n >= 20:
            other.append(" ".join([*words[:at], "other", *words[at + 1:]]))
        for x in other:
            edits[len(texts) + 1] = n
            texts += [line, x]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {r.row.doc_id for r in found.collect() if r.emptied}
    assert len(gone & set(edits)) >= 0.9 * len(edits)


def test_line_shingles_start_at_every_character(spark):
    lines = ["abcdefg", "abcd", "a", "日本語日本語日", "𝒳𝒴𝒵 a😀é", "  x  ", "aaaaaaaaaaaa"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {r.line_id: r.set for r in
           line_dedup.shingle_sets(frame, frame.select("line_id")).collect()}
    for i, line in enumerate(lines):
        want = set(re.findall(line_dedup.PATTERN.replace("(?s)", ""), line, re.S))
        assert want == {line[k:k + 5] for k in range(max(1, len(line) - 4))}
        assert len(got[i]) == len(set(got[i])) == len(want)


def test_line_dedup_loses_no_link_of_large_buckets(spark):
    """Two chains of edits off one line, each step a link and the ends far apart."""
    words = prose(50, 60).split()
    texts = []
    for k in range(60):
        words[(k * 7) % 60] = f"edit{k:03d}"
        texts += [" ".join(words), " ".join([*words[:59], f"tail{k:03d}"])]
    rows = list(enumerate(texts + texts[:40]))
    lines = line_dedup.text_lines(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    distinct = lines.groupBy("line_id").agg(F.count("*").alias("n"))
    ids = {r.line_id: r.line for r in lines.select("line_id", "line").distinct().collect()}
    sets = {i: set(re.findall(line_dedup.PATTERN.replace("(?s)", ""), x, re.S))
            for i, x in ids.items()}
    close = [(a, b) for a, b in itertools.combinations(sets, 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(sets, close)
    found = {r.node: r.component
             for r in line_dedup.line_components(lines, distinct, 0.8).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: want[i] for i in sets}


def test_line_dedup_keeps_its_bands_compiled(spark):
    given = spark.conf.getAll.get(METHOD_LIMIT)
    try:
        spark.conf.unset(METHOD_LIMIT)
        rows = [(1, "one line of a text\nanother line"), (2, "one line of a text")]
        found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert spark.conf.get(METHOD_LIMIT) == str(COMPILED)
        assert sorted((r.row.doc_id, r.n_removed) for r in found.collect()) == [(1, 0), (2, 1)]
    finally:
        spark.conf.unset(METHOD_LIMIT) if given is None else spark.conf.set(METHOD_LIMIT, given)


def test_rarest_shingles_find_every_pair_across_components(spark):
    rng = random.Random(8)
    sets = {i: rng.sample(range(14), rng.randint(5, 12)) for i in range(60)}
    component = {i: 0 if i < 40 else i for i in sets}
    frame = spark.createDataFrame(list(sets.items()), "line_id long, set array<long>")
    members = spark.createDataFrame(list(component.items()), "line_id long, component long")
    pairs = line_dedup.across(members, frame, 0.8)
    found = {(r.a, r.b) for r in line_dedup.verified(pairs, frame, 0.8).collect()}
    assert found == {(a, b) for a, b in itertools.combinations(sets, 2)
                     if component[a] != component[b]
                     and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert len(found) > 3


def test_packing_places_every_id_once(spark, edge, none):
    path = public_tokenizers.path(catalog.WORD_BPE)
    limits = packing.Limits(tokens=256, segments=8, loss=250)
    pieces = packing.token_pieces(edge, path, 250)
    found = packing.pack(pieces, limits).toPandas()
    library = packing.WordTokenizer(path).library
    want = []
    for doc, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want += [(-1 if doc is None else doc, s, len(ids[s:s + 250]),
                  zlib.crc32(np.array(ids[s:s + 250], "<u4").tobytes()), len(ids))
                 for s in range(0, len(ids), 250)]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(want) == sorted(map(tuple, found.fillna(-1)[columns].astype(int).to_numpy()))
    for _, bin_rows in found.sort_values("offset").groupby("sequence_id"):
        ends = (bin_rows.offset + bin_rows.length).tolist()
        assert bin_rows.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 256
        assert len(bin_rows) <= 8 and bin_rows.loss.sum() <= 250
    assert packing.pack_documents(none, path).count() == 0


def test_line_dedup_pairs_every_similar_set(spark):
    """Sets that each lose some shared shingles: the pairs to verify hold every link."""
    draw = random.Random(1)
    base = [draw.getrandbits(63) - 2**62 for _ in range(40)]
    sets = {}
    for i in range(150):
        own = list(base)
        for k in draw.sample(range(40), draw.randint(0, 8)):
            own[k] = draw.getrandbits(63) if draw.random() < 0.7 else k
        sets[i] = set(own)
    frame = spark.createDataFrame([(i, list(x)) for i, x in sets.items()],
                                  "line_id long, set array<long>")
    members = frame.selectExpr("line_id", "line_id as component")
    pairs = line_dedup.across(members, frame, 0.8)
    found = {(r.a, r.b) for r in line_dedup.verified(pairs, frame, 0.8).collect()}
    assert found == {(i, j) for i in sets for j in sets
                     if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_rarest_shingles_meet_again_only_after_a_gap(spark):
    """Sets alike in long stretches, in components of which several are the largest somewhere."""
    draw = random.Random(5)
    bases = [[draw.getrandbits(63) - 2**62 for _ in range(120)] for _ in range(2)]
    sets, component = {}, {}
    for i in range(90):
        own = list(bases[i % 2]) + draw.sample(bases[1 - i % 2], 6)
        for k in draw.sample(range(120), draw.randint(0, 22)):
            own[k] = draw.getrandbits(63) if draw.random() < 0.5 else k
        sets[i], component[i] = set(own), i if i > 60 else i % 4
    frame = spark.createDataFrame([(i, list(x)) for i, x in sets.items()],
                                  "line_id long, set array<long>")
    members = spark.createDataFrame(list(component.items()), "line_id long, component long")
    pairs = line_dedup.across(members, frame, 0.8)
    found = {(r.a, r.b) for r in line_dedup.verified(pairs, frame, 0.8).collect()}
    assert found == {(a, b) for a, b in itertools.combinations(sets, 2)
                     if component[a] != component[b]
                     and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(found) > 50


def test_line_dedup_loses_no_link_of_lines_that_share_one_large_bucket(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        line = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12))
        rows += [(2 * k, line), (2 * k + 1, line[:-1] + "#")]
    monkeypatch.setattr(line_dedup, "bands", lambda signed: signed.select(
        "line_id", F.lit(1).cast("long").alias("band")).distinct())
    lines = line_dedup.text_lines(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    distinct = lines.groupBy("line_id").agg(F.count("*").alias("n"))
    found = line_dedup.line_components(lines, distinct, 0.8).groupBy("component").count()
    assert sorted(r["count"] for r in found.collect()) == [2] * 30


def test_lines_that_agree_in_enough_minima_meet_across_components(spark):
    """Every such pair, also where only one row of the square has three minima in common."""
    draw = random.Random(9)
    bases = [[draw.getrandbits(31) for _ in range(25)] for _ in range(2)]
    kept = [0, 1, 2, 5, 6, 7, 10, 11, 12, 15, 16, 20, 21]
    signs = [[x if k in kept else draw.getrandbits(31) for k, x in enumerate(bases[0])]]
    for i in range(80):
        lost = draw.sample(range(25), draw.randint(5, 14))
        signs.append([draw.getrandbits(31) if k in lost else x
                      for k, x in enumerate(bases[i % 2])])
    signs.append([x ^ 1 << 20 for x in signs[1]])
    rows = [(i, half, x) for i, x in enumerate(signs) for half in ((False, True)[i % 3 > 0:])]
    signed = spark.createDataFrame(rows, "line_id long, half boolean, signature array<int>")
    component = {i: i if i > 50 else i % 3 for i in range(len(signs))}
    members = spark.createDataFrame(list(component.items()), "line_id long, component long")
    found = [(r.a, r.b) for r in line_dedup.agreeing_across(members, signed).collect()]
    want = {(i, j) for (i, h, x), (j, g, y) in itertools.combinations(rows, 2)
            if h == g and component[i] != component[j]
            and sum(map(int.__eq__, x, y)) >= line_dedup.LEAST_AGREED}
    assert {tuple(sorted(p)) for p in found} == want and len(found) == len(want) > 50


def test_parities_drop_no_similar_pair(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(63) - 2**62 for _ in range(60)]
    sets = {i: {draw.getrandbits(63) if draw.random() < i / 300 else x for x in base}
            for i in range(60)}
    frame = spark.createDataFrame([(i, list(x)) for i, x in sets.items()],
                                  "line_id long, set array<long>")
    pairs = list(itertools.combinations(sets, 2))
    left = line_dedup.alike(spark.createDataFrame(pairs, "a long, b long"), frame, 0.8)
    found = {(r.a, r.b) for r in left.collect()}
    assert {(i, j) for i, j in pairs
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} <= found
    assert len(found) < len(pairs)


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    code = f"""
import glob, sys
sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.local.dir", {str(tmp_path)!r} + "/local")
         .config("spark.checkpoint.dir", {str(tmp_path)!r} + "/shared").getOrCreate())
from culturelens.llm.common import DROP_SHUFFLES, written
rows = written(spark.range(100000).selectExpr("id % 7777 as k").groupBy("k").count(), "counts")
left = glob.glob({str(tmp_path)!r} + "/local/**/shuffle_*.data", recursive=True)
assert rows.count() == 7777 and spark.conf.get(DROP_SHUFFLES, "false") == "false"
print("files", len(left))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                          env={**os.environ, "SPARK_LOCAL_DIRS": f"{tmp_path}/local"}, timeout=120)
    assert "files 0" in done.stdout, done.stderr[-2000:]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    def long(seed):
        return "\n".join("the of and " + prose(seed * 10 + k, 30) for k in range(3))

    texts = [long(1), long(2), long(1), "1234 5678", "word " * 100, None, "", long(3),
             long(3) + "\nan added line with the other words of it"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string,"
                          " n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(found.doc_id.unique()) == [0, 1, 7, 8]
    library = packing.WordTokenizer(public_tokenizers.path(catalog.WORD_BPE)).library
    for doc, text in ((0, texts[0]), (8, "an added line with the other words of it")):
        ids = library.encode(text, add_special_tokens=False).ids
        assert set(found[found.doc_id == doc].doc_tokens) == {len(ids) + 1}
    assert len(corpus_pipeline.STAGES) == 5
