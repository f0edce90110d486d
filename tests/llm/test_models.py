"""Scoring, quality, language, tokens, neighbours, URLs and mixing."""

import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from juristrata.llm import bpe, hmm, language_id, mixing, neighbours, quality, url_filter

SF = os.environ.get("TEST_NEIGHBOURS_DIR", "/root/testdata/sf0.1")
EXTRA = ", learn string, h string, row string, key string, n string"


def frame(spark, rows, schema="doc_id long, text string", extra=True):
    if extra:
        return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], schema + EXTRA).repartition(3)
    return spark.createDataFrame(rows, schema).repartition(3)


# BPE

@pytest.fixture(scope="module")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


def awkward():
    r = random.Random(1)
    fixed = ["", "  ", None, "a<|endoftext|>b C", "don't I'LL we've  x y\x1cz\x85q é É Å İ Σς 123 ½ ②  ̈a", "日本語テキスト 🤗🤗 <|startoftext|><|endoftext|>", "<|endof text|>", "word " * 5000]
    mixed = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x3000), r.randrange(97, 123)])) for _ in range(r.randrange(80))) for _ in range(300)]
    return fixed + mixed + ["".join(r.choice("abcdeth in<|>'s'") for _ in range(100)) for _ in range(100)]


def test_bpe_equals_the_library(spark, word_bpe):
    texts = awkward()
    library = Tokenizer.from_file(word_bpe)
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, list(enumerate(texts))), word_bpe).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == bpe.decode(bytes(got[i]["ids"]), word_bpe)


def test_bpe_with_tiny_caches(word_bpe, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e, library = bpe.TrieEncoder(word_bpe), Tokenizer.from_file(word_bpe)
    for t in awkward()[:60]:
        assert np.frombuffer(next(iter(e.encode_batch([t])))[0], "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_bpe_of_nothing(spark, word_bpe):
    assert bpe.encode(frame(spark, [(1, "a")]).where("doc_id > 1"), word_bpe).count() == 0


# Hidden Markov model

def sum_over_paths(codes, start, move, emit):
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(codes)):
        p = start[path[0]] * emit[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= move[path[t - 1], path[t]] * emit[codes[t], path[t]]
        total += p
    return total


def counts_over_paths(codes, start, move, emit):
    k = len(start)
    first, moves, found, total = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape), sum_over_paths(codes, start, move, emit)
    for path in itertools.product(range(k), repeat=len(codes)):
        p = start[path[0]] * emit[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= move[path[t - 1], path[t]] * emit[codes[t], path[t]]
        p /= total
        first[path[0]] += p
        for t, s in enumerate(path):
            found[codes[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    return first, moves, found


def random_hmm(k=3, symbols=7):
    r = np.random.default_rng(0)
    start, move, emit = r.random(k), r.random((k, k)), r.random((symbols, k))
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def test_recursions_equal_the_sum_over_paths():
    parts, r = random_hmm(), random.Random(2)
    codes = [np.array([r.randrange(7) for _ in range(r.randrange(1, 7))], np.int32) for _ in range(30)]
    assert np.allclose(np.exp(hmm.likelihoods(codes, *parts)), [sum_over_paths(c, *parts) for c in codes])
    want = [sum(x) for x in zip(*(counts_over_paths(c, *parts) for c in codes), strict=True)]
    for got, w in zip(hmm.expectations(codes, *parts), want, strict=True):
        assert np.allclose(got, w)


def test_long_texts_go_through_in_pieces(monkeypatch):
    parts = random_hmm()
    codes = [np.random.default_rng(i).integers(0, 7, n).astype(np.int32) for i, n in enumerate((5, 100, 333, 1))]
    whole, counts = hmm.likelihoods(codes, *parts), hmm.expectations(codes, *parts)
    for steps in (1, 7, 10, 100):
        monkeypatch.setattr(hmm, "LONGEST", steps)
        assert np.allclose(hmm.likelihoods(codes, *parts), whole)
        assert all(np.allclose(got, want) for got, want in zip(hmm.expectations(codes, *parts), counts, strict=True))


@pytest.mark.parametrize("head, longest", [(0, 2), (3, 1024), (1000, 1024)])
def test_scores(spark, monkeypatch, head, longest):
    """Base scores and counts against their definition; scores against a model that is trained and applied by sums over
    all paths of states. Neither the broadcast head nor the length of pieces changes a score."""
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "LONGEST", longest)
    docs = [(i, " ".join(random.Random(i).choice(["the", "cat", "sat", "on", "mat", f"w{i % 7}"]) for _ in range(i % 7))) for i in range(60)] + [(100, None), (101, ""), (102, "Unknown WORDS the Ünknown")]
    learn = F.col("doc_id") < 50
    symbols = 4  # fewer than words, so that some share a class
    got = {r["doc_id"]: r for r in hmm.score_corpus(frame(spark, docs), learn, rounds=2, head=head, symbols=symbols).collect()}
    tokens_of = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in docs if i < 50 for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    unigram = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    symbol = lambda w: 0 if w is None else hmm.symbol_of(w, symbols)
    classes = {k: [w for w in c if w is not None and symbol(w) == k] for k in range(1, symbols + 1)}
    of_class = [unigram(None), *[sum(map(unigram, ws)) + 0.1 / symbols / (n + 0.1 * (v + 1)) for ws in classes.values()]]
    assert abs(sum(of_class) - 1) < 1e-9
    model = hmm.Model(np.array([sum(c[w] for w in ws) for ws in classes.values()], float), np.array([len(ws) for ws in classes.values()], float), c[None])
    assert np.allclose(model.unigram, of_class) and max(map(len, classes.values())) > 1
    codes = {i: np.array([symbol(w) for w in tokens_of(t)]) for i, t in docs}
    for _ in range(2):
        model.update(*[sum(x) for x in zip(*(counts_over_paths(codes[i], model.start, model.move, model.emit) for i in range(50)), strict=True)])
    for i, t in docs:
        tokens, r = tokens_of(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10(unigram(w)) for w in tokens)) < 1e-9
        p = sum_over_paths(codes[i], model.start, model.move, model.emit)
        inside = sum(math.log10(unigram(w) / of_class[symbol(w)]) for w in tokens)
        assert abs(r["score"] - (math.log10(p) + inside)) < 1e-4
    assert hmm.score_corpus(frame(spark, docs).where("doc_id > 999"), learn).count() == 0


def test_class_of_a_word_is_that_of_the_sql_function(spark):
    ws = [b"", b"a", "\u00fcber".encode(), b"w" * 100]
    rows = spark.createDataFrame([(w, k + 1) for k, w in enumerate(ws)], "word binary, n long")
    tokens, distinct = hmm.class_counts(rows, 16)
    assert [tokens[hmm.symbol_of(w, 16) - 1] for w in ws] and sum(tokens) == 10 and sum(distinct) == 4
    for k, w in enumerate(ws):
        one, _ = hmm.class_counts(rows.where(F.col("n") == k + 1), 1 << 16)
        assert one[hmm.symbol_of(w, 1 << 16) - 1] == k + 1


def test_training_helps_on_held_out_texts(spark):
    r = random.Random(5)
    langs = [[f"{p}{i}" for i in range(40)] for p in "abc"]
    docs = [(i, " ".join(r.choice(langs[i % 3]) for _ in range(40))) for i in range(300)]
    rows = [x for x in hmm.score_corpus(frame(spark, docs), F.col("doc_id") < 200).collect() if x["doc_id"] >= 200]
    assert sum(x["score"] for x in rows) > 0.85 * sum(x["base_score"] for x in rows)


# Quality and language

def test_quality_tells_held_out_texts(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["river", "meadow", "walked", "quietly", "morning", "light", "garden"]) for _ in range(80))
    bad = lambda: " ".join(r.choice(["CLICK$$", "!!!free", "###", "win|win", "$$$cash"]) for _ in range(80))
    docs = [(i, good() if i % 2 else bad()) for i in range(600)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(600)] + [(3, 1, None), (900, 1, None), (901, None, None)], "doc_id long, quality int, text string")
    model = quality.train(frame(spark, docs), labels, F.col("doc_id") % 5 != 0)
    got = {x["doc_id"]: x["score"] for x in quality.predict(frame(spark, docs), model).collect()}
    test = [i for i in range(600) if i % 5 == 0]
    assert len(got) == 602 and np.mean([(got[i] >= 0.3) == (i % 2 == 1) for i in test]) > 0.98
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none, F.lit(True))
    assert [x["score"] for x in quality.predict(docs, model).collect()] == [0.5, 0.5]


LANGS = {"en": "the and with that this from have been through", "de": "und der die nicht mit eine werden durch über", "fr": "les des dans avec une pour être très où", "es": "los las para con una por está más año", "xx": "qua zim bor tek lun dar vos"}


def test_language(spark):
    r = random.Random(7)
    codes = list(LANGS)
    docs = [(i, " ".join(r.choice(LANGS[codes[i % 5]].split()) for _ in range(25)), codes[i % 5]) for i in range(500)]
    docs += [(900, None, "en"), (901, "", "en"), (902, "12 34 -- !?", "de"), (903, "the and", None)]
    rows = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = language_id.train(rows, F.col("doc_id") % 3 != 1, per_language=40)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(rows, model).collect()}
    assert np.mean([got[i][0] == codes[i % 5] for i in range(500) if i % 3 == 1]) > 0.98
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and got[903][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_with_one_or_no_language(spark):
    one = frame(spark, [(1, "a b", "fr"), (2, "c", None), (3, "1", "fr")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(one, language_id.train(one, F.lit(True))).collect()}
    assert got == {1: "fr", 2: "fr", 3: "und"}
    assert language_id.train(one, F.lit(False)) is None
    assert {x["lang_pred"] for x in language_id.predict(one, None).collect()} == {"und"}


# Neighbours

def exact(vectors, query, k):
    q = np.array(vectors[query])
    near = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return near[:k]


def test_neighbours(spark):
    r = np.random.default_rng(8)
    centres = r.normal(0, 4, (12, 16))
    vectors = {i: (centres[i % 12] + r.normal(0, 1, 16)).astype(np.float32).astype(float).tolist() for i in range(1500)}
    vectors |= {i: vectors[0] for i in range(1500, 1900)}
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [1.0] * 3), (5005, [float("inf")] * 16), (5100, [])]
    rows = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).repartition(4)
    got = {}
    for x in neighbours.nearest(rows, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    asked = [i for i in vectors if i % 50 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        want = exact(vectors, q, 10)
        found = [(s, i) for _, s, i in sorted(got[q])]
        assert found == sorted(found) and [n for n, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((np.array(vectors[i]) - np.array(vectors[q])) ** 2).sum())) < 1e-12 for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in want})
    assert hits / (10 * len(asked)) >= 0.9
    assert [i for _, i in [(s, i) for _, s, i in sorted(got[0])]] == list(range(1500, 1510))


def test_neighbours_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 7)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    r = np.random.default_rng(9)
    vectors = {i: r.normal(0, 1, 4).tolist() for i in range(80)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {}
    for x in neighbours.nearest(rows, F.col("vec_id") % 10 == 0, k=5, mass=2.0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert all([i for _, i in sorted(got[q])] == [i for _, i in exact(vectors, q, 5)] for q in range(0, 80, 10))


def test_every_row_of_a_repeated_query_is_a_query(spark):
    """Only the own row is left out; other rows with the query's id, and copies under other ids, are candidates."""
    r = np.random.default_rng(11)
    rows = [(i, r.normal(0, 1, 4).tolist()) for i in range(40)]
    rows += [rows[0]] * 3 + [(7, rows[0][1])] + [(50 + i, r.normal(0, 1, 3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in neighbours.nearest(df, F.col("vec_id").isin(0, 60), k=10, mass=2.0).collect())
    want = []
    for at, (i, v) in enumerate(rows):
        if i in (0, 60):
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for other, (j, w) in enumerate(rows) if other != at and len(w) == len(v))
            want += [(i, n, j, round(d, 9)) for n, (d, j) in enumerate(near[:10], 1)]
    assert got == sorted(want) and sum(g[0] == 0 for g in got) == 40


def test_parts_grow_with_the_rows():
    assert [neighbours.parts_of(n, 8192) for n in (0, 1000, 50_000, 200_000, 10**6, 10**9)] == [16, 16, 16, 32, 72, 128]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_embeddings_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids, y = list(vectors), np.stack(list(vectors.values()))
    got = {}
    for x in neighbours.nearest(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((y - vectors[q]) ** 2).sum(1))
        near = [ids[i] for i in np.argsort(d, kind="stable") if ids[i] != q][:10]
        hits += len(found & set(near))
    assert set(got) == {i for i in ids if i % 100 == 0} and hits >= 9 * len(got)


def test_few_or_no_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (100, None)], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in neighbours.nearest(rows, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.nearest(rows.where("vec_id > 999"), F.col("vec_id") % 100 == 0).count() == 0


# URLs

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://a.example.com/en/1?x#y", "http://example.com/en", "http://net/es/", "x://sub.net/fr/a?b", "http://notcom", "http://a.net?x=/es/", "http://b.com#f", "http://a://b/c"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(rows, RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("example.com", "/en", "com/", "allow"), ("net", "/es/", "net/es/", "block"), ("sub.net", "/fr/a", "net/fr/", "block"), ("notcom", "", None, "allow"), ("a.net", "", None, "allow"), ("b.com", "", None, "allow"), ("a:", "//b/c", None, "allow"),
    ]
    assert url_filter.url_filter(rows.where("page_id > 99"), RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(10)
    words = ["casino", "win", "news", "shop", "blog", "free", "help", "bets"]
    rows = [(i, sorted(set(r.choices(words, k=3)))) for i in range(400)]
    labelled = [(t, ("casino" in t and "win" in t) or "bets" in t) for _, t in rows]
    mined = url_filter.mine(spark.createDataFrame(labelled, "tokens array<string>, blocked boolean"), 0.01, 0.8, 1.2)
    got = {tuple(sorted(x["tokens"])): round(x["confidence"], 9) for x in mined.collect()}
    share, want = sum(b for _, b in labelled) / 400, {}
    for k in (1, 2, 3):
        for combo in itertools.combinations(sorted(words), k):
            all_, both = sum(set(combo) <= set(t) for t, _ in labelled), sum(set(combo) <= set(t) and b for t, b in labelled)
            if both >= 4 and both / all_ >= 0.8 and both / all_ / share >= 1.2:
                want[combo] = round(both / all_, 9)
    pruned = {c: v for c, v in want.items() if not any(want.get(tuple(x for x in c if x != out), -1) >= v for out in c)}
    assert got == pruned
    pages = spark.createDataFrame(rows, "rid long, tokens array<string>")
    matched = {x["rid"] for x in url_filter.match(pages, mined, "rid").collect()}
    assert matched == {i for i, t in rows if any(set(c) <= set(t) for c in pruned)}


def test_method_judges_what_no_rule_fits(spark):
    urls = [f"http://casino-win{i}.org/x" if i % 2 else f"http://news{i}.org/y" for i in range(40)]
    rows = spark.createDataFrame([(i, u.replace("win" + str(i), "win").replace("news" + str(i), "news")) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(20)] + [(21, None)], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(rows, RULES, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(40))


def test_the_whole_filter_equals_brute_force(spark):
    """Rules first; what they decide is mined, and what they leave open is judged by the mined rules."""
    r = random.Random(14)
    urls = []
    for _ in range(300):
        tld, lang, word = r.choice(["com", "net", "org"]), r.choice(["en", "fr", "es", "de"]), r.choice(["shop", "casino", "blog"])
        urls.append(f"http://{word}.{r.choice(['example', 'other'])}.{tld}/{lang}/{r.randrange(100)}" + r.choice(["", "?ref=x", "#top"]))
    rows = spark.createDataFrame(list(enumerate([*urls, None, "none"])), "page_id long, url string").repartition(3)
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.url_filter(rows, RULES, min_support=0.05, min_confidence=0.9, min_lift=1.1).collect()}

    def judged(url):
        host, _, rest = url.partition("://")[2].partition("/")
        path, best = "/" + rest.partition("?")[0].partition("#")[0], None
        for verdict, rule in RULES:
            at, _, prefix = rule.partition("/")
            if (host == at or host.endswith("." + at)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        number = lambda w: "#" if w.isdigit() else w
        found = {"h:" + number(w) for w in host.split(".")} | {"p:" + number(w) for w in path.split("/") if w}
        return best, found | {"q:" + w for w in (["ref", "x"] if "?ref=x" in url else [])}

    parsed = {i: judged(u) for i, u in enumerate(urls)}
    known = [(b[0] == "block", t) for b, t in parsed.values() if b]
    share, surest = sum(b for b, _ in known) / len(known), {}
    for size in range(1, 8):
        for combo in {c for b, t in known if b for c in itertools.combinations(sorted(t), size)}:
            every, both = sum(set(combo) <= t for _, t in known), sum(b and set(combo) <= t for b, t in known)
            if both >= max(0.05 * len(known), 5) and both / every >= 0.9 and both / every / share >= 1.1:
                surest[combo] = both / every
    for i, (best, found) in parsed.items():
        method = "block" if any(set(c) <= found for c in surest) else "allow"
        assert got[i] == ((best[1], best[0]) if best else (None, method))
    undecided = [got[i][1] for i, (best, _) in parsed.items() if not best]
    assert got[300] == got[301] == (None, "allow") and {"block", "allow"} == set(undecided)


# Mixing

def rows_of(spark, sizes):
    docs = [(i, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, s, "x", "y") for k, (_, s) in enumerate(docs)], "doc_id long, source string, key string, slot string").repartition(3)


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}, {"a": 1, "b": 1, "c": 1, None: 1}, None])
def test_mixture_stays_within_a_block(spark, weights):
    docs = rows_of(spark, {"a": 400, "b": 300, "c": 300, None: 200})
    got = mixing.mix(docs, weights, slots=100, block_rows=2).collect()
    assert len(got) == 1200 == len({r["doc_id"] for r in got})
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["block"]), []).append(r)
    assert len({rs[0]["slot"] for rs in blocks.values()}) == len(blocks)
    for rs in blocks.values():
        assert {r["slot"] for r in rs} == {rs[0]["slot"]} and sorted(r["place"] for r in rs) == list(range(len(rs)))
        assert rs[0]["release"] <= rs[0]["slot"] < rs[0]["deadline"]
    p = {r["key"]: r["p"] for r in mixing.targets(docs, weights, slots=100).collect()}
    assert sum(p.values()) == 100
    order = sorted((rs[0]["slot"], rs[0]["source"]) for rs in blocks.values() if rs[0]["within"])
    seen = Counter()
    for t, (slot, source) in enumerate(order, 1):
        assert slot == t - 1
        seen[source] += 1
        assert all(abs(seen[None if k == "null" else k[1:]] - t * n / 100) < 1 for k, n in p.items())


def test_mixing_many_ranges_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    docs = rows_of(spark, {"a": 900, "b": 30})
    few = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10**6)
    assert few == {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs).collect()}


def test_mixing_nothing_and_too_many(spark):
    docs = rows_of(spark, {"a": 3})
    assert mixing.mix(docs.where("doc_id > 9")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(rows_of(spark, {f"s{i}": 1 for i in range(12)}), slots=10).count()


def test_mixture_order_keeps_rows_and_columns(spark):
    docs = rows_of(spark, {"a": 100, "b": 10})
    got = mixing.in_mixture_order(docs, power=0.0)
    assert got.columns == docs.columns
    rows = [r["source"] for r in got.collect()]
    assert Counter(rows) == {"a": 100, "b": 10} and abs(rows[:16].count("a") - 8) <= 8
