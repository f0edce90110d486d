"""Near-duplicates, lines and exact copies against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from juristrata.llm import components, exact_dedup, line_dedup, minhash
from juristrata.llm.common import Bitmap, Scratch, filter_words

TEXT = "doc_id long, text string, lang string, _id string, digest string"


def frame(spark, docs, parts=3):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], TEXT).repartition(parts)


def sets_of(docs, size):
    return [(i, frozenset(minhash.shingles(t, size).tolist())) for i, t in docs]


def classes(docs, size, num, den):
    """component_id of each row by comparing all pairs."""
    sets = sets_of(docs, size)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(sets[k][0])
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((sets[k][0], len(sets[k][1]), least[find(k)] if sets[k][1] else sets[k][0]) for k in range(len(sets))), key=repr)


def family(r, base, members, share, start):
    out = []
    for m in range(members):
        w = list(base)
        for _ in range(max(1, int(len(w) * r.choice(share)))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        if r.random() < 0.2:
            w = w[: int(len(w) * r.uniform(0.7, 1))]
        out.append((start + m, " ".join(w)))
    return out


@pytest.mark.parametrize("size, seed", [(4, 1), (5, 2)])
def test_near_dedup_equals_all_pairs(spark, size, seed):
    r = random.Random(seed)
    docs = []
    for f in range(4):
        base = [f"w{r.randrange(3000)}" for _ in range((6, 40, 120, 250)[f])]
        docs += family(r, base, 30, [0.01, 0.02, 0.03, 0.04, 0.06], f * 100)
    docs += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two"), (5004, "ONE two"), (5005, "one two three"), (7, docs[2][1]), (7, docs[2][1]), (None, docs[3][1]), (9000, "Ä b c d e f"), (9001, "ä b c d e f")]
    got = minhash.near_dedup(frame(spark, docs), size, (80, 100)).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == classes(docs, size, 80, 100)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert sum(x["first_row"] for x in got) == len({x["component_id"] for x in got})


def test_near_dedup_of_a_hot_group(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    docs = [(i, "the same words over and over again in all of these") for i in range(200)] + family(r, base, 150, [0.005], 1000)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_dedup(frame(spark, docs), 5).collect()}
    assert {got[i] for i in range(200)} == {0}
    assert sorted(((i, len(s), got[i]) for i, s in sets_of(docs, 5)), key=repr) == classes(docs, 5, 80, 100)


def test_family_just_below_the_threshold_makes_no_rows(spark, monkeypatch):
    """Copies of one text, each with its own changes: near its threshold to one another, and few linked. Tasks compare
    them in parts and give fewer links than there are members, never pairs."""
    monkeypatch.setattr(minhash, "PART_ROWS", 40)
    r = random.Random(12)
    base = [f"w{r.randrange(3000)}" for _ in range(150)]
    docs = []
    for m in range(200):
        w = list(base)
        for _ in range(2 + m % 6):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((m, " ".join(w)))
    given, inside = [], minhash.links_inside

    def watched(open_rows, *more):
        links = inside(open_rows, *more)
        parts = open_rows.groupBy("key").count().selectExpr("sum(count * ceil(count / 40)) AS n").first()["n"]
        given.append((links.count(), parts, open_rows.select("node").distinct().count()))
        return links

    monkeypatch.setattr(minhash, "links_inside", watched)
    got = minhash.near_dedup(frame(spark, docs), 5).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == classes(docs, 5, 80, 100)
    (links, most, members), = given
    assert members > 50 and links < min(most, 4 * members)


def test_similar_equals_plain_sets():
    r = random.Random(13)
    sets = [np.unique(np.array([r.randrange(400 + 4000 * (k % 2)) for _ in range(r.choice([1, 30, 300]))], np.uint64)) for k in range(40)]
    sets += [np.append(s[:-1], np.uint64(10**6 + k)) for k, s in enumerate(sets)]
    i, j = np.triu_indices(len(sets), 1)
    got = {p for a, b in minhash.similar(sets, [(i, j)], (80, 100)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    plain = [set(s.tolist()) for s in sets]
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])} and got


def test_near_dedup_of_nothing_and_of_a_long_text(spark):
    assert minhash.near_dedup(frame(spark, [(1, "a")]).where("doc_id > 1")).count() == 0
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_dedup(frame(spark, [(1, long), (2, long + " end"), (3, "other words than those of the long one")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_keep_one_of_each(spark):
    docs = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "q r s t u v"), (3, "q r s t u v"), (4, None), (5, "")]
    got = minhash.keep_one_of_each(frame(spark, docs))
    assert got.columns == ["doc_id", "text", "lang", "_id", "digest"]
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(51)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


COPIES = [(3, "a b"), (1, "ab"), (2, " a\tb "), (9, "a  b "), (4, None), (5, ""), (6, " \n"), (7, "A b"), (7, "A b"), (None, "zz"), (8, "zz"), (10, "x" * 100_000), (11, "x" * 100_000)]


def brute_copies(docs):
    key = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in docs:
        groups.setdefault(key(t), []).append((i, t or ""))
    out = []
    for k, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), r[0] is not None, r[0] or 0))
        out += [(i, best[0], len(rows), hashlib.sha256(k.encode()).hexdigest()) for i, _ in rows]
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark, COPIES)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got), key=repr) == brute_copies(COPIES)
    assert sum(r["kept"] for r in got) == len({r["digest"] for r in got})
    assert exact_dedup.exact_dedup(frame(spark, COPIES).where("doc_id > 99")).count() == 0


def test_exact_dedup_survives_colliding_digests(spark):
    """A digest with four values: the byte verification must split what it throws together."""
    weak = lambda norm: F.pmod(F.length(norm), F.lit(4)).cast("string")
    strong = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, COPIES)).collect() if r["doc_id"] != 7}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, COPIES), digest=weak).collect() if r["doc_id"] != 7}
    assert got == strong


def test_keep_first_copies(spark):
    got = exact_dedup.keep_first_copies(frame(spark, COPIES))
    assert got.columns == ["doc_id", "text", "lang", "_id", "digest"]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([2, 6, 7, None, 10], key=repr)


def test_filters_of_runs_are_probed_and_levels_compact(spark, monkeypatch):
    """Only entries whose bit another entry set are merged by a shuffle; runs become fewer level by level."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"own {i}" if i % 10 else f"shared {i % 30}") for i in range(300)], "doc_id long, text string").repartition(7)
    scratch = Scratch(spark)
    runs = exact_dedup.flush(docs, scratch)
    assert {r["run"] for r in runs.select("run").distinct().collect()} == set(range(7))
    entries = runs.select("digest", F.struct((-F.col("n_chars")).alias("shorter"), "doc_id", "rid").alias("best"), F.lit(1).cast("long").alias("size"), "run")
    to = entries.withColumn("to", F.expr("run div 2").cast("int"))
    words = filter_words(300)
    bits = exact_dedup.meeting_bits(exact_dedup.run_filters(to, words))
    alone, hits = Bitmap.of(words, bits).split(to, F.xxhash64("digest", "to"))
    twice = {(r["digest"], r["to"]) for r in to.groupBy("digest", "to").count().where("count > 1").collect()}
    met = {(r["digest"], r["to"]) for r in hits.collect()}
    assert twice and twice <= met and len(met - twice) < 30 and not twice & {(r["digest"], r["to"]) for r in alone.collect()}
    level = exact_dedup.compact(entries, scratch, 300)
    assert {r["run"] for r in level.select("run").distinct().collect()} == {0, 1, 2, 3}
    assert level.groupBy("run", "digest").count().where("count > 1").count() == 0 and level.agg(F.sum("size")).first()[0] == 300
    last = exact_dedup.compacted(runs, scratch)
    assert last.count() == 273 == last.select("digest").distinct().count()
    assert sorted(r["keep_id"] for r in last.where("group_size = 10").collect()) == [0, 10, 20]


def test_filters_of_one_word_lose_no_copy(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_words", lambda n: 1)
    got = exact_dedup.exact_dedup(frame(spark, COPIES)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got), key=repr) == brute_copies(COPIES)


LINES = [(i, f"Header\n own line {i}\n\theader \nseldom{i % 5}\n\n" + "x" * (i % 3)) for i in range(20)] + [(50, None), (51, ""), (52, "HEADER"), (52, "HEADER"), (53, "no\nnewline at end\n"), (54, "a\r\n" * 3), (55, "line " * 20_000)]


def brute_lines(docs, least, min_chars=1):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for _, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < least]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_line_dedup(spark, bound):
    """Both ways of dropping: by broadcast, and beyond its bound by join."""
    for least, chars in ((10, 1), (4, 3), (2, 1)):
        got = line_dedup.line_dedup(frame(spark, LINES), least, chars, broadcast_lines=bound).collect()
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == brute_lines(LINES, least, chars)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_line_dedup_can_keep_the_first_place(spark, bound):
    docs = [(2, "a\nb"), (1, "x\na\na"), (3, "b")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, docs), 2, keep_first=True, broadcast_lines=bound).collect()}
    assert got == {1: "x\na", 2: "b", 3: ""}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(frame(spark, LINES).where("doc_id > 99")).count() == 0


def test_full_filters_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BITS", 8 * line_dedup.BLOCK_BYTES)
    docs = [(i, "\n".join(f"l{(i * 37 + j) % 4000}" for j in range(300))) for i in range(60)]
    got = line_dedup.line_dedup(frame(spark, docs), 3).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == brute_lines(docs, 3)
