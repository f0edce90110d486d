"""The whole pipeline beside a brute-force version, on rows of every awkward kind; and of nothing."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from juristrata.llm import minhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, _id long, key string, slot int, place string, stays boolean, score double"
WORDS = {"en": "the and with that this from have been through which", "de": "und der die nicht mit eine werden durch über auch", "fr": "les des dans avec une pour être très où mais", "es": "los las para con por está más año pero sus"}


def documents():
    r = random.Random(11)
    text = lambda code, n: " ".join(r.choice(WORDS[code].split()) + str(r.randrange(50)) for _ in range(n))
    rows = []
    for k in range(120):
        code = list(WORDS)[k % 4]
        rows.append((k, text(code, r.choice([1, 3, 12, 60])), code, "hot" if k % 3 == 0 else f"s{k % 5}" if k % 7 else None))
    base = [x for x in rows if len(x[1].split()) == 60]
    for n, (k, t, code, source) in enumerate(base[:12]):
        words = t.split()
        words[n] = "changed"
        rows += [(200 + k, " " + t.replace(" ", "  ") + "\n", code, source), (300 + k, " ".join(words), code, "hot"), (300 + k, " ".join(words), code, "hot")]
    rows += [(900, None, "en", "hot"), (901, "", None, None), (902, "12 -- 34 !?", "de", "s1"), (903, " \n\t", "fr", ""), (None, "a row that has no id at all, with words of its own", "en", "s2"), (904, text("en", 30_000), None, "s3"), (905, "日本語 テキスト", "xx", "s4")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "d", 1, "k", 2, "p", False, 0.5) for i, t, lang, s in rows], COLUMNS).repartition(3)


def by_hand(rows):
    """(doc_id, text, source) of the documents that stay."""
    rows = [(i, t, s) for i, t, _, s in rows if t and regex.search(r"\p{L}", t)]
    best = {}
    for i, t, s in rows:
        rank = (-len(t), i is not None, i or 0)
        best.setdefault(regex.sub(r"[ \t\n\x0b\x0c\r]", "", t), []).append((rank, (i, t, s)))
    rows = [min(group, key=lambda g: g[0])[1] for group in best.values()]
    sets = [set(minhash.shingles(t, 5).tolist()) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row)
    return [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    want = by_hand(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tokens = []
    for i, t, _ in want:
        ids = library.encode(t, add_special_tokens=False).ids
        tokens.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=repr) == sorted(tokens, key=repr)
    assert len(want) < len(rows) - 30 and len({(r["slot"], r["place"]) for r in got}) == len(got)
    # Inside a source, rows follow the digests of their ids.
    source = {i: s for i, _, s in want}
    order = {}
    for r in sorted(got, key=lambda r: (r["slot"], r["place"])):
        order.setdefault(source[r["doc_id"]], []).append(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest())
    assert all(o == sorted(o) for o in order.values()) and len(order) > 5


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a"), (2, "12", None, None)]])
def test_run_over_nothing(spark, tmp_path, rows):
    import corpus_pipeline as cp

    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place"]
