"""Near-duplicates, decontamination and token counts against brute force, with awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from blendscope.llm import decontamination, minhash, tokencount

SCHEMA = "doc_id long, text string, key string, n_words string, row string"
LETTERS = [f"w{i}" for i in range(400)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", "n", "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(LETTERS) for _ in range(n))


def edited(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(LETTERS)
    return " ".join(words)


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts):
    sets = word_sets(texts)
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return {i: (len(sets[i]), part[i]) for i in range(len(texts))}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(12)]
    out = [edited(rng, b, k) for b in base for k in (0, 1, 3, 5, 8)]
    hot = prose(rng, 90)
    out += [hot] * 30 + [edited(rng, hot, 1) for _ in range(30)]  # one hot group of exact and near copies
    passage = prose(rng, 60)
    out += [f"{prose(rng, 60)} {passage} {prose(rng, 40)}" for _ in range(10)]  # a shared passage, no duplicates
    chain = [rng.choice(LETTERS) for _ in range(900)]
    out += [" ".join(chain[k:k + 150]) for k in range(0, 400, 12)]  # neighbours are similar, the ends share nothing
    out += [None, "", " \t\n", "Two words", "two  WORDS", "one", None, "é ü x y z q", prose(rng, 30_000), hot.upper().replace(" ", "\n")]
    rng.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(spark, texts):
    out = minhash.near_duplicates(frame(spark, texts))
    assert {"key", "n_words", "row"} <= set(out.columns)
    rows = out.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_links_across_components_of_a_bucket():
    """Candidates that no centre connects are still compared (last step)."""
    assert minhash.BANDS * minhash.ROWS * 2 == len(minhash.SLOPES)
    miss = lambda s: 1 - (1 - (1 - s ** minhash.ROWS) ** minhash.BANDS) ** 2
    assert miss(0.75) < 3e-4 and miss(0.8) < 1e-5


def test_long_texts_give_the_same_shingles_in_spans(monkeypatch):
    text = prose(random.Random(1), 3000)
    whole = set(minhash.shingles(text).tolist())
    monkeypatch.setattr(minhash, "SPAN", 200)
    monkeypatch.setattr(minhash, "POWERS", minhash.POWERS[:201])
    assert set(minhash.shingles(text).tolist()) == whole and len(whole) == len(word_sets([text])[0])
    assert len(minhash.shingles("x" * 1000 + " a b c d e f")) == 3


def test_null_ids_and_repeated_rows(spark):
    text = prose(random.Random(2), 50)
    rows = minhash.near_duplicates(frame(spark, [text, text, text, "solo text here", "solo text here", None, None], [None, 3, 3, None, None, 8, None])).collect()
    got = sorted((str(r.doc_id), str(r.component_id), r.kept, r.kept_rows) for r in rows)
    assert got == sorted([("None", "3", False, 2), ("3", "3", True, 2), ("3", "3", True, 2), ("None", "None", True, 2), ("None", "None", True, 2),
                          ("8", "8", True, 1), ("None", "None", True, 1)])
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def brute_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        for k in range(max(1, len(q) - width + 1)) if q else ():
            p = q[k:k + width]
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words,segment_words", [(500_000, 1 << 19), (60, 100)])
def test_decontamination_matches_brute_force(spark, monkeypatch, block_words, segment_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", segment_words)
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((25, 14, 10, 4, 12, 30))] + [(6, None), (7, "..."), (8, "the the the the the the the the the the the"), (2, "W1, w2-w3")]
    docs = [prose(rng, 80), None, "", "the " * 40, f"{prose(rng, 20)} {items[0][1].upper()}! {prose(rng, 5)}", items[2][1].replace(" ", ", "), items[3][1],
            " ".join(items[1][1].split()[2:13]), " ".join(items[4][1].split()[:9]), items[5][1][:-40], items[1][1], items[1][1], prose(rng, 40_000), "w1 w2 w3", "W1 w2"]
    docs += [f"{items[3][1]} {items[4][1]}"] * 8
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, phrase string")
    out = decontamination.decontaminate(frame(spark, docs), bench, 10).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(docs[r.doc_id], items), r.doc_id
        assert r.n_hit == len({i for s in r.spans for i in range(s.a, s.b)}) and r.key == "k"


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.decontaminate(frame(spark, ["a b", None]), bench).collect()] == [0, 0]
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(frame(spark, []), full).count() == 0


def test_windows_of_items_without_id(spark):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (2, "delta beta gamma"), (None, "Delta beta gamma")], "item_id long, text string")
    docs = ["alpha beta gamma x", "delta beta gamma", "beta gamma"]
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.decontaminate(frame(spark, docs), bench, 10).collect()}
    assert got == {0: (3, []), 1: (3, ["2"]), 2: (0, [])}


def test_proximity_matches(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = frame(spark, ["alpha x beta gamma", "alpha beta gamma", "alpha x x x beta gamma", "gamma", "alpha beta", "beta alpha gamma"])
    near = {r.doc_id: r.n_hit > 0 for r in decontamination.decontaminate(docs, bench, 3, slop=1).collect()}
    assert near == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}


def brute_near(text, items, width, slop):
    w, hit, found = (text or "").split(), set(), set()
    for item, t in items:
        q = t.split()
        for k in range(max(1, len(q) - width + 1)):
            p = q[k:k + width]
            for start in range(-len(p) - slop, len(w) + slop + 1):
                if all(any(0 <= x < len(w) and w[x] == term for x in range(start + j - slop, start + j + slop + 1)) for j, term in enumerate(p)):
                    hit |= {x for x in range(start, start + len(p)) if 0 <= x < len(w)}
                    found.add(str(item))
    return len(hit), sorted(found)


@pytest.mark.parametrize("slop,segment_words,block_words,index_terms", [(1, 1 << 19, 500_000, 10), (2, 40, 30, 1_000), (3, 1, 30, 2), (0, 60, 25, 2)])
def test_proximity_against_brute_force(spark, monkeypatch, slop, segment_words, block_words, index_terms):
    """Results do not depend on how documents lie in segments or phrases in blocks; matches at the edges count."""
    for name, value in (("SEGMENT_WORDS", segment_words), ("BLOCK_WORDS", block_words), ("INDEX_TERMS", index_terms)):
        monkeypatch.setattr(decontamination, name, value)
    rng = random.Random(slop)
    items = [(i, " ".join(rng.choice("abcdefghi") for _ in range(rng.randrange(1, 9)))) for i in range(6)]
    docs = [None, "", "a"] + [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 25))) for _ in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    total = 0
    for r in decontamination.decontaminate(frame(spark, docs).repartition(3), bench, 4, slop=slop).collect():
        n, found = brute_near(docs[r.doc_id], items, 4, slop)
        assert (r.n_hit, list(r["items"])) == (n, found), (docs[r.doc_id], items)
        total += n
    assert total > 5 or slop == 0


def test_token_counts_equal_the_library_and_reuse_the_cache(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["it's  THE end\r\n\n x", "a<|endoftext|>b", "", None, "ñandú über 12345 €", " x y\x1c z", "日本語 text", "  lead", "tail  ", "x" * 5000,
             prose(rng, 60_000), "Same text", "Same text", "\x00\x85é", "١٢٣ ⅷ ²"]
    cache = str(tmp_path / "cache")
    out = {r.doc_id: r.n_tokens for r in tokencount.token_counts(frame(spark, texts), path, cache).collect()}
    assert out == {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    again = tokencount.token_counts(frame(spark, [*texts, "a new one"]), path, cache)
    assert again.count() == len(texts) + 1 and spark.read.parquet(cache).count() == stored + 1
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokencount.token_counts(frame(spark, ["Same text"]), other, cache).first().n_tokens == len(Tokenizer.from_file(other).encode("Same text", add_special_tokens=False))
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert tokencount.token_counts(frame(spark, []), path, cache).count() == 0


def test_remembered_pieces_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokencount, "REMEMBERED", 50)
    monkeypatch.setattr(tokencount, "GROUP_CHARS", 100)
    counter = tokencount.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = prose(random.Random(5), 500)
    assert counter.count(text) == counter.whole([text])[0] and len(counter.seen) <= 100


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_token_counts", "op6_near_duplicates"])
def test_registered_queries_return_every_document(spark, sf, name):
    from blendscope.llm.queries import QUERIES

    out = QUERIES[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and out.count() == docs.count()
    assert out.filter(F.col("doc_id").isNull()).count() == 0
