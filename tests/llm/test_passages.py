"""Filter audit, periodic runs and repeated passages against brute force, with awkward rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blendscope.llm import audit, runs, substring, text_queries, wordblocks

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def words_of(text):
    return SPLIT.findall(text or "")


def some_texts(rng, n):
    """Texts of a few letters with planted repetitions, blanks and control characters."""
    out = [None, "", " \n\t", "a", " a\x0bb\x1c c d  e\x0c", "é " * 40, "x" * 70_000 + " y" * 9]
    while len(out) < n:
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 6, 8])]
        w = [rng.choice(letters) for _ in range(rng.randrange(1, 110))]
        if rng.random() < 0.6:
            period = rng.randrange(1, 20)
            for t in range(rng.randrange(len(w)) + period, len(w)):
                w[t] = w[t - period]
        if rng.random() < 0.3:
            w *= rng.randrange(1, 5)
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "z"
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                run = w[i:i + length]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_words_and_blocks():
    texts = some_texts(random.Random(1), 60)
    column = pa.array(texts, pa.string())
    cut = list(wordblocks.blocks(column, 500))
    assert len(cut) > 5 and [i for part in cut for i in range(part.start, part.stop)] == list(range(len(texts)))
    words, bounds = wordblocks.split(column)
    assert [words[a:b].to_pylist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())] == [words_of(t) for t in texts]
    assert wordblocks.join(words, bounds).to_pylist() == [" ".join(words_of(t)) for t in texts]
    grams = wordblocks.Grams(wordblocks.word_hashes(words.dictionary_encode()))
    listed = words.to_pylist()
    for n in (1, 2, 3, 5, 8, 20):
        seen = {}
        for i, h in enumerate(grams.of(n).tolist()):
            assert seen.setdefault(tuple(listed[i:i + n]), h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("least,exponent", [(6, 4), (3, 3), (20, 5)])
def test_runs_against_brute_force(spark, least, exponent):
    texts = some_texts(random.Random(least), 260)
    docs = spark.createDataFrame([(i, t, "r", "c") for i, t in enumerate(texts)], "doc_id long, text string, runs string, Collapsed string").repartition(3)
    rows = runs.collapse_runs(docs, least=least, exponent=exponent).collect()
    assert len(rows) == len(texts)
    total = 0
    for r in rows:
        w = words_of(texts[r["doc_id"]])
        found = brute_runs(w, least, exponent)
        total += len(found)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == found
        assert r["collapsed"] == collapsed(w, found) and r["n_words"] == len(w)
    assert total > 30


def test_runs_of_long_texts_and_none(spark):
    block = " ".join(f"w{i}" for i in range(7_001))
    texts = ["a " * 50_000, " ".join([block] * 5), " ".join(f"u{i}" for i in range(60_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.collapse_runs(docs).collect()}
    assert got == {0: [(0, 50_000, 1)], 1: [(0, 35_005, 7_001)], 2: []}
    assert runs.collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.collapse_runs(docs, exponent=2)


def test_planted_blocks(spark):
    import zlib

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40))) for i in range(400)} | {-1: None}
    docs = spark.createDataFrame(list(texts.items()) + [(None, "x y z")], "doc_id long, text string")
    for r in text_queries.planted(docs).collect():
        if r["doc_id"] is None:
            assert r["text"] == "x y z"
            continue
        w = words_of(texts[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            assert words_of(r["text"]) == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        else:
            assert r["text"] == texts[r["doc_id"]]


def brute_repeats(rows, width):
    split = [(LAST if i is None else i, words_of(t)) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            s = tuple(w[k:k + width])
            first[s] = min(first.get(s, (i, k)), (i, k))
    for i, w in split:
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < (i, k) for j in range(k, k + width)}
        yield len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)


def passages(rng, n):
    common = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = [(None, None), (3, None), (4, ""), (5, " \n\t"), (6, "word " * 3_000)]
    for i in range(n):
        w, size = [], rng.randrange(1, 150)
        while len(w) < size:
            w += rng.choice(common) if rng.random() < 0.5 else [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 30))]
        rows.append((rng.choice([None, 7, i, i, i, i, i]), rng.choice([" ", "\n", "  "]).join(w)))
    return rows + rows[20:40]  # repeated rows


@pytest.mark.parametrize("width,partitions,words", [(20, 5, 1 << 20), (20, 1, 64), (6, 3, 200)])
def test_repeats_against_brute_force(spark, monkeypatch, width, partitions, words):
    rows = passages(random.Random(width + partitions), 110)
    monkeypatch.setattr(substring, "BUCKET_WORDS", words)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, Kept_Text string, key int").repartition(partitions)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["n_words"], r["n_removed"], r["kept_text"])
                 for r in substring.remove_repeats(docs, width=width).collect())
    assert got == sorted((-1 if i is None else i, t or "", *b) for (i, t), b in zip(rows, brute_repeats(rows, width), strict=True))
    assert sum(g[3] for g in got) > 1_000
    assert substring.remove_repeats(docs.limit(0)).collect() == []


def test_frequent_grams_rank_last(spark, monkeypatch):
    """A passage inside many different texts: its surroundings spread over as many keys as there are texts."""
    monkeypatch.setattr(substring, "OFTEN", 16)
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefghij") for _ in range(40))
    other = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"{o} {passage} {p}") for i, (o, p) in enumerate(zip(other, reversed(other)))], "id long, text string")
    keyed = docs.withColumn("content", F.lit(0).cast("long")).coalesce(2)
    late, codes = substring.frequent(keyed, substring.GRAM)
    w = passage.split()
    assert len(late) == len({tuple(w[i:i + substring.GRAM]) for i in range(41 - substring.GRAM)}) and set(codes) == set(w)

    def largest(late):
        return substring.pack(keyed, 20, substring.GRAM, late, codes).filter("packed is not null").groupBy("key").count().agg(F.max("count")).first()[0]

    assert largest(late) <= 4 < 40 < largest(np.zeros(0, np.uint64))


def test_codes_tell_words_apart():
    texts = ["the cat the rare the", "rare", "the the", "é rare odd é"]
    block = substring.Block(pa.array(texts), 1)
    codes = {"the": 1, "é": 2, "cat": substring.CODES}
    a, z = block.bounds[[0, 1, 3, 0]], block.bounds[[1, 2, 4, 4]]
    packed, rare = substring.coded(block, codes, a, z)
    assert rare.to_pylist() == ["rare", "rare", "rare odd", "rare rare rare odd"]
    number, bounds = substring.decoded(packed, rare)
    words = [w for i, j in zip(a.tolist(), z.tolist()) for w in block.words[i:j].to_pylist()]
    assert bounds.tolist() == np.concatenate([[0], np.cumsum(z - a)]).tolist()
    assert len(set(zip(words, number.tolist()))) == len(set(words)) == len(set(number.tolist()))


def test_windows_of_one_hash_are_told_apart():
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    at = np.array([0, 3, 6])
    same = np.zeros(3, np.uint64)
    assert substring.repeated(words, at, same, np.array([1, 1, 1]), at, 3).tolist() == [False, False, True]


def brute_audit(docs, labels):
    fails = {}
    for n, (i, text, _) in enumerate(docs):
        t, w = text or "", words_of(text)
        fails[n] = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                    "D": bool(re.search("[#$%&*|]", t)),
                    "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [n for n, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            alive = set(mine)
            for step, c in enumerate(order, 1):
                failing = {n for n in mine if fails[n][c]}
                gone = alive & failing
                alive -= gone
                out[part, "".join(order), step] = [
                    len(alive), len(gone), len(failing - gone), sum(sum(fails[n].values()) == 1 for n in failing),
                    sum(docs[n][0] in good for n in gone), sum(docs[n][0] in toxic for n in gone)]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    base = ["", None, "A#", "plain words " * 120, " ".join(f"w{i}" for i in range(230)), " ".join(f"W{i}" for i in range(230)), "B " * 300, "x" * 9_000, "a|b é"]
    docs = [(rng.choice([None, i, i, i, i, 5]), rng.choice(base + [f"t {rng.randrange(40)}"]), rng.choice([None, "", "a", "b"])) for i in range(160)]
    docs += docs[:15]
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(160)] * 2
    table = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, source string, part string, step string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
           for r in audit.audit_filters(table.repartition(4), marks).collect()}
    want = brute_audit(docs, [r for r in labels if r[0] is not None])
    assert len(got) == 3 * 120 * 5 and got == want
    assert audit.audit_filters(table.limit(0), marks).collect() == []
    assert {r["good_lost"] for r in audit.audit_filters(table, marks.limit(0)).collect()} == {0}


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "bb", "s"), (4, None, "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in audit.audit_filters(docs, marks, {"X": F.length("text") > 1}).collect()}
    assert got == {("XE", 1): (3, 1), ("XE", 2): (2, 1), ("EX", 1): (3, 1), ("EX", 2): (2, 1)}
    with pytest.raises(ValueError):
        audit.audit_filters(docs, marks, {c: F.lit(True) for c in "ABCDFG"})
