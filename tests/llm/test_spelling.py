import collections
import random
import re
import string
import zlib

import pytest
from pyspark.sql import functions as F

from stratasize.llm import spelling
from stratasize.llm.spelling import group_variants, near_words, neighbourhood, reduced, words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_words(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def edit_of_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if edit_of_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÿ×q") for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    rows = []
    for i in range(400):
        some = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + "b" + w[k:]])
            some.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(some)))
    rows += [(None, "Straße abcdefgh"), (None, "abcdefgh"), (500, None), (501, ""), (502, "Æther" * 30), (502, "Æther" * 30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    found = sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in group_variants(docs).collect())
    assert found == plain(rows) and any(f[3] for f in found)
    assert found == sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in group_variants(docs, symbols=3).collect())
    assert group_variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    """Each word is a tenth of the next as frequent, so roots are several forms away."""
    chain = ["sixteen" + "y" * k for k in range(6)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling._roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_neighbourhood_is_whole(spark):
    alphabet = "012"
    for w in ("0", "0120", "1111222"):
        got = spark.range(1).select(neighbourhood(F.lit(w), 3).alias("x")).first()["x"]
        want = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        assert len(got) == len(set(got)) and set(got) == want
    one = spark.createDataFrame([("abcéÿ×",)], "w string").select(reduced(F.col("w"), 4).alias("r")).first()["r"]
    assert len(one) == 6 and set(one) <= set("0123")


@pytest.mark.parametrize("symbols", [2, 8])
def test_pairs_of_given_words(spark, small, symbols):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = plain_words(rows)
    assert {(r["word"], r["n"]) for r in words(docs).collect()} == set(known.items())
    by = collections.defaultdict(set)  # by what one deletion leaves
    for w in known:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by[x].add(w)
    want = {tuple(sorted((a, b))) for g in by.values() for a in g for b in g if a < b and edit_of_one(a, b)}
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in near_words(words(docs), symbols).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
