import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratasize.llm import language_id, line_dedup, mixing, neighbours, packing, substring_dedup, token_files
from stratasize.llm.components import connected_components
from stratasize.llm.exact_dedup import drop_copies, exact_dedup
from stratasize.llm.html_text import extract, main_text
from stratasize.llm.simhash import drop_near_copies, fingerprint_links, near_duplicates
from stratasize.llm.tokens import DEFAULT_TOKENIZER, WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, norm string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    line = "one line that many documents share"
    rows = [
        (0, "a b c", "en", "s1"), (1, "a  b\tc", "en", "s1"), (2, None, "en", None), (3, "", None, "s2"), (None, "a b c", "en", "s2"), (4, long, "de", "s1"), (5, long, "de", None), (6, "123 !!", None, "s3"),
        (7, f"x\n{line}\n\ny", "en", "s1"), (7, f"x\n{line}\n\ny", "en", "s1"), (8, f"p\n{line}\nq", "en", "s3"), (None, None, None, None), (9, " \n ", "en", "s3"), (10, "A B C", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, 1, "k", "n", "d") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# Exact dedup


def test_exact_dedup_odd_rows(odd):
    found = exact_dedup(odd).collect()
    assert len(found) == odd.count()
    of = {(r["doc_id"], r["text_sha256"]): r for r in found}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (of[1, sha("a b c")]["keep_id"], of[1, sha("a b c")]["group_size"], of[1, sha("a b c")]["kept"]) == (0, 3, False)
    assert of[None, sha("a b c")]["kept"] is False and of[3, sha("")]["keep_id"] == 2 and of[10, sha("A B C")]["kept"] is True
    assert sum(r["kept"] for r in found if r["doc_id"] == 7) == 2
    assert drop_copies(odd).columns == odd.columns and exact_dedup(odd.limit(0)).count() == 0


def test_exact_dedup_when_digests_collide(docs):
    strong, weak = (sorted(map(tuple, exact_dedup(docs, digest_bits=b).collect())) for b in (256, 8))
    assert strong == weak


# SimHash


def fingerprint(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))], dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def test_simhash_equals_brute_force(docs, texts, odd):
    found = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    ids = sorted(texts)
    f = np.array([fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    assert [int(found[i]["fingerprint"], 16) for i in ids] == f.tolist()
    near, part = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, np.array(ids)
    while not (new := np.where(near, part[None, :], 1 << 60).min(1)).tolist() == part.tolist():
        part = new
    assert [found[i]["component_id"] for i in ids] == part.tolist()
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r["component_id"] is None for r in rows if r["fingerprint"] == "0" * 16)
    assert near_duplicates(odd.limit(0)).count() == 0 and drop_near_copies(odd).columns == odd.columns


def test_links_of_a_dense_ball(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    f = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(150)} | {0, (1 << 64) - 1, 7, 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    got = {(r["a"], r["b"]) for r in fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(min(x, y), max(x, y)) for i, x in enumerate(signed) for y in signed[:i] if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# Substring dedup


def repeats(rows, window):
    """rows: (id, text). (words, removed, kept) by brute force."""
    seen, gone = set(), collections.defaultdict(set)
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            if key in seen:
                gone[i] |= set(range(s, s + window))
            seen.add(key)
    return {i: (len(w), len(gone[i]), " ".join(x for n, x in enumerate(w) if n not in gone[i])) for i, w in words.items()}


@pytest.mark.parametrize("window", [3, 5, 20])
def test_substrings_equal_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcé") for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(70, "z " * 9000), (71, None), (72, ""), (73, " ".join("abcé" * 6))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    assert got == repeats(rows, window)


def test_substrings_with_one_hash_for_all(monkeypatch):
    """Windows that collide are told apart by content."""
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: x * np.uint64(0))
    gone = substring_dedup.repeated_windows([b"a b c d", b"b c d", b"x y z", b"x y z q"], np.array([(1, 0), (2, 0), (3, 0), (4, 0)], substring_dedup._DOC), np.array([0, 5, 0, 2]), 3)
    assert sorted(gone.tolist()) == [(2, 0, 5, 8), (4, 0, 2, 5)]


def test_substrings_odd_rows(odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] is not None}
    want = repeats([(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").collect()], 20)
    assert by_id == want and by_id[5][2] == ""


# Line dedup


def test_patience():
    assert line_dedup.patience("abcdef", "abxdef") == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    assert line_dedup.patience("xaybz", "qaraybt") == [(1, 3), (2, 4), (3, 5)]
    assert line_dedup.patience([None, 1], [2, None]) == [] and line_dedup.patience([], [1]) == []


def test_lines_odd_rows(odd):
    got = line_dedup.drop_repeated_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == odd.count()
    by_id = {r["doc_id"]: r["text"] for r in got.where("doc_id IS NOT NULL").collect()}
    assert by_id[8] == "p\nq" and by_id[2] is None and by_id[5] == "" and by_id[7].startswith("x\none line")
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


# Tokens, files and packing


def test_words_encode_like_the_library():
    library, own = Tokenizer.from_file(DEFAULT_TOKENIZER), WordEncoder(DEFAULT_TOKENIZER, 7, most_parts=50)
    rng = random.Random(5)
    pieces = ["a", "Z", "'", "'s", "DON'T", "'LL", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "ß", "İ", "Σ", "ΑΣ", "ж", "中", "😀", "1", "_", "-", "...", "<|endoftext|>", "\x00", "ﬁ", "​", "　", "½", "́", "the"]
    for _ in range(60):
        batch = [None if rng.random() < 0.05 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(20)]
        ids, size = own.encode(pa.array(batch, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids + [7] for t in batch]
        assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def ids_of(texts, end):
    library = Tokenizer.from_file(DEFAULT_TOKENIZER)
    return {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for d, t in texts.items()}


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), page_rows=50, row_group_bytes=1 << 20)
    want, start = ids_of(texts, 1), 0
    rows = {r["doc_id"]: r for r in token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()}
    index = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in token_files.read_index(spark, str(tmp_path / "t")).collect()}
    for d in sorted(texts):
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(want[d]), zlib.crc32(want[d])) and index[d] == (start, len(want[d]))
        start += len(want[d])
    some = token_files.read_tokens(spark, str(tmp_path / "t"), 10, 12).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in some) == [(d, want[d].tolist()) for d in (10, 11, 12)]
    import pyarrow.parquet as pq

    file = pq.ParquetFile(next(p for p in (tmp_path / "t").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows))
    columns = {c.path_in_schema: c for c in (file.metadata.row_group(0).column(i) for i in range(5))}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert columns["ids.list.element"].has_offset_index and columns["doc_id"].has_column_index


def test_token_files_odd_rows(spark, odd, tmp_path):
    token_files.write_tokens(odd, str(tmp_path / "t"))
    rows = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None and [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert [r["start"] for r in rows] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in rows])[:-1])).tolist()
    token_files.write_tokens(odd.limit(0), str(tmp_path / "e"))
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def test_tournament_tree_is_first_fit():
    rng = random.Random(2)
    for _ in range(30):
        sizes, tree, room = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))], None, []
        tree = packing.Bins(len(sizes), 100)
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (b == len(room))
            room[b] -= s
            assert tree.first_fit(s) == b


@pytest.mark.parametrize("least", [1, 8])
def test_packed_lengths_are_whole(least):
    rng = random.Random(least)
    for _ in range(40):
        lengths = [rng.choice([0, 1, 5, 64, 65, 200]) + rng.randint(0, 9) for _ in range(rng.randint(0, 50))]
        bins = packing.pack_lengths(lengths, 64, least)
        for doc, n in enumerate(lengths):
            own = sorted((a, k) for b in bins for d, a, k in b if d == doc)
            assert [a for a, _ in own] == np.concatenate(([0], np.cumsum([k for _, k in own])))[: len(own)].astype(int).tolist() and sum(k for _, k in own) == n
        full = [sum(p[2] for p in b) for b in bins]
        assert all(0 < x <= 64 and (64 - x < least or x & (x - 1) == 0) for x in full)


def check_packed(rows, want):
    for d, own in want.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own[at : at + r["length"]]))
            at += r["length"]
        assert at == len(own)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_is_whole_and_repeats(docs, texts, odd):
    rows = packing.pack(docs, group_documents=64).collect()
    check_packed(rows, ids_of(texts, 2))
    again = packing.pack(docs.repartition(7), group_documents=64, with_ids=False).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in collections.Counter({s: sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}}).values())
    assert padding < 0.002 * sum(r["length"] for r in rows)
    assert {r["doc_id"] for r in packing.pack(odd).collect()} == {r["doc_id"] for r in odd.collect()} and packing.pack(odd.limit(0)).count() == 0


# Mixing


def fill(sizes, share=1.5, most=2.0):
    """Targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while len(full) < len(names):
        level = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in names if s not in full}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        full |= over
    return out


def test_targets_and_takings(docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes = collections.Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
        want, taken = fill(sizes), collections.Counter()
        for r in rows:
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        times = [r["first_time"] for r in rows if r["first_time"] is not None]
        assert times == sorted(times) and all(0 <= t <= 1 for t in times)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken", "first_time").collect()), key=str) == sorted(((r["doc_id"], r["taken"], r["first_time"]) for r in mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_training_time_inverts_the_integral(spark):
    df = spark.range(101).select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("kind"), (F.col("id") / 100).alias("x"))
    for r in df.select("kind", "x", mixing.training_time(F.col("x"), F.col("kind")).alias("t")).collect():
        knots, area = mixing.SCHEDULES[r["kind"]], lambda upto, knots: sum((min(upto, t1) - t0) * (r0 + r0 + (r1 - r0) * (min(upto, t1) - t0) / (t1 - t0)) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]) if upto > t0)
        assert area(r["t"], knots) / area(1.0, knots) == pytest.approx(r["x"], abs=1e-9)


def test_mixed_documents_hold_the_words_taken(docs):
    took = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = collections.Counter()
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == {d: n for d, n in took.items() if n}


# Language, neighbours, pages


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    m = language_id.new_model(["a", "b"], 3, rng)
    for d in (m.forward, m.backward):
        d.table, d.recur = d.table.astype(np.float64) * 0.3, d.recur.astype(np.float64) * 0.3
    m.out, m.bias = m.out.astype(np.float64), m.bias.astype(np.float64)
    steps, there, label = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.ones((5, 4)), np.array([0, 1, 1, 0])
    there[3:, 0] = 0
    _, grads = language_id._gradient(m, steps, there, label)
    for x, g in zip(m.parameters(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in x.shape) for _ in range(6)]:
            at = (at[0], 97 + at[1] % 4) if x.shape[1] == 256 else at
            old, e = x[at], 1e-5
            x[at] = old + e
            up = language_id._gradient(m, steps, there, label)[0]
            x[at] = old - e
            down = language_id._gradient(m, steps, there, label)[0]
            x[at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[at], abs=2e-4)


def test_language_held_out(spark, docs, odd):
    from stratasize.llm.queries import op1_language_id

    rows = {r["doc_id"]: r for r in op1_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in truth if rows[d]["held_out"]]
    assert held == [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(rows[d]["lang_pred"] == truth[d] for d in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows.values())
    model = language_id.fit(docs, rounds=5)
    got = language_id.predict(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    assert {(r["lang_pred"], r["score"]) for r in got.where("doc_id IN (2, 3, 6, 9)").collect()} == {("und", 0.0)}
    assert language_id.fit(odd.limit(0)) is None and language_id.predict(odd, None).count() == odd.count() and language_id.predict(odd.limit(0), model).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:500] = x[100]  # a hot vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1500, None), (1520, [0.0] * 16), (1540, [float("nan")] * 16), (1560, [1.0]), (None, x[3].tolist()), (1580, [None] * 16)]
    found = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=10, leaf_rows=30, search_share=2.5, trees=8, shard_rows=400, block_queries=40).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    x, hits = x.astype(np.float64), []
    assert sorted(found) == list(range(0, 1500, 20))
    for q, got in found.items():
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:10]
        hits.append(len(set(want) & {i for i, _ in got}) / 10)
        assert all(abs(s[i] - v) < 1e-9 for i, v in got) and got == sorted(got, key=lambda g: (-round(g[1], 9), g[0]))
    assert np.mean(hits) >= 0.9
    assert [i for i, _ in found[200]] == list(range(100, 110))
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 4.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div id="wrap"><div class="post-content"><h2>Title</h2>
<p>This is a paragraph, with commas, and a good deal of text to be sure.</p><div class="sidebar"><p>Buy now, cheap, lots of text here and more, and more again please.</p></div>Loose text here, a bit <b>bold</b> &amp; more.
<ul><li>One item of text<li>Two items</ul><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul><form>Name <input></form><script>var x = "<p>";</script><p>Second &lt;x&gt; paragraph<br>long enough, to count for something at all.</div>
<div id="comments"><h3>Comments</h3><p>First! I love this article, so much, really a lot of love here.</p></div></div><div class="cookie-notice">We use cookies, lots</div><footer>c</footer></body></html>"""


def test_main_text(spark):
    assert main_text(PAGE).split("\n") == [
        "Title", "This is a paragraph, with commas, and a good deal of text to be sure.", "Loose text here, a bit bold & more.", "One item of text", "Two items",
        "Second <x> paragraph long enough, to count for something at all.",
    ]
    assert [main_text(x) for x in (None, "", "just text", "<p>a<p>b<div>c", "<nav>x</nav>")] == ["", "", "just text", "a\nb\nc", ""]
    assert main_text("<article><header><h1>T</h1>by me</header><p>x</article><aside>no</aside>") == "T\nx"
    assert main_text("<div>" * 3000 + "deep" + "</b>" * 50) == "deep"
    pages = spark.createDataFrame([(1, None, "u", 5), (2, PAGE, None, 5)], "page_id long, html string, url string, n_chars int")
    assert [(r["page_id"], r["n_chars"]) for r in extract(pages).orderBy("page_id").collect()] == [(1, 0), (2, len(main_text(PAGE)))]
    assert extract(pages.limit(0)).count() == 0
