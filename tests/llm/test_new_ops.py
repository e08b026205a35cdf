"""Spelling groups, whitening and suffix dedup against plain versions, and on nulls, long texts, ties, repeats, empty
tables and clashing names."""

import collections
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from cutweave.llm import queries, spelling, suffix_dedup, whitening
from cutweave.llm.text import documents
from test_ops import ODD, by, odd_docs, pairs


@pytest.mark.parametrize("name", ["op11_spelling", "op13_suffix_dedup"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert by(getattr(queries, name)(spark, sf), *names) == sorted(res.fetchall(), key=repr)


# 11


def brute_spelling(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)) if len(w) < 1000 else [0]:
            for c in ["", *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]:
                other = w[:i] + c + w[i + 1 :]
                if other != w and other in n:
                    near[w].add(other)
                    near[other].add(w)
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in best.items() if n[o] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()), key=repr)


def chains():
    """Words whose forms have forms, ties, accents that stay upper-case, and insertions at both ends."""
    texts = ["correctly " * 1000, "correctlyy " * 90, "correctlyyy " * 8 + "ccorrectlyyy " * 3, "spelling " * 3 + "Spellinq " * 3 + "spellinx " * 40, "Éléphants " * 30 + "éléphants " * 3, "aaaaaaaa " * 300 + "aaaaaaa " * 20 + "aaaaaaaaa " * 20, "naïvetés-naïveté " * 5]
    return texts


def test_spelling(spark, sf):
    for docs in (documents(spark, sf), odd_docs(spark, ODD + chains())):
        got = by(spelling.group_spellings(docs), "word", "form", "root", "n", "n_near", "form_n")
        assert got == brute_spelling([(r["doc_id"], r["text"]) for r in docs.collect()])
    forms = [r for r in got if r[1]]
    assert any(r[1] != r[2] for r in forms) and ("spellinq", "spellinx", "spellinx") in [r[:3] for r in forms]
    docs = odd_docs(spark, ODD + chains())
    assert by(spelling.group_spellings(docs, filter_bytes=32), "word", "form", "root", "n", "n_near", "form_n") == got  # a filter block a pass
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def test_filters_pass_all_members_and_few_others():
    words = sorted({"".join(random.Random(i).choices("abcdefgh\xe9", k=9)) for i in range(5000)})
    own = [w.encode("latin-1") for w in words]
    h = spelling._sums(spelling._matrix(own))[:, -1]
    blocks = spelling.plan_filters({9: len(own)}, 1 << 20)[0][0][3]
    f = np.zeros((blocks, 8), np.uint32)
    at, bits = spelling._place(h, blocks)
    for lane in range(8):
        np.bitwise_or.at(f[:, lane], at, spelling._lane(bits, lane))
    assert len(spelling._passing(f, blocks, h)) == len(own)
    other = np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64)
    assert len(spelling._passing(f, blocks, other)) < 1000
    alphabet = np.array(sorted({c for w in own for c in w}), np.uint8)
    for size, hashes, i, k, letter in spelling.edits(own[:50], alphabet):
        made = [own[x][:y] + (bytes((z,)) if z else b"") + own[x][y + 1 :] for x, y, z in zip(i, k, letter.tolist())]
        assert {len(m) for m in made} == {size} and (spelling._sums(spelling._matrix(made))[:, -1] == hashes).all()


def test_filter_plan_covers_every_length_within_its_bytes():
    lengths = {7: 100_000, 8: 10, 40: 5000, 300_000: 1}
    plan = spelling.plan_filters(lengths, 1 << 16)
    assert {n for p in plan for n, *_ in p} == set(lengths)
    assert all(sum(b * 32 for *_, b in p) <= 1 << 16 for p in plan)
    assert sorted(s for p in plan for n, s, _, _ in p if n == 7) == list(range(next(k for p in plan for n, _, k, _ in p if n == 7)))


# 12


def plain_whitening(vectors, m=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    dev = n * x - s
    y = dev / n
    _, sigma, vt = np.linalg.svd(y, full_matrices=False)  # not from the Gram matrix, whose condition is the square
    e, u = sigma**2 / n, vt.T
    return (dev**2).sum(1), y @ u[:, :m] / np.sqrt(e[:m]), e[:m] / e.sum()


def test_whitening(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    flat = rows.toPandas().sort_values("vec_id")
    dev, white, share = plain_whitening(list(flat["embedding"]))
    got = queries.op12_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(flat) and set(got["n"]) == {len(flat)}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-9
    assert got.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == dev.tolist()
    assert np.abs(got.drop_duplicates("component").sort_values("component")["explained"].to_numpy() / share - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_of_close_and_tiny_directions(spark):
    """Columns that nearly repeat others: a condition of 10^5 beside which the Gram matrix's is 10^10."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 3)) * [3000, 40, 1]
    x = np.round(np.hstack([base, base[:, :1] + rng.integers(-1, 2, (400, 1)) / 64]) * 64) / 64
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    model = whitening.fit_whitening(rows)
    _, white, share = plain_whitening(x, 4)
    assert model.identity_error < 1e-6 and np.abs(model.explained / share - 1).max() < 1e-6
    got = np.array([r["whitened"] for r in whitening.whiten(rows, model).orderBy("vec_id").collect()])
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-4


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [1.0, None], [nan, 1.0], [3.0, 4.5], [6.0], [5.0, 5.5], [inf, 0.0], [3.0, 4.5], [1e30, 0.0], [], [-2.0, 9.0]]
    ids = [1, 2, 3, 4, 5, 6, None, 7, 5, 8, 9, 1]
    rows = spark.createDataFrame([(i, v, "c", 0.5) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, whitened string, kept double").repartition(3)
    got = whitening.whitening_table(rows)
    assert sorted(str(r["vec_id"]) for r in got.where("component = 2").collect()) == ["1", "1", "5", "5", "None"]
    dev, white, share = plain_whitening([[1, 2], [3, 4.5], [5, 5.5], [3, 4.5], [-2, 9]], 2)
    assert sorted(r["deviation"] for r in got.where("component = 1").collect()) == sorted(dev.tolist())
    assert np.allclose(sorted(abs(r["whitened"]) for r in got.where("component = 1").collect()), sorted(abs(white[:, 0])))
    assert whitening.whitening_table(rows.limit(0)).count() == 0
    one = whitening.whitening_table(rows.where("vec_id = 5")).collect()  # two equal rows
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 2, 0, None, 0.0), (2, 2, 0, None, 0.0)] * 2
    kept = whitening.whiten(rows, whitening.fit_whitening(rows), keep=["vec_id", "whitened", "kept"])
    assert kept.columns == ["vec_id", "kept", "deviation", "whitened"] and kept.first()["kept"] == 0.5
    huge = spark.createDataFrame([(1, [1e15, 2.0]), (2, [-1e15, 7.0]), (3, [1e14, 7.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitening_table(huge).collect()} == {None}


def test_whitening_does_not_depend_on_partitions(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = (whitening.fit_whitening(rows.repartition(k)) for k in (1, 7))
    assert a.sums == b.sums and np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-12)


# 13


def brute_bytes(bodies, window):
    n = collections.Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        covered = np.cumsum(gone[: len(b)]) > 0
        out.append((len(b), int(covered.sum()), np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist(), bytes(x for x, c in zip(b, covered) if not c)))
    return out


def mosaics(seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices("abcd", k=rnd.randint(20, 120))) for _ in range(12)]
    texts = ["".join(rnd.choice(pool) if rnd.random() < 0.7 else "".join(rnd.choices("abcdé", k=rnd.randint(1, 40))) for _ in range(rnd.randint(0, 20))) for _ in range(60)]
    return [*texts, texts[3], texts[5], "x" * 500, "x" * 300 + "y", "ab" * 200, "", None, "😀é" * 40, "zz" + "😀é" * 30]


@pytest.mark.parametrize("limit", [1 << 15, 6, 0])
def test_suffix_dedup(spark, limit, monkeypatch):
    """Also with runs of a few suffixes, and with large classes counted by windows."""
    for seed in range(2):
        texts = mosaics(seed)
        docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
        got = suffix_dedup.remove_repeated_bytes(docs, keep=["doc_id", "spans"], window=60, gram=16, limit=limit).collect()
        got = [(r["n_bytes"], r["n_removed"], r["spans"], bytes(r["kept"])) for r in sorted(got, key=lambda r: r["doc_id"])]
        assert got == brute_bytes([(t or "").encode() for t in texts], 60)


def test_suffix_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["spans"]) for r in suffix_dedup.remove_repeated_bytes(docs).collect()), key=repr)
    assert len(got) == len(rows) and [g[1] for g in got] == [len((t or "").encode()) for _, t in rows]
    long = {g[1]: g for g in got}
    assert long[300_000][2:] == (300_000, [0, 300_000]) and long[len("one two three " * 4000)][2] == len("one two three " * 4000)
    assert suffix_dedup.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_ten_thousand_equal_texts(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choices("abcdefgh ", k=900))
    docs = spark.range(10_000).selectExpr("id as doc_id", f"'{text}' as text").union(spark.createDataFrame([(-1, "q" * 50 + text[100:600] + "r" * 50)], "doc_id long, text string"))
    got = suffix_dedup.remove_repeated_bytes(docs)
    assert got.where("doc_id >= 0 and n_removed = 900").count() == 10_000
    assert got.where("doc_id = -1").first()["spans"] == [50, 550]


def test_merge_gives_the_sorted_order_and_its_prefixes():
    rnd = random.Random(3)
    items = [(bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))), bytes([i % 7]), [(i, 0, 0)]) for i in range(500)]
    cut = [items[i::7] for i in range(7)] + [[]]
    for runs in (cut, cut[:1], []):
        flat = sorted(x[0] for r in runs for x in r)
        coded = [suffix_dedup.front_code(sorted(r)) for r in runs]
        got = list(suffix_dedup.merge(suffix_dedup.decode(r) for r in coded))
        assert [g[1] for g in got] == flat
        assert [g[0] for g in got] == [suffix_dedup.shared(a, b) for a, b in zip([b"", *flat], flat)]
        assert sorted(int(g[3][0, 0]) for g in got) == sorted(x[2][0][0] for r in runs for x in r)


def test_merge_never_compares_known_prefixes(monkeypatch):
    """Bytes looked at: no more than each item's own, plus what front-coding and the games' last bytes take."""
    looked = [0]
    plain = suffix_dedup.shared

    def counted(x, y, known=0):
        k = plain(x, y, known)
        looked[0] += k - known + 1
        return k

    runs = [[(b"p" * 1000 + b"%05d" % i, b"", [(i, 0, 0)]) for i in range(k, 800, 8)] for k in range(8)]
    coded = [suffix_dedup.front_code(r) for r in runs]
    monkeypatch.setattr(suffix_dedup, "shared", counted)
    assert len(list(suffix_dedup.merge(suffix_dedup.decode(r) for r in coded))) == 800
    assert looked[0] < 8 * 1005 + 800 * 3 * 8


def test_anchors_are_in_every_window_and_equal_for_equal_windows():
    rnd = random.Random(9)
    body = bytes(rnd.choices(b"abc", k=3000)) + b"z" * 500
    body += body[500:1500]
    p, a, b, h = suffix_dedup.anchors(body, 60, 16)
    of = {s: (int(x) - s, int(y)) for x, lo, hi, y in zip(p, a, b, h) for s in range(lo, hi + 1)}
    assert sorted(of) == list(range(len(body) - 59)) and all(0 <= o <= 44 for o, _ in of.values())
    assert all(of[s] == of[s + 3000] for s in range(500, 1441))


def test_anchors_across_blocks(monkeypatch):
    body = bytes(random.Random(2).choices(b"ab", k=5000)) + b"c" * 300
    whole = suffix_dedup.anchors(body, 60, 16)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 97)
    assert all((x == y).all() for x, y in zip(whole, suffix_dedup.anchors(body, 60, 16)))


def test_time_of_a_long_periodic_text():
    began = time.process_time()
    assert len(suffix_dedup.anchors(b"x" * 3_000_000)[0]) == 3_000_000 - 399
    assert time.process_time() - began < 10
