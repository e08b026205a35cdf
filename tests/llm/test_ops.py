"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.llm import chat_format, decontaminate, fingerprint, jaccard_join, license_scan, packing, quality, queries, secret_scan, substring_dedup, token_codec
from cutweave.llm.text import documents
from cutweave.llm.tokens import default_path, encoder

ODD = [None, "", " ", "\n\t", "a", "Ünïcode — ſtraße K 中文 😀", "x" * 300_000, "one two three " * 4000, "a b c\x0bd", "T̈he é İ ΑΣ's don't", "<|endoftext|> x"]
SCHEMA = "doc_id long, text string, key string, n_words string, component_id string, fingerprint string"


def odd_docs(spark, texts=ODD):
    """Repeated rows, a null id, ids out of order, and columns whose names an operator uses itself."""
    rows = [(i * 7 % 101, t, "k", "w", "c", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[-1], (None, "null id", "k", "w", "c", "f")], SCHEMA).repartition(3)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def split_space(t):
    return [w.decode() for w in t.encode().split()]


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


# 1


def brute_license(t):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    at, found = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                found.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def test_licenses(spark, sf):
    extra = ["MIT license MIT  License, the apache-license; mit license", "GNU General Public License. general public license", "mit licenses", "é mit license"]
    for docs in (documents(spark, sf), odd_docs(spark, ODD + extra)):
        got = by(license_scan.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert got == sorted(((i, *brute_license(t)) for i, t in pairs(docs)), key=repr)
    assert license_scan.scan_licenses(odd_docs(spark).limit(0)).count() == 0


def plain_labels(t):
    """labels, score and expressions, phrase by phrase."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    labels, miss, told = set(), 1.0, []
    weights = {p: (label, license_scan.BASE_WEIGHT) for p, label in license_scan.BASE_PHRASES.items()} | license_scan.NOTICE_PHRASES | {p: (None, w) for p, w in license_scan.HINT_PHRASES.items()}
    for phrase, (label, weight) in weights.items():
        p = phrase.split()
        n = sum(words[i : i + len(p)] == p for i in range(len(words)))
        miss *= (1 - weight) ** n
        labels |= {label} - {None} if n else set()
    for part in re.split("(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])(?i:spdx-license-identifier)(?=:)", t)[1:]:
        line = re.split("[\r\n]", part[1:])[0].strip().rstrip("*/-> \t").strip()
        got = license_scan.evaluate(line)
        if got is None and (head := re.match(r"[a-zA-Z0-9_+-]+(?:\.[a-zA-Z0-9_+-]+)*", line)):
            got, line = license_scan.evaluate(head[0]), head[0]
        if got:
            told.append(line)
            labels |= {license_scan.family(x) or x for x in got[0]}
            miss *= 1 - license_scan.TAG_WEIGHT
    return ",".join(sorted(labels)), round(1 - miss, 9), ";".join(told)


def test_license_labels_against_plain(spark, sf):
    extra = ["SPDX-License-Identifier: MIT", "x SPDX-License-Identifier: (GPL-2.0 with e) or BSD-3-Clause */\nlicensed under cc0, spdx license identifier: no", "spdx-license-identifier: mit spdx-license-identifier: isc", "spdx-license-identifier: and\r\nspdx-license-identifier:\tApache-2.0 prose follows", "myspdx-license-identifier: mit", "all rights reserved. All rights reserved", "éspdx-license-identifier: mit"]
    for docs in (documents(spark, sf), odd_docs(spark, ODD + extra)):
        got = sorted(((r["doc_id"], r["labels"], round(r["score"], 9), r["expressions"]) for r in license_scan.scan_licenses(docs).collect()), key=repr)
        assert got == sorted(((i, *plain_labels(t)) for i, t in pairs(docs)), key=repr)


def test_license_time_is_linear():
    import time

    for text in (b"mit license " * 80_000, b"spdx-license-identifier: mit and more " * 20_000, b"spdx-license-identifier: " + b"mit or " * 100_000 + b"x", b"spdx-license-identifier: " + b" or ".join(b"n%d" % i for i in range(50_000))):
        began = time.process_time()
        row = license_scan.scan_text(text)
        assert time.process_time() - began < 5 and row[0] > 50_000
    assert license_scan.scan_text(b"mit license " * 80_000)[1:4] == (80_000, 0, 159_998)


def test_license_expressions():
    assert license_scan.to_postfix("MIT OR (Apache-2.0 AND GPL-2.0 WITH x)") == ["mit", "apache-2.0", "gpl-2.0", "x", "with", "and", "or"]
    for bad in ("", "and", "mit or", "(mit", "mit)", "mit apache", "mit ()"):
        assert license_scan.to_postfix(bad) is None
    assert license_scan.evaluate("GPL-3.0 OR MIT")[1] == 1.0
    for told, labels, free in (("MIT,Apache-2.0", "apache,mit", 1.0), ("MIT/Apache-2.0", "apache,mit", 1.0), ("GPL-2.0; BSD-3-Clause and x_y", "gpl", 0.3), ("LGPL-2.1, MIT", "lgpl,mit", 1.0), ("MIT,", "mit", 1.0)):
        row = license_scan.scan_text(f"mit license SPDX-License-Identifier: {told}".encode())
        assert row[5] == ",".join(sorted({"mit", *labels.split(",")})) and row[8] == free
    assert license_scan.evaluate("GPL-3.0 AND MIT")[1] == 0.3
    assert license_scan.evaluate("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl-2.0"}, 0.5)
    row = license_scan.scan_text(b"/* SPDX-License-Identifier: Apache-2.0 OR MIT */")
    assert row[5] == "apache,mit" and row[7] == "Apache-2.0 OR MIT" and row[8] == 1.0 and 0.9 < row[6] <= 1
    assert license_scan.scan_text(b"SPDX-License-Identifier: MIT. And more prose follows")[5] == "mit"
    assert license_scan.scan_text(b"")[:2] == (0, 0) and license_scan.scan_text(b"plain words")[6] == 0


# 2


def auc(rows):
    ranks = {s: i for i, s in enumerate(sorted({s for s, _ in rows}))}
    pos, neg = [ranks[s] for s, y in rows if y], [ranks[s] for s, y in rows if not y]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, sf)
    assert got.count() == 1000
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and auc([(r["score"], r["quality"]) for r in rows]) > 0.95
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)


def test_quality_edges(spark):
    docs = odd_docs(spark)
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score_quality(docs, none)
    assert scored.count() == docs.count() and {r["score"] for r in scored.collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (14, None), (28, 1), (49, 0)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in scores)


def plain_grams(text):
    """Counts of the hashed features of one text, word by word."""
    from cutweave.llm.text import SPACE, Words

    w = Words([text.encode()], SPACE, lower=False)
    return collections.Counter(quality.features(w).ravel().tolist()), len(w.starts)


def plain_ftrl(rows, epochs=quality.EPOCHS):
    """FTRL-proximal, weight by weight: z and n of each index, and the closed form of w."""
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), 1 << quality.BITS

    def weight(i):
        l1 = 0.0 if i == bias else quality.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for label, x in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_against_plain(spark, sf):
    from pyspark.sql import functions as F

    docs = documents(spark, sf).select("doc_id", "text").where("doc_id < 80").union(spark.createDataFrame([(3, "a row that repeats an id"), (5, None), (None, "no id"), (6, "")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)] + [(4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    want_labels = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            want_labels[r["doc_id"]] = max(r["quality"], want_labels.get(r["doc_id"], 0))
    rows = []
    for r in docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("ord")).collect():
        if r["doc_id"] in want_labels:
            grams, n = plain_grams(r["text"] or "")
            idx = np.array(sorted(grams), "<i4").tobytes()
            told = spark.createDataFrame([(bytearray(idx),)], "idx binary").select(F.xxhash64("idx")).first()[0] if r["doc_id"] in (3, 5, 6) else 0
            rows.append((r["ord"], told, want_labels[r["doc_id"]], {i: np.float32(c * (quality.SCALE / max(n, 1))).item() for i, c in grams.items()} | {1 << quality.BITS: 1.0}))
    fitted = quality.fit_quality(docs, labels)
    want = plain_ftrl([(y, x) for _, _, y, x in sorted(rows, key=lambda r: r[:2])])
    assert np.count_nonzero(fitted) == sum(v != 0 for v in want.values()) > 100
    assert all(fitted[i] == pytest.approx(v, abs=1e-5) for i, v in want.items())
    scores = collections.defaultdict(list)
    for r in quality.score_quality(docs, fitted, ["doc_id", "text"]).collect():
        scores[r["doc_id"], r["text"]].append(r["score"])
    for (_, text), got in scores.items():
        grams, n = plain_grams(text or "")
        dot = sum(float(fitted[i]) * c for i, c in grams.items()) * quality.SCALE / max(n, 1) + float(fitted[-1])
        assert got == [pytest.approx(1 / (1 + math.exp(-dot)), abs=2e-9)] * len(got)


def test_quality_empty_and_clashing(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(7, 1), (28, 0)], "doc_id long, quality int")
    assert not quality.fit_quality(docs.limit(0), labels).any()
    weights = quality.fit_quality(docs.withColumnRenamed("key", "label").withColumnRenamed("n_words", "ord"), labels)
    assert quality.score_quality(docs.limit(0), weights).count() == 0
    clash = quality.score_quality(docs.withColumnRenamed("key", "score"), weights, ["doc_id", "score"])
    assert clash.columns == ["doc_id", "score"] and clash.schema["score"].dataType.simpleString() == "double"
    assert by(clash, "doc_id", "score") == by(quality.score_quality(docs, weights), "doc_id", "score")


def test_quality_features_are_sparse_dot_products():
    from cutweave.llm.text import SPACE, Words

    w = Words([b"a b c", b"", b"c"], SPACE, lower=False)
    f = quality.features(w)
    alone = quality.features(Words([b"a b c"], SPACE, lower=False))
    assert f.shape == (4, 3) and (f[:3] == alone).all() and f[2, 0] == f[3, 0]


# 3 and its stage


def brute_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = split_space(low(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= percent * len(sets[a] | sets[b]):
            ra, rb = root(a), root(b)
            comp[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def near_copies(seed=3):
    """Texts in chains of small edits, of many lengths, some at the very threshold."""
    r = np.random.default_rng(seed)
    out = []
    for size in (1, 2, 3, 4, 5, 8, 11, 12, 13, 20, 21, 22, 30, 40, 60, 100, 200, 400):
        words = [f"w{x}" for x in r.integers(0, 10**6, size)]
        for _ in range(8):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(int(r.integers(0, max(2, size // 25)))):
                k = int(r.integers(0, 3))
                at = int(r.integers(0, len(words))) if words else 0
                if k == 0:
                    words.insert(at, "new")
                elif k == 1 and len(words) > 1:
                    del words[at]
                elif words:
                    words[at] = f"w{int(r.integers(0, 10**6))}"
    return out


@pytest.mark.parametrize("shingle,percent,tile,tile_sets", [(3, 90, 2_000_000, 4096), (5, 80, 2_000_000, 4096), (3, 90, 300, 4096), (5, 80, 300, 3)])
def test_jaccard(spark, sf, shingle, percent, tile, tile_sets):
    texts = near_copies() + [t for _, t in pairs(documents(spark, sf))[:60]] + ["", "  ", "A b", "a B"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = by(jaccard_join.jaccard_components(docs, shingle, percent, tile, tile_sets), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(enumerate(texts), shingle, percent), key=repr)


def test_jaccard_edges(spark):
    docs = odd_docs(spark)
    got = jaccard_join.jaccard_components(docs)
    assert got.count() == docs.count()
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in got.collect())
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_signatures_meet():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        edges = jaccard_join.band_edges(percent, 1 << 20)
        for _ in range(400):
            n = int(r.integers(1, 300))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            cut, add = int(r.integers(0, n // 8 + 1)), int(r.integers(0, n // 8 + 2))
            b = np.unique(np.concatenate([r.permutation(a)[cut:], r.integers(0, 2**64, add, dtype=np.uint64)]))
            x = len(np.intersect1d(a, b))
            if 100 * x >= percent * (len(a) + len(b) - x):
                assert len(np.intersect1d(jaccard_join.signatures(a, percent, edges), jaccard_join.signatures(b, percent, edges)))


# 4


def test_chats(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "\\", "<", "<\\|", "\\<|", "|>", "<<||", "a\nb", "", None, "\\n", "\\\\n"]
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, None, "ro\nle<|\\n|", "y"), (1, 2, "assistant", "b"), *((4, i, r, t) for i, t in enumerate(nasty) for r in ("assistant", "user"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.chat_digest(chat_format.format_chats(chat_format.text_messages(df))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(mine), hashlib.sha256(told.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(chat_format.text_messages(df.limit(0))).count() == 0


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]), (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 2), ("odd", None, None, None, None, None, None)]), (1, 2, "user", None)]
    got = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).first()
    assert got["formatted"] == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|><|unknown|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["ordinal"], a["turn"], a["part"], a["type"], a["uri"], a["tokens"]) for a in got["attachments"]] == [(1, 0, 1, "image", "i.png", 4), (2, 0, 2, "audio", "a.wav", 38), (3, 1, 0, "document", "d.pdf", 1024), (4, 1, 1, "unknown", None, 0)]
    apart = spark.createDataFrame([(1, 0, "assistant", [("text", t, None, None, None, None, None) for t in ("a<", "|im_end|>\n", "<", "|", "|x", "\\")], 7)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, formatted int")
    row = chat_format.format_chats(apart).first()
    assert row["formatted"].count("<|im_end|>") == 1
    told = chat_format.chat_digest(chat_format.format_chats(apart)).first()
    assert told["loss_sha256"] == hashlib.sha256("a<|im_end|>\n<||x\\".encode()).hexdigest() and told["n_turns"] == 1
    long = chat_format.format_chats(chat_format.text_messages(spark.createDataFrame([(1, i, "user", "<|" * 100_000) for i in range(3)], "conv_id long, turn long, role string, text string"))).first()
    assert len(long["formatted"]) > 900_000
    (span,) = got["loss_spans"]
    assert got["formatted"][span["start"] : span["start"] + span["length"]] == "<|document|><|unknown|>" and got["attachment_tokens"] == 1066


# 5


def brute_repeats(docs, n):
    split = [split_space(t) for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, split):
        gone = {k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,anchor,hot", [(35, 8, 2000), (6, 3, 1), (3, 1, 20)])
def test_repeats(spark, sf, window, anchor, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)  # all hashes are hot, none, or some
    r = np.random.default_rng(2)
    few = [" ".join(f"v{x}" for x in r.integers(0, 3, int(n))) for n in r.integers(0, 60, 60)]
    for docs in (odd_docs(spark, ODD + few), documents(spark, sf)):
        got = by(substring_dedup.remove_repeats(docs, window=window, anchor=anchor), "doc_id", "n_words", "n_removed", "kept")
        assert got == brute_repeats(pairs(docs), window)
    row = substring_dedup.remove_repeats(spark.createDataFrame([(1, "a b c a b c x")], "doc_id long, text string"), window=3, anchor=2).first()
    assert (row["spans"], row["kept"]) == ([0, 6], "x")
    assert substring_dedup.remove_repeats(odd_docs(spark).limit(0)).count() == 0


# 6


def test_codec_round_trip():
    r = np.random.default_rng(1)
    for n, alphabet in ((1, 1), (5, 2), (2047, 50), (2049, 3), (70_000, 40_000), (600_000, 700)):
        tokens = (r.zipf(1.3, n) % alphabet).astype(np.uint32)
        ids, counts = np.unique(tokens, return_counts=True)
        table = token_codec.Table(ids, counts)
        assert int(table.freq.sum()) == 1 << token_codec.SCALE_BITS and table.freq.min() >= 1
        block = token_codec.encode_block(tokens, np.array([n]), table)
        got, docs = token_codec.decode_block(block, table)
        assert (got == tokens).all() and docs.tolist() == [n]
        lanes = min(token_codec.LANES, n)
        k = -(-(-(-n // lanes)) // token_codec.CHECKPOINT_STEPS) - 1
        last, _ = token_codec.decode_block(block, table, range(k, k + 1))
        assert (last == tokens[k * token_codec.CHECKPOINT_STEPS * lanes :]).all()
        for at in (len(block) - 1, len(block) // 2):
            with pytest.raises(ValueError):
                token_codec.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :], table)
    assert len(block) < n * 1.1  # 700 ids, most of them rare: far below two bytes each


def whole_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [e.ids + [end] for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoding_is_exact(spark, sf):
    import pyarrow as pa

    texts = [t or "" for t in ODD if not t or len(t) < 100_000] + [t for _, t in pairs(documents(spark, sf))]
    for size in (1, 1000):
        for i in range(0, 30 if size == 1 else len(texts), size):
            ids, count = encoder(default_path()).texts(pa.array(texts[i : i + size]), 1)
            parts = np.split(ids, np.cumsum(count)[:-1])
            assert [p.tolist() for p in parts] == whole_ids(texts[i : i + size], 1)


def test_token_files(spark, sf):
    for docs in (documents(spark, sf).repartition(5), odd_docs(spark)):
        rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
        ids = whole_ids([t for _, t in rows], 1)
        start = np.cumsum([0, *map(len, ids)])
        want = sorted(((i, int(s), len(x), crc(x)) for (i, _), s, x in zip(rows, start, ids)), key=repr)
        assert by(token_codec.token_digest(docs), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_codec.token_digest(odd_docs(spark).limit(0)).count() == 0


# 7


def brute_secrets(text):
    """The base columns by the contract's own words."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return *(sum(k == x for _, k, _ in found) for x in range(3)), hashlib.sha256(told.encode()).hexdigest()


SYMBOLS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def plain_encoding(token):
    body = re.sub("=+$", "", token)
    if re.fullmatch("[A-Za-z]*", body) or not re.search("[A-Za-z]", body):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch("[A-Z2-7]+", body):
        return "base32"
    if re.fullmatch("[A-Za-z0-9+/_-]+", body) and re.search("[a-z]", body) and re.search("[A-Z]", body) and re.search("[0-9]", body):
        return "base64"
    return None


def plain_battery(token, enc):
    """The three tests, symbol by symbol."""
    body = re.sub("=+$", "", token)
    body = body.lower() if enc == "hex" else body.replace("-", "+").replace("_", "/")
    v = [SYMBOLS[enc].index(c) for c in body]
    n, size = len(v), len(SYMBOLS[enc])
    groups = size
    while groups > 4 and n < 4 * groups:
        groups //= 2
    seen = collections.Counter(x * groups // size for x in v)
    chi = sum((seen[g] - n / groups) ** 2 / (n / groups) for g in range(groups))
    k = groups - 1
    p1 = 0.5 * math.erfc(((chi / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)) / math.sqrt(2))
    signs = [x >= size / 2 for x in v]
    a, b = sum(signs), n - sum(signs)
    runs = 1 + sum(x != y for x, y in zip(signs, signs[1:]))
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        p2 = 2.0 ** (1 - n)
    m = sum(v) / n
    s = sum((x - m) ** 2 for x in v)
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / s if s else None
    p3 = math.erfc(abs(r) * math.sqrt(n / 2)) if s else 0.0
    return min(1.0, 3 * min(p1, p2, p3))


def plain_randoms(texts):
    """Start and end of the extra spans of each text: Benjamini-Hochberg in each encoding and band of lengths, over p-values
    rounded as documented, then those that meet no base span."""
    tests = []
    for d, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t):
            enc = plain_encoding(m[0])
            if enc and len(re.sub("=+$", "", m[0])) * math.log2(len(SYMBOLS[enc])) >= 80:
                p = plain_battery(m[0], enc)
                tests.append((enc, len(m[0]).bit_length(), min(400, int(-10 * math.log10(max(p, 1e-300)))), d, m.start(), m.end()))
    kept = [[] for _ in texts]
    for key in {x[:2] for x in tests}:
        mine = sorted((x for x in tests if x[:2] == key), key=lambda x: -x[2])
        rejected = max((i + 1 for i, x in enumerate(mine) if 10 ** (-x[2] / 10) <= 0.05 * (i + 1) / len(mine)), default=0)
        for x in mine[rejected:]:
            base = [(m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})|AKIA""", texts[x[3]])]
            if all(x[5] <= a or b <= x[4] for a, b in base) and not re.search("[0-9a-f]{32}", texts[x[3]][x[4] : x[5]]):
                kept[x[3]].append((x[4], x[5]))
    return [sorted(x) for x in kept]


def test_random_spans_against_plain(spark):
    r = np.random.default_rng(4)
    draw = lambda symbols, n: "".join(symbols[i] for i in r.integers(0, len(symbols), n))
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    texts = [f"{draw(every, int(n))} {draw(every[:62], int(m))} url?key={draw(SYMBOLS['base32'], 24)} x" for n, m in r.integers(15, 90, (150, 2))]
    texts += ["A1b" * 12, "token=" + draw(every[:62], 30), "url?key=AbCdEf123456GhIjKl78 x", "a=b" * 20, "=" * 40, "0123456789ABCDEF" * 2 + "==", "-_" * 15 + "aB3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == 3] for x in secret_scan.find_secrets(docs).collect()}
    want = plain_randoms(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 50
    masked = {x["doc_id"]: x["text"] for x in secret_scan.mask_secrets(docs).collect()}
    assert len(masked) == len(texts) and all(("[SECRET]" in masked[i]) == bool(want[i] or secret_scan.base_spans(t)) for i, t in enumerate(texts))


def test_battery_against_plain():
    r = np.random.default_rng(8)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    for symbols in (every, *SYMBOLS.values(), "abcdefg0", "ABC234="):
        for n in r.integers(20, 200, 60):
            token = "".join(symbols[i] for i in r.integers(0, len(symbols), int(n)))
            enc = secret_scan.infer_encoding(token)
            assert enc == plain_encoding(token)
            if enc:
                assert secret_scan.battery(token, enc) == pytest.approx(plain_battery(token, enc), abs=1e-9)


def test_secrets(spark, sf):
    extra = ["token=token: abcdefgh1", "PASSWORD : 'abcdefgh' api_key=\"12345678\"", "xAKIA" + "B" * 12 + "c", "AKIA1", "0" * 31, "f" * 40 + "g", "secret=short ſecret=longenough1", "é" * 5 + " apikey:  abc.def.ghi"]
    for docs in (documents(spark, sf), odd_docs(spark, ODD + extra)):
        got = by(secret_scan.secrets_digest(secret_scan.find_secrets(docs)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
        assert got == sorted(((i, *brute_secrets(t)) for i, t in pairs(docs)), key=repr)
    assert secret_scan.find_secrets(odd_docs(spark).limit(0)).count() == 0


def test_randomness(spark):
    r = np.random.default_rng(9)
    make = lambda enc, n: "".join(secret_scan.ALPHABETS[enc][i] for i in r.integers(0, len(secret_scan.ALPHABETS[enc]), n))
    random = [t for enc, n in (("hex", 48), ("base64", 40), ("base64", 64)) for t in (make(enc, n) for _ in range(40)) if secret_scan.infer_encoding(t)]
    regular = ["A1b" * 14, "abcdefABCDEF0123456789abcdefABCDEF0123456789", "0123456789abcdef" * 3, "aB3" + "a" * 50]
    ps = [secret_scan.battery(t, secret_scan.infer_encoding(t)) for t in random]
    assert np.mean(np.array(ps) < 0.05) < 0.15
    assert all(secret_scan.battery(t, secret_scan.infer_encoding(t)) < 1e-3 for t in regular)
    docs = spark.createDataFrame([(i, f"go {t} on") for i, t in enumerate(random + regular)], "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secret_scan.find_secrets(docs).collect()}
    assert sum(bool(got[i]) for i in range(len(random))) > 0.5 * len(random) and not any(got[len(random) + i] for i in range(len(regular)))
    assert secret_scan.infer_encoding("onlylettershereinthisword") is None and secret_scan.infer_encoding("12345678901234567890") is None


def test_masks(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", 22, "x"), (2, None, None, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in secret_scan.mask_secrets(docs).collect()}
    assert got == {1: ("a [SECRET] b", 12, "x"), 2: (None, None, "y"), 3: ("clean", 5, "z")}
    assert secret_scan.mask_spans("abcdef", [(1, 3), (2, 4), (5, 6)], "#") == "a#e#"


# 8


def brute_contamination(text, items, window=13):
    """n_words, n_hit and items by the contract's own words."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))
    words, hit, found = split(text), set(), set()
    for name, t in items:
        ws = split(t)
        m = min(window, len(ws))
        wins = {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("pass_words", [2_000_000, 600])
def test_contamination(spark, sf, pass_words):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(*[c for c in ("item_id", "text")])
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()] + [("s1", "Tiny"), ("s2", "two words"), ("e", ""), ("n", None), ("p", "a b a b a b a b a b a b a b a b")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["tiny", "a TINY two-words tiny", "x a b a b a b a b a b a b a b a b a b y", (items[0][1] or "") * 2]
    for docs in (documents(spark, sf), odd_docs(spark, ODD + texts)):
        found = decontaminate.find_contamination(docs, bench, pass_words=pass_words)
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=repr)
        assert got == sorted(((i, *brute_contamination(t, items)) for i, t in pairs(docs)), key=repr)
    whole = odd_docs(spark, ODD + texts)
    kept = decontaminate.find_contamination(whole, bench, ["doc_id", "text", "key"], pass_words=pass_words)
    assert kept.columns[:3] == ["doc_id", "text", "key"] and by(kept, "doc_id", "text") == by(whole, "doc_id", "text")
    none = decontaminate.find_contamination(odd_docs(spark), bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(ODD) + 3
    assert decontaminate.find_contamination(odd_docs(spark).limit(0), bench).count() == 0


# 9


def brute_prints(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    out = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt))))
    return sorted(out, key=repr)


def test_fingerprints(spark, sf):
    odd = [(i, t) for i, t in enumerate(ODD + ["Straße", "STRASSE", "é", "É", "a  b", "A b "])] + [(None, "null id")]
    for docs in (documents(spark, sf).repartition(7), spark.createDataFrame(odd, "doc_id long, text string").repartition(3), spark.createDataFrame(odd[:1] + odd[9:10], "doc_id long, text string"), spark.createDataFrame(odd[9:10], "doc_id long, text string")):
        assert by(fingerprint.edited_fingerprints(docs), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == brute_prints(pairs(docs))
    got = fingerprint.fingerprints(odd_docs(spark, ["Straße", "STRASSE", "other", None, ""]))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[0]["fingerprint"] == rows[7]["fingerprint"] != rows[14]["fingerprint"] and rows[7]["group_id"] == 0 and rows[28]["group_id"] == 21
    assert fingerprint.edited_fingerprints(odd_docs(spark).limit(0)).count() == 0


def test_fingerprint_clash(spark, monkeypatch):
    made = spark.createDataFrame([("f", "s1"), ("f", "s2"), ("g", "s3")], "fingerprint string, sha string")
    clash = spark.createDataFrame([("f",)], "fingerprint string")
    assert by(fingerprint.resolve(made, clash, {"fingerprint": "sha"}), "fingerprint") == [("f-s1",), ("f-s2",), ("g",)]
    docs = spark.createDataFrame([("a",), ("A ",), ("b",)], "text string")
    prints = spark.createDataFrame([(fingerprint.digest("a"),)] * 2, "fingerprint string")
    assert fingerprint.collided(docs, prints).count() == 0


# 10


def check_packing(rows, docs, end=2, capacity=4096):
    want = whole_ids([t for _, t in docs], end)
    have = collections.defaultdict(list)
    for r in rows:
        have[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    need = collections.defaultdict(list)
    for (i, _), ids in zip(docs, want):
        need[i] += [(s, len(ids[s : s + capacity]), crc(ids[s : s + capacity]), len(ids)) for s in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in need.items()}
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return sum(map(len, want)), len(seqs)


def test_packing(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    docs = spark.createDataFrame(pairs(docs), "doc_id long, text string")
    total, n = check_packing(packing.pack(docs).collect(), pairs(docs))
    assert n <= math.ceil(total / 4096) * 1.03 + 1
    odd = odd_docs(spark)
    check_packing(packing.pack(odd).collect(), pairs(odd))
    assert packing.pack(odd.limit(0)).count() == 0


def test_column_generation():
    for demand in ({511: 5}, {0: 7}, {255: 10, 127: 3}, {300: 100, 100: 100, 50: 100, 9: 1000}):
        plan = packing.plan(demand, 512)
        held = collections.Counter()
        for pattern, times in plan:
            assert times > 0 and sum((c + 1) * n for c, n in pattern.items()) <= 512
            for c, n in pattern.items():
                held[c] += n * times
        assert dict(held) == demand
    bound = sum(v for _, v in packing.solve(np.array([100 if c in (300, 100, 50) else 0 for c in range(512)]), 512))
    assert bound <= 100 * (301 + 101 + 51) / 512 * 1.35


def test_ten_thousand_equal_texts_are_scanned_once_a_task(spark, monkeypatch):
    words = " ".join(f"w{i * i % 997}" for i in range(90))
    docs = spark.range(10_000).selectExpr("id as doc_id", f"'{words}' as text").union(spark.createDataFrame([(-1, "x y " + " ".join(words.split()[20:70]) + " z")], "doc_id long, text string"))
    rows = substring_dedup._anchors(docs.select("text", F.xxhash64("text").alias("key")).coalesce(3), substring_dedup.WINDOW, substring_dedup.ANCHOR)
    assert rows.groupBy("key", "mh").count().agg(F.max("count")).first()[0] <= 3
    got = substring_dedup.remove_repeats(docs)
    assert got.where("doc_id >= 0 and n_removed = 90").count() == 10_000
    assert got.where("doc_id = -1").first()["spans"] == [2, 52]
