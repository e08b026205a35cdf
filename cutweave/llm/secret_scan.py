"""Secret scans: fixed patterns, and a battery of randomness tests on encoded-looking tokens under false-discovery
control."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import as_str, carried, released, slices, with_fields
from cutweave.session import discard, materialise

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more: runs never overlap, so shorter ones need no dropping
KINDS = ("assign", "access", "hex", "random")
#: Runs of the symbols of any encoding; = pads an end, and elsewhere parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets by inferred encoding, each in its usual order.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
MIN_BITS, FDR = 80.0, 0.05
BINS = 400  # of -log10 p, a tenth each


def infer_encoding(token: str) -> str | None:
    """The narrowest encoding that all of a token's characters fit, padding at its end aside; else null. Letters alone, or
    digits alone, are no encoding."""
    body = token.rstrip("=")
    if body.isalpha() or not any(c.isalpha() for c in body):
        return None
    low = body if body.islower() else body.lower() if body.isupper() else ""
    if low and all(c in ALPHABETS["hex"] for c in low):
        return "hex"
    if all(c in ALPHABETS["base32"] for c in body):
        return "base32"
    body = body.replace("-", "+").replace("_", "/")
    if any(c.islower() for c in body) and any(c.isupper() for c in body) and any(c.isdigit() for c in body):
        return "base64" if all(c in ALPHABETS["base64"] for c in body) else None
    return None


def _upper_chi(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees, by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, encoding: str) -> float:
    """P-value of the token under uniform random symbols: chi-squared uniformity over the alphabet (in groups, so that
    each expects some), runs about the middle, and lag-one serial correlation; Bonferroni over the three."""
    alphabet = ALPHABETS[encoding]
    body = token.rstrip("=")
    body = body.lower() if encoding == "hex" else body.replace("-", "+").replace("_", "/")
    v = np.array([alphabet.index(c) for c in body], float)  # ``infer_encoding`` has seen to it that all are there
    n, size = len(v), len(alphabet)
    groups = size
    while groups > 4 and n / groups < 4:
        groups //= 2
    seen = np.bincount((v * groups / size).astype(int), minlength=groups)
    p1 = _upper_chi(float(((seen - n / groups) ** 2).sum() * groups / n), groups - 1)
    high = v >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
        p2 = math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(2 * var))
    else:
        p2 = 2.0 ** (1 - n)
    d = v - v.mean()
    s = float((d * d).sum())
    p3 = math.erfc(abs(float((d[1:] * d[:-1]).sum()) / s) * math.sqrt(n / 2)) if s else 0.0
    return min(1.0, 3 * min(p1, p2, p3))


def length_band(n: int) -> int:
    return int(math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length band, p) of tokens that look encoded and carry MIN_BITS or more."""
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if (kind := infer_encoding(token)) and len(token.rstrip("=")) * math.log2(len(ALPHABETS[kind])) >= MIN_BITS:
            yield m.start(), m.end(), kind, length_band(len(token)), battery(token, kind)


def clear_of(base: list[tuple[int, int, int]]):
    """A test of whether a span meets none of ``base``, by a search among their starts and the furthest ends so far."""
    starts = [s for s, _, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max))

    def clear(start: int, end: int) -> bool:
        at = bisect.bisect_left(starts, end)
        return not at or ends[at - 1] <= start

    return clear


def p_bin(p: float) -> int:
    """Tenths of -log10 p, in whole numbers up to BINS."""
    return min(BINS, int(-10 * math.log10(max(p, 1e-300))))


_SPAN = "array<struct<start:long,kind:int,end:long>>"
_CAND = "array<struct<start:long,end:long,enc:string,band:int,bin:int,clear:boolean>>"


def _scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """kept (a struct of those columns), base (spans of the fixed patterns) and cands (encoded-looking tokens)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("enc", pa.string()), ("band", pa.int32()), ("bin", pa.int32()), ("clear", pa.bool_())]))
    rows, text = carried(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                base, more = [], []
                for t in as_str(part, text):
                    found = base_spans(t)
                    clear = clear_of(found)
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                    more.append([{"start": s, "end": e, "enc": c, "band": b, "bin": p_bin(p), "clear": clear(s, e)} for s, e, c, b, p in candidates(t)])
                yield pa.RecordBatch.from_arrays([part["kept"], pa.array(base, span), pa.array(more, cand)], names=["kept", "base", "cands"])

    return rows.mapInArrow(run, with_fields(rows, ("base", _SPAN), ("cands", _CAND)))


def rejection_bins(scanned: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """Benjamini-Hochberg over every candidate of the corpus, by encoding and length band: the least bin of -log10 p at
    which uniformity is rejected. From a histogram of bounded size (encodings x bands x bins), counted in Spark."""
    rows = scanned.select(F.explode("cands").alias("c")).groupBy("c.enc", "c.band", "c.bin").count().collect()
    strata: dict[str, dict[int, int]] = {}
    for r in rows:
        strata.setdefault(f"{r['enc']}:{r['band']}", {})[r["bin"]] = r["count"]
    out = {}
    for key, hist in strata.items():
        m, seen = sum(hist.values()), 0
        for b in sorted(hist, reverse=True):
            seen += hist[b]
            if 10 ** (-b / 10) <= fdr * seen / m:
                out[key] = b
    return out


def find_secrets(docs: DataFrame, keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """The kept columns (default doc_id) and ``spans``: an ordered array of start, kind (rank in KINDS) and end, in code
    points, end exclusive. A random span is a candidate, outside every base span, whose uniformity isn't rejected.

    Two jobs: the scan, narrow and written once, and a histogram of p-values of bounded size. Null text is empty and
    has no spans; repeated rows repeat; an empty table gives an empty one; other columns are ignored, and a kept one
    named spans gives way to the result. Time is linear in a text.
    """
    scanned = materialise(_scan(docs, keep or ["doc_id"]), "secrets")
    reject = rejection_bins(scanned, fdr)
    key = lambda c: F.concat(c["enc"], F.lit(":"), c["band"].cast("string"))
    table = F.create_map(*(F.lit(x) for kv in reject.items() for x in kv)) if reject else None
    passes = lambda c: (F.lit(True) if table is None else F.coalesce(c["bin"] < F.element_at(table, key(c)), F.lit(True)))
    extra = F.transform(F.filter("cands", lambda c: passes(c) & c["clear"]), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return released(scanned, {"spans": F.array_sort(F.concat("base", extra))})


def spans_text(spans, kinds: int):
    """kind:start:end of the spans whose kind ranks under ``kinds``, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < kinds), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spans_text(F.col("spans"), 3), 256).alias("base_sha256"), spans_text(F.col("spans"), 4).alias("spans"))


def mask_spans(text: str | None, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str | None:
    """Each run of overlapping spans replaced by ``mask``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``docs`` (text and any other columns) with every secret in text masked; n_chars, where there is one, is counted anew
    in documents that changed. The text is read twice, once to gather p-values, and not shuffled.

    Null and empty texts, and all other columns, stay as they are; repeated rows repeat; an empty table gives an empty
    one.
    """
    scanned = materialise(_scan(docs, []).select("cands"), "secrets")
    reject = rejection_bins(scanned, fdr)
    discard(scanned)
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that any names pass
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "row.text"):
                row = part["row"]
                cols = {c: pc.struct_field(row, [i]) for i, c in enumerate(names)}
                texts = cols["text"].to_pylist()
                new = [mask_spans(t, [(s, e) for s, _, e in base_spans(t)] + list(randoms(t, reject))) if t else t for t in texts]
                changed = [a != b for a, b in zip(texts, new)]
                if any(changed):
                    cols["text"] = pa.array(new, cols["text"].type)
                    if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                        cols["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(new, changed, cols["n_chars"].to_pylist())], cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(cols.values()), fields=list(row.type))], names=["row"])

    return rows.mapInArrow(run, rows.schema).select("row.*")


def randoms(text: str, reject: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Candidates whose uniformity isn't rejected and that no base span meets."""
    clear = clear_of(base_spans(text))
    for s, e, kind, band, p in candidates(text):
        if p_bin(p) < reject.get(f"{kind}:{band}", BINS + 1) and clear(s, e):
            yield s, e
