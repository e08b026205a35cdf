"""License scans: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates tag
expressions with and / or / with."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cutweave.llm.text import ALNUM, LOWER, as_bytes, slices

#: The contract's own phrases; every place counts.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases: label and how sure a notice they are.
NOTICE_PHRASES = {
    "apache license version 2 0": ("apache-2.0", 0.9),
    "bsd license": ("bsd", 0.7),
    "cc by": ("cc-by", 0.6),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc0": ("cc0", 0.6),
    "creative commons": ("cc", 0.6),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
}
#: Phrases that speak of a licence and name none.
HINT_PHRASES = {"licensed under": 0.3, "all rights reserved": 0.3}
BASE_WEIGHT, TAG_WEIGHT = 0.6, 0.95
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)  # tried only where the automaton finds the tag's words

#: How free a licence family leaves its user, 0 to 1; an expression takes the least of and, the most of or.
FREEDOM = {"mit": 1.0, "isc": 1.0, "0bsd": 1.0, "bsd": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "epl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1}
EXCEPTION_BONUS = 0.2
RANK = {"or": 1, "and": 2, "with": 3}


NAME = re.compile(r"[a-z0-9.+-]+")


def family(name: str) -> str | None:
    """The longest known family that ``name`` is or begins with, at a hyphen; else null."""
    known = [f for f in FREEDOM if name == f or name.startswith(f + "-")]
    return max(known, key=len) if known else None


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: infix licence expression to postfix; null for a malformed one. A comma, semicolon or slash between
    names leaves the choice, as or does; a name has letters, digits, dots, plus signs and hyphens alone."""
    out: list[str] = []
    ops: list[str] = []
    operand_due = True
    for tok in re.findall(r"[(),;/]|[^\s(),;/]+", expression.lower()):
        tok = "or" if tok in ",;/" else tok
        if tok == "(":
            if not operand_due:
                return None
            ops.append(tok)
        elif tok == ")":
            if operand_due:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif tok in RANK:
            if operand_due:
                return None
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[tok]:
                out.append(ops.pop())
            ops.append(tok)
            operand_due = True
        else:
            if not operand_due or not NAME.fullmatch(tok):
                return None
            out.append(tok)
            operand_due = False
    if operand_due or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Licence names of an expression and the freedom it grants: or takes the more free side, and the less free one,
    with adds an exception's. Null if it can't be parsed."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for tok in postfix:
        if tok not in RANK:
            f = family(tok)
            stack.append(({tok.rstrip("+")}, FREEDOM[f] if f else 0.0))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        if tok == "with":
            stack.append((a, min(1.0, x + EXCEPTION_BONUS)))
        else:
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b  # the larger set grows, so that long expressions take linear time
            stack.append((a, max(x, y) if tok == "or" else min(x, y)))
    return stack[0]


_machine = None


def machine():
    """The automaton over normalised words, each phrase between single spaces."""
    global _machine
    if _machine is None:
        import ahocorasick

        _machine = ahocorasick.Automaton()
        for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, *HINT_PHRASES, TAG}:
            _machine.add_word(f" {phrase} ", phrase)
        _machine.make_automaton()
    return _machine


_NON_WORD = bytes(b if w else 0x20 for b, w in enumerate(ALNUM))
_FOLD = bytes(_NON_WORD[LOWER[b]] for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, freedom double"


def _word_starts(text: bytes) -> np.ndarray:
    """Where each word of a text begins, in bytes."""
    inside = ALNUM[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def read_tag(text: bytes, at: int, stop: int) -> tuple[str, tuple[set[str], float]] | None:
    """The expression of the tag at byte ``at``, up to the end of its line or ``stop``, and its value; null if there is none.
    Prose may follow the tag on its line: then its first name alone counts."""
    m = TAG_TEXT.match(text, at, stop)
    if not m:
        return None
    told = m[1].decode("utf-8", "replace").strip().rstrip("*/-> \t").strip()
    got = evaluate(told)
    if got is None:
        head = re.match(r"[A-Za-z0-9+-]+(?:\.[A-Za-z0-9+-]+)*", told)
        got, told = (evaluate(head[0]), head[0]) if head else (None, told)
    return (told, got) if got else None


def scan_text(text: bytes) -> tuple:
    """All columns of SCHEMA but doc_id, for one UTF-8 text, in time linear in it."""
    words = text.translate(_FOLD).split()
    hay = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last = 0, None, None
    base, labels, miss, expressions, freedom = set(), set(), 1.0, [], None
    hits = list(machine().iter(hay))
    ends = np.cumsum([len(w) + 1 for w in words]) if hits else None  # where the space after each word stands
    place = lambda end, phrase: int(np.searchsorted(ends, end - len(phrase)))  # noqa: E731  the word a hit starts at
    for end, phrase in hits:
        if phrase in BASE_PHRASES:
            at = place(end, phrase)
            n_base, first, last = n_base + 1, at if first is None else min(first, at), at if last is None else max(last, at)
            base.add(BASE_PHRASES[phrase])
            miss *= 1 - BASE_WEIGHT
        elif phrase in NOTICE_PHRASES:
            label, sure = NOTICE_PHRASES[phrase]
            labels.add(label)
            miss *= 1 - sure
        elif phrase in HINT_PHRASES:
            miss *= 1 - HINT_PHRASES[phrase]
    tags = [place(end, phrase) for end, phrase in hits if phrase == TAG]
    if tags:
        starts = _word_starts(text)[tags].tolist()
        for at, stop in zip(starts, [*starts[1:], len(text)]):
            if told := read_tag(text, at, stop):
                expression, (names, free) = told
                expressions.append(expression)
                labels |= {f for x in names for f in [family(x) or x]}
                freedom = free if freedom is None else min(freedom, free)
                miss *= 1 - TAG_WEIGHT
    if freedom is None and (known := [FREEDOM[f] for x in base | labels if (f := family(x))]):
        freedom = min(known)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - miss, ";".join(expressions), freedom


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored), in SCHEMA.

    Narrow: no shuffle, memory bounded by one Arrow batch. Null text is empty: no words, score 0, empty labels, null
    places. A null doc_id stays null; repeated rows give repeated results; an empty table gives none; very long texts
    take time in proportion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*map(scan_text, as_bytes(part))))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
