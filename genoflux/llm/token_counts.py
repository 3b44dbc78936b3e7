"""Token counts of sections: documents are encoded once, and token spans are attributed to the sections they overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytekit import binary_parts
from .cluster import read, ship

#: first: a token that crosses a boundary counts where its first byte lies. most: where most of its bytes lie
#: (of equal shares the earlier). last: where its last byte lies.
RULES = ("first", "most", "last")
_NAMES = ("doc_id", "section", "start_char", "end_char", "start_byte", "end_byte", "n_tokens", "n_crossing")
_OUT = pa.schema([(n, pa.int64()) for n in _NAMES])
#: Section of the tokens that lie in no given one.
OUTSIDE = -1


def lines(raw: np.ndarray) -> np.ndarray:
    """Where sections start that are lines, each with its line feed; an empty text is one empty section."""
    at = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def covering(given: list[tuple[int, int]], size: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Starts of stretches that cover 0..size and the section of each, and the sections' own (start, end).

    Sections are cut to the text, and one that overlaps the section that starts before it begins where that ends (of equal starts the first given is
    before). What no section holds is OUTSIDE.
    """
    own: list[tuple[int, int]] = [(0, 0)] * len(given)
    starts, names, at = [], [], 0
    for k in sorted(range(len(given)), key=lambda i: (given[i][0], i)):
        a = min(max(given[k][0], at), size)
        z = max(a, min(given[k][1], size))
        own[k] = (a, z)
        if a < z:
            if a > at:
                starts.append(at)
                names.append(OUTSIDE)
            starts.append(a)
            names.append(k)
            at = z
    if at < size or not starts:
        starts.append(at)
        names.append(OUTSIDE)
    return starts, names, own


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that reach beyond it, of each section. Spans and sections ascend, so the join is two searches."""
    n = len(sections)
    a = np.searchsorted(sections, starts, "right") - 1
    z = np.searchsorted(sections, ends - 1, "right") - 1
    to = a if rule == "first" else z
    if rule == "most":
        to = a.copy()
        bounds = np.append(sections, size)
        for i in np.flatnonzero(a != z):  # few: only tokens over a boundary
            k = np.arange(a[i], z[i] + 1)
            to[i] = k[np.argmax(np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], starts[i]))]
    return np.bincount(to, minlength=n), np.bincount(to[a != z], minlength=n)


def _sections(raw: np.ndarray, given) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which the stretches of a text start with their sections, and for each section its (start, end) in characters."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each character
    if given is None:
        cut = lines(raw)
        at = np.searchsorted(first, np.append(cut, len(raw)))
        return cut, np.arange(len(cut)), np.stack([at[:-1], at[1:]], axis=1), np.arange(len(cut))
    ok = [(int(x["start"]), int(x["end"])) if x is not None and x["start"] is not None and x["end"] is not None else (0, 0) for x in given]
    starts, names, own = covering(ok, len(first))
    shown = np.arange(len(own))
    return np.append(first, len(raw))[starts], np.array(names), np.array(own, np.int64).reshape(-1, 2), shown


def _run(path: str, rule: str, given: bool):
    def run(batches):
        from .tokenizers import byte_bpe

        encoding = byte_bpe(path)
        top = encoding.max_token_value + 1
        width = np.zeros(top, np.int64)
        for token, rank in encoding._mergeable_ranks.items():
            width[rank] = len(token)
        for b in batches:
            buf, off = binary_parts(b.column(1))
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            fields = [x or [] for x in b.column(2).to_pylist()] if given else [None] * len(texts)
            rows = [[] for _ in _OUT]
            for d, (t, f, i, j) in enumerate(zip(texts, fields, off[:-1].tolist(), off[1:].tolist())):
                raw = buf[i:j]
                ends = np.cumsum(width[encoding.encode_to_numpy(t or "", disallowed_special=())])
                cut, names, own, shown = _sections(raw, f)
                n, over = attribute(np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends, cut, j - i, rule)
                # by section, and what lies outside of all in a row of its own
                total, crossing = (np.bincount(names + 1, weights=x, minlength=len(own) + 1).astype(np.int64) for x in (n, over))
                outside = 1 if total[0] else 0
                first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), j - i)
                span = np.concatenate([np.zeros((outside, 2), np.int64) + [0, len(first) - 1], own]) if outside else own
                k = np.concatenate([[OUTSIDE] * outside, shown]).astype(np.int64)
                for r, x in zip(rows, (np.full(len(k), d), k, span[:, 0], span[:, 1], first[span[:, 0]], first[span[:, 1]], total[k + 1], crossing[k + 1])):
                    r.append(x)
            cols = [np.concatenate(r) if r else np.zeros(0, np.int64) for r in rows]
            doc = pa.array(ids, pa.int64()).take(pa.array(cols[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c.astype(np.int64)) for c in cols[1:])], schema=_OUT)

    return run


def section_tokens(docs: DataFrame, ranks: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """(doc_id, section, start_char, end_char, start_byte, end_byte, n_tokens, n_crossing) of the sections of every row of docs.

    sections: a column of arrays of (start, end), in characters, end not included, numbered in their order; without it sections are lines with their
    line feeds. Sections that are null, or hold a null, are empty ones at the start; they are cut to the text, and one that overlaps another begins where
    that ends. n_tokens sum up to the tokens of the whole document, whichever the rule (see RULES), with a row of section -1 for those in
    no section, if any; n_crossing of them reach beyond their section. Null and empty texts have one empty line, or empty sections. Repeated
    rows are repeated.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *([docs[sections].alias("sections")] if sections else []))
    return d.mapInArrow(_run(ranks, rule, sections is not None), ", ".join(f"{n} long" for n in _NAMES))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
