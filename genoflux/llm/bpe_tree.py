"""Byte-level BPE as a monoid tree: halves are encoded by themselves and joined at their boundary."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import read, ship

#: Characters that a leaf encodes at once; a first window on either side of a boundary.
LEAF, WINDOW = 512, 24
#: A match of the pattern is settled by what it has read. It reads on at most past its end by two characters
#: (an apostrophe and two letters), so matches that end this far before the end of a text stay when text is appended.
LOOKAHEAD = 3


class Part:
    """Tokens of a piece of text, and where in it the pattern's matches start (in characters)."""

    __slots__ = ("text", "starts", "ids")

    def __init__(self, text: str, starts: list[int], ids: np.ndarray):
        self.text, self.starts, self.ids = text, starts, ids


class TreeEncoder:
    """Encodes a text as tiktoken would, from the encodings of its halves.

    A leaf runs the pattern and the merges over a piece of text. To join two neighbours, the text from a match
    that is surely a match of the whole (see LOOKAHEAD) to some way into the right neighbour is encoded anew. As
    soon as the new matches and the right neighbour's own agree on a start, they agree from there on, as the
    pattern reads only forwards from a start; the tokens of each match depend on the match alone. Until then
    the window grows, on the right by doubling, on the left by starting earlier.
    """

    def __init__(self, encoding, leaf: int = LEAF, window: int = WINDOW):
        import regex

        self.encoding, self.leaf, self.window = encoding, leaf, window
        self.pattern = regex.compile(encoding._pat_str)
        self.joins = 0

    def _starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def _leaf(self, text: str) -> Part:
        return Part(text, self._starts(text), self.encoding.encode_to_numpy(text, disallowed_special=()))

    def _each(self, text: str, starts: list[int], end: int) -> list[int]:
        """Tokens of the matches of text that start at `starts`, the last of which ends at `end`."""
        single, ids = self.encoding._core_bpe.encode_single_piece, []
        for a, z in zip(starts, [*starts[1:], end]):
            ids += single(text[a:z].encode("utf-8", "surrogatepass"))
        return ids

    def join(self, left: Part, right: Part) -> Part:
        if not left.text or not right.text:
            return right if not left.text else left
        self.joins += 1
        n, k = len(left.text), self.window
        while True:
            # the last match of the left part that starts where nothing appended can have changed the matches before it
            at = max(0, bisect_right(left.starts, n - LOOKAHEAD - k) - 1)
            begin = left.starts[at]
            if at and left.text[begin:n].isspace():
                k *= 2  # white space up to the boundary is one run with what follows: start before it
                continue
            take = min(len(right.text), k)
            middle = left.text[begin:] + right.text[:take]
            starts = self._starts(middle)
            shift = begin - n  # from places in the middle to the right part's
            # a start found anew counts only as far as more text could not move it
            sure = take if take == len(right.text) else take - 2 * LOOKAHEAD
            m, r, meet = bisect_left(starts, -shift), 0, None
            while m < len(starts) and starts[m] + shift <= sure:
                r = bisect_left(right.starts, starts[m] + shift, r)
                if r < len(right.starts) and right.starts[r] == starts[m] + shift:
                    meet = right.starts[r]
                    break
                m += 1
            if meet is not None and take < len(right.text) and right.text[meet:take].isspace():
                meet = None
            if meet is not None or take == len(right.text):
                break
            k *= 2
        if meet is None:
            m, r, meet = len(starts), len(right.starts), len(right.text)
        # only tokens next to the boundary are looked at: those that go on the left and on the right, and those that come in between
        gone_left = len(self._each(left.text, left.starts[at:], n))
        gone_right = len(self._each(right.text, right.starts[:r], meet))
        new = self._each(middle, starts[:m], n - begin + meet)
        ids = np.concatenate([left.ids[: len(left.ids) - gone_left], np.array(new, left.ids.dtype), right.ids[gone_right:]])
        return Part(left.text + right.text, left.starts[:at] + [x + begin for x in starts[:m]] + [x + n for x in right.starts[r:]], ids)

    def _tree(self, text: str) -> Part:
        if len(text) <= self.leaf:
            return self._leaf(text)
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text).ids


def decode(encoding, ids: np.ndarray, leaf: int = 256) -> bytes:
    """Bytes of the tokens, concatenated up the tree."""
    if len(ids) <= leaf:
        return encoding.decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode(encoding, ids[:half], leaf) + decode(encoding, ids[half:], leaf)


def _run(path: str, leaf: int):
    def run(batches):
        from .tokenizers import byte_bpe

        encoding = byte_bpe(path)
        tree = TreeEncoder(encoding, leaf)
        for b in batches:
            ids = [tree.encode(t or "").astype(np.int32) for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([decode(encoding, x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, ranks: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row of docs; null and empty texts have no ids.

    ranks: path of a file of ranks on every machine. Texts are handled one by one, whole; the tree bounds what is
    encoded at once. Repeated rows are repeated; other columns are ignored.
    """
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return d.mapInArrow(_run(ranks, leaf), "doc_id long, ids array<int>, decoded binary")


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op4_bpe_tree": op4_bpe_tree}
SQL: dict[str, str] = {}
