"""SentencePiece vocabularies of the merge type: an agenda of adjacent symbol pairs, ordered by score."""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import read, ship

#: Segments of more characters have a heap of their own, shorter ones are merged side by side; characters of a text that are cut up at once.
LONG, WINDOW = 128, 1 << 18
#: Segments of at most LONG characters that a worker keeps with their ids; past that many all are forgotten. Plan only.
KEPT = 1 << 20
SPACE = "▁"
_NONE = 1 << 30


class PieceModel:
    """Encodes and decodes as the sentencepiece library does with a merge-type vocabulary with byte fallback.

    A text is normalised by the library's own rules and cut wherever no piece of the vocabulary has the two
    characters next to each other: no merge can cross such a place, so that each segment between two of them
    has an agenda of its own. An agenda holds the adjacent pairs of symbols that make up a piece; the one of best score,
    the leftmost of several, is merged, and its new neighbours come in. Equal segments are merged once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = np.full(256, -1, np.int64)
        normal: dict[str, int] = {}
        self.surface: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                normal[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.is_led = np.zeros(n, bool)
        self.is_led[[i for p, i in normal.items() if p[0] == SPACE]] = True
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_id] = True
        self.prefix = sp.normalize("a") == SPACE + "a"
        self.plain = all(sp.normalize(t) == SPACE * self.prefix + t.replace(" ", SPACE) for t in ("a  b ", " éé ﬁ ①　 x\t\n", "\x00\x01​"))
        # symbols: the pieces, and characters of pieces that are none themselves
        symbol = {p: k for k, p in enumerate(normal)}
        for c in sorted({c for p in normal for c in p} - set(symbol)):
            symbol[c] = len(symbol)
        self.symbol, self.size = symbol, len(symbol) + 1
        self.id_of = np.array([normal.get(p, -1) for p in symbol] + [-1], np.int64)
        scores = {p: sp.get_score(i) for p, i in normal.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p in normal:
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * self.size + symbol[p[k:]]] = (order[scores[p]], symbol[p])
        self.pairs = pairs
        self.pair_code = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[x][0] for x in self.pair_code.tolist()], np.int64)
        self.pair_made = np.array([pairs[x][1] for x in self.pair_code.tolist()], np.int64)
        # which characters may stand next to each other in a piece
        near = sorted({c for p in normal if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in near]] = np.arange(1, len(near) + 1)
        self.joins = np.zeros((len(near) + 1, len(near) + 1), bool)
        for p in normal:
            for a, b in zip(p, p[1:]):
                self.joins[self.kind[ord(a)], self.kind[ord(b)]] = True
        self.char_symbol = np.full(0x110000, self.size - 1, np.int64)
        for c, k in symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = k
        #: whether segments can be held against the library apart from their texts
        self.apart, self.check = self.plain and self.kind[10] == 0 and len(sp.encode("\n")) == 1 + self.prefix, False
        self.kept: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """The text as the library's normaliser leaves it, blanks as U+2581."""
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else text

    def cuts(self, text: str) -> np.ndarray:
        """Places in a normalised text that no merge can cross, with its start and end."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        return np.concatenate([[0], np.flatnonzero(~self.joins[kind[:-1], kind[1:]]) + 1, [len(text)]])

    def _ids(self, text: str, symbols: list[int], sizes: list[int]) -> bytes:
        out, at = [], 0
        for s, n in zip(symbols, sizes):
            i = int(self.id_of[s])
            if i >= 0:
                out.append(i)
            else:
                out += self.byte_id[list(text[at : at + n].encode())].tolist()
            at += n
        return np.array(out, np.int32).tobytes()

    def agenda(self, text: str) -> bytes:
        """Ids (32 bits each) of one segment, by a heap of its pairs."""
        pairs, size = self.pairs, self.size
        sym = [self.symbol.get(c, size - 1) for c in text]
        n = len(sym)
        before, after, length = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        heap = [(p[0], i, 2, p[1]) for i in range(n - 1) if (p := pairs.get(sym[i] * size + sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, both, made = heapq.heappop(heap)
            j = after[i] if length[i] else -1
            if j < 0 or length[i] + length[j] != both:
                continue  # one of the two has been merged since
            sym[i], length[i], length[j] = made, both, 0
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := pairs.get(made * size + sym[k]):
                    heapq.heappush(heap, (p[0], i, both + length[k], p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get(sym[h] * size + made)):
                heapq.heappush(heap, (p[0], h, length[h] + both, p[1]))
        left = [i for i in range(n) if length[i]]
        return self._ids(text, [sym[i] for i in left], [length[i] for i in left])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the score of what each pair makes, and the symbol that it makes."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where(self.pair_code[at] == code, self.pair_rank[at], _NONE), self.pair_made[at]

    def agendas(self, texts: list[str]) -> list[bytes]:
        """Ids of many segments: in each round the top of every segment's agenda is merged; segments without a pair left go out."""
        out = [b""] * len(texts)
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        sym = self.char_symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        seg, length = np.repeat(np.arange(len(texts)), count), np.ones(len(sym), np.int64)
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            at = at[at + 1 < len(sym)]
            at = at[seg[at] == seg[at + 1]]
            rank[at], made[at] = self._rank(sym[at], sym[at + 1])

        look(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
            done = best >= _NONE << 32
            keep = np.ones(len(sym), bool)
            if done.any():
                size = np.diff(np.append(first, len(sym)))
                gone = np.repeat(done, size)
                self._put(out, texts, seg[first[done]], size[done], sym[gone], length[gone])
                keep[gone] = False
            at = best[~done] & 0xFFFFFFFF
            sym[at] = made[at]
            length[at] += length[at + 1]
            keep[at + 1] = False
            rank[at] = _NONE
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, seg, length, rank, made, changed = (x[keep] for x in (sym, seg, length, rank, made, changed))
            before = changed.copy()
            before[:-1] |= changed[1:]
            look(np.flatnonzero(before))
        return out

    def _put(self, out: list, texts: list[str], seg: np.ndarray, size: np.ndarray, sym: np.ndarray, length: np.ndarray) -> None:
        ids = self.id_of[sym]
        odd = np.add.reduceat(ids < 0, np.cumsum(size) - size) > 0
        flat, ends = ids.astype(np.int32).tobytes(), np.cumsum(size).tolist()
        for k, a, z, hard in zip(seg.tolist(), [0, *ends], ends, odd.tolist()):
            out[k] = self._ids(texts[k], sym[a:z].tolist(), length[a:z].tolist()) if hard else flat[4 * a : 4 * z]

    def _pieces(self, texts: list[str]):
        """(number of the text, its next segments): stretches of whole segments of some WINDOW characters at most."""
        for k, t in enumerate(texts):
            s = self.normal(t)
            cuts = self.cuts(s) if s else np.zeros(1, np.int64)
            step = np.unique(np.concatenate([np.searchsorted(cuts, np.arange(0, len(s), WINDOW)), [len(cuts) - 1]]))
            for a, z in zip(step.tolist(), step[1:].tolist()):
                at = cuts[a : z + 1].tolist()
                yield k, at[-1] - at[0], [s[i:j] for i, j in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Segments of some WINDOW characters are merged at a time, whether of many texts or of one."""
        found: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            got = self._segments(set(chain.from_iterable(x for _, x in held)))
            for k, segments in held:
                found[k].append(b"".join(map(got.__getitem__, segments)))

        for k, n, segments in self._pieces(texts):
            held.append((k, segments))
            size += n
            if size >= WINDOW:
                flush()
                held, size = [], 0
        flush()
        return [np.frombuffer(b"".join(x), np.int32) for x in found]

    def _segments(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of each segment; common ones are remembered."""
        new = [x for x in segments if x not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, list(segments)
        short = [x for x in new if len(x) <= LONG]
        made = dict(zip(short, self.agendas(short)))
        self.kept.update(made)
        much = {x: self.agenda(x) for x in new if len(x) > LONG}
        if self.check and self.apart:
            self.compare(made | much)
        return self.kept | much if much else self.kept

    def compare(self, made: dict[str, bytes]) -> None:
        """Hold segments against the library, which gets them as lines of one text: no merge crosses a line feed here."""
        lead = self.library.encode("\n")
        want = np.array(self.library.encode("\n" + "\n".join(made).replace(SPACE, " ")), np.int32).tobytes()
        line = np.array(lead[-1:], np.int32).tobytes()
        if want != np.array(lead, np.int32).tobytes() + line.join(made.values()):
            raise ValueError("the agenda and the library differ on a segment")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for U+2581, without the blank that a text got in front; bytes that are no UTF-8 become U+FFFD each."""
        if not len(ids):
            return ""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        shown = ids[~self.is_control[ids]][:1]
        lead = self.prefix and len(shown) and self.is_led[shown[0]]
        apart = len(shown) and self.is_control[ids].any()  # bytes on either side of a control piece are no one character
        try:
            text = self._mixed(ids) if apart else raw.decode()
        except UnicodeDecodeError:
            text = self._mixed(ids)
        return text[1:] if lead else text

    def _mixed(self, ids: np.ndarray) -> str:
        out, at = [], 0
        edge = np.concatenate([[0], np.flatnonzero(np.diff(self.is_byte[ids])) + 1, [len(ids)]]).tolist()
        for a, z in zip(edge, edge[1:]):
            raw = b"".join(self.surface[i] for i in ids[a:z].tolist())
            at = 0
            while at < len(raw):
                n = next((k for k in (1, 2, 3, 4) if _valid(raw[at : at + k])), 0)
                out.append(raw[at : at + n].decode() if n else "�")
                at += n or 1
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _run(path: str, check: bool):
    def run(batches):
        model = piece_model(path)
        if check and not model.check:
            model.check, model.kept = True, {}
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = model.encode(texts)
            text = [model.decode(x) for x in ids]
            if check:
                for t, x, y in zip(texts, ids, text):
                    # where normalising changes blanks alone, the library gives the text back, U+2581 as blanks
                    back = t.replace(SPACE, " ") if model.plain else model.library.decode(x.tolist())
                    if y != back or not model.apart and model.library.encode(t) != x.tolist():
                        raise ValueError(f"the agenda and the library differ on a text that begins with {t[:80]!r}")
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, model: str, check: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of docs; null and empty texts have no ids.

    model: path of a merge-type sentencepiece model with byte pieces, on every machine. check: of each Arrow batch encode the segments
    that are merged anew with the library as well (whole texts where a model leaves no way to tell segments apart), and hold what is decoded against what it would
    decode; a difference fails. Repeated rows are repeated; other columns are
    ignored. A task holds one batch of texts, and some 20 bytes for each character of the longest.
    """
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return d.mapInArrow(_run(model, check), "doc_id long, ids array<int>, decoded string")


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {"op12_piece_agenda": op12_piece_agenda}
SQL: dict[str, str] = {}
