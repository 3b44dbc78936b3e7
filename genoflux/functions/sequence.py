"""Functions of nucleotide strings, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoflux.shipping import ship

#: Bytes of strings that a task looks at together.
TOGETHER = 8 << 20
#: Substrings that a task looks at together, different ones that it counts before it passes them on, rows of a batch of them, and substrings of a list that it holds.
AT_ONCE, COUNTED, PASSED, LISTED = 1 << 18, 1 << 20, 1 << 16, 1 << 23


def base_code(c: Column) -> Column:
    """A, C, G, T in either case: 0..3; others: null."""
    k = F.instr(F.lit("ACGT"), F.upper(c)) - 1
    return F.when((F.length(c) == 1) & (k >= 0), k)


def code_base(k: Column) -> Column:
    return F.when(k.between(0, 3), F.substring(F.lit("ACGT"), k + 1, F.lit(1)))


def revcomp(s: Column) -> Column:
    """Reverse complement in the same case; letters other than A, C, G, T become X."""
    return F.translate(F.regexp_replace(F.reverse(s), "(?s)[^ACGTacgt]", "X"), "ACGTacgt", "TGCAtgca")


def canonical(s: Column) -> Column:
    return F.least(s, revcomp(s))


def is_flipped(s: Column) -> Column:
    return s > revcomp(s)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def hamming_any(a: Column, b: Column) -> Column:
    """The smaller of the distances to b and to its reverse complement."""
    return F.least(hamming(a, b), hamming(a, revcomp(b)))


def align_score(a: Column, b: Column) -> Column:
    return F.when((a == "-") | (b == "-"), -10000).when(F.upper(a) == F.upper(b), 100).otherwise(0)


def flip_coordinate(p: Column, length: Column) -> Column:
    return length - p + 1


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def bowtie_read_id(v: Column) -> Column:
    return F.regexp_extract(v, r"^(\d+)[+-]", 1).cast("bigint")


def chromosome_of(path: Column) -> Column:
    """The last name that starts with chr, up to its point."""
    return F.regexp_extract(path, r".*(chr[^.]*)\.", 1)


def make_string(x: Column) -> Column:
    """A value as text: broken numbers with six digits that count, truth values as 1 and 0, nulls as nothing; others as they are."""
    kind = F.typeof(x)
    broken = F.format_string("%.5e", x.cast("double"))
    ten = F.regexp_extract(broken, "e(.*)$", 1).cast("int")
    # a plain number up to six places before the point and four after it, else a power of ten; without zeros at the end
    digits = F.regexp_replace(F.regexp_extract(broken, "^-?([0-9.]+)e", 1), r"[.]?0+$", "")
    rounded = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", broken.cast("double")), r"0+$", ""), r"[.]$", "")
    sign = F.when(x.cast("double") < 0, "-").otherwise("")
    far = F.concat(sign, digits, F.lit("e"), F.when(ten < 0, "-").otherwise("+"), F.when(F.abs(ten) < 10, "0").otherwise(""), F.abs(ten).cast("string"))
    text = F.when((ten >= -4) & (ten < 6), rounded).otherwise(far)
    return F.coalesce(F.when(kind.isin("float", "double"), text).when(kind == "boolean", x.cast("int").cast("string")).otherwise(x.cast("string")), F.lit(""))


def make_int(s: Column) -> Column:
    """The whole number that a text begins with after blanks, 0 if it begins with none."""
    return F.coalesce(F.regexp_extract(s, r"^[\x20\x09-\x0D]*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def flip(c: Column) -> Column:
    return ~c


def random_between(low: int, high: int, seed: int | None = None) -> Column:
    """A random whole number from low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint")


def pieces(s: Column, size: int) -> Column:
    """Consecutive pieces of `size` letters, the last maybe shorter; one pass over the string, where a substring for
    each piece would count letters from the start every time."""
    return F.filter(F.split(s, rf"(?s)(?<=\G.{{{size}}})"), lambda x: x != "")


def letter_stretches(strings: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive strings, some TOGETHER bytes at once: (number of the first, their letters as code points, where each begins and the end of all)."""
    a = strings.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + TOGETHER, "right")) - 1)
        raw, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(raw) and raw.max() > 127:
            at = at - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), at)  # without the further bytes of letters
            raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        yield i, raw, at
        i = j


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(id, start, kmer): every substring of length k of each sequence (id, seq), from 1."""
    size = max(256, k)
    d = seqs.where(F.length("seq") >= k).select("id", pieces(F.col("seq"), size).alias("p"))
    d = d.select("id", F.posexplode(F.transform("p", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("p", i + 1), 1, k - 1), F.lit(""))))).alias("n", "s"))
    # the k-mers are k times the text, and a sequence may be one row: deal the pieces out before they grow
    d = d.where(F.length("s") >= k).repartition("id", "n").select("id", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.length("s") - k + 1, F.lit(size)))).alias("j"))
    return d.select("id", (F.col("n") * size + F.col("j")).alias("start"), F.substring("s", F.col("j"), F.lit(k)).alias("kmer"))


class _Letters:
    """Numbers of letters, and keys of substrings of k letters that are equal if the substrings are: whole numbers of 63 // k bits a letter as long as the
    letters' numbers fit these, else the letters side by side."""

    def __init__(self, k: int):
        self.k, self.bits = k, 63 // k
        self.known = np.zeros(0, np.int64)  # letters by number
        self.number = np.full(256, -1, np.int64)

    def learn(self, cp: np.ndarray) -> None:
        """Give letters that are new a number."""
        if len(cp) and cp.max() >= len(self.number):
            self.number = np.r_[self.number, np.full(int(cp.max()) + 1 - len(self.number), -1, np.int64)]
        there = np.zeros(len(self.number), bool)
        there[cp] = True
        new = np.flatnonzero(there & (self.number < 0))
        self.number[new] = len(self.known) + np.arange(len(new))
        self.known = np.r_[self.known, new]

    @property
    def small(self) -> bool:
        return len(self.known) <= 1 << self.bits

    def keys(self, cp: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, key) of the substrings that begin at lo to hi - 1 in strings which begin at `at`, and have no letter without a number."""
        k, n = self.k, hi - lo
        part = cp[lo : hi + k - 1]
        ok = np.ones(n, bool)
        ends = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi + k - 1, "right")] - lo
        for j in range(1, k):
            x = ends - j
            ok[x[(x >= 0) & (x < n)]] = False
        code = np.zeros(n + k - 1, np.int64)
        code[: len(part)] = part
        far = code >= len(self.number)  # letters beyond the last number have none either
        code[: len(part)] = self.number[np.where(far, 0, code)[: len(part)]]
        code[far] = -1
        if code.min(initial=0) < 0:
            for j in range(k):
                ok &= code[j : j + n] >= 0
            code = np.maximum(code, 0)
        start = np.flatnonzero(ok)
        if self.small:
            key = np.zeros(n, np.int64)
            for j in range(k):
                key = key << self.bits | code[j : j + n]
            return lo + start, key[ok]
        letters = np.zeros(n + k - 1, "<u4")
        letters[: len(part)] = part
        return lo + start, self._void(np.lib.stride_tricks.sliding_window_view(letters, k)[start])

    def _void(self, letters: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(letters).view(np.dtype((np.void, 4 * self.k))).ravel()

    def _letters(self, keys: np.ndarray) -> np.ndarray:
        if keys.dtype != np.int64:
            return keys.view("<u4").reshape(-1, self.k)
        mask = (1 << self.bits) - 1
        return np.stack([self.known[keys >> self.bits * (self.k - 1 - j) & mask] for j in range(self.k)], axis=1).astype("<u4")

    def side(self, keys: np.ndarray) -> np.ndarray:
        """Whole numbers as keys of the other kind."""
        return self._void(self._letters(keys))

    def spelt(self, keys: np.ndarray) -> pa.Array:
        """The substrings of keys."""
        if not len(keys):
            return pa.array([], pa.string())
        letters = self._letters(keys)
        wide = 1 + (letters > 0x7F).astype(np.int32) + (letters > 0x7FF) + (letters > 0xFFFF)
        size = np.r_[0, np.cumsum(wide.sum(axis=1))].astype(np.int32)
        return pa.StringArray.from_buffers(len(keys), pa.py_buffer(size.tobytes()), pa.py_buffer(letters.tobytes().decode("utf-32-le").encode()))


class _Tally:
    """How often substrings of k letters occur, in sorted tables that are put together when they hold COUNTED rows, and passed on when that leaves over half as many."""

    def __init__(self, k: int):
        self.letters, self.tables, self.rows = _Letters(k), [], 0

    def add(self, cp: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        was = self.letters.small
        self.letters.learn(cp[lo : hi + self.letters.k - 1])
        if was and not self.letters.small:
            yield from self.rest()  # keys of the other kind
        _, key = self.letters.keys(cp, at, lo, hi)
        if not len(key):
            return
        self.tables.append(np.unique(key, return_counts=True))
        self.rows += len(self.tables[-1][0])
        if self.rows > COUNTED:
            self._join()
            if self.rows > COUNTED // 2:
                yield from self.rest()

    def _join(self) -> None:
        if len(self.tables) > 1:
            key, n = (np.concatenate(x) for x in zip(*self.tables))
            self.tables = []
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.tables, self.rows = [(key[first], np.add.reduceat(n, first))], len(first)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is held, in batches."""
        self._join()
        for key, n in self.tables:
            for i in range(0, len(key), PASSED):
                yield pa.RecordBatch.from_arrays([self.letters.spelt(key[i : i + PASSED]), pa.array(n[i : i + PASSED])], ["kmer", "n"])
        self.tables, self.rows = [], 0


def _listed(path: str, k: int) -> Iterator[tuple[_Letters, np.ndarray]]:
    """The substrings of k letters that a table of kmer has, as sorted keys with their letters, some LISTED rows at once."""
    import pyarrow.parquet as pq

    from genoflux.sources import store

    letters, held, rows = _Letters(k), [], 0
    for p, _ in store.listed(path, ".parquet"):
        with store.opened(p) as f:
            for b in pq.ParquetFile(f).iter_batches(PASSED, columns=["kmer"]):
                for _, cp, at in letter_stretches(b.column(0)):
                    was = letters.small
                    letters.learn(cp)
                    if was and not letters.small:
                        held = [letters.side(x) for x in held]
                    held.append(letters.keys(cp, at, 0, len(cp))[1])
                    rows += len(held[-1])
                if rows >= LISTED:
                    yield letters, np.sort(np.concatenate(held))
                    letters, held, rows = _Letters(k), [], 0
    if rows:
        yield letters, np.sort(np.concatenate(held))


def _dealt(seqs: DataFrame, k: int) -> DataFrame:
    """Sequences with substrings of length k; a few rows or files may hold them all, so that they are dealt out to the tasks."""
    return seqs.where(F.length("seq") >= k).select("id", "seq").repartition("id")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often every substring of length k occurs in the sequences (id, seq); counted in each task, in bounded memory, then summed."""

    def run(batches):
        tally = _Tally(k)
        for b in batches:
            for _, cp, at in letter_stretches(b.column(0)):
                for lo in range(0, len(cp), AT_ONCE):
                    yield from tally.add(cp, at, lo, min(lo + AT_ONCE, len(cp)))
        yield from tally.rest()

    ship(seqs.sparkSession)
    return _dealt(seqs, k).select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def covered_by(seqs: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(id, start, end): stretches of each sequence (id, seq) that the substrings listed in kmers (kmer) cover, closed and from 1. Tasks read the list
    from the shared folder, so that no substring is sent to it; a long list is gone through in parts for each stretch of letters."""
    from genoflux.scratch import new_path

    path = new_path(seqs.sparkSession, "kmers")
    kmers.select("kmer").write.parquet(path)

    def run(batches):
        parts = _listed(path, k)
        held = [x for x in (next(parts, None),) if x is not None]
        if more := next(parts, None) is not None:
            held = []
        parts.close()
        for b in batches:
            for i, cp, at in letter_stretches(b.column(1)):
                hit = np.zeros(len(cp), bool)
                for letters, often in _listed(path, k) if more else held:
                    for lo in range(0, len(cp), AT_ONCE):
                        start, key = letters.keys(cp, at, lo, min(lo + AT_ONCE, len(cp)))
                        each, which = np.unique(key, return_inverse=True)
                        place = np.minimum(np.searchsorted(often, each), len(often) - 1)
                        hit[start[(often[place] == each)[which]]] = True
                for start, end in _stretches(hit, k):
                    who = np.searchsorted(at, start, "right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + who)), pa.array(start - at[who] + 1), pa.array(end - at[who])], ["id", "start", "end"])

    ship(seqs.sparkSession)
    d = _dealt(seqs, k)
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, start long, end long")


def _stretches(hit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, end), the end not included, of what is covered by the k places from each hit on, some at once. Strings' last k - 1 places are no hits, so
    that none goes on into the next."""
    begun = last = None
    for lo in range(0, len(hit), AT_ONCE):
        x = lo + np.flatnonzero(hit[lo : lo + AT_ONCE])
        if not len(x):
            continue
        cut = np.flatnonzero(np.diff(x) >= k)
        start, end = np.r_[x[0], x[cut + 1]], np.r_[x[cut], x[-1]] + k
        if begun is not None:
            if x[0] - last < k:
                start[0] = begun
            else:
                start, end = np.r_[begun, start], np.r_[last + k, end]
        begun, last = int(start[-1]), int(x[-1])
        if len(start) > 1:
            yield start[:-1], end[:-1]
    if begun is not None:
        yield np.array([begun]), np.array([last + k])


def mask_same_columns(strings: DataFrame, by: str, order: str, s: str) -> DataFrame:
    """Strings of each group with a blank where all of the group have the same letter; strings of a group have one length."""
    letters = strings.select(by, F.posexplode(F.split(s, "")).alias("_k", "_c"))
    kinds = letters.groupBy(by, "_k").agg((F.min("_c") == F.max("_c")).alias("same"))
    # a row for each group, so that strings aren't taken apart to be put together again
    same = kinds.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "same"))), lambda x: x["same"]).alias("_same"))
    shown = F.zip_with(F.split(s, ""), "_same", lambda c, x: F.when(x, " ").otherwise(c))
    return strings.join(same, by).select(by, order, F.array_join(shown, "").alias("masked"))
