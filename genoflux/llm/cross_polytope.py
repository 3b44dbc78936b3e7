"""Approximate nearest neighbours by cross-polytope hashing with several probes, ranked exactly.

A table rotates vectors by three rounds of random signs and a fast Hadamard transform and assigns each to the
nearest signed axis. A query looks at the members of its nearest axes in every table. Neighbouring axes are put together
to blocks of bounded size: a vector is sent once to each block that it has to do with, where its axes are found anew, the members
of each axis meet the queries that probe it by a matrix product, and the best of each query are kept.

Members are hashed apart by length of vector and by norm, in powers of two, so that a few long ones don't push the others
onto one axis. Queries that found too few meet the whole table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bytekit import U64, mix
from .cluster import materialise, parts, read, ship

#: Tables, and the share of its signed axes that a query probes in each.
TABLES, PROBED = 2, 0.45
#: Members of a block, and queries that meet them in one task.
BLOCK, ASKED = 8192, 1 << 16
#: Members up to which a norm class is searched exactly; 0: all are hashed.
SMALL = 0


def hadamard(a: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; the length is a power of two."""
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, d // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return a / np.sqrt(d)


def axes(x: np.ndarray, table: int, probes: int, seed: int = 7) -> np.ndarray:
    """The nearest signed axes (2 * axis + 1 if negative) of each row after the table's rotation, nearest first."""
    rng = np.random.default_rng([seed, table, x.shape[1]])
    y = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], x.shape[1]))
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose nearest by angle are the nearest by inner product: members get the coordinate that fills
    them up to the longest norm, queries a zero; padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, 1 << int(d).bit_length()))
    if query:
        out[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        out[:, :d] = x / longest
        out[:, d] = np.sqrt(np.maximum(0, 1 - (out[:, :d] ** 2).sum(axis=1)))
    return out


def _matrix(col) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length among the lists of a column."""
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(off)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[off[rows][:, None] + np.arange(d)[None, :]]))
    return out


class Blocks:
    """Which block of members an axis belongs to. counts: members by (length, class, table) and axis; table -1 isn't hashed."""

    def __init__(self, counts: dict[tuple[int, int, int], np.ndarray], longest: dict[tuple[int, int], float], most: int, probes: int | None):
        self.longest, self.probes, self.first, self.parts, self.of = longest, probes, {}, {}, []
        for key in sorted(counts):
            n = counts[key]
            first, parts = np.zeros(len(n), np.int64), np.maximum(1, -(-n // most))
            block, held = len(self.of), 0
            for axis in range(len(n)):
                if held and held + n[axis] > most:
                    block, held = len(self.of), 0
                first[axis] = block
                while len(self.of) < block + parts[axis]:
                    self.of.append(key)
                held = held + n[axis] if parts[axis] == 1 else most
            self.first[key], self.parts[key] = first, parts
        self.keys = sorted(self.first)

    def probed(self, dim: int) -> int:
        width = 2 << int(dim).bit_length()
        return min(width, max(1, self.probes or round(PROBED * width)))

    def axes_of(self, key: tuple[int, int, int], x: np.ndarray, query: bool) -> np.ndarray:
        """The axes of each row: a member's own, or those that a query probes."""
        dim, cls, table = key
        if table < 0:
            return np.zeros((len(x), 1), np.int64)
        return axes(lifted(x, 1.0 if query else self.longest[dim, cls], query), table, self.probed(dim) if query else 1)

    def members(self, key: tuple[int, int, int], x: np.ndarray, node: np.ndarray) -> np.ndarray:
        axis = self.axes_of(key, x, False)[:, 0]
        own = mix(node.astype(np.int64).view(np.uint64)) % self.parts[key][axis].astype(np.uint64)
        return self.first[key][axis] + own.astype(np.int64)

    def queries(self, key: tuple[int, int, int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks that a query's probes are in."""
        axis, n = self.axes_of(key, x, True), len(self.of)
        row = np.repeat(np.arange(len(x)), axis.shape[1])
        parts = self.parts[key][axis.ravel()]
        first = np.repeat(self.first[key][axis.ravel()], parts) + np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        both = np.unique(np.repeat(row, parts) * n + first)
        return both // n, both % n


def _count(longest: dict[tuple[int, int], float], tables: int):
    """Members by length, class, table and axis."""
    names = ["dim", "cls", "tab", "axis", "n"]

    def run(batches):
        for b in batches:
            of = b.column(1).to_numpy()
            for rows, x in _matrix(b.column(2)):
                dim = x.shape[1]
                for c in np.unique(of[rows]).tolist():
                    if (dim, c) in longest:
                        up = lifted(x[of[rows] == c], longest[dim, c], False)
                        for t in range(tables):
                            axis, n = np.unique(axes(up, t, 1)[:, 0], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), v, np.int32)) for v in (dim, c, t)] + [pa.array(axis.astype(np.int32)), pa.array(n.astype(np.int64))], names)

    return run


_DEALT = "block int, qpart int, kind tinyint, node long, v "


def _deal(blocks: Blocks, qparts: int):
    """Each member once to its block of every table, each query once to every block that it probes. Queries are dealt to qparts parts."""

    def rows_of(b, block, qpart, kind, r):
        columns = [pa.array(block.astype(np.int32)), pa.array(qpart.astype(np.int32)), pa.array(np.full(len(r), kind, np.int8))]
        return pa.RecordBatch.from_arrays([*columns, b.column(0).take(pa.array(r)), b.column(3).take(pa.array(r))], ["block", "qpart", "kind", "node", "v"])

    def run(batches):
        for b in batches:
            node, query, of = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for rows, x in _matrix(b.column(3)):
                dim = x.shape[1]
                part = (mix(node[rows].view(np.uint64) + U64(1)) % U64(qparts)).astype(np.int64)
                ask = np.flatnonzero(query[rows])
                for key in blocks.keys:
                    if key[0] != dim:
                        continue
                    own = np.array([(dim, c) not in blocks.longest if key[2] < 0 else c == key[1] for c in of[rows].tolist()], bool)
                    at = np.flatnonzero(own)
                    if len(at):
                        block = blocks.members(key, x[at], node[rows[at]])
                        yield rows_of(b, np.repeat(block, qparts), np.tile(np.arange(qparts), len(at)), 0, rows[np.repeat(at, qparts)])
                    if len(ask):
                        r, block = blocks.queries(key, x[ask])
                        yield rows_of(b, block, part[ask[r]], 1, rows[ask[r]])

    return run


def exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, always summed in the same order."""
    return (q * m).sum(axis=1)


def _best(q: np.ndarray, m: np.ndarray, score: np.ndarray, top: int):
    """The best of each q, by score and then m; pairs that were found more than once count once."""
    order = np.lexsort((m, -score, q))
    q, m, score = q[order], m[order], score[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (m[1:] != m[:-1])] if len(q) else np.zeros(0, bool)
    q, m, score = q[new], m[new], score[new]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < top
    return q[keep], m[keep], score[keep]


_PAIRS = "q long, m long, score double"
_BLOCKS = "part int, n int, body binary"


def _packed(deal: int, q: np.ndarray, m: np.ndarray, score: np.ndarray) -> pa.Table:
    """Pairs as columns of bytes, dealt by query to `deal` parts: a row for each part, not for each pair."""
    part = (mix(q.astype(np.int64).view(np.uint64)) % U64(deal)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
    body = [q[c].astype("<i8").tobytes() + m[c].astype("<i8").tobytes() + score[c].astype("<f8").tobytes() for c in cuts]
    return pa.table({"part": pa.array([int(part[c[0]]) for c in cuts], pa.int32()), "n": pa.array([len(c) for c in cuts], pa.int32()), "body": pa.array(body, pa.binary())})


def _meet(blocks: Blocks, top: int, deal: int):
    def run(key, table):
        of = blocks.of[int(key[0].as_py())]
        kind, node = table.column("kind").to_numpy(), table.column("node").to_numpy()
        qs, ms, ss = [], [], []
        for rows, x in _matrix(table.column("v").combine_chunks()):
            m, q = rows[kind[rows] == 0], rows[kind[rows] == 1]
            xm, xq = x[kind[rows] == 0], x[kind[rows] == 1]
            if not len(m) or not len(q):
                continue
            axis = blocks.axes_of(of, xm, False)[:, 0]
            order = np.argsort(axis, kind="stable")
            m, xm, axis = m[order], xm[order], axis[order]
            at = np.flatnonzero(np.r_[True, axis[1:] != axis[:-1]])
            to = np.r_[at[1:], len(axis)]
            for i in range(0, len(q), 512):
                some = xq[i : i + 512]
                probes = blocks.axes_of(of, some, True)
                s = np.full((len(some), len(m)), -np.inf)
                for a, z in zip(at.tolist(), to.tolist()):
                    r = np.flatnonzero((probes == axis[a]).any(axis=1))
                    s[r, a:z] = some[r] @ xm[a:z].T
                k = min(top, s.shape[1])
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                a, z = np.nonzero((s >= least[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))[:, None]) & np.isfinite(s))  # near ties too: the exact order decides
                qs.append(node[q[i + a]])
                ms.append(node[m[z]])
                ss.append(exact(some[a], xm[z]))
        none = np.zeros(0, np.int64)
        return _packed(deal, *(_best(np.concatenate(qs), np.concatenate(ms), np.concatenate(ss), top) if qs else (none, none, np.zeros(0))))

    return run


def _merge(top: int):
    def run(table):
        cols = [[np.zeros(0, t)] for t in ("<i8", "<i8", "<f8")]
        for n, cell in zip(table.column("n").to_pylist(), table.column("body")):
            raw = cell.as_buffer()
            for k, c in enumerate(cols):
                c.append(np.frombuffer(raw, c[0].dtype, n, 8 * n * k))
        q, m, s = _best(*(np.concatenate(c) for c in cols), top)
        return pa.table({"q": pa.array(q, pa.int64()), "m": pa.array(m, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    ok = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok)


def _nearest(nodes: DataFrame, blocks: Blocks, top: int, deal: int, asked: int) -> DataFrame:
    """(q, m, score): the best `top` members of each query among those that it looks at; nodes has node, q, cls, v."""
    vector = dict(nodes.dtypes)["v"]
    dealt = nodes.select("node", "q", "cls", "v").mapInArrow(_deal(blocks, -(-asked // ASKED) or 1), _DEALT + vector)
    pairs = dealt.groupBy("block", "qpart").applyInArrow(_meet(blocks, top, deal), _BLOCKS)
    return pairs.groupBy("part").applyInArrow(_merge(top), _PAIRS)


def _vectors(v: DataFrame, top: int) -> DataFrame:
    """node (in the order of the smallest vec_id), q, v, ids, norm, cls of each different vector: its smallest top + 1 ids, and whether one asks.

    Vectors are told apart by 128 bits, so that they themselves are shuffled once; ids are counted in two steps, so that a vector of very many rows
    is no task of its own."""
    ids = v.select("vec_id", "q", "h1", "h2").distinct()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    few = ids.withColumn("n", F.row_number().over(W.partitionBy("h1", "h2", salt).orderBy("vec_id"))).where(F.col("n") <= top + 1)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    few = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.groupBy("h1", "h2").agg(F.max("q").alias("q"))
    few = few.join(asked, ["h1", "h2"]).sort(F.col("ids")[0], "h1", "h2").withColumn("node", F.monotonically_increasing_id())
    few = materialise(few, "ann-ids")
    nodes = v.groupBy("h1", "h2").agg(F.first("embedding").alias("v")).join(few, ["h1", "h2"])
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("size"), F.lit(2.0)))
    nodes = nodes.withColumn("size", size).withColumn("norm", F.col("size") * F.sqrt(square)).drop("size")
    # 1 is in the middle of its class: unit vectors stay together whatever their rounding
    return materialise(nodes.withColumn("cls", F.floor(F.log2("norm") + 0.5).cast("int")), "ann-vectors")


def search(vectors: DataFrame, query: str, top: int = 20, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to each row of vectors (vec_id, embedding) for which `query` holds.

    Nearest by inner product in double precision, over all rows but the query's own; ties go to the smaller vec_id.
    probes: axes that a query looks at in a table (a share PROBED of all, if not given). Every query gets `top` rows, or all candidates where
    there are fewer. Rows whose vector is null, zero or has null or non-finite components, or whose vec_id is null, take no part;
    vectors of different lengths don't meet. Equal vectors are searched once: of each, the smallest top + 1 ids
    can appear, and no more are kept. A repeated row is one row; rows that share a vec_id alone are searched one by one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = usable(vectors).withColumn("q", F.expr(query)).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    nodes = _vectors(v, top)
    dim = F.size("v").alias("dim")
    per_class = nodes.groupBy(dim, "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("asked"), F.max("norm").alias("longest")).collect()
    longest = {(r.dim, r.cls): r.longest for r in per_class if r.n > SMALL}
    asked = sum(r.asked for r in per_class)
    counts, total = {}, defaultdict(int)
    for r in per_class:
        total[r.dim] += r.n
        if (r.dim, r.cls) not in longest:
            counts[r.dim, 0, -1] = counts.get((r.dim, 0, -1), np.zeros(1, np.int64)) + r.n
    if longest:
        hashed = nodes.select("node", "cls", "v").mapInArrow(_count(longest, tables), "dim int, cls int, tab int, axis int, n long")
        for r in hashed.groupBy("dim", "cls", "tab", "axis").agg(F.sum("n").alias("n")).collect():  # a row for each axis of each class at most
            counts.setdefault((r.dim, r.cls, r.tab), np.zeros(2 << int(r.dim).bit_length(), np.int64))[r.axis] = r.n
    deal = max(parts(spark), asked // 64)
    best = _nearest(nodes, Blocks(counts, longest, BLOCK, probes), top + 1, deal, asked)
    if longest:
        best = materialise(best, "ann-best")
        # a query that found fewer vectors than there are, and than it needs, meets all of its length
        need = spark.createDataFrame([(d, min(n, top + 1)) for d, n in total.items()], "dim int, need long")
        had = best.groupBy("q").agg(F.count(F.lit(1)).alias("had"))
        short = nodes.where("q").select(dim, "node").join(F.broadcast(need), "dim").join(had, F.col("node") == F.col("q"), "left")
        short = materialise(short.where(F.coalesce("had", F.lit(0)) < F.col("need")).select("node", F.lit(True).alias("short")), "ann-short")
        n = short.count()
        if n:
            every = Blocks({(d, 0, -1): np.array([k]) for d, k in total.items()}, {}, BLOCK, None)
            all_of = nodes.select("node", "cls", "v").join(short, "node", "left").withColumn("q", F.coalesce("short", F.lit(False)))
            best = best.join(short.select(F.col("node").alias("q")), "q", "left_anti").unionByName(_nearest(all_of, every, top + 1, deal, n))
    # from vectors to rows: the first top + 1 ids of each asked vector, of which a query leaves itself out
    found = best.join(nodes.select(F.col("node").alias("m"), "ids"), "m").select("q", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= top + 1)
    found = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")).withColumnRenamed("q", "node")
    asks = v.where("q").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    left = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = asks.join(found, "node").select("query_id", F.posexplode(left).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES = {"op7_cross_polytope": op7_cross_polytope}
SQL: dict[str, str] = {}
