"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines that occur in too many different documents of a host are taken away; documents of which too little is left are
rejected, as are those that fail rules on their own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialise, read
from .page_lines import SPACES, host_lines, normal_lines, once, page_key

#: Documents of a host that a line may be in: this share of all, but FLOOR in any case and LIMIT at most.
SHARE, FLOOR, LIMIT = 0.02, 5, 500
#: Share of its words that a document must keep.
LEAST_LEFT = 0.75
#: Words up to which windows are sorted by numbers of hash and position, and the bits of a position; beyond it by their words.
PLACE_BITS = 20
PACKED_WORDS = 1 << PLACE_BITS


def words(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def covered(w: str) -> Column:
    """Words of array column w in windows of three words that occur more than once in it.

    Windows are sorted by hash with their position, equal neighbours are repeats, and their positions, sorted, cover
    three words each or as many as lie before the next. Sorting keeps this n log n in rows of any length. Up to
    PACKED_WORDS words hash and position are one number, else a pair of the words themselves and the position. Where neighbours have
    one hash but other words, the text is sorted by the words too, so that the count is exact in any case.
    """
    spans = "aggregate(sequence(0, size({p}) - 2), cast(3 as bigint), (a, j) -> a + least(3, {p}[j + 1] - {p}[j]))"
    cover = f"transform(array({{p}}), p -> case when size(p) = 0 then 0L when size(p) = 1 then 3L else {spans.format(p='p')} end)[0]"
    key = f"(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) & {-1 << PLACE_BITS}L) | i"
    place = f"({{}} & {(1 << PLACE_BITS) - 1}L)"
    other = " or ".join(f"{w}[cast({place.format('s[j]')} as int) + {k}] <> {w}[cast({place.format('s[j - 1]')} as int) + {k}]" for k in range(3))
    # one pass finds the few windows that equal the one before, and only these are looked at further
    again = f"filter(sequence(1, size(s) - 1), j -> shiftright(s[j] ^ s[j - 1], {PLACE_BITS}) = 0)"
    places = f"sort_array(array_distinct(concat(transform(m, j -> {place.format('s[j - 1]')}), transform(m, j -> {place.format('s[j]')}))))"
    triples = f"sort_array(transform(sequence(0, size({w}) - 3), i -> named_struct('a', {w}[i], 'b', {w}[i + 1], 'c', {w}[i + 2], 'i', cast(i as bigint))))"
    equal = "filter(sequence(1, size(z) - 1), j -> z[j].a = z[j - 1].a and z[j].b = z[j - 1].b and z[j].c = z[j - 1].c)"
    pairs = f"""transform(array({triples}), z -> transform(array({equal}), y ->
        sort_array(array_distinct(concat(transform(y, j -> z[j - 1].i), transform(y, j -> z[j].i)))))[0])[0]"""
    hashes = f"sort_array(transform(sequence(0, size({w}) - 3), i -> {key}))"
    packed = f"transform(array({hashes}), s -> transform(array({again}), m -> case when exists(m, j -> {other}) then {pairs} else {places} end)[0])[0]"
    return F.expr(
        f"case when size({w}) < 4 then 0L when size({w}) <= {PACKED_WORDS} then {cover.format(p=packed)} else {cover.format(p=pairs)} end"
    )


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, source, page, hashes, sizes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(docs["doc_id"], docs["source"], text.alias("text"))
    filled = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    plain = F.filter(normal_lines(F.col("text")), lambda x: x != "")
    d = once(d, words(F.col("text")).alias("w"), filled.alias("lines"), plain.alias("plain"))
    bare = F.array_join("w", "")
    return d.select(
        "doc_id",
        "source",
        page_key().alias("page"),
        F.transform("plain", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("plain", lambda x: F.size(F.split(x, " "))).alias("sizes"),
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered("w").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, limit: int = LIMIT, least_left: float = LEAST_LEFT, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words, base_failed, kept) of every row of docs.

    n_left_words: words outside lines that occur, up to case and blanks, in too many documents of the host (column source): in more than
    `share` of them, where that is from `floor` to `limit`, else in more than the nearer of the two. A document is kept if it doesn't fail the rules on
    its words and at least `least_left` of them are left. Null and empty texts have no words and fail. Rows without a host lose no line. A document
    is a doc_id with its text: repeated rows are repeated and count once, copies count each. Other columns are ignored.
    """
    base = materialise(base_rules(docs), "quality-base")
    pages = base.where("source is not null").select(F.col("source").alias("host"), "page", "hashes")
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    over = F.col("pages") > F.greatest(F.lit(float(floor)), F.least(F.lit(float(limit)), F.lit(share) * F.col("total")))
    often = host_lines(pages).where(F.col("pages") > floor).join(total, "host").where(over)
    # rows that are equal lose the same lines, so that is found once for each host and document
    each = base.where("source is not null").select("source", "page", F.posexplode("hashes").alias("i", "line"), "sizes")
    each = each.select("source", "page", "line", "i", F.col("sizes")[F.col("i")].alias("size"))
    hit = each.join(often.select(F.col("host").alias("source"), "line"), ["source", "line"], "left_semi").distinct()
    lost = hit.groupBy("source", "page").agg(F.sum("size").alias("lost"))
    d = base.drop("hashes", "sizes").join(lost, ["source", "page"], "left")
    d = d.withColumn("n_left_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= least_left * F.col("n_words")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left_words", "base_failed", "kept")


def op9_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


_OP9 = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), tri as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as n from tri) where n > 1
), cov as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id
), l as (
  select doc_id, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as norm
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d)
), filled as (select * from l where norm <> ''),
total as (select source, count(*) as total from (select distinct source, doc_id, text from d) group by source),
often as (
  select source, norm from (select distinct source, doc_id, text, norm from filled where source is not null) join total using (source)
  group by source, norm, total having count(*) > greatest(5::double, least(500::double, 0.02::double * total))
),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from filled group by doc_id),
lost as (select doc_id, sum(len(string_split(norm, ' '))) as lost from filled semi join often using (source, norm) group by doc_id),
base as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from d left join dup using (doc_id) left join cov using (doc_id) left join lost using (doc_id)
), f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words - lost)::bigint as n_left_words, base_failed,
       not base_failed and n_words - lost >= 0.75 * n_words as kept
from f
"""
QUERIES = {"op9_line_frequency_rules": op9_line_frequency_rules}
SQL = {"op9_line_frequency_rules": _OP9}
