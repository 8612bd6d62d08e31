"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 benchmark words (shorter items are one pattern of their own length). For each pattern length
a shift table, indexed by a hash of a block of ``BLOCK`` consecutive words, says how far the search may jump: a block that
no pattern holds moves it past the whole pattern. A block that ends a pattern has shift 0 and leads to the bucket of
patterns with that suffix hash, whose words are then compared directly. Words, not bytes, are the alphabet, as the
contract counts words. Patterns are places in one text of normalised words, and all tables are arrays of numbers.

The benchmark is measured in Spark and broadcast in blocks of at most ``block_bytes`` of text. A benchmark of one block is
searched in one pass in which documents stay where they are. A larger one is searched block by block over a copy of the
documents with row numbers: the first pass tells of every row, the others only of the rows that they hit, and these are
joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.common import few_or_merging, map_batches, quoted, ship, stash, table, unused, without

WINDOW = 13
BLOCK = 3

#: ASCII bytes that are no part of a word become blanks; A-Z become a-z; bytes of other characters stay.
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


_hash = xxhash.xxh3_64_intdigest


class Table:
    """The patterns of one length: the shift table, and patterns sorted by the hash of their last block.

    A pattern is a range of bytes of ``text``; equal patterns stand once, with a range of ``owners``.
    """

    def __init__(self, n: int, block: int, text: bytes, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, words: np.ndarray):
        """``words`` has, for each pattern, the place of its first word in the arrays of word starts and ends."""
        self.n, self.b, self.far, self.text = n, min(block, n), n - min(block, n) + 1, text
        first, last = starts[words], ends[words + n - 1]
        whole = np.fromiter((_hash(text[s:e]) for s, e in zip(first.tolist(), last.tolist())), np.uint64, len(words))
        suffix = np.fromiter((_hash(text[s:e]) for s, e in zip(starts[words + n - self.b].tolist(), last.tolist())), np.uint64, len(words))
        order = np.lexsort((owners, whole, suffix))
        first, last, whole, owners, suffix = first[order], last[order], whole[order], owners[order], suffix[order]
        new = np.ones(len(order), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (suffix[1:] != suffix[:-1])
        for i in np.flatnonzero(~new).tolist():  # an equal hash is no proof
            new[i] = text[first[i] : last[i]] != text[first[i - 1] : last[i - 1]]
        at = np.flatnonzero(new)
        self.first, self.last, self.suffix = first[at], last[at], suffix[at]
        self.owners, self.owned = owners, np.append(at, len(order)).astype(np.int64)
        self.mask = (1 << (8 * len(at)).bit_length()) - 1  # neighbouring patterns share blocks, so about one a pattern: an eighth is taken
        self.shift = np.full(self.mask + 1, self.far, np.uint8)
        for end in range(self.b, n + 1):  # from the pattern's front to its back, so that the least shift comes last
            s, e = starts[words + end - self.b].tolist(), ends[words + end - 1].tolist()
            keys = np.fromiter((_hash(text[x:y]) for x, y in zip(s, e)), np.uint64, len(words)) & np.uint64(self.mask)
            self.shift[keys] = np.minimum(self.shift[keys], n - end)
        self.jumps = self.shift.tobytes()

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        n, b, mask, jumps, join = self.n, self.b, self.mask, self.jumps, b" ".join
        at, total = n, len(words)
        while at <= total:
            key = _hash(join(words[at - b : at]))
            step = jumps[key & mask]
            if step:
                at += step
                continue
            low, high = np.searchsorted(self.suffix, np.uint64(key), "left"), np.searchsorted(self.suffix, np.uint64(key), "right")
            if low < high:
                here = join(words[at - n : at])
                for i in range(low, high):
                    if self.text[self.first[i] : self.last[i]] == here:
                        spans.append((at - n, at))
                        items.update(self.owners[self.owned[i] : self.owned[i + 1]].tolist())
            at += 1


class Patterns:
    """The tables of a block of the benchmark, one for each pattern length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, block: int = BLOCK):
        self.names = sorted({str(item) for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        joined, sizes, of = [], [], []
        for item, text in items:
            if words := words_of(text):
                joined.append(b" ".join(words))
                sizes.append(len(words))
                of.append(number[str(item)])
        text = b" ".join(joined)
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(text))
        size, own = np.array(sizes, np.int64), np.array(of, np.int64)
        heads = np.cumsum(size) - size
        self.tables = []
        for n in np.unique(np.minimum(size, window)).tolist():
            some = np.minimum(size, window) == n
            counts = size[some] - n + 1
            words = np.repeat(heads[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            self.tables.append(Table(n, block, text, starts, ends, np.repeat(own[some], counts).astype(np.int32), words))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word ranges inside occurrences, and the items, as strings, with an occurrence."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for t in self.tables:
            t.search(words, spans, items)
        return merged(spans), {self.names[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]


def _hits(rows: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.StructArray:
    told = [(n, [s for s, _ in spans], [e for _, e in spans], sorted(items)) for n, spans, items in rows]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in told], k) for i, k in enumerate(_KINDS)], names=HITS.names)


def _searcher(patterns, text_at: int, kept: list[int], sparse: bool):
    """The kept columns and the hits; with ``sparse``, only of rows that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = patterns.value.search
        for b in batches:
            rows = [(len(words), *search(words)) for words in map(words_of, b.column(text_at).to_pylist())]
            chosen = [i for i, r in enumerate(rows) if r[1] or not sparse]
            columns = [b.column(i).take(pa.array(chosen, pa.int64())) if sparse else b.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, _hits([rows[i] for i in chosen])], names=[str(i) for i in range(len(kept) + 1)])

    return run


def _join_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, the first block's hits and a list of other blocks' hits of the row, as one struct."""
    for b in batches:
        rows = []
        for first, parts in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            parts = [first, *(parts or [])]
            spans = [x for p in parts for x in zip(p["starts"], p["ends"])]
            rows.append((first["n_words"], merged(spans), {x for p in parts for x in p["items"]}))
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], _hits(rows)], names=b.schema.names[:-1])


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark cut by a hash of its items into as many blocks as keep each near ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _found(docs: DataFrame, blocks: list[DataFrame], text_col: str, kept: list[str], row: str, window: int, hits: str) -> DataFrame:
    """``kept`` columns and the hits. With several blocks ``row`` is a column that numbers the rows alike in every pass, and the first of ``kept``.

    The first pass tells the number of words of every row, the others only of rows that they hit; what they write is joined
    by number, so texts move only where they are among ``kept``.
    """
    load = lambda block: docs.sparkSession.sparkContext.broadcast(Patterns([tuple(r) for r in block.collect()], window))
    made = T.StructField(hits, HITS)
    schema = T.StructType([*[docs.schema[docs.columns.index(c)] for c in kept], made])
    first = map_batches(docs, _searcher(load(blocks[0]), docs.columns.index(text_col), [docs.columns.index(c) for c in kept], False), schema)
    if len(blocks) == 1:
        return first
    others = None
    for block in blocks[1:]:
        patterns = load(block)
        part = map_batches(docs.select(*quoted([row, text_col])), _searcher(patterns, 1, [0], True), T.StructType([T.StructField(row, T.LongType()), made]))
        part = stash(part, "hits")
        patterns.destroy()
        others = part if others is None else others.unionAll(part)
    (several,) = unused(first.columns, "__several")
    others = others.groupBy(row).agg(F.collect_list(*quoted([hits])).alias(several))  # one of each block at most
    return map_batches(first.join(others, row, "left"), _join_hits, schema)


def _numbered(docs: DataFrame, *taken: str) -> tuple[DataFrame, str]:
    """A copy of the rows in the shared folder with a number each, and that column's name."""
    (row,) = unused([*docs.columns, *taken], "__row")
    return stash(docs.select(F.monotonically_increasing_id().alias(row), "*"), "numbered"), row


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, hits: str = "__hits", keep: list[str] | None = None) -> DataFrame:
    """The input's rows, its columns or those named by ``keep``, and a struct ``hits`` (n_words, starts, ends, items), which replaces a column of that name.

    starts and ends are the merged word ranges, end exclusive, inside any occurrence of a window; items are the ids, as
    sorted strings, of items with an occurrence. Null text has no words. Items without id or words are passed over; equal
    texts under several ids count for each. An empty benchmark hits nothing.
    """
    ship(docs.sparkSession)
    docs = docs.select(*quoted([docs.columns[i] for i in without(docs.columns, [hits])]))
    kept = docs.columns if keep is None else keep
    blocks = pattern_blocks(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return _found(docs, blocks, text_col, kept, "", window, hits)
    docs, row = _numbered(docs.select(*quoted(list(dict.fromkeys([*kept, text_col])))), hits)
    return _found(docs, blocks, text_col, [row, *kept], row, window, hits).drop(row)


def hit_words(hits: Column) -> Column:
    return F.aggregate(F.zip_with(hits["starts"], hits["ends"], lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hits: Column) -> Column:
    """At least one word is hit, and at least one in twenty."""
    n_hit = hit_words(hits)
    return (n_hit > 0) & (20 * n_hit >= hits["n_words"])


def summary(found: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with n_words, n_hit, n_items, items_sha256 and contaminated."""
    h = F.col("__hits")
    return found.select(
        *quoted(list(keep)),
        h["n_words"].alias("n_words"),
        hit_words(h).alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """The input's rows and columns, whatever they are named, without documents of which at least one word in twenty is hit.

    With several blocks of the benchmark the numbers of rows to drop are joined to the copy of the documents, whose texts are
    shuffled only where there are more of those numbers than a join may broadcast.
    """
    ship(docs.sparkSession)
    (hits,) = unused(docs.columns, "__hits")
    blocks = pattern_blocks(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return _found(docs, blocks, text_col, docs.columns, "", window, hits).where(~contaminated(F.col(hits))).select(*quoted(docs.columns))
    copy, row = _numbered(docs, hits)
    dropped = _found(copy, blocks, text_col, [row], row, window, hits).where(contaminated(F.col(hits))).select(row)
    return copy.join(few_or_merging(stash(dropped, "dropped")), row, "left_anti").select(*quoted(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]), "doc_id")


ORACLE = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
p as (select distinct item, n, array_to_string(w[i:i+n-1],' ') s from (select item, w, least(13,len(w)) n, unnest(range(1,len(w)-least(13,len(w))+2)) i from b where len(w)>0)),
g as (select r, n, i, array_to_string(w[i:i+n-1],' ') s from (select r, w, n, unnest(range(1,len(w)-n+2)) i from d, (select distinct n from p) where len(w)>=n)),
o as (select g.r, g.i, g.n, p.item from g join p on p.n=g.n and p.s=g.s),
h as (select r, count(distinct j) n_hit from (select r, unnest(range(i,i+n)) j from (select distinct r,i,n from o)) group by r),
t as (select r, count(*) n_items, string_agg(item,',' order by item) items from (select distinct r,item from o) group by r)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(h.n_hit,0) as bigint) n_hit, cast(coalesce(t.n_items,0) as bigint) n_items,
 sha256(coalesce(t.items,'')) items_sha256, coalesce(h.n_hit,0)>0 and 20*coalesce(h.n_hit,0)>=len(d.w) contaminated
from d left join h using(r) left join t using(r)
"""
