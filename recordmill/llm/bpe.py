"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

Each task holds one in-memory DuckDB with the merge table (left id, right id, merged id = rank). Words not seen before
become token-position rows; a recursive query joins neighbouring rows with the merge table and contracts each word's
leftmost pair of least rank, until no word has a pair. Decoding joins token-position rows with the vocabulary and
aggregates the pieces in order.

Words repeat, so a worker keeps the ids of what it met lately in a memory of bounded size: a text is cut at blanks, and
only pieces not in memory go through the recursive query. That is exact, since a merge never crosses a match of the split
pattern. Texts stay in their partition: there is no shuffle.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from collections.abc import Iterator
from itertools import chain, compress, islice
from operator import not_

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.common import map_batches, ship, table, without

REMEMBERED = 400_000
#: Words longer than this are not remembered.
LONG_WORD = 256
#: Bytes of a word up to which it is not worth to look for cuts; bytes of a part up to which ENCODE takes it, one contraction a round; longer ones take ENCODE_LONG.
PLAIN_WORD, SHORT_WORD = 32, 96
#: What a query holds at most: rows of all rounds of ENCODE (a part of n bytes has at most n * n / 2 or so), bytes of parts of ENCODE_LONG, or one part.
ROWS_A_QUERY, BYTES_A_QUERY = 2_000_000, 64 << 10
#: Stands between the parts of a query and merges with nothing.
GAP = (1 << 31) - 1

# Fixed value: the split pattern for which cutting at blanks is proven; with any other, texts are split plainly.
WHOLE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODE = """
with recursive t(k, w, g, id) as (
  select 0, w, g, id from tokens
  union all
  (with p as (
     select k, w, g, id, lead(w) over win next_w, lead(id) over win next_id, lead(g) over win next_g
     from t window win as (order by g)),
   pairs as materialized (
     select p.k, p.w, p.g, p.id, p.next_g, m.id merged
     from p left join merges m on m.pair = case when p.next_w = p.w then p.id::bigint << 32 | p.next_id end),
   best as (
     select w, min(merged::bigint << 32 | (g & 4294967295)) key,
            arg_min(next_g, merged::bigint << 32 | (g & 4294967295)) gone
     from pairs where merged is not null group by w)
   select pairs.k + 1, pairs.w, pairs.g,
          case when pairs.g = (best.w::bigint << 32 | (best.key & 4294967295)) then pairs.merged else pairs.id end
   from pairs join best on best.w = pairs.w where pairs.g <> best.gone)
),
last as (select w, max(k) k from t group by w)
select t.w, t.id from t join last using (w, k) order by t.g
"""

#: The same for long words, one after the other with a gap between that no pair reaches over, in far fewer rounds. A round contracts every pair whose rank is the least within ``reach``
#: bytes on either side, where reach is three times the longest token that occurs in the word. That gives what one
#: contraction at a time would give: a token that a lower pair farther off could grow into is too short to come near
#: (it is a token that occurs), so nothing touches the pair before its turn. Of equal pairs that overlap, every second
#: one from the left counts. Equal pairs in reach go together unless what one of them makes could merge with a neighbour
#: at no higher rank ("rough"); then only the first of them goes. Rows that are gone have the id -1; the recursion keeps
#: one state, not all.
ENCODE_LONG = """
with recursive t(g, id) using key (g) as (
  select g, id from tokens
  union
  (with live as (
     select g, id, lag(id) over o before_id, lead(g) over o next_g, lead(id) over o next_id, lead(id, 2) over o after_id
     from recurring.t where id >= 0 window o as (order by g)),
   pairs as (
     select live.*, m.id merged from live left join merges m on m.pair = live.id::bigint << 32 | live.next_id),
   near as (
     select *, lag(merged) over (order by g) previous,
            min(merged) over (order by g range between {reach} preceding and 1 preceding) least_before,
            min(merged) over (order by g range between current row and {reach} following) least_after
     from pairs),
   tested as (
     select n.g, n.next_g, n.merged, n.previous, n.least_before, n.least_after,
            case when least(a.id, b.id, c.id) <= n.merged then n.merged end rough
     from near n left join merges a on a.pair = case when n.merged = n.least_after then n.before_id::bigint << 32 | n.merged end
                 left join merges b on b.pair = case when n.merged = n.least_after then n.merged::bigint << 32 | n.after_id end
                 left join merges c on c.pair = case when n.merged = n.least_after then n.merged::bigint << 32 | n.merged end
     where n.merged is not null),
   runs as (
     select g, next_g, merged, merged = least_after and (coalesce(least_before > merged, true) or least_before = merged and coalesce(
              min(rough) over (order by g range between {reach} preceding and current row) > merged, true)) ready,
            sum(case when merged = previous then 0 else 1 end) over (order by g rows unbounded preceding) run
     from tested),
   chosen as (
     select g, next_g, merged from (
       select *, row_number() over r place, first_value(ready) over r head_ready from runs window r as (partition by run order by g))
     where ready and head_ready and place % 2 = 1)
   select g, merged from chosen union all select next_g, -1 from chosen)
)
select g, id from t where id >= 0 order by g
"""

DECODE = """
select tokens.w, array_to_string(list(vocabulary.chars order by tokens.g), '') chars
from tokens join vocabulary using (id) group by tokens.w
"""


class Memory:
    """Values by key, of bounded number: when full, the young become the old generation, whose entries return when used."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.young, self.old = most, {}, {}

    def recall(self, rows: list[list], learn) -> list[list]:
        """The values of rows of keys, of which learn() works out those not remembered."""
        found = [list(map(self.young.get, row)) for row in rows]
        lacking = set(chain.from_iterable(compress(row, map(not_, values)) for row, values in zip(rows, found) if None in values))
        if not lacking:
            return found
        here = {k: v for k in lacking if (v := self.old.get(k)) is not None}
        if fresh := list(lacking - here.keys()):
            here.update(zip(fresh, learn(fresh)))
        self.put({k: v for k, v in here.items() if len(k) <= LONG_WORD})
        return [[here[k] if v is None else v for k, v in zip(row, values)] if None in values else values for row, values in zip(rows, found)]

    def put(self, values: dict) -> None:
        if len(self.young) + len(values) > self.most:
            self.old, self.young = self.young, {}
            values = dict(islice(values.items(), self.most))
        self.young.update(values)


def _bounded(words: list[bytes], cost, most: int) -> Iterator[list[bytes]]:
    """Slices of words whose costs, by length, come to ``most`` together, or of one word."""
    at, total = 0, 0
    for i, word in enumerate(words):
        if i > at and total + cost(len(word)) > most:
            yield words[at:i]
            at, total = i, 0
        total += cost(len(word))
    if at < len(words):
        yield words[at:]


class Codec:
    """Encoder and decoder for one rank file's content and split pattern."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.split = regex.compile(pattern)
        self.plain = pattern != WHOLE_WORDS
        pairs, merged = [], []
        self.sizes: dict[bytes, list[int]] = {}
        for token, rank in self.ranks.items():
            if len(token) > 3:
                self.sizes.setdefault(token[:3], []).append(len(token))
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self.sizes = {head: sorted(set(sizes), reverse=True) for head, sizes in self.sizes.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})  # what a query holds is bounded, so nothing spills
        self._load("merges", {"pair": pa.array(pairs, pa.int64()), "id": pa.array(merged, pa.int32())})
        ids = np.array(list(self.ranks.values()), np.int32)
        # A byte is held as the character of that number, as a string of bytes need not be UTF-8.
        self._load("vocabulary", {"id": pa.array(ids), "chars": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.known = np.zeros(int(ids.max(initial=0)) + 1, bool)
        self.known[ids] = True
        self.decimals = list(map(str, range(len(self.known))))
        self.single = {int(i): i.tobytes() for i in ids}
        self.units = Memory()

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"create table {name} as select * from loading")
        self.db.unregister("loading")

    def _query(self, sql: str, columns: dict[str, np.ndarray]) -> pa.Table:
        self.db.register("tokens", pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("tokens")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array."""
        sizes = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        out = self._query(ENCODE, {"w": w, "g": w.astype(np.int64) << 32 | at, "id": ids})
        owner, ids = out.column(0).to_numpy(), out.column(1).to_numpy().astype(np.int32)
        ends = np.searchsorted(owner, np.arange(len(words)), "right")
        flat = ids.tobytes()
        return [flat[4 * s : 4 * e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _longest_token(self, word: bytes) -> int:
        """The length of the longest token that occurs in the word, 3 at least."""
        best = 3
        for i in range(len(word) - 3):
            for size in self.sizes.get(word[i : i + 3], ()):
                if size <= best:
                    break
                if word[i : i + size] in self.ranks:
                    best = size
                    break
        return best

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """As _contract, for words of more than a few bytes."""
        reach = 3 * max(map(self._longest_token, words))
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + reach + 2) - (sizes + reach + 2)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        g, ids = np.concatenate([at, starts[1:] - 1]), np.concatenate([ids, np.full(len(words) - 1, GAP, np.int32)])
        out = self._query(ENCODE_LONG.format(reach=reach), {"g": g, "id": ids})
        places, ids = out.column(0).to_numpy(), out.column(1).to_numpy()
        places, ids = places[ids != GAP], ids[ids != GAP].astype(np.int32)
        return [ids[s:e].tobytes() for s, e in zip(np.searchsorted(places, starts).tolist(), np.searchsorted(places, starts + sizes).tolist())]

    def _learn_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of matches of the split pattern."""
        found, parts_of = {}, {}
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                found[word] = self.single[rank]
            else:
                parts_of[word] = self._apart(raw) if len(raw) > PLAIN_WORD else [raw]
        parts = sorted(set(chain.from_iterable(parts_of.values())), key=lambda x: (len(x), x))
        known = {x: self.byte_ids[x[0]].tobytes() for x in parts if len(x) == 1}
        cut = sum(len(x) <= SHORT_WORD for x in parts)
        for some, contract, cost, most in ((parts[len(known) : cut], self._contract, lambda n: n * n // 2, ROWS_A_QUERY), (parts[cut:], self._contract_long, lambda n: n, BYTES_A_QUERY)):
            for batch in _bounded(some, cost, most):
                known.update(zip(batch, contract(batch)))
        found.update((word, b"".join(map(known.__getitem__, own))) for word, own in parts_of.items())
        return found

    def _apart(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token that occurs in it reaches over: each merge makes such a token, so none crosses a cut, and the parts don't touch each other."""
        cuts, far = [0], 1
        for i in range(len(word)):
            if i >= far:
                cuts.append(i)
            if word[i : i + 2] in self.ranks:
                far = max(far, i + 2)
            if word[i : i + 3] in self.ranks:
                far = max(far, i + 3)
            for size in self.sizes.get(word[i : i + 3], ()):
                if i + size <= far:
                    break
                if word[i : i + size] in self.ranks:
                    far = i + size
                    break
            far = max(far, i + 1)
        return [word[s:e] for s, e in zip(cuts, [*cuts[1:], len(word)])]

    def ids_digest(self, ids: bytes) -> str:
        return hashlib.sha256(",".join(map(self.decimals.__getitem__, np.frombuffer(ids, np.int32).tolist())).encode()).hexdigest()

    def _learn(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are split as a whole."""
        pieces_of = [self._pieces(t) for t in texts]
        known = self._learn_words(set(chain.from_iterable(pieces_of)))
        return [known[pieces[0]] if len(pieces) == 1 else b"".join(map(known.__getitem__, pieces)) for pieces in pieces_of]

    def _pieces(self, text: str) -> list[str]:
        """The matches of the split pattern; the commonest forms, a word of letters with or without a mark, need no search."""
        if self.plain:
            return [m[0] for m in self.split.finditer(text) if m[0]]
        if text[:1] == " " and text[1:].isalpha():
            return [text]
        if text[:1] == " " and text[-1] in ".,;:!?" and text[1:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.split.findall(text)

    def _learn_units(self, units: list[str]) -> list[bytes | bool]:
        """Ids of a blank and the unit; False for a unit that cannot be split apart from its neighbours."""
        apart = [bool(u) and not u[0].isspace() and not u[-1].isspace() for u in units]
        ids = iter(self._learn([" " + u for u, a in zip(units, apart) if a]))
        return [a and next(ids) for a in apart]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of an int32 array.

        A text is cut at each single blank that stands between two characters that are no white space: no match of
        the split pattern reaches over such a place. Texts with other white space next to a blank are split as a whole.
        """
        if self.plain:
            return self._learn(texts)
        heads, tails = [], []
        for t in texts:
            head, *tail = t.split(" ")
            heads.append(head)
            tails.append(tail)
        found = self.units.recall(tails, self._learn_units)
        for i, (head, ids) in enumerate(zip(heads, found)):
            if ids and (not head or head[-1].isspace() or False in ids):
                heads[i], found[i] = texts[i], []
        return [first + b"".join(ids) for first, ids in zip(self._learn(heads), found)]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids, an int32 array's bytes, stands for. An id that the vocabulary lacks raises ValueError."""
        ids = np.frombuffer(b"".join(rows), np.int32)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("token id outside the vocabulary")
        w = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) // 4 for r in rows])
        got = self._query(DECODE, {"w": w, "g": np.arange(len(ids)), "id": ids})
        chars = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
        return [chars.get(i, "").encode("latin-1") for i in range(len(rows))]


_codecs: dict[str, Codec] = {}


@contextlib.contextmanager
def codec(name: str, content):
    """The worker's codec for a rank file; content() gives (lines, pattern) when it must be made."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*content())
    yield _codecs[name]


def _chunks(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in the column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    at, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        total += n
        if total > most:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _ids_array(rows: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def rank_file(docs: DataFrame, path: str):
    """The content of a rank file under the driver's path, broadcast: a vocabulary has a fixed size of about 1 MB."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


#: What a pass over the texts can add to a row, and its type.
ADDS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "round_trip": T.BooleanType()}


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", add: tuple[str, ...] = ("ids",), keep_text: bool = True) -> DataFrame:
    """The input's rows and columns with the columns ``add``: the token ids of the text, null as empty text, or what
    follows from them: n_tokens, ids_sha256 of the comma-joined ids, and, by decoding the ids, decoded_sha256 of the
    bytes and round_trip (the bytes are the text's). They replace columns of the same names.

    As the tiktoken library's encode_ordinary: a match that is itself a token is that token, any other is contracted. A
    match of 100 kB, such as a text without blanks, takes 1 to 40 seconds, in proportion to its length. Equal texts have
    equal ids; an empty table gives an empty result. ``path`` is a file of base64 tokens and ranks, read on the driver.
    """
    ship(docs.sparkSession)
    ranks = rank_file(docs, path)
    at = docs.columns.index(text_col)
    kept = [i for i in without(docs.columns, add) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(f"{path} {pattern}", lambda: (ranks.value, pattern)) as c:
            for whole in batches:
                for b in _chunks(whole, at):
                    texts = [t or "" for t in b.column(at).to_pylist()]
                    ids = c.encode(texts)
                    made: dict[str, pa.Array] = {}
                    if "ids" in add:
                        made["ids"] = _ids_array(ids)
                    if "n_tokens" in add:
                        made["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
                    if "ids_sha256" in add:
                        made["ids_sha256"] = pa.array([c.ids_digest(x) for x in ids])
                    if "decoded_sha256" in add or "round_trip" in add:
                        raw = c.decode(ids)
                        made["decoded_sha256"] = pa.array([hashlib.sha256(r).hexdigest() for r in raw])
                        made["round_trip"] = pa.array([r == t.encode() for r, t in zip(raw, texts)])
                    yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[made[a] for a in add]], names=[*[b.schema.names[i] for i in kept], *add])

    return map_batches(docs, run, T.StructType([*[docs.schema[i] for i in kept], *[T.StructField(a, ADDS[a]) for a in add]]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The input's rows and columns with ``decoded``, which replaces a column of that name: the bytes of the tokens. Null ids give null; unknown ids raise."""
    ship(rows.sparkSession)
    ranks = rank_file(rows, path)
    at = rows.columns.index(ids_col)
    kept = without(rows.columns, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(f"{path} {pattern}", lambda: (ranks.value, pattern)) as c:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    ids = b.column(at)
                    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(np.int32)
                    raw = c.decode([flat[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])])
                    out = pa.array([r if v else None for r, v in zip(raw, ids.is_valid().to_pylist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], out], names=[*[b.schema.names[i] for i in kept], "decoded"])

    return map_batches(rows, run, T.StructType([*[rows.schema[i] for i in kept], T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the texts encoded, and the ids decoded, in one pass."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return encode(narrow, path, pattern, add=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
