"""Token ids of whole texts by a public byte-level BPE tokenizer.

Method: DuckDB recursive queries per partition. The distinct words of a batch
become token-position rows; every step joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of least rank, until no word has
such a pair; an ordered aggregation gives each word's ids. Texts are then put
together from their words. A worker keeps the words it has seen, so a frequent
word is contracted once, not once an occurrence.

One pass without a shuffle: every text is encoded where it is read. Words longer
than ``LONG_WORD`` bytes (runs without white space) would make as many steps as
they have tokens over as many rows; they are contracted by the same rule over a
heap.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.plans.columns import col, free_name, other_columns

TOKENIZERS = os.environ.get("CINETABLE_TOKENIZERS", "/opt/tokenizers")
#: The pattern that belongs to the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 512
ROWS_PER_QUERY = 1_500_000  # bound of what the steps of one recursive query gather
KNOWN_WORDS = 200_000  # words a worker keeps
ROWS_AT_ONCE = 256

CONTRACT = """
with recursive steps(word, pos, token, step) as (
    select word, pos, token, 0 from started
    union all
    (with pairs as (
        select word, pos, token, step,
               lead(token) over by_word as next_token, lead(pos) over by_word as next_pos
        from steps window by_word as (partition by word order by pos)),
    ranked as (
        select pairs.*, merges.rank, merges.merged
        from pairs left join merges on merges.left_token = pairs.token and merges.right_token = pairs.next_token),
    chosen as (
        select word, min(rank::bigint * 1048576 + pos) as least from ranked where rank is not null group by word)
    select ranked.word, ranked.pos,
           case when ranked.pos = least % 1048576 then merged else token end, step + 1
    from ranked join chosen using (word)
    where ranked.pos <> (select r.next_pos from ranked r where r.word = chosen.word and r.pos = least % 1048576)))
select word, list(token order by pos) as ids
from steps
where (word, step) in (select word, max(step) from steps group by word)
group by word
"""


def _alphabet() -> dict[str, int]:
    """Byte of each character of the vocabulary's spelling: printable bytes are themselves, the rest follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The merge table as four integer columns, and the id of every byte: about 1 MB, fixed by the tokenizer."""

    def __init__(self, byte_ids: list[int], merges: np.ndarray) -> None:
        self.byte_ids, self.merges = byte_ids, merges

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str | None = None) -> Vocabulary:
        with open(os.path.join(folder or TOKENIZERS, f"{name}.json"), encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        byte_ids = [0] * 256
        for ch, byte in _alphabet().items():
            byte_ids[byte] = ids[ch]
        rows = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            rows.append((ids[left], ids[right], rank, ids[left + right]))
        return cls(byte_ids, np.array(rows, dtype=np.int32).T.copy())


    def spellings(self) -> dict[int, bytes]:
        """The bytes of every token."""
        made = {token: bytes([byte]) for byte, token in enumerate(self.byte_ids)}
        for left, right, _, merged in self.merges.T.tolist():
            made[merged] = made[left] + made[right]
        return made


class Encoder:
    """Words to ids; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.byte_ids = vocabulary.byte_ids
        self.known: dict[str, array] = {}
        self.split = regex.compile(WORDS).findall
        self.ranks: dict[tuple[int, int], tuple[int, int]] | None = None
        self.merges = vocabulary.merges
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.con.execute("set preserve_insertion_order = false")
        left, right, rank, merged = vocabulary.merges
        table = pa.table({"left_token": left, "right_token": right, "rank": rank, "merged": merged})
        self.con.register("merge_rows", table)
        self.con.execute("create table merges as select * from merge_rows")
        self.con.unregister("merge_rows")

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        short, held = [], 0
        for word in sorted(new, key=len):
            data = word.encode("utf-8", "replace")
            if len(data) > LONG_WORD:
                self.known[word] = self._by_heap(data)
                continue
            rows = len(data) * (len(data) + 1) // 2
            if held + rows > ROWS_PER_QUERY and short:
                self._by_query(short)
                short, held = [], 0
            short.append((word, data))
            held += rows
        if short:
            self._by_query(short)

    def _by_query(self, words: list[tuple[str, bytes]]) -> None:
        lengths = np.fromiter((len(data) for _, data in words), dtype=np.int64, count=len(words))
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.frombuffer(b"".join(data for _, data in words), dtype=np.uint8)
        started = pa.table(
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
                "pos": (np.arange(len(codes)) - starts).astype(np.int32),
                "token": np.asarray(self.byte_ids, dtype=np.int32)[codes],
            }
        )
        self.con.register("started", started)
        done = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("started")
        ids = done.column("ids").combine_chunks()
        values = np.asarray(ids.flatten())
        lengths = np.asarray(ids.value_lengths())
        ends = np.cumsum(lengths)
        for index, start, end in zip(done.column("word").to_pylist(), (ends - lengths).tolist(), ends.tolist()):
            self.known[words[index][0]] = array("i", values[start:end].astype(np.int32).tobytes())

    def _by_heap(self, data: bytes) -> array:
        """The same contraction, leftmost pair of least rank first, for a long word."""
        if self.ranks is None:
            self.ranks = {(a, b): (rank, merged) for a, b, rank, merged in self.merges.T.tolist()}
        ranks, tokens = self.ranks, [self.byte_ids[b] for b in data]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(*ranks[pair], i) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in ranks]
        heap = [(rank, i, tokens[i], tokens[i + 1]) for rank, _, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= len(tokens) or tokens[j] != right:
                continue
            tokens[i], tokens[j] = ranks[left, right][1], -1
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
                if found := ranks.get((tokens[i], tokens[after[i]])):
                    heapq.heappush(heap, (found[0], i, tokens[i], tokens[after[i]]))
            if (h := before[i]) >= 0 and (found := ranks.get((tokens[h], tokens[i]))):
                heapq.heappush(heap, (found[0], h, tokens[h], tokens[i]))
        return array("i", [t for t in tokens if t >= 0])

    def encode(self, texts: list[str | None]) -> list[array]:
        split = [self.split(text) if text else [] for text in texts]
        self.learn({word for words in split for word in words})
        known, out = self.known, []
        for words in split:
            ids = array("i")
            for word in words:
                ids += known[word]
            out.append(ids)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.split(text) if text else [] for text in texts]
        self.learn({word for words in split for word in words})
        return [sum(map(len, map(self.known.__getitem__, words))) for words in split]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary."""
    key = str(getattr(shared, "_path", None) or id(shared))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def encode_column(
    df: DataFrame, text: str, *, counts_only: bool = False, vocabulary: Vocabulary | None = None, folder: str | None = None
) -> DataFrame:
    """The other columns of ``df`` and ``ids`` (array of int), or ``n_tokens`` with ``counts_only``.

    Ids are those of the tokenizer without special tokens; their strings in a
    text are ordinary text. Defined results: an empty or null text gives the
    empty list; blank text has the ids of its white space; repeated rows stay
    repeated; an empty table stays empty; an input column named like the result
    is replaced.
    """
    made = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    kept, held = other_columns(df, text, made.name), free_name(df, "_text")
    source = df.select(*(col(c) for c in kept), col(text).cast("string").alias(held))
    schema = T.StructType(source.schema.fields[:-1] + [made])
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load(folder=folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in _slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if counts_only:
                result = pa.array(encoder.count(texts), pa.int64())
            else:
                lists = encoder.encode(texts)
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                joined = array("i")
                for ids in lists:
                    joined += ids
                values = pa.array(np.frombuffer(joined, dtype=np.int32) if joined else np.empty(0, np.int32), pa.int32())
                result = pa.ListArray.from_arrays(pa.array(offsets), values).cast(arrow.field(len(kept)).type)
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, result], schema=arrow)

    return source.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, name: str = "text", *, vocabulary: Vocabulary | None = None, folder: str | None = None) -> DataFrame:
    """The other columns of ``df`` and the text of its ids; null ids give null, the empty list the empty text."""
    kept, held = other_columns(df, ids, name), free_name(df, "_ids")
    source = df.select(*(col(c) for c in kept), col(ids).cast("array<int>").alias(held))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(name, T.StringType())])
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load(folder=folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = None
        for batch in _slices(batches):
            spelt = spelt or shared.value.spellings()
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else b"".join(map(spelt.__getitem__, x)).decode("utf-8", "replace") for x in lists]
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], schema=arrow)

    return source.mapInArrow(run, schema)


def token_ids(documents: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every document."""
    return encode_column(documents.select(col(key), col(text)), text, folder=folder)


def token_counts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of every document."""
    return encode_column(documents.select(col(key), col(text)), text, counts_only=True, folder=folder)


