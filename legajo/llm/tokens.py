"""Token ids of a public byte-level BPE vocabulary, computed by recursive SQL inside each partition.

Words are cut by the vocabulary's split pattern. The distinct words of a batch become token-position rows of a DuckDB table;
a recursive query joins neighbouring rows with the merge table and contracts the leftmost pairs of least rank of each word
until no pair is left (several places of one rank in a step: they can not touch each other's result). Ids are gathered by
ordered aggregation, and so is the text when ids are decoded. No data leaves the partition: one pass, no shuffle.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the vocabulary used where a caller names none.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's own split pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of distinct words in one recursive query, and words kept between batches; both change speed only, not results.
CHUNK_BYTES = 120_000
KEPT_WORDS = 150_000

_ENCODE = """
with recursive state(word, pos, tok) using key (word, pos) as (
  select word, pos, tok from start
  union
  (with live as (
     select word, pos, tok, lead(tok) over w as next_tok, lead(pos) over w as next_pos, row_number() over w as i
     from recurring.state where tok >= 0 and word in (select word from state)
     window w as (partition by word order by pos)),
   pairs as (select l.*, m.rank, m.made from live l join merges m on m.a = l.tok and m.b = l.next_tok),
   least as (select *, i - row_number() over (partition by word order by i) as run from pairs
             qualify rank = min(rank) over (partition by word)),
   runs as (select *, i - row_number() over (partition by word order by i) as streak from least),
   chosen as (select * from runs qualify row_number() over (partition by word, streak order by i) % 2 = 1)
   select word, pos, made from chosen union all select word, next_pos, -1 from chosen))
select word, list(tok order by pos) as ids from state where tok >= 0 group by word
"""
_DECODE = """
select text_no, string_agg(hex, '' order by pos) as hex from ids join pieces using (tok) group by text_no
"""


def byte_letters() -> dict[str, int]:
    """The public mapping of byte-level BPE: each byte has a printable letter; the unprintable ones follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class Bpe:
    """One vocabulary in one DuckDB connection; lives as long as its Python worker."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.split = regex.compile(PATTERN).findall
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocabulary[letter]
        self.known: dict[str, tuple[int, ...]] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table(
            {
                "a": pa.array([vocabulary[a] for a, _ in pairs], pa.int32()),
                "b": pa.array([vocabulary[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "made": pa.array([vocabulary[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self._load("merges", merges)
        as_hex = {i: bytes(letters[c] for c in t).hex() for t, i in vocabulary.items() if all(c in letters for c in t)}
        self._load("pieces", pa.table({"tok": pa.array(list(as_hex), pa.int32()), "hex": list(as_hex.values())}))

    def _load(self, name: str, data: pa.Table) -> None:
        self.con.register("incoming", data)
        self.con.execute(f"create or replace table {name} as select * from incoming")
        self.con.unregister("incoming")

    def _encode_chunk(self, words: list[str]) -> None:
        no, pos, tok = [], [], []
        for n, w in enumerate(words):
            b = w.encode("utf-8", "surrogatepass")
            no += [n] * len(b)
            pos += range(len(b))
            tok += [self.of_byte[x] for x in b]
        self._load("start", pa.table({"word": pa.array(no, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))
        for n, ids in self.con.execute(_ENCODE).fetchall():
            self.known[words[n]] = tuple(ids)

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet, in chunks of bounded size."""
        new, size = [], 0
        for w in words:
            if w in self.known:
                continue
            new.append(w)
            size += len(w)
            if size >= CHUNK_BYTES:
                self._encode_chunk(new)
                new, size = [], 0
        if new:
            self._encode_chunk(new)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; a null or empty text has no ids."""
        cut = [self.split(t) if t else [] for t in texts]
        self._prepare(cut)
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        cut = [self.split(t) if t else [] for t in texts]
        self._prepare(cut)
        known = self.known
        return [sum(len(known[w]) for w in words) for words in cut]

    def _prepare(self, cut: list[list[str]]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.learn({w for words in cut for w in words})

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become the replacement character."""
        no = [n for n, x in enumerate(ids) for _ in x or []]
        pos = [p for x in ids for p in range(len(x or []))]
        tok = [t for x in ids for t in x or []]
        self._load("ids", pa.table({"text_no": pa.array(no, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))
        texts = [""] * len(ids)
        for n, h in self.con.execute(_DECODE).fetchall():
            texts[n] = bytes.fromhex(h).decode("utf-8", "replace")
        return texts


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _slices(batch: pa.RecordBatch, text: str, characters: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``characters`` characters each, so that memory does not follow the longest batch."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > characters:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of every row; null and empty texts have an empty list. Other columns are not read."""
    path = path or os.path.join(FOLDER, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for whole in batches:
            for b in _slices(whole, "_text"):
                ids = pa.array(encoder.encode(b.column("_text").to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("_key"), ids], [key, "ids"])

    read = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return read.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and n_tokens of every row; null and empty texts have none."""
    path = path or os.path.join(FOLDER, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for whole in batches:
            for b in _slices(whole, "_text"):
                n = pa.array(encoder.count(b.column("_text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_key"), n], [key, "n_tokens"])

    read = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return read.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and text of every row of ids; a null or empty list has an empty text."""
    path = path or os.path.join(FOLDER, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = bpe(path)
        for b in batches:
            texts = pa.array(decoder.decode(b.column("_ids").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_key"), texts], [key, "text"])

    read = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{ids}`").alias("_ids"))
    return read.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
