"""Encoding of whole corpora with a public tokenizer, and back.

Texts go through the tokenizers library in Arrow batches. Null and empty texts have no ids (an empty list); strings of
special tokens within a text are ordinary text; no special tokens are added. Ids stand for bytes: the byte table of
byte-level vocabularies gives each id its bytes, from which texts and character positions follow, also where a
character is split over several ids.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Characters that are encoded in one call, but for a longer single text.
CALL_CHARS = 1 << 19


def vocabulary(path: str | None = None) -> str:
    """The file's text, read on the driver."""
    return Path(path or os.path.join(TOKENIZERS, BYTE_BPE)).read_text()


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def id_bytes(vocab_text: str) -> list[bytes]:
    """The bytes of each id; of special tokens their text's."""
    parsed, table = json.loads(vocab_text), byte_table()
    vocab = parsed["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", ())}
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for token, i in vocab.items():
        out[i] = special[i] if i in special else bytes(table[c] for c in token)
    for i, content in special.items():
        out[i] = content
    return out


def _once(key: str, make: Callable):
    """One object for each Python worker, however many tasks it runs."""
    held = sys.__dict__.setdefault("_tidemark_held", {})
    if key not in held:
        held.clear() if len(held) > 8 else None
        held[key] = make()
    return held[key]


def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        made = Tokenizer.from_str(text)
        made.encode_special_tokens = True
        return made

    return _once(f"tokenizer {hash(text)}", make)


# Fixed value: where byte-level vocabularies cut a text.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker, and the longest that is.
MEMO, MEMO_CHARS = 200_000, 64


class _Pieces(dict):
    """Ids of pieces of text, from the tokenizer where they are not known yet."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> list[int]:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """A tokenizer that remembers pieces. Vocabularies that cut texts by the byte-level rule encode each piece for itself.

    The rule speaks of classes of characters, of which the tokenizers library has a table of its own. So each character,
    once it is seen, is tried in both; texts with one that they take differently go to the library as a whole.
    """

    def __init__(self, vocab: str):
        import regex

        self.tokenizer, parsed = _tokenizer(vocab), json.loads(vocab)
        cut = parsed.get("pre_tokenizer") or {}
        plain = not any(parsed.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and all(t.get("special") for t in parsed.get("added_tokens", ()))
        self.by_piece = plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.find, self.pieces = regex.compile(_CUT).findall, _Pieces(self.tokenizer)
        self.known: set[str] = set()
        self.odd: set[str] = set()

    def _agree(self, fresh: set[str]) -> bool:
        for c in fresh - self.odd:
            probe = f"a{c}b 1{c}2 !{c}! {c} {c}{c}  {c}"
            spans = [tuple(x) for _, x in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            ends = np.cumsum([0, *map(len, self.find(probe))]).tolist()
            (self.known if spans == list(zip(ends, ends[1:])) else self.odd).add(c)
        return not fresh & self.odd

    def _made(self, texts: list[str | None], of_pieces: Callable, of_ids: Callable) -> list:
        out, whole, get = [of_ids([])] * len(texts), [], self.pieces.__getitem__
        for i, t in enumerate(texts):
            if not t:
                continue
            fresh = set(t) - self.known
            if not self.by_piece or (fresh and not self._agree(fresh)):
                whole.append(i)
            else:
                out[i] = of_pieces(map(get, self.find(t)))
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = of_ids(e.ids)
        return out

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        return self._made(texts, lambda parts: list(chain.from_iterable(parts)), lambda ids: ids)

    def counts(self, texts: list[str | None]) -> list[int]:
        return self._made(texts, lambda parts: sum(map(len, parts)), len)


def _calls(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about CALL_CHARS characters."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > CALL_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _lists(lengths: list[int], values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.astype(np.int64)))


def _over_text(df: DataFrame, text: str, vocab: str, each: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """df's other columns (but for those of a made name) and what ``each(tokenizer, texts)`` gives for each slice of texts."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocab)  # the vocabulary file, a few MB whatever the corpus
    keep = [f for f in df.schema if f.name != text and f.name not in {n for n, _ in fields}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _calls(texts):
                tokenizer = tokenizer or _once(f"encoder {hash(shared.value)}", lambda: Encoder(shared.value))
                made = each(tokenizer, texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*part.schema.names[1:], *(n for n, _ in fields)])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keep] + [T.StructField(n, t) for n, t in fields])
    return df.select(text, *[f.name for f in keep]).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """df without its text column, with ids array<bigint>; [] for null and empty texts. Whole texts, however long."""

    def each(tokenizer, texts):
        ids = tokenizer.ids(texts)
        return [_lists([len(x) for x in ids], np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))))]

    return _over_text(df, text, vocab or vocabulary(), each, [("ids", T.ArrayType(T.LongType()))])


def token_counts(df: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """df without its text column, with n_tokens bigint; 0 for null and empty texts."""
    return _over_text(df, text, vocab or vocabulary(), lambda t, x: [pa.array(t.counts(x), pa.int64())], [("n_tokens", T.LongType())])


def char_spans(text: str, ids: list[int], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each id, in characters. Ids that split a character all cover it."""
    sizes = np.fromiter((len(pieces[i]) for i in ids), np.int64, len(ids))
    ends = np.cumsum(sizes)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80) - 1  # of the character of each byte
    starts = ends - sizes
    return number[starts] if len(ids) else starts, number[ends - 1] + 1 if len(ids) else ends


def encode_with_offsets(df: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """df without its text column, with ids, starts, ends (array<bigint>, characters)."""
    vocab = vocab or vocabulary()

    def each(tokenizer, texts):
        pieces = _once(f"pieces {hash(vocab)}", lambda: id_bytes(vocab))
        ids = tokenizer.ids(texts)
        spans = [char_spans(t or "", i, pieces) for t, i in zip(texts, ids)]
        sizes = [len(i) for i in ids]
        flat = lambda parts: np.concatenate([np.asarray(p, np.int64) for p in parts])
        return [_lists(sizes, flat(ids)), _lists(sizes, flat([s for s, _ in spans])), _lists(sizes, flat([e for _, e in spans]))]

    lists = T.ArrayType(T.LongType())
    return _over_text(df, text, vocab, each, [("ids", lists), ("starts", lists), ("ends", lists)])


def decode_ids(ids: list[int] | None, pieces: list[bytes]) -> str:
    """Text of ids; bytes that are no whole character become U+FFFD."""
    return b"".join(pieces[i] for i in ids or ()).decode("utf-8", "replace")


def decode(df: DataFrame, ids: str = "ids", vocab: str | None = None) -> DataFrame:
    """df without its ids column, with text; empty for null and empty lists."""
    shared = df.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    keep = [f for f in df.schema if f.name not in (ids, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = _once(f"pieces {hash(shared.value)}", lambda: id_bytes(shared.value))
            texts = pa.array([decode_ids(x, pieces) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], "text"])

    return df.select(ids, *[f.name for f in keep]).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in keep] + [T.StructField("text", T.StringType())]))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(documents(spark, d).select("doc_id", "text"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode_with_offsets(documents(spark, d).select("doc_id", "text")).select("doc_id", "starts", "ends")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again; null texts come back empty."""
    return decode(encode(documents(spark, d).select("doc_id", "text")))


def p7_tokens_per_source(spark: SparkSession, d: str) -> DataFrame:
    counts = token_counts(documents(spark, d).select("source", "text"))
    return counts.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_offsets, p7_decoded, p7_tokens_per_source)}
