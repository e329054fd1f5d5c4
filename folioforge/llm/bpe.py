"""Operator 2: byte-level BPE encoding and decoding.

The ``tokenizers`` library encodes Arrow batches. Its vocabulary is written in the printable characters of the
byte-to-character table; decoding reverses that table, so ids whose bytes split a character are put together before
UTF-8 is read. The rank file is read by every Python worker once; its place is a parameter and it must exist on every
executor, like the library itself.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioforge.llm.batches import as_strings, slices

#: Characters after which a long text is cut at the next safe place.
PIECE_CHARS = 50_000

#: Before a lone space between two characters that aren't white space, the pattern always cuts.
SAFE_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= [^\s\u180e\u200b\ufeff])")


def pieces_of(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``size`` characters whose ids, put together, are those of the whole text."""
    out, at = [], 0
    while len(text) - at > 2 * size and (cut := SAFE_CUT.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def byte_table() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 0x100
    for b in range(256):
        table.append(chr(b if b in prints else spare))
        spare += b not in prints
    return table


def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``, by merging its bytes with the lower ranks."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        known = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank]
        if not known:
            raise ValueError(f"no merges lead to the token of rank {rank}")
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """A byte-level BPE of a rank file (lines of base64 token and rank) behind the ``tokenizers`` library."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        char = byte_table()
        shown = lambda token: "".join(char[b] for b in token)
        merges = [tuple(map(shown, _last_merge(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        # no cache of words, so that a worker's memory doesn't depend on what it has read
        self._tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
        self._tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self._byte = {c: b for b, c in enumerate(char)}
        size = self._tokenizer.get_vocab_size()
        tokens = [bytes(self._byte[c] for c in self._tokenizer.id_to_token(i)) for i in range(size)]
        self._length = np.array([len(t) for t in tokens], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Long texts go to the library in pieces, cut where the splitting pattern cuts too."""
        pieces = [pieces_of(t) for t in texts]
        flat = iter(self._tokenizer.encode_batch_fast([p for x in pieces for p in x], add_special_tokens=False))
        return [list(chain.from_iterable(next(flat).ids for _ in x)) for x in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; a character may be split over several of them."""
        ids = np.asarray(ids, np.int64)
        n = self._length[ids]
        if not n.sum():
            return b""
        return self._bytes[np.repeat(self._start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in code points; an id that holds part of a character covers that character."""
        ids = np.asarray(ids, np.int64)
        raw = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80)  # byte to character, from 1
        end = np.cumsum(self._length[ids])
        return char[end - self._length[ids]] - 1, char[end - 1]


@lru_cache(2)
def _bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def public_ranks() -> tuple[str, str]:
    """Place of the multilingual rank file, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``(key, ids array<int>)`` of every whole text, with ``starts`` and ``ends`` in code points if ``offsets``.

    A null or empty text has no ids. Rows are encoded one by one: repeated rows stay, other columns are left out, no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches):
        bpe, ints = _bpe(ranks_path, pattern), pa.list_(pa.int32())
        for batch in slices(batches, text, 1 << 18):
            ids = bpe.encode(as_strings(batch, text))
            cols = [batch.column(key), pa.array(ids, ints)]
            if offsets:
                both = [bpe.offsets(x) for x in ids]
                cols += [pa.array([x[k] for x in both], ints) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "starts", "ends"][: len(cols)])

    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, raw binary, text string)``: the bytes of the ids, and their UTF-8 with U+FFFD for what is no character.

    Null or empty ids give empty bytes. ``ids`` is returned as it came, without another join.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                raw = [bpe.decode(x.values.to_numpy() if x.is_valid else []) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column(ids), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())],
                    names=[key, "ids", "raw", "text"],
                )

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, ids array<int>, raw binary, text string")


def digest(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every text: it is encoded, and its ids are decoded again. A null
    text is empty. Keys, null and repeated ones too, come back as they are, a row for each row; other columns are left out, and a key named
    like a result is an error."""
    if key in ("n_tokens", "ids_sha256", "decoded_sha256"):
        raise ValueError(f"the key column {key} is named like a result")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = _bpe(ranks_path, pattern)
        shown = [str(i) for i in range(len(bpe._length))].__getitem__
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, text, 1 << 18):
            ids = bpe.encode(as_strings(batch, text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hexed(",".join(map(shown, x)).encode()) for x in ids], pa.string()),
                    pa.array([hexed(bpe.decode(x)) for x in ids], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over the whole ``documents`` table."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks())


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
