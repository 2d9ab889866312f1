"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 32 bytes ends in zeros, so equal
passages are cut alike wherever they stand. A chunk that several texts hold is
encoded once and its ids are joined to those texts; other chunks are encoded
where their text is. Where two chunks meet, the ids of the two may differ from
those of the whole: from the last token of the left that surely starts a word
to the first such token of the right, the tokens are decoded and encoded anew,
and the window grows over further chunks until both ends are such tokens.

A token that starts with a space and a visible ASCII character starts a word in
every context, because the vocabulary's pattern lets a space stand only before
a word or among white space. So the ids before and after a window are those of
the whole text.

What moves: 32-byte keys of texts and chunks; the shared chunks' texts, once a
task, to be encoded; each distinct text, compressed, once a task; and the ids of
its shared chunks. A task holds one text at a time. The filter that tells tasks
which chunks may be shared has at most ``FILTER_BITS`` bits; beyond, more chunks
pass it, and the exact join behind it drops them.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plover.session import materialize

#: 8 MB at most, whatever the number of shared chunks.
FILTER_BITS = 1 << 26

_BLOCK = 1 << 20
_WINDOW = 32
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, np.uint32)
_WORD_START = re.compile(r"(?= [!-~])")
#: Runs that are whole words of the vocabulary's pattern wherever they stand: Latin letters, ASCII marks but the apostrophe, a line's end between them.
_WHOLE = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[ ]?[!-&(-/:-@\\[-`{-~]+|\n(?=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])")


@dataclass(frozen=True)
class Cutting:
    """Chunks of about ``2 ** bits`` bytes beyond ``least``, up to ``most``."""

    bits: int = 10
    least: int = 256
    most: int = 8192


def cuts(data: bytes, how: Cutting = Cutting()) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``, none inside a character; the last is its length."""
    raw, found = np.frombuffer(data, np.uint8), []
    for start in range(0, len(raw), _BLOCK):
        from_ = max(0, start - _WINDOW + 1)
        h = _GEAR[raw[from_ : start + _BLOCK]]
        for shift in (1, 2, 4, 8, 16):
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        at = np.flatnonzero(h >> np.uint32(32 - how.bits) == 0) + from_ + 1
        at = at[(at > start) & (at < len(raw))]
        found += at[(raw[at] & 0xC0) != 0x80].tolist()
    ends, last = [], 0

    def forced(last: int, until: int) -> int:
        while until - last > how.most:
            last += how.most
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        return last

    for end in found:
        last = forced(last, end)
        if end - last >= how.least:
            ends.append(end)
            last = end
    last = forced(last, len(raw))
    return [*ends, len(raw)] if len(raw) > last or not ends else ends


def _byte_of_char() -> dict[str, int]:
    """The public byte alphabet: visible Latin-1 stands for itself, other bytes for U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Coder(dict):
    """A byte-level vocabulary, and the ids of pieces that this process has encoded.

    Pieces run from one sure word start to the next; up to ``pieces`` of them
    are remembered. A new piece that is made of whole words goes to the merges
    word by word, which are remembered too; any other goes to the tokenizer.
    """

    pieces = 600_000

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level vocabulary")
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that strip, normalise or need word ends aren't supported")
        self.special = {t.content: i for i, t in added.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = _byte_of_char()
        size = 1 + max([*self.tokenizer.get_vocab(with_added_tokens=True).values(), 0])
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.bytes = [bytes(byte[c] for c in t) if k not in added and all(c in byte for c in t) else t.encode() for k, t in enumerate(names)]
        self.starts = np.array([len(t) > 1 and t[0] == 32 and 33 <= t[1] <= 126 for t in self.bytes])
        self.wire = "<u2" if size <= 1 << 16 else "<u4"
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte.items()}

    def __missing__(self, piece: str) -> bytes:
        words = _WHOLE.findall(piece) if len(piece) <= 64 else []
        if len(words) == 1 and words[0] == piece:
            ids = _raw([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        elif words and "".join(words) == piece:
            ids = b"".join([self[w] for w in words])
        else:
            ids = _raw(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= self.pieces:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of UTF-8 ``data`` without special tokens."""
        return np.frombuffer(b"".join(map(self.__getitem__, _WORD_START.split(data.decode()))) if data else b"", "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def segments(self, text: str) -> list[tuple[bytes, int | None]]:
        """(stretch, None) of plain text and (b"", id) of special tokens, in order."""
        parts = self.splitter.split(text) if self.splitter else [text]
        return [(b"", self.special[p]) if k % 2 else (p.encode(), None) for k, p in enumerate(parts) if p]

    def join(self, chunks: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of the text that the chunks make up, from the ids of each chunk on its own."""
        out, open_ = [], b""
        for k, ids in enumerate(chunks):
            sure = np.flatnonzero(self.starts[ids])
            if not len(sure):
                open_ += self.decode(ids)
                continue
            first, last = int(sure[0]), int(sure[-1])
            if k:
                out += [self.encode(open_ + self.decode(ids[:first])), ids[first:last]]
            else:
                out.append(ids[:last])
            open_ = self.decode(ids[last:])
        return [*out, self.encode(open_)]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def chunk_key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(code: Coder, text: str, how: Cutting) -> Iterator[bytes]:
    for data, special in code.segments(text):
        if special is None:
            last = 0
            for end in cuts(data, how):
                yield data[last:end]
                last = end


class _Seen(set):
    """Keys that a task has met; forgotten beyond a bound, which only costs repeats."""

    def new(self, key: bytes) -> bool:
        if key in self:
            return False
        if len(self) >= 500_000:
            self.clear()
        self.add(key)
        return True


def _holdings(path: str, how: Cutting):
    """(text_key, chunk_key) of each text, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = coder(path), _Seen()
        for batch in batches:
            texts, chunks = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if seen.new(key):
                    for c in {chunk_key(c) for c in _chunks(code, text.as_py(), how)}:
                        texts.append(key)
                        chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(chunks, pa.binary())], ["text_key", "chunk_key"])

    return run


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Four filter bits of each key."""
    halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return np.stack([(halves[:, 0] + np.uint64(k) * (halves[:, 1] | np.uint64(1))) % np.uint64(bits) for k in range(4)])


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at = _places(batch.column(0).to_pylist(), bits).ravel()
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64), pa.int64())], ["at", "word"])

    return run


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys, of at most ``FILTER_BITS`` bits."""
    bits = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(max(1, 12 * keys.count())))))
    got = keys.mapInArrow(_filter_words(bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return words


def _texts_of(path: str, how: Cutting, words: np.ndarray):
    """Texts of the chunks that the filter lets pass, once a task."""
    bits = 64 * len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen, sent = coder(path), _Seen(), _Seen()
        for batch in batches:
            keys, chunks = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not seen.new(key):
                    continue
                held = {chunk_key(c): c for c in _chunks(code, text.as_py(), how)}
                if held:
                    at = _places(list(held), bits)
                    passed = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
                    for (k, c), ok in zip(held.items(), passed, strict=True):
                        if ok and sent.new(k):
                            keys.append(k)
                            chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], ["chunk_key", "body"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            ids = [code.encode(c).astype(code.wire).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk_key", "body"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task, compressed."""
    seen, press = _Seen(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        keys, bodies = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if seen.new(key):
                keys.append(key)
                bodies.append(press.compress(text.as_py().encode()))
        none = pa.nulls(len(keys), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), none, pa.array(bodies, pa.binary())], ["text_key", "chunk_key", "body"])


def _assemble(path: str, how: Cutting, with_ids: bool):
    """Rows sorted by text and chunk, the text after the ids of its shared chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, press = coder(path), zstandard.ZstdDecompressor()
        now, held, done = None, {}, None
        for batch in batches:
            out = []
            for key, chunk, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != now:
                    now, held = key, {}
                if chunk is not None:
                    held[chunk] = np.frombuffer(body, code.wire).astype("<u4")
                    continue
                if key == done:
                    continue
                done, ids = key, []
                for data, special in code.segments(press.decompress(body).decode()):
                    if special is not None:
                        ids.append(np.array([special], "<u4"))
                        continue
                    parts, last = [], 0
                    for end in cuts(data, how):
                        piece = data[last:end]
                        k = chunk_key(piece)
                        if k not in held:
                            held[k] = code.encode(piece)
                        parts.append(held[k])
                        last = end
                    ids += code.join(parts)
                every = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
                raw = every.tobytes()
                back = code.decode(every).decode("utf-8", "replace").encode()
                held = {}
                out.append((key, len(every), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), *((raw, back) if with_ids else ())))
            names = ["text_key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.binary()] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def encode_texts(docs: DataFrame, path: str, how: Cutting = Cutting(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 under the vocabulary file ``path``.

    ``path`` is read where tasks run. Ids equal those that the tokenizers
    library gives for the whole text without adding special tokens; special
    tokens that a text spells out are encoded as such. ``ids`` (little-endian
    unsigned 32-bit) and ``decoded`` (UTF-8) are added if ``with_ids``. A null
    text is the empty text, without ids. Ids may be null or repeat, repeated
    rows come out each, other columns are ignored, and an empty table gives no
    rows.
    """
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = named.select("id", F.unhex(F.sha2("text", 256)).alias("text_key"), "text")
    texts = keyed.select("text_key", "text")
    holdings = texts.mapInArrow(_holdings(path, how), "text_key binary, chunk_key binary")
    holdings = materialize(holdings.distinct(), "holdings")
    shared = holdings.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("chunk_key")
    shared = materialize(shared, "shared")
    bodies = texts.mapInArrow(_texts_of(path, how, _key_filter(shared)), "chunk_key binary, body binary")
    once = bodies.join(shared, "chunk_key", "left_semi").dropDuplicates(["chunk_key"])
    encoded = materialize(once.mapInArrow(_encode(path), "chunk_key binary, body binary"), "encoded")
    lent = holdings.join(encoded, "chunk_key").select("text_key", "chunk_key", "body")
    whole = texts.mapInArrow(_packed, "text_key binary, chunk_key binary, body binary")
    dealt = lent.unionByName(whole).repartition("text_key").sortWithinPartitions("text_key", F.col("chunk_key").asc_nulls_last())
    more = ", ids binary, decoded binary" if with_ids else ""
    results = dealt.mapInArrow(_assemble(path, how, with_ids), f"text_key binary, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    results = materialize(results, "tokens")
    return keyed.select("id", "text_key").join(results, "text_key").drop("text_key")
