"""Byte-level BPE: a backtracking encoder that gives exact merges in linear time, and an offset-table decoder."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.llm.common import ship, text_of

#: Entries that a worker keeps of chunks and of pairs; a full table is emptied, so memory is bounded.
KEPT_CHUNKS, KEPT_PAIRS, LONGEST_KEPT = 500_000, 1_000_000, 64
#: Pieces of up to so many bytes are matched where the encoder looks only; longer ones in one run of the automaton.
SHORT_PIECE = 48

_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of other than white space with one space before, else white space; no piece of PIECES crosses their borders.
CHUNKS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary in the JSON format of the tokenizers library.

    Tokens are numbered inside by merge order, bytes first. ``split`` has the pair that each token was merged from,
    ``joined`` the token that a pair merges to, ``shorter`` the longest other token that a token begins with. Added
    tokens are matched in the raw text before anything else, as the library does.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, chars = spec["model"], _byte_chars()
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only plain byte-level vocabularies are supported")
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = [c for c, _ in sorted(chars.items(), key=lambda x: x[1])] + list(dict.fromkeys(a + b for a, b in merges))
        inner = {name: i for i, name in enumerate(names)}
        self.outer = [vocab[name] for name in names]
        text = ["".join(chr(chars[c]) for c in name) for name in names]  # one character a byte
        self.length = [len(t) for t in text]
        self.split = [(i, i) for i in range(len(names))]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = (inner[a], inner[b])
            if pair not in self.joined:
                self.joined[pair] = c = inner[a + b]
                if self.split[c] == (c, c):
                    self.split[c] = pair
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        by_text: dict[str, int] = {}
        for i, t in enumerate(text):
            # A token that its own bytes don't merge to can't come out of a whole encoding.
            if i < 256 or self.fits(*self.split[i], i):
                by_text.setdefault(t, i)
        self.shorter = [next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1) for t in text]
        # Whatever a token begins with, and the longest token that begins it.
        self.begins = {t[:k]: next((by_text[t[:j]] for j in range(k, 0, -1) if t[:j] in by_text)) for t in by_text for k in range(1, len(t) + 1)}
        self.forward = ahocorasick.Automaton()
        for t, i in by_text.items():
            self.forward.add_word(t, i)
        self.automaton = ahocorasick.Automaton()
        for t, i in by_text.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.packed = [int(x).to_bytes(4, "little") for x in self.outer]
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec.get("added_tokens", ())}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        bytes_of = {o: t.encode("latin-1") for o, t in zip(self.outer, text)} | {int.from_bytes(i, "little"): t.encode() for t, i in self.added.items()}
        top = max(bytes_of) + 1
        self.blob = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(bytes_of.get(i, b"")) for i in range(top)]))).astype(np.int64)

    def fits(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether merging leaves a and b apart: no earlier merge joins the end of a with the start of b."""
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.fits(a, b)
        return known

    def piece(self, data: bytes) -> bytes:
        """Ids of one piece: longest matches first, shorter ones and steps back where neighbours don't fit.

        The automaton over reversed tokens gives the longest token at every start in one run; for a short piece it is
        cheaper to walk the trie from those starts alone that the encoder comes to. A position is given up at most
        once, so the steps are linear in the bytes.
        """
        n, text = len(data), data.decode("latin-1")
        longest: list[int] | None = None
        if n > SHORT_PIECE:
            longest = [-1] * n
            for end, token in self.automaton.iter(text[::-1]):  # for one end, longer tokens come first
                if longest[n - 1 - end] < 0:
                    longest[n - 1 - end] = token
        begins, walk = self.begins, self.forward.longest_prefix
        token = longest[0] if longest else begins[text[: walk(text)]]
        if self.length[token] == n:
            return self.packed[token]
        out: list[int] = []
        usable, at, length, shorter = [True] * (n + 1), 0, self.length, self.shorter
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if usable[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    if at == n:
                        return b"".join([self.packed[t] for t in out])
                    if longest:
                        token = longest[at]
                    else:
                        rest = text[at:]
                        token = begins[rest[: walk(rest)]]
                    break
                if (token := shorter[token]) < 0:
                    usable[at] = False
                    token = out.pop()
                    at -= length[token]
                    break

    def chunk(self, text: str) -> bytes:
        bare = text[text[0] == " " :]
        if bare.isalpha():
            out = self.piece(text.encode())
        elif bare[:-1].isalpha() and bare[-1] in ",.;:!?|":
            out = (self.chunks.get(text[:-1]) or self.chunk(text[:-1])) + self.piece(bare[-1].encode())
        else:
            out = b"".join([self.piece(p.encode()) for p in PIECES.findall(text)])
        if len(text) <= LONGEST_KEPT:
            if len(self.chunks) >= KEPT_CHUNKS:
                self.chunks.clear()
            self.chunks[text] = out
        return out

    def plain(self, text: str) -> bytes:
        parts = CHUNKS.findall(text)
        ids = list(map(self.chunks.get, parts))
        if None in ids:
            ids = [self.chunk(p) if i is None else i for i, p in zip(ids, parts)]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(t in text for t in self.added):
            return self.plain(text)
        return b"".join(self.added.get(p) or self.plain(p) for p in self.special.split(text) if p)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: every id's slice of the blob, found in the offset table."""
        start = self.offsets[ids]
        sizes = self.offsets[ids + 1] - start
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """The codec of a vocabulary, built once in a process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def _vocabulary(spark, path: str):
    """The vocabulary file, a few MB by its kind, for all workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256) of every document, row by row, without a shuffle.

    Null text counts as empty: no ids, and the hashes of nothing. Strings of added tokens inside texts become those
    tokens. ``decoded_sha256`` is of the text decoded from the ids. Ids may repeat or be null; other columns are ignored.
    """
    ship(docs.sparkSession)
    vocabulary = _vocabulary(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            numbers = [np.frombuffer(i, "<u4") for i in ids]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in numbers]))).astype(np.int32)
            values = pa.array(np.concatenate([*numbers, np.zeros(0, "<u4")]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                    pa.array([len(x) for x in numbers], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(c.decode(x.astype(np.int64))).hexdigest() for x in numbers]),
                ],
                names=["_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = rows.mapInArrow(run, f"_id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); a null list gives the empty text, bytes that aren't UTF-8 become U+FFFD."""
    ship(encoded.sparkSession)
    vocabulary = _vocabulary(encoded.sparkSession, tokenizer)
    rows = encoded.select(F.col(id_col).alias("_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value)
        for b in batches:
            texts = [c.decode(np.asarray(i, np.int64)).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()).drop("ids")
