"""Token counts through a digest cache: only contents that no run has counted before are encoded."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintarium.llm.common import SPACE, WORDS, release, scratch, ship, text_of, written

#: Words whose counts a worker keeps; a full table is emptied. Longer words are never kept.
KEPT_WORDS, LONGEST_KEPT = 500_000, 64
#: Names of the normalisations, part of the version: runs of white space become one space and none at the ends, where
#: the tokenizer drops white space (see ``by_word``), or the text as it is.
SPACES, WHOLE = "spaces-1", "whole-1"
#: Fixed value: a pattern whose pieces hold no white space, so that what it doesn't match includes all of it.
DROPS_SPACE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CACHE = "version string, digest string, n_tokens bigint"


def normalisation(data: bytes) -> str:
    return SPACES if by_word(data) else WHOLE


def version_of(data: bytes) -> str:
    """Digest of the tokenizer file, its library's version and the normalisation."""
    import sentencepiece
    import tokenizers

    library = tokenizers.__version__ if _is_json(data) else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(b"\0".join([data, library.encode(), normalisation(data).encode()])).hexdigest()


def _is_json(data: bytes) -> bool:
    return data.lstrip()[:1] == b"{"


def by_word(data: bytes) -> bool:
    """Whether a text's count is the sum over its words: white space is dropped before merging and joins nothing.

    Read off the specification: normalizers that work inside words, a split that keeps only pieces without white space,
    and added tokens that neither hold white space nor look at what is beside them. Anything else counts by whole texts.
    """
    if not _is_json(data):
        return False
    spec = json.loads(data)
    flat = lambda x, inner: [] if x is None else [z for y in x[inner] for z in flat(y, inner)] if x["type"] == "Sequence" else [x]
    for n in flat(spec.get("normalizer"), "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        if n["type"] not in ("NFC", "Lowercase") and not spaces:
            return False
    pre = flat(spec.get("pre_tokenizer"), "pretokenizers")
    split = pre[:1] and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": DROPS_SPACE} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    if not split or any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in pre[1:]):
        return False
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or WORDS.findall(t["content"]) != [t["content"]] for t in spec["added_tokens"])


class Counter:
    """Counts tokens with the file's library, one thread, no added special tokens, truncation or padding."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = by_word(data)
        self.words: dict[str, int] = {}
        if _is_json(data):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(data.decode())
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.sizes = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_proto=data)
            self.sizes = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.sizes(texts)
        split = [WORDS.findall(t) for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        missing = list({w for ws in split for w in ws if w not in known})
        fresh = dict(zip(missing, self.sizes(missing)))
        known.update((w, n) for w, n in fresh.items() if len(w) <= LONGEST_KEPT)
        long = {w: n for w, n in fresh.items() if len(w) > LONGEST_KEPT}
        if not long:
            return [sum(map(known.__getitem__, ws)) for ws in split]
        return [sum(long[w] if w in long else known[w] for w in ws) for ws in split]


def _portions(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of the batches in lists of about ``most`` characters, as their words are objects of their own meanwhile."""
    for b in batches:
        held, size = [], 0
        for i in range(b.num_rows):
            held.append(b.column(0)[i].as_py())
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held


_counters: dict[str, Counter] = {}


def _counter(data: bytes) -> Counter:
    key = version_of(data)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(data)
    return _counters[key]


def load_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; appends of runs that overlapped may repeat a digest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "digest string, n_tokens bigint")
    return spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; null text counts as empty, repeated rows stay rows.

    ``cache`` is a folder of Parquet files (version, digest, n_tokens) that all executors reach; without it a new one
    is made in the shared folder. A first pass digests every normalised content. Digests without an entry of this
    version are given to one document each, whose text is fetched by id and checksum, counted, and appended under
    the digest of what was counted. Files are committed by Spark, so a failed run leaves no half entry, and a rerun
    counts only what is missing. A tokenizer that drops white space takes contents as equal that differ only in it; for
    any other one contents are equal when they are the same. Texts of any length are counted whole, alone in their
    portion if they are long. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        data = f.read()  # a few MB by its kind
    version, cache = version_of(data), cache or scratch(spark, "token-cache")
    text, spaces = text_of(docs, text_col), by_word(data)
    norm = F.trim(F.regexp_replace(text, F.lit(SPACE + "+"), F.lit(" "))) if spaces else text
    meta = docs.select(docs[id_col].alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(norm, 256).alias("digest"), F.xxhash64(text).alias("_check"))
    meta = written(meta, "token-digests")
    _add_missing(docs.select(docs[id_col].alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_check")), meta, data, version, cache)
    # The texts that were dealt out are no longer needed.
    release(spark)
    # Written, so that the join deals out both sides itself and may split a digest that very many rows share.
    entries = written(load_cache(spark, cache, version), "token-entries")
    out = meta.join(entries, "digest", "left")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _add_missing(texts: DataFrame, meta: DataFrame, data: bytes, version: str, cache: str) -> None:
    """Counts one text (_id, _text, _check) of each digest that the cache lacks and appends the entries."""
    spark, spaces = texts.sparkSession, by_word(data)
    vocabulary = spark.sparkContext.broadcast(data)
    one = meta.groupBy("digest").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_check").alias("c"))).alias("_one"))
    missing = one.join(load_cache(spark, cache, version), "digest", "left_anti").select(F.col("_one.i").alias("_i"), F.col("_one.c").alias("_c"))
    fetched = texts.join(missing.hint("shuffle_hash"), texts["_id"].eqNullSafe(F.col("_i")) & (texts["_check"] == F.col("_c")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for part in _portions(batches):
            digests = [hashlib.sha256((" ".join(WORDS.findall(t)) if spaces else t).encode()).hexdigest() for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(counter.counts(part), pa.int64())], names=["digest", "n_tokens"])

    counted = fetched.mapInArrow(run, "digest string, n_tokens bigint")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
