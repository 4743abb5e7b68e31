"""Quality rules: counts of a text, and its character and word histograms against language references."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.llm.common import ship, text_of, written

#: Common words of the languages that have a reference of their own; all other texts share one.
COMMON = {
    "en": "the of and to a in is it that was for on with as be by this from are or at an he have not".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
OTHER = "other"
#: Texts with fewer characters are not judged by their characters.
LEAST_CHARS = 200
#: Largest distance (0 to 1) of the characters that is kept. On labelled rows good texts stay below 0.24, junk lies above 0.34.
MOST_CHARS = 0.28
#: The largest distance of the words depends on their number: this share of the way from what a sample of the reference is expected to have to what a
#: text without common words has, and no less than this quantile of such samples. Chosen on half of the labelled rows of sf0.1.
WORD_SHARE, WORD_QUANTILE = 0.5, 0.99
#: Sizes in words at which samples are drawn, and how many; the cut is interpolated between the sizes.
SAMPLE_SIZES, SAMPLES = np.unique(np.geomspace(10, 4000, 28).round().astype(int)), 400
CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "symbol", "lower_other", "upper_other", "other")


def _class(c: str) -> int:
    if c == "\n":
        return 4
    if c in " \t\r\x0b\x0c":
        return 3
    if c in ".,;:!?'\"-()":
        return 5
    kind = unicodedata.category(c)
    if kind[0] == "N":
        return 2
    if kind[0] == "L":
        upper = kind in ("Lu", "Lt")
        return (1 if upper else 0) if c.isascii() else (8 if upper else 7)
    return 6 if c.isascii() else 9


_TABLE = np.array([_class(chr(i)) for i in range(0x3000)] + [9], np.uint8)
_PLACES = {k: {w.encode(): i for i, w in enumerate(ws)} for k, ws in COMMON.items()}
_BINS = max(map(len, COMMON.values())) + 1


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included.

    Words are numbered, and windows are numbered from those of half their length, so that a window is one number and equal
    numbers are equal windows; a text of many words costs a few arrays of them.
    """
    if len(words) <= size:
        return 0
    index: dict[bytes, int] = {}
    one = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    if len(index) == len(words):
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    windows, width = one, 1
    while width < size:
        step = min(width, size - width)
        # The last window of the same length that still ends where the wider one ends.
        windows = joined(windows[: len(words) - width - step + 1], windows[step : len(words) - width + 1])
        width += step
    twice = np.bincount(windows)[windows] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[size : size + len(twice)] -= twice
    return int((np.cumsum(edges) > 0).sum())


def histograms(text: str, lang: str | None) -> tuple[list[int], list[int]]:
    """Characters by class, and words by common word of the language with all others in the last bin."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = np.bincount(_TABLE[np.minimum(codes, 0x3000)], minlength=len(CLASSES))
    words = np.zeros(_BINS, np.int64)
    places = _PLACES.get(lang)
    counts = Counter(text.encode("utf-8", "replace").lower().split())
    if places:
        for w, i in places.items():
            words[i] = counts.get(w, 0)
    words[-1] = counts.total() - words.sum()
    return chars.tolist(), words.tolist()


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the reference: the root of the divergence in bits."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum((a.sum(axis=1) + b.sum(axis=1)) / 2, 0))


def word_cuts(reference: np.ndarray, share: float = WORD_SHARE, quantile: float = WORD_QUANTILE) -> np.ndarray:
    """Largest distance that is kept for a text of each of ``SAMPLE_SIZES`` words, from seeded samples of the reference."""
    rng, q = np.random.default_rng(0), reference / max(reference.sum(), 1)
    if not reference.sum():
        return np.ones(len(SAMPLE_SIZES))
    none = np.zeros((1, len(q)))
    none[0, -1] = 1
    farthest = distance(none, q)[0]
    drawn = [distance(rng.multinomial(n, q, SAMPLES).astype(float), q) for n in SAMPLE_SIZES]
    return np.array([max(d.mean() + share * (farthest - d.mean()), np.quantile(d, quantile)) for d in drawn])


FEATURES = "_id {}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_chars bigint, base_failed boolean, chars array<bigint>, words array<bigint>"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of every document in one pass, without its text."""
    ship(docs.sparkSession)
    lang = F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise(F.lit(OTHER))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"), lang.alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            counts = [base_counts(t) for t in texts]
            hists = [histograms(t, k) for t, k in zip(texts, langs)]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(failed, pa.bool_()), pa.array([h[0] for h in hists], pa.list_(pa.int64())), pa.array([h[1] for h in hists], pa.list_(pa.int64()))],
                names=["_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "base_failed", "chars", "words"],
            )

    return rows.mapInArrow(run, FEATURES.format(rows.schema["_id"].dataType.simpleString()))


def references(found: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums of the histograms of all texts that pass the base rules, by language: five rows at most."""
    sums = [F.sum(F.element_at("chars", i + 1)).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.element_at("words", i + 1)).alias(f"w{i}") for i in range(_BINS)]
    rows = found.where("not base_failed").groupBy("lang").agg(*sums).collect()
    return {r["lang"]: (np.array([r[f"c{i}"] for i in range(len(CLASSES))], float), np.array([r[f"w{i}"] for i in range(_BINS)], float)) for r in rows}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_chars: float = MOST_CHARS, word_share: float = WORD_SHARE, word_quantile: float = WORD_QUANTILE) -> DataFrame:
    """Counts, distances and verdict of every document.

    The reference of a language is the sum over all its documents that pass the base rules; languages without a word
    list, null among them, share one. A text of at least ``LEAST_CHARS`` characters is rejected when its characters
    are further away than ``most_chars``, one of a language with a word list when its common words are further than
    ``word_cuts`` gives for that many words. Null text counts as empty and fails the base rules. Repeated rows stay
    rows; other columns are ignored; an empty table gives an empty result. The text is read once.
    """
    found = written(features(docs, id_col, text_col, lang_col), "quality")
    known = references(found)
    cuts = {lang: word_cuts(w, word_share, word_quantile) for lang, (_, w) in known.items() if lang != OTHER}
    kind = found.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            langs, sizes, words = np.array(b.column("lang").to_pylist(), object), b.column("n_chars").to_numpy(), b.column("n_words").to_numpy()
            failed = np.array(b.column("base_failed").to_pylist(), bool)
            chars = np.array(b.column("chars").to_pylist(), float).reshape(n, len(CLASSES))
            common = np.array(b.column("words").to_pylist(), float).reshape(n, _BINS)
            by_chars, by_words, most_words = np.zeros(n), np.zeros(n), np.ones(n)
            for lang, (c, w) in known.items():
                own = langs == lang
                by_chars[own] = distance(chars[own], c)
                if lang != OTHER:
                    by_words[own] = distance(common[own], w)
                    most_words[own] = np.interp(np.log(np.maximum(words[own], 1)), np.log(SAMPLE_SIZES), cuts[lang])
            odd = ((sizes >= LEAST_CHARS) & (by_chars > most_chars)) | (by_words > most_words)
            keep = [b.column(c) for c in ("_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(~failed & ~odd), pa.array(by_chars), pa.array(by_words)], names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"])

    out = found.mapInArrow(run, f"_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double")
    return out.withColumnRenamed("_id", id_col)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
