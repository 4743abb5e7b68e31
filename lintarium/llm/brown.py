"""Language-model scoring with Brown classes: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.llm.common import forget, held_out, ship, text_of, written

#: Words with a unit of their own in the first exchange, buckets by ending for all other words there, and classes.
HEAD, ENDINGS, CLASSES = 2048, 512, 64
#: Every other word that occurs this often then moves to a class by the classes around it, however many such words there are.
LEAST = 4
#: Words, at most, whose counts and classes go out to all workers; those of rarer ones stay in a table and are joined.
SENT_WORDS = 200_000
#: Share of the smoothed unigram in a token's probability; pseudo-count of a class's own frequency in its transitions.
MIXED, PSEUDO = 0.05, 10.0
#: Passes of the exchange at most; distinct words, or contexts, that a worker counts before it hands them on.
PASSES, COUNTED, HELD = 6, 400_000, 4_000_000
#: Stands for the end of a text. It is white space, so it is never a word.
END = b"\n"


@dataclass
class Tokens:
    """The tokens of some texts: distinct words, the word of each token (``len(words)`` is END, after each text), and starts."""

    array: pa.Array
    at: np.ndarray
    starts: np.ndarray

    def __post_init__(self):
        self.words: list[bytes] = self.array.to_pylist()


def tokens(texts: pa.Array) -> Tokens:
    """Words between white space with A-Z lower-cased. Arrow splits and numbers them, so only distinct ones become objects."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, of = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(flat), 0)
    flat, of = flat.filter(full), of.filter(full).to_numpy()
    coded = flat.cast(pa.binary()).dictionary_encode()
    sizes = np.bincount(of, minlength=len(texts)) + 1
    at = np.full(len(of) + len(texts), len(coded.dictionary), np.int64)
    at[np.arange(len(of)) + of] = coded.indices.to_numpy()
    return Tokens(coded.dictionary, at, np.cumsum(sizes) - sizes)


def _portions(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Slices of the batches of about ``most`` bytes of text with their tokens."""
    for b in batches:
        texts = b.column(b.schema.get_field_index("_text"))
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
            yield b.slice(at, end - at), tokens(texts.slice(at, end - at))
            at = end


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over the column ``_text``; the word is binary, and ``END`` counts the texts. Counted in the workers first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, t in _portions(batches):
            for word, n in zip([*t.words, END], np.bincount(t.at, minlength=len(t.words) + 1).tolist()):
                counts[word] += n
            if len(counts) > COUNTED:
                yield _table(counts)
                counts = Counter()
        yield _table(counts)

    return training.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _table(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


@dataclass
class Lexicon:
    """The most frequent words, their counts and, once they are known, the classes of the words, of END and of the endings.

    In the first exchange, units are the head words, END, and the endings of all other words.
    """

    words: list[bytes]
    counts: np.ndarray
    head: int
    endings: int
    end_count: int
    cls: np.ndarray | None = None
    ending_cls: np.ndarray | None = None
    name: str = ""

    def __post_init__(self):
        self.name = self.name or uuid.uuid4().hex
        self.place = {w: i for i, w in enumerate([*self.words, END])}
        own = min(self.head, len(self.words))
        self.unit = np.concatenate((np.arange(own), self.head + 1 + self.buckets(self.words[own:]), [self.head])).astype(np.int64)
        self.count = np.append(self.counts, self.end_count)

    @property
    def units(self) -> int:
        return self.head + 1 + self.endings

    def buckets(self, words: list[bytes]) -> np.ndarray:
        return np.array([zlib.crc32(w[-3:]) % self.endings for w in words], np.int64)

    def places(self, t: Tokens) -> np.ndarray:
        """Places of the distinct words (-1: not in the list) and of END."""
        return np.fromiter(map(self.place.get, [*t.words, END], repeat(-1)), np.int64, len(t.words) + 1)

    def of_words(self, own: np.ndarray, ending: np.ndarray, t: Tokens, places: np.ndarray) -> np.ndarray:
        """What each distinct word and END has: ``own`` by its place, or ``ending`` by the ending of a rare word."""
        out, rare = own[places], np.flatnonzero(places < 0)
        if len(rare):
            out[rare] = ending[self.buckets([t.words[i] for i in rare.tolist()])]
        return out

    def packed(self) -> tuple:
        return self.words, self.counts, self.head, self.endings, self.end_count, self.cls, self.ending_cls, self.name


_lexicons: dict[str, Lexicon] = {}


def _lexicon(packed: tuple) -> Lexicon:
    if packed[-1] not in _lexicons:
        _lexicons.clear()
        _lexicons[packed[-1]] = Lexicon(*packed)
    return _lexicons[packed[-1]]


def pair_counts(training: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each unit follows each other one, over all training tokens."""
    n = lexicon.units
    sent = training.sparkSession.sparkContext.broadcast(lexicon.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dense = _lexicon(sent.value), np.zeros(n * n, np.int64)
        ending = known.head + 1 + np.arange(known.endings)
        for _, t in _portions(batches):
            units = known.of_words(known.unit, ending, t, known.places(t))[t.at]
            codes, many = np.unique(np.append(known.head, units[:-1]) * n + units, return_counts=True)
            dense[codes] += many
        codes = np.flatnonzero(dense)
        for i in range(0, len(codes), 1 << 18):
            part = codes[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(dense[part])], names=["code", "n"])

    found = training.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


#: A context and how often it occurs. With n classes, a context is the class before a word (0 to n - 1), the class of a
#: listed word after it (n more), or that of a rare word after it (2 n more).
_CONTEXT = np.dtype([("c", "<u2"), ("n", "<u4")])


class _Held:
    """Contexts of words that a worker has seen, packed into one row for each word."""

    def __init__(self, width: int):
        self.width, self.parts, self.held = width, [], 0

    def add(self, ids: np.ndarray, contexts: np.ndarray) -> None:
        self.parts.append(ids * self.width + contexts)
        self.held += len(ids)

    def rows(self, name) -> Iterator[pa.RecordBatch]:
        """(word, found) of all that is held, which is then forgotten; ``name`` gives the words of the ids."""
        if self.held:
            codes, many = np.unique(np.concatenate(self.parts), return_counts=True)
            first = np.flatnonzero(np.diff(codes // self.width, prepend=-1))
            ends = np.append(first, len(codes))
            flat = np.empty(len(codes), _CONTEXT)
            flat["c"], flat["n"] = codes % self.width, many
            words = name((codes[first] // self.width).tolist())
            for i in range(0, len(words), 1 << 13):
                yield _contexts(words[i : i + (1 << 13)], flat, ends[i : i + (1 << 13) + 1])
        self.parts, self.held = [], 0


def _contexts(words: list[bytes], flat: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    part = flat[ends[0] : ends[-1]]
    offsets = ((ends - ends[0]) * _CONTEXT.itemsize).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), found], names=["word", "found"])


def contexts(training: DataFrame, lexicon: Lexicon, classes: int, listed: bool) -> DataFrame:
    """(word, found), the packed contexts of the listed words beyond the head, or of all rare ones; one row a word and portion.

    With the rare words also come rows of END and a class: how often a listed word of each class follows a listed word of
    that one. So with the rare words' contexts every pair of tokens is counted once.
    """
    sent = training.sparkSession.sparkContext.broadcast(lexicon.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, ids, table = _lexicon(sent.value), _Held(3 * classes), {}, np.zeros(classes * classes, np.int64)
        name = (lambda at: [known.words[known.head + i] for i in at]) if listed else (lambda at: list(map(list(ids).__getitem__, at)))
        for _, t in _portions(batches):
            own = known.places(t)
            cls, places = known.of_words(known.cls, known.ending_cls, t, own)[t.at], own[t.at]
            left, seen = np.append(known.cls[-1], cls[:-1]), places >= 0
            if listed:
                at = np.flatnonzero((places >= known.head) & (places < len(known.words)))
                who = places[at] - known.head
            else:
                at, fresh = np.flatnonzero(~seen), np.flatnonzero(own < 0)
                own[fresh] = [ids.setdefault(t.words[i], len(ids)) for i in fresh.tolist()]
                who = own[t.at[at]]
                table += np.bincount((left * classes + cls)[seen & np.append(True, seen[:-1])], minlength=classes * classes)
            held.add(who, left[at])
            held.add(who, cls[at + 1] + np.where(seen[at + 1], classes, 2 * classes))
            if held.held > HELD or len(ids) > COUNTED:
                yield from held.rows(name)
                ids.clear()
        yield from held.rows(name)
        for c, row in enumerate(table.reshape(classes, classes)):
            to = np.flatnonzero(row)
            if len(to):
                flat = np.empty(len(to), _CONTEXT)
                flat["c"], flat["n"] = to, row[to]
                yield _contexts([END + bytes([c])], flat, np.array([0, len(to)]))

    return training.mapInArrow(run, "word binary, found binary")


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and the counts of their contexts, from rows sorted by word; however many rows a word has, one sum is held."""
    word, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        words, found = b.column(0).to_pylist(), b.column(1).to_pylist()
        new = np.array([True, *(x != y for x, y in zip(words, words[1:]))])
        group = np.cumsum(new) - 1
        names = [words[i] for i in np.flatnonzero(new).tolist()]
        flat = np.frombuffer(b"".join(found), _CONTEXT)
        at = np.repeat(group, [len(x) // _CONTEXT.itemsize for x in found]) * width + flat["c"]
        counts = np.bincount(at, weights=flat["n"], minlength=len(names) * width).reshape(-1, width)
        if word == names[0]:
            counts[0] += held
        elif word is not None:
            yield [word], held[None]
        word, held = names[-1], counts[-1].copy()
        if len(names) > 1:
            yield names[:-1], counts[:-1]
    if word is not None:
        yield [word], held[None]


def _chooser(step: np.ndarray, size: np.ndarray):
    """Gives each row of contexts the class that makes the classes after the word and its own occurrences likeliest.

    That is the sum over its contexts of log P(class after | class) + log P(class | class before) / size of the class.
    """
    n, flow = len(size), np.log(np.maximum(step, 1e-300))
    before = flow.T - np.log(np.maximum(size, 0.5))[:, None]
    return lambda counts: np.argmax(counts[:, :n] @ before.T + (counts[:, n : 2 * n] + counts[:, 2 * n :]) @ flow.T, axis=1)


def place_listed(training: DataFrame, lexicon: Lexicon, step: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """The classes of the listed words and END after the words beyond the head have moved by their contexts."""
    n, choose = len(size), _chooser(step, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _merged(batches, 3 * n):
            # A word has as many contexts on its left as it occurs.
            kept = np.flatnonzero(counts[:, :n].sum(axis=1) >= least)
            best = choose(counts[kept]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in kept.tolist()], pa.binary()), pa.array(best)], names=["word", "cls"])

    rows = contexts(training, lexicon, n, True).repartition("word").sortWithinPartitions("word")
    moved, cls = rows.mapInArrow(run, "word binary, cls int").toArrow(), lexicon.cls.copy()
    cls[[lexicon.place[w] for w in moved["word"].to_pylist()]] = moved["cls"].to_numpy()
    return cls


def place_rare(training: DataFrame, lexicon: Lexicon, step: np.ndarray, size: np.ndarray, least: int) -> tuple[DataFrame, np.ndarray]:
    """(word, n, cls) of every word outside the list, written, and the counts of all pairs of classes.

    Words that occur ``least`` times or more move by their contexts, rarer ones have the class of their ending. Where a rare
    word follows a rare one, the first counts with the class of its ending.
    """
    n, choose = len(size), _chooser(step, size)
    endings = lexicon.ending_cls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((n, n), np.int64)
        for words, counts in _merged(batches, 3 * n):
            pairs = np.array([w[:1] == END for w in words])
            for i in np.flatnonzero(pairs).tolist():
                table[words[i][1]] += counts[i, :n].astype(np.int64)
            words, counts = [w for w in words if w[:1] != END], counts[~pairs]
            many = counts[:, :n].sum(axis=1).astype(np.int64)
            own = endings[np.array([zlib.crc32(w[-3:]) % len(endings) for w in words], np.int64)]
            best = np.where(many >= least, choose(counts), own)
            np.add.at(table.T, best, counts[:, :n].astype(np.int64))
            np.add.at(table, best, counts[:, n : 2 * n].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(many), pa.array(best, pa.int32()), pa.nulls(len(words), pa.list_(pa.int64()))], names=["word", "n", "cls", "pairs"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([table.reshape(-1)], pa.list_(pa.int64()))], names=["word", "n", "cls", "pairs"])

    rows = contexts(training, lexicon, n, False).repartition("word").sortWithinPartitions("word")
    rows = written(rows.mapInArrow(run, "word binary, n bigint, cls int, pairs array<bigint>"), "lm-words")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, n * n).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["pairs"])

    # One table from each task that merged words; they are summed in a few tasks and then here.
    table = sum(np.array(r["pairs"], float) for r in rows.where("word is null").select("pairs").repartition(8).mapInArrow(add, "pairs array<bigint>").collect())
    return rows.where("word is not null").drop("pairs"), table.reshape(n, n)


def _steps(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed transitions of the classes, and their sizes: each token is once the second of a pair."""
    size = table.sum(axis=0)
    share = size / max(size.sum(), 1)
    return (table + PSEUDO * share) / (table.sum(axis=1)[:, None] + PSEUDO), size


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit: every unit in turn, the most frequent first, moves where the bigram likelihood grows most.

    Starts from units dealt out by frequency. What a move changes is computed for all classes at once from the class
    matrix and the unit's counts with the classes on its left and right. Stops after a pass with hardly a move.
    """
    units, size = len(pairs), pairs.sum(axis=1)
    order = np.argsort(-size, kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(units) % classes
    belongs = np.zeros((units, classes))
    belongs[np.arange(units), cls] = 1
    right, left = pairs @ belongs, pairs.T @ belongs
    table = belongs.T @ right
    total = belongs.T @ size
    used = [int(w) for w in order if size[w] > 0]
    for _ in range(passes):
        moves = 0
        for w in used:
            a, r, l, own = int(cls[w]), right[w].copy(), left[w].copy(), pairs[w, w]
            table[a] -= r
            table[:, a] -= l
            table[a, a] += own
            r[a] -= own
            l[a] -= own
            total[a] -= size[w]
            flat = _h(table)
            rows, columns, corner = _h(table + r), _h(table + l[:, None]), np.diagonal(table)
            gain = (rows - flat).sum(axis=1) - np.diagonal(rows - flat) + (columns - flat).sum(axis=0) - np.diagonal(columns - flat)
            gain += _h(corner + r + l + own) - _h(corner) - 2 * (_h(total + size[w]) - _h(total))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            total[b] += size[w]
            if b != a:
                moves += 1
                cls[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if moves <= len(used) // 200:
            break
    return cls


@dataclass
class Model:
    """Listed words with their classes, transitions divided by the smoothed size of the class they lead to, and the unigram's N and V."""

    lexicon: tuple
    weight: np.ndarray
    tokens: int
    types: int
    mixed: float = MIXED
    classes: int = CLASSES

    def base(self, counts):
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def both(self, weight, counts, base, known):
        """A token's probability; ``weight`` is its class's, and an unknown word is shared out among the classes."""
        return (1 - self.mixed) * weight * (counts + 0.5) + self.mixed * base * known


def _listed(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """About ``most`` words, never more, from the most frequent on, with their counts.

    Whole levels of counts are taken, an eighth of an octave each, as long as they fit, so that no task sorts for all; of
    the level that no longer fits, the part whose hash is low enough.
    """
    words = counts.where(F.col("word") != F.lit(END))
    level = F.floor(F.log2("n") * 8)
    wanted, room = F.lit(False), most
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("n"), F.max("n").alias("most")).collect(), key=lambda r: -r["n"]):
        if r["c"] > room:
            # Six standard deviations below the room that is left.
            share = max(0.0, room - 6 * room**0.5) / r["c"]
            wanted = wanted | (F.col("n").between(r["n"], r["most"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
            break
        wanted, room = F.col("n") >= r["n"], room - r["c"]
    top = words.where(wanted).select("word", "n").toArrow().to_pylist()
    return sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))


def fit(training: DataFrame, counts: DataFrame, head: int = HEAD, endings: int = ENDINGS, classes: int = CLASSES, sent_words: int = SENT_WORDS, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model from all training texts (column ``_text``) and their word counts, and the table (word, n, cls) of the rare words."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("e")).first()
    top = _listed(counts, sent_words)
    lexicon = Lexicon([w for w, _ in top], np.array([n for _, n in top], np.int64), head, endings, int(total["e"] or 0))
    pairs = pair_counts(training, lexicon)
    cls = exchange(pairs, classes)
    table = np.zeros((classes, classes))
    np.add.at(table, (cls[:, None], cls[None, :]), pairs)
    step, size = _steps(table)
    # From here on the list has classes; the rest of the vocabulary has those of its endings until it is placed.
    known = [*lexicon.packed()[:5], cls[lexicon.unit], cls[head + 1 :]]
    lexicon = Lexicon(*known)
    known[5] = place_listed(training, lexicon, step, size, least)
    lexicon = Lexicon(*known)
    rare, table = place_rare(training, lexicon, step, size, least)
    step, size = _steps(table)
    kinds = np.bincount(lexicon.cls[: len(lexicon.words) + (lexicon.end_count > 0)], minlength=classes).astype(float)
    for r in rare.groupBy("cls").count().collect():
        kinds[r["cls"]] += r["count"]
    return Model(lexicon.packed(), step / (size + 0.5 * (kinds + 1)), int(total["n"] or 0), int(total["v"]), MIXED, classes), rare


def score(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """log10 probability of every text under a class bigram model of the texts outside the held-out fold.

    A token's probability is (1 - MIXED) * P(class | class before) * P(word | class) + MIXED * unigram. Emissions and
    unigram are smoothed by half a count, over the known words of the class or of all and one unknown, so both parts
    sum to one; an unknown word takes the class of its ending and an equal share of the unknown. All training tokens
    are counted. The ``HEAD`` most frequent words are exchanged one by one over the pairs of all tokens; then every
    other word that occurs ``LEAST`` times moves to the class that its contexts make likeliest, all at once, and only
    rarer ones keep the class of their last three bytes: the clustered vocabulary grows with the input. Only the
    ``SENT_WORDS`` most frequent words are known to every worker; counts and classes of the rest are a table, which the
    rare tokens are joined with, so nothing that is sent out grows with the vocabulary.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. Null text counts as empty and
    has one token, its end. Repeated rows stay rows and are learned from as often; null ids hash as the empty text.
    Other columns are ignored, whatever their names. Without training texts every count is zero. An empty table gives an
    empty result. Texts of any length are scored whole; a text's rare tokens may be summed up in several tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(docs[id_col], folds).alias("held_out"), text_of(docs, text_col).alias("_text"))
    training = rows.where("not held_out").select("_text")
    counts = written(word_counts(training), "lm-counts")
    model, words = fit(training, counts, **sizes)
    forget(counts)
    sent = spark.sparkContext.broadcast(model)
    kind, n = rows.schema["_id"].dataType.simpleString(), model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        known = _lexicon(m.lexicon)
        for b, t in _portions(batches):
            places, starts = known.places(t)[t.at], t.starts
            seen, cls, at = places >= 0, known.cls[places], np.flatnonzero(places < 0)
            count = known.count[places]
            after = np.append(True, seen[:-1])
            before = np.append(known.cls[-1], cls[:-1])
            base = m.base(count)
            lone = np.where(seen, np.log10(base), 0)
            mixed = np.where(seen & after, np.log10(m.both(m.weight[before, cls], count, base, 1.0)), 0)
            rare_ends = np.cumsum(np.add.reduceat((~seen).astype(np.int64), starts))
            pair_ends = np.cumsum(np.add.reduceat((~seen & ~after).astype(np.int64), starts))
            # A rare word goes with the class before it and the listed word after it; two in a row also go as a pair.
            left, follows = np.where(after, before, -1)[at], seen[at + 1]
            words, second = t.array.take(pa.array(t.at[at])), np.flatnonzero(~after[at])
            one = [words, pa.array(left, pa.int16()), pa.array(np.where(follows, cls[at + 1], -1), pa.int16()), pa.array(np.where(follows, count[at + 1], 0))]
            two = [words.take(pa.array(second - 1)), words.take(pa.array(second))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(np.diff(np.append(starts, len(places)))),
                    pa.array(np.add.reduceat((seen & (count > 0)).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(lone, starts)),
                    pa.array(np.add.reduceat(mixed, starts)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, rare_ends).astype(np.int32)), pa.StructArray.from_arrays(one, names=["word", "l", "r", "k"])),
                    pa.ListArray.from_arrays(pa.array(np.append(0, pair_ends).astype(np.int32)), pa.StructArray.from_arrays(two, names=["first", "word"])),
                ],
                names=["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "pairs"],
            )

    shape = "n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:binary,l:smallint,r:smallint,k:bigint>>, pairs array<struct<first:binary,word:binary>>"
    parts = written(rows.mapInArrow(run, f"_id {kind}, held_out boolean, {shape}").withColumn("_row", F.monotonically_increasing_id()), "lm-parts")
    endings, weights = F.lit(Lexicon(*model.lexicon).ending_cls.tolist()), F.lit(model.weight.reshape(-1).tolist())
    ending = lambda word: F.get(endings, F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(model.lexicon[3])).cast("int")).cast("int")
    weight = lambda a, b: F.get(weights, (a.cast("int") * n + b.cast("int")))
    zero = F.lit(0.0)

    rare = parts.select("_row", F.inline("rare")).join(words, "word", "left")
    rare = rare.select("_row", "l", "r", "k", F.coalesce("n", F.lit(0)).alias("c"), F.coalesce("cls", ending(F.col("word"))).alias("cls"))
    known = F.when(F.col("c") > 0, 1.0).otherwise(1.0 / n)
    own = F.when(F.col("l") >= 0, F.log10(model.both(weight(F.col("l"), F.col("cls")), F.col("c"), model.base(F.col("c")), known))).otherwise(zero)
    following = F.when(F.col("r") >= 0, F.log10(model.both(weight(F.col("cls"), F.col("r")), F.col("k"), model.base(F.col("k")), F.lit(1.0)))).otherwise(zero)
    single = rare.select("_row", (F.col("c") > 0).cast("long").alias("k"), F.log10(model.base(F.col("c"))).alias("b"), (own + following).alias("s"))

    firsts = words.select(F.col("word").alias("first"), F.col("cls").alias("first_cls"))
    pairs = parts.select("_row", F.inline("pairs")).join(words, "word", "left").join(firsts, "first", "left")
    pairs = pairs.select("_row", F.coalesce("n", F.lit(0)).alias("c"), F.coalesce("cls", ending(F.col("word"))).alias("cls"), F.coalesce("first_cls", ending(F.col("first"))).alias("first_cls"))
    double = pairs.select("_row", F.lit(0).cast("long").alias("k"), zero.alias("b"), F.log10(model.both(weight(F.col("first_cls"), F.col("cls")), F.col("c"), model.base(F.col("c")), known)).alias("s"))

    sums = single.unionByName(double).groupBy("_row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    whole = parts.drop("rare", "pairs").join(sums, "_row", "left")
    out = whole.select(
        F.col("_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_brown(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
