"""Toxicity by a linear-chain conditional random field over words: marginals give offending spans and document scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintarium.llm.common import WORDS, forget, held_out, ship, text_of, written

#: The classifier is fitted on so many labelled rows of each kind at most, taken in order of a hash, and on so many bytes.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_BYTES = 1000, 2000, 3_000_000
#: A word is labelled toxic when its evidence (log-likelihood ratio) reaches this, or this in texts without such words, and it is so much likelier in toxic texts.
EVIDENCE, AMONG_REST, RATIO = 24.0, 16.0, 20.0
#: A word is part of a span from this marginal on.
SPAN = 0.5
STEPS, RATE, PENALTY = 40, 0.3, 0.05
#: Lengths of the beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Distinct words whose emissions a worker keeps.
KEPT_WORDS = 200_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"
Z = 20.0


def bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def features(word: bytes) -> list[str]:
    """The word without marks around it and its beginnings, each with the length it is a beginning of (0: the word)."""
    w = bare(word)
    return ["0" + w, *[f"{k}{w[:k]}" for k in BEGINNINGS if len(w) >= k]]


def _stems(word: bytes) -> list[str]:
    return [f for f in features(word) if f[0] != "3"]


class Chain:
    """Forward-backward over many two-state chains that lie one behind the other in one array.

    ``step`` has the potentials of following states and ``first`` those of a chain's start. The array is cut into
    equal parts that are walked side by side: once to compose each part's linear map, once with the true start.
    """

    def __init__(self, step: np.ndarray, first: np.ndarray):
        self.step, self.first = step, first

    def _run(self, up: np.ndarray, reset: np.ndarray, to0: np.ndarray, to1: np.ndarray, fresh0: np.ndarray, fresh1: np.ndarray) -> np.ndarray:
        """States (x0, x1), scaled to sum 1, after each place: x' = up-weighted step of x, or the fresh state where reset."""
        n = len(up)
        length = max(1, min(512, math.isqrt(n)))
        parts = -(-n // length)
        pad = parts * length - n
        shape = lambda a, fill: np.concatenate((a, np.full(pad, fill, a.dtype))).reshape(parts, length).T
        up, reset, fresh0, fresh1 = shape(up, 1.0), shape(reset, True), shape(fresh0, 0.5), shape(fresh1, 0.5)
        (a00, a10), (a01, a11) = to0, to1

        def after(x0, x1, i):
            y0, y1 = x0 * a00 + x1 * a10, (x0 * a01 + x1 * a11) * up[i]
            return y0, y1

        u0, u1, v0, v1 = np.ones(parts), np.zeros(parts), np.zeros(parts), np.ones(parts)
        for i in range(length):
            p0, p1 = after(u0, u1, i)
            q0, q1 = after(v0, v1, i)
            r = reset[i]
            u0, u1, v0, v1 = np.where(r, fresh0[i], p0), np.where(r, fresh1[i], p1), np.where(r, fresh0[i], q0), np.where(r, fresh1[i], q1)
            scale = 1 / (u0 + u1 + v0 + v1)
            u0, u1, v0, v1 = u0 * scale, u1 * scale, v0 * scale, v1 * scale
        begin, x0, x1 = np.empty((2, parts)), 0.5, 0.5
        for k, (a, b, c, d) in enumerate(zip(u0.tolist(), u1.tolist(), v0.tolist(), v1.tolist())):
            begin[0, k], begin[1, k] = x0, x1
            y0, y1 = x0 * a + x1 * c, x0 * b + x1 * d
            x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
        out = np.empty((length, parts))
        x0, x1 = begin
        for i in range(length):
            p0, p1 = after(x0, x1, i)
            x0, x1 = np.where(reset[i], fresh0[i], p0), np.where(reset[i], fresh1[i], p1)
            scale = 1 / (x0 + x1)
            x0, x1 = x0 * scale, x1 * scale
            out[i] = x1
        return out.T.reshape(-1)[:n]

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(state 1) at each place; the forward share of state 1; and what comes back from the right as a share of state 1."""
        n = len(emission)
        e = np.exp(np.clip(emission, -Z, Z))
        start = np.zeros(n, bool)
        start[starts] = True
        s0, s1 = self.first
        f1 = s1 * e / (s0 + s1 * e)
        a = self.step
        forward = self._run(e, start, (a[0, 0], a[1, 0]), (a[0, 1], a[1, 1]), 1 - f1, f1)
        # Backwards: x is the message times the emission at the place, so the step is the transposed one; the message itself follows.
        last = np.append(start[1:], True)
        l1 = e / (1 + e)
        back = self._run(e[::-1], last[::-1], (a[0, 0], a[0, 1]), (a[1, 0], a[1, 1]), (1 - l1)[::-1], l1[::-1])[::-1]
        beta1 = back / e
        beta0 = 1 - back
        top = forward * beta1
        return top / (top + (1 - forward) * beta0), forward, back


@dataclass
class Model:
    """Weights by feature length and text, the bias, the potentials of the chain, and the document's regression."""

    weights: dict[int, dict[str, float]]
    bias: float
    step: np.ndarray
    first: np.ndarray
    document: np.ndarray

    def emission(self, word: bytes) -> float:
        w, got = bare(word), self.weights
        return self.bias + got[0].get(w, 0.0) + got[3].get(w[:3], 0.0) + got[4].get(w[:4], 0.0) + got[5].get(w[:5], 0.0) + got[6].get(w[:6], 0.0)

    def documents(self, texts: list[bytes], kept: dict[bytes, float]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each text, and the marginals of its words."""
        split = [t.split() for t in texts]
        flat = [w for ws in split for w in ws]
        if len(kept) > KEPT_WORDS:
            kept.clear()
        get = kept.get
        found = list(map(get, flat))
        if None in found:
            for w in {w for w, e in zip(flat, found) if e is None}:
                kept[w] = self.emission(w)
            found = list(map(kept.__getitem__, flat))
        sizes = np.array([len(ws) for ws in split], np.int64)
        ends = np.cumsum(sizes)
        full = sizes > 0
        p = Chain(self.step, self.first).marginals(np.array(found), (ends - sizes)[full])[0] if flat else np.zeros(0)
        most, total = np.zeros(len(texts)), np.zeros(len(texts))
        if flat:
            most[full], total[full] = np.maximum.reduceat(p, (ends - sizes)[full]), np.add.reduceat(p, (ends - sizes)[full])
        return _logistic(_rows(most, total) @ self.document), np.split(p, ends[:-1])


def _rows(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a document's score depends on: the largest marginal and the expected number of toxic words."""
    return np.stack((np.ones(len(most)), most, np.log1p(total)), axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _distinct(texts: list[bytes], labels: list[int]) -> list[int]:
    """Places of texts that are no copies or near copies of earlier ones with their label, by four least hashes of their words."""
    seen: list[dict] = [defaultdict(set) for _ in range(4)]
    out = []
    for i, (t, y) in enumerate(zip(texts, labels)):
        hashes = [zlib.crc32(w) for w in set(t.split())] or [0]
        signs = [(y, min((h * m + 97) & 0xFFFFFFFF for h in hashes)) for m in (1, 2654435761, 40503, 2246822519)]
        near = Counter(j for s, k in zip(seen, signs) for j in s.get(k, ()))
        if near and max(near.values()) >= 3:
            continue
        for s, k in zip(seen, signs):
            s[k].add(i)
        out.append(i)
    return out


def _evidence(k1: int, n1: int, k0: int, n0: int) -> float:
    part = lambda k, e: k * math.log(k / e) if k else 0.0
    n, k = n1 + n0, k1 + k0
    return 2 * (part(k1, k * n1 / n) + part(k0, k * n0 / n) + part(n1 - k1, (n - k) * n1 / n) + part(n0 - k0, (n - k) * n0 / n))


def label_words(texts: list[list[int]], toxic: np.ndarray, stems: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Which words of each text count as toxic, from the labels of the texts; and which texts can be learned from.

    A stem (a word or a beginning of four or more characters) is toxic when texts that hold it are labelled toxic far
    more often. Of the toxic texts that hold none, the stem with the most evidence among them is added, again and
    again while there is enough. A stem must be in three or four texts that are not alike. Toxic texts that still hold none are
    left out, as their words can't be told apart.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    held = [{s for w in set(ws) for s in stems[w]} for ws in texts]
    clean = Counter(s for h, y in zip(held, toxic) if not y for s in h)

    def evidence(among: list[int]) -> dict[str, float]:
        found = Counter(s for i in among for s in held[i])
        n = len(among)
        return {s: _evidence(k, n, clean[s], n0) for s, k in found.items() if k >= 3 and k * n0 >= RATIO * clean[s] * n}

    def apart(stem: str, among: list[int], need: int = 3) -> bool:
        """Whether ``need`` texts hold the stem that have little else in common, so that it isn't just part of a copied text."""
        picked: list[set] = []
        for i in among:
            if stem in held[i]:
                own = set(texts[i])
                if all(len(own & p) <= 0.25 * len(own | p) for p in picked):
                    picked.append(own)
                    if len(picked) == need:
                        return True
        return False

    every = [i for i in range(len(texts)) if toxic[i]]
    strong = {s for s, e in evidence(every).items() if e >= EVIDENCE and apart(s, every)}
    # A beginning must do more than stand for one word.
    within, words = Counter(s for i in every for s in held[i] if s in strong), Counter()
    for i in every:
        words.update({(s, ss[0]) for ss in (stems[w] for w in set(texts[i])) for s in ss if s in strong and s[0] != "0"})
    one = {s for (s, _), k in words.items() if k > 0.7 * within[s]}
    chosen = {s for s in strong if s not in one}
    rest = [i for i in every if not held[i] & chosen]
    while rest:
        best = next((s for e, s in sorted(((e, s) for s, e in evidence(rest).items() if e >= AMONG_REST), reverse=True) if apart(s, rest, 4)), None)
        if best is None:
            break
        chosen.add(best)
        rest = [i for i in rest if best not in held[i]]
    marked = np.array([any(s in chosen for s in ss) for ss in stems], bool)
    usable = np.ones(len(texts), bool)
    usable[rest] = False
    return [marked[np.array(ws, np.int64)] & bool(y) for ws, y in zip(texts, toxic)], usable


def train(rows: list[tuple[bytes, int]]) -> Model:
    """Fits the field on labelled texts; without a toxic and a clean text it gives the share of toxic rows to everything."""
    rows = [rows[i] for i in _distinct([t for t, _ in rows], [y for _, y in rows])]
    toxic = np.array([bool(y) for _, y in rows], bool)
    share = math.log((toxic.sum() + 0.5) / ((~toxic).sum() + 1.5)) if len(rows) else -3.0
    index: dict[bytes, int] = {}
    texts = [[index.setdefault(w, len(index)) for w in t.split()] for t, _ in rows]
    if not toxic.any() or toxic.all() or not index:
        return Model({k: {} for k in (0, *BEGINNINGS)}, -5.0, np.ones((2, 2)), np.ones(2), np.array([share, 0.0, 0.0]))
    words = list(index)
    marks, usable = label_words(texts, toxic, [_stems(w) for w in words])
    texts, marks, toxic = [t for t, u in zip(texts, usable) if u], [m for m, u in zip(marks, usable) if u], toxic[usable]
    if not toxic.any():
        return Model({k: {} for k in (0, *BEGINNINGS)}, -5.0, np.ones((2, 2)), np.ones(2), np.array([share, 0.0, 0.0]))
    # Features of at least three occurrences among the words, by word; 0 is the bias.
    listed = [features(w) for w in words]
    common = Counter(f for fs in listed for f in fs)
    seen = np.bincount(np.concatenate([np.array(t, np.int64) for t in texts]), minlength=len(words))
    hits = Counter()
    for w, fs in enumerate(listed):
        for f in fs:
            hits[f] += int(seen[w])
    place = {f: i + 1 for i, f in enumerate(f for f in common if hits[f] >= 3)}
    found = [(w, place[f]) for w, fs in enumerate(listed) for f in fs if f in place] + [(w, 0) for w in range(len(words))]
    of, at = np.array(found, np.int64).T
    flat = np.concatenate([np.array(t, np.int64) for t in texts])
    y = np.concatenate([m.astype(float) for m in marks])
    sizes = np.array([len(t) for t in texts])
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    begin = np.zeros(len(flat), bool)
    begin[starts] = True
    theta, trans = np.zeros(len(place) + 1), np.zeros(6)
    theta[0] = math.log((y.sum() + 1) / (len(y) + 1))
    state = [np.zeros(len(theta) + 6), np.zeros(len(theta) + 6)]
    follows = ~begin[1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][follows].astype(int), y[1:][follows].astype(int)), 1)
    firsts = np.array([(1 - y[starts]).sum(), y[starts].sum()])
    for t in range(1, STEPS + 1):
        emission = np.bincount(of, theta[at], len(words))
        step, first = np.exp(trans[:4].reshape(2, 2)), np.exp(trans[4:])
        e = emission[flat]
        p, forward, back = Chain(step, first).marginals(e, starts)
        by_word = np.bincount(flat, p - y, len(words))
        grad = np.bincount(at, by_word[of], len(theta)) + PENALTY * theta * (np.arange(len(theta)) > 0)
        a0, a1, b0, b1 = 1 - forward[:-1], forward[:-1], 1 - back[1:], back[1:]
        joint = np.stack((a0 * step[0, 0] * b0, a0 * step[0, 1] * b1, a1 * step[1, 0] * b0, a1 * step[1, 1] * b1))
        joint = joint @ (follows / joint.sum(axis=0))
        from_start = np.array([(1 - p[starts]).sum(), p[starts].sum()])
        g = np.concatenate((grad, joint - pairs.reshape(-1) + PENALTY * trans[:4], from_start - firsts + PENALTY * trans[4:]))
        state = [0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g]
        move = RATE * (1 - t / (STEPS + 1)) * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-9)
        theta, trans = theta - move[:-6], trans - move[-6:]
    weights: dict[int, dict[str, float]] = {k: {} for k in (0, *BEGINNINGS)}
    theta[np.abs(theta) < 0.05] = 0
    for f, i in place.items():
        if theta[i]:
            weights[int(f[0])][f[1:]] = float(theta[i])
    model = Model(weights, float(theta[0]), np.exp(trans[:4].reshape(2, 2)), np.exp(trans[4:]), np.zeros(3))
    p = Chain(model.step, model.first).marginals(np.bincount(of, theta[at], len(words))[flat], starts)[0]
    most, total = np.zeros(len(texts)), np.zeros(len(texts))
    most[sizes > 0], total[sizes > 0] = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts)
    x, w = _rows(most, total), np.zeros(3)
    for _ in range(25):
        q = _logistic(x @ w)
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w - np.linalg.solve(hess, x.T @ (q - toxic) + 0.1 * w)
    model.document = w
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """The model from a bounded sample of labelled rows outside the held-out fold.

    Up to ``toxic_rows`` and ``clean_rows`` ids are taken in order of a hash; their texts are taken whole in the same order
    as long as ``train_bytes`` hold them. Labels that are null don't count, and an id with two labels counts as toxic.
    Null texts count as empty, other columns of either table are ignored whatever their names, and tables without a row
    give a model that scores everything low.
    """
    # Only id and text go on, under names of their own: other columns may be called anything.
    texts = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_t"))
    labels = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y"))
    known = labels.where(F.col("_y").isNotNull() & F.col("_id").isNotNull())
    if folds:
        known = known.where(~held_out(F.col("_id"), folds))
    known = known.groupBy(F.col("_id").alias("_i")).agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_i"))
    taken = known.where("_y = 1").orderBy("_h", "_i").limit(toxic_rows).unionByName(known.where("_y <> 1").orderBy("_h", "_i").limit(clean_rows))
    found = texts.join(F.broadcast(taken), F.col("_id") == F.col("_i")).select("_h", "_i", F.least("_y", F.lit(1)).alias("_y"), "_t")
    found = written(found.withColumn("_n", F.octet_length("_t")), "toxic-sample")
    # Of repeated rows of one id the longest text is taken, so there are at most toxic_rows + clean_rows rows here.
    sizes = found.groupBy("_h", "_i", "_y").agg(F.max("_n").alias("n")).orderBy("_h", "_i").collect()
    room, ids = {0: train_bytes // 2, 1: train_bytes // 2}, []
    for r in sizes:
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            ids.append((r["_i"], r["n"]))
    some = docs.sparkSession.createDataFrame(ids or [(None, 0)], f"i {found.schema['_i'].dataType.simpleString()}, n int")
    rows = found.join(F.broadcast(some), (F.col("_i") == F.col("i")) & (F.col("_n") == F.col("n"))).groupBy("_h", "_i", "_y").agg(F.min("_t").alias("_t")).orderBy("_h", "_i").select("_t", "_y").collect()
    forget(found)
    return train([(r["_t"].encode("utf-8", "replace"), r["_y"]) for r in rows])


def spans(text: str, marginals: np.ndarray, least: float = SPAN) -> list[dict]:
    """Start and end in code points of every run of words whose marginals reach ``least``, with the largest of them."""
    out: list[dict] = []
    hot = marginals >= least
    if not hot.any():
        return out
    for i, m in enumerate(WORDS.finditer(text)):
        if hot[i]:
            if i and hot[i - 1]:
                out[-1]["end"], out[-1]["probability"] = m.end(), max(out[-1]["probability"], float(marginals[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": float(marginals[i])})
    return out


def _portions(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def score(docs: DataFrame, model: Model, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, spans) of every document by its text alone.

    The score grows with the largest marginal and the expected number of toxic words; spans are offsets in code points.
    Null text counts as empty, which scores low. Repeated rows stay rows; other columns are ignored; an empty table
    gives an empty result. No shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = sent.value, {}
        for b in batches:
            for i, j in _portions(b, 1):
                part = b.slice(i, j - i)
                scores, marks = m.documents(part.column(1).cast(pa.binary()).to_pylist(), kept)
                found = [spans(part.column(1)[k].as_py(), p) if len(p) and p.max() >= SPAN else [] for k, p in enumerate(marks)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(found, kind)], names=["_id", "score", "predicted", "spans"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>").withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``cut``, with all their columns and in their schema.

    The text is a string column. Null and empty texts score low and stay; repeated rows are judged alike. Columns of any name are kept, an empty table gives an empty result, and nothing is shuffled.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = sent.value, {}
        for b in batches:
            for i, j in _portions(b, column):
                part = b.slice(i, j - i)
                texts = [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(m.documents(texts, kept)[0] < cut))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(found["doc_id"], 3).alias("held_out"), "score", "predicted", "spans")
