"""Operators and pipeline stages on clashing column names, empty tables, nulls, ties, repeated rows and very long texts."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintarium.llm import brown, exact_dedup, mixing, quality, sharding, simhash, token_counts, toxicity

CLASHES = ("_i", "_h", "_y", "_t", "_n", "_id", "_text", "_digest", "_goes", "_row", "fp", "v", "word", "size", "best", "keep_id", "taken", "copies", "shard", "n_tokens", "digest", "level", "first", "l", "r", "k", "i", "n")
TYPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def _rows(texts):
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), *("x",) * len(CLASHES)) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeinorstu") for _ in range(rng.randint(2, 9)))
    plain = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(30)]
    huge = " ".join(word() for _ in range(400_000))
    return [(0, None), (1, ""), (2, " \n\t"), *((i + 3, t) for i, t in enumerate(plain)), (40, plain[0]), (41, plain[0].replace(" ", "\n")), (3, plain[0]), (3, plain[5]), (50, huge), (51, "x" * 1_000_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(_rows(texts), TYPE).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0), "q") for i in range(3, 30)] + [(None, 1, 1, "q"), (4, None, None, "q"), (900, 1, 1, "q")], "doc_id long, quality int, toxic int, _i string").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/none/labels.parquet")
    return at


def test_stages_on_edge_cases(spark, docs, texts, folder):
    now, names = docs, set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert set(now.columns) == names and now.schema == docs.schema, name
    found = {(r["doc_id"], r["text"]) for r in now.collect()}
    assert found <= set(texts) and Counter(t for _, t in found).most_common(1)[0][1] == 1
    encoded = corpus_pipeline.STAGES[-1][1](spark, now, folder).select("doc_id", "n_tokens").collect()
    assert len(encoded) == now.count()


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_empty_tables(spark, docs, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, docs.limit(0), folder).count() == 0
    if name == "toxicity":
        assert stage(spark, docs, f"{folder}/none").count() == docs.count()


def test_toxicity_ignores_other_columns(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.select("doc_id", "text"), labels.drop("_i"))
    assert a.weights == b.weights and a.bias == b.bias
    assert toxicity.score(docs, a).count() == docs.count()


def test_operators_take_clashing_names_and_long_texts(docs):
    n = docs.count()
    assert brown.score(docs, head=50, endings=8, classes=4, sent_words=100).count() == n
    assert exact_dedup.content_sort(docs).count() == n
    assert quality.judge(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert sharding.shard(docs, [1.0] * 8, [1.0] * 9).count() == n
    assert simhash.near_duplicates(docs).count() == n


def test_brown_without_training_texts(spark):
    """Only held-out rows: nothing is known, and every text still has a score."""
    held = [i for i in range(200) if brown.zlib.crc32(str(i).encode()) % 5 == 1][:4]
    rows = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = brown.score(rows).collect()
    assert len(got) == 4 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(spark, tmp_path, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["a b", "a   b", " a b ", "a\n\n\nb", "a\tb", "", None, "e ́", "<|endoftext|>\n <|endoftext|>", "é x　y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda x: len(t.encode(x))
    want = {i: size(x or "") for i, x in enumerate(texts)}
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, cache).collect()} == want
    assert token_counts.by_word(open(path, "rb").read()) == (name == "word_bpe_49k.json")


def test_token_cache_holds_several_tokenizers(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some  words here")], "doc_id long, text string")
    cache, sizes = str(tmp_path / "cache"), []
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "word_bpe_49k.json"):
        sizes.append(token_counts.count_tokens(docs, public_tokenizers.path(name), cache).first()["n_tokens"])
    assert sizes[0] == sizes[2] != sizes[1] and spark.read.parquet(cache).count() == 2


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_repeat_words_are_those_of_all_windows(words, size):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = Counter(windows)
    assert quality.repeat_words(words, size) == len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(size)})


def _distance(p, q):
    """Jensen-Shannon distance of two histograms in bits."""
    p, q = [x / (sum(p) or 1) for x in p], [x / (sum(q) or 1) for x in q]
    part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def _char_class(c):
    if c == "\n":
        return "newline"
    if c in " \t\r\x0b\x0c":
        return "space"
    if c in ".,;:!?'\"-()":
        return "sentence"
    kind = unicodedata.category(c)
    if ord(c) >= 0x3000:
        return "other"
    if kind[0] == "N":
        return "digit"
    if kind[0] == "L":
        return ("upper" if kind in ("Lu", "Lt") else "lower") + ("" if c.isascii() else "_other")
    return "symbol" if c.isascii() else "other"


def test_quality_verdicts_match_a_plain_computation(spark):
    """Base counts, both distances and the verdict, from texts alone; the cuts come from the reference that is summed here."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()] + [(90_001, "x # 東京 " * 60, None), (90_002, "", "en"), (90_003, "of the and to a in is it that was " * 12, "en")]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    base, chars, common = {}, {}, {}
    for i, text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts = Counter(windows)
        repeated = len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base[i] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words))
        by_class = Counter(map(_char_class, text))
        chars[i] = [by_class[k] for k in quality.CLASSES]
        listed = quality.COMMON.get(lang, [])
        lower = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in words)
        common[i] = [lower[w] for w in listed] + [0] * (quality._BINS - 1 - len(listed)) + [len(words) - sum(lower[w] for w in listed)]
    group = {i: lang if lang in quality.COMMON else "other" for i, _, lang in rows}
    total = lambda table, g: [sum(x) for x in zip(*(table[i] for i, *_ in rows if group[i] == g and not base[i][5]))]
    references = {g: (total(chars, g), total(common, g)) for g in set(group.values())}
    rejected = 0
    for i, text, _ in rows:
        r, (c, w) = found[i], references[group[i]]
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base[i]
        far, off = (_distance(chars[i], c), _distance(common[i], w)) if c else (0.0, 0.0)
        kept = not base[i][5] and not (len(text) >= quality.LEAST_CHARS and far > quality.MOST_CHARS)
        if group[i] != "other":
            assert r["word_distance"] == pytest.approx(off, abs=1e-9)
            cuts = quality.word_cuts(np.array(w, float))
            kept = kept and off <= np.interp(math.log(max(base[i][0], 1)), np.log(quality.SAMPLE_SIZES), cuts)
        assert r["char_distance"] == pytest.approx(far, abs=1e-9) and r["kept"] == kept
        rejected += not base[i][5] and not kept
    assert rejected


def test_toxicity_document_scores_match_a_plain_forward_backward(spark):
    """Emissions from features, marginals by the textbook recursion in plain floats, and the score of the document."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "to", "ri", "me") for b in ("na", "ke", "pi", "du", "so")]
    rows = [(" ".join([*(rng.choice(words) for _ in range(rng.randint(3, 30))), *(["zunkert", "grobol"] if i % 4 == 0 else [])]).encode(), int(i % 4 == 0)) for i in range(240)]
    m = toxicity.train(rows)
    texts = [*(t for t, _ in rows[:60]), b"", b"  ", b"(Zunkert!) zunkig x", b"ba"]
    scores, marks = m.documents(texts, {})
    for text, score, got in zip(texts, scores, marks):
        found = text.split()
        weight = [math.exp(max(-toxicity.Z, min(toxicity.Z, m.bias + sum(m.weights[int(f[0])].get(f[1:], 0.0) for f in toxicity.features(w))))) for w in found]
        forward, back = [], [(1.0, 1.0)] * len(found)
        for i, e in enumerate(weight):
            a = m.first if i == 0 else [sum(forward[-1][k] * m.step[k, j] for k in (0, 1)) for j in (0, 1)]
            a = (a[0], a[1] * e)
            forward.append((a[0] / sum(a), a[1] / sum(a)))
        for i in range(len(found) - 2, -1, -1):
            b = [sum(m.step[j, k] * (1.0 if k == 0 else weight[i + 1]) * back[i + 1][k] for k in (0, 1)) for j in (0, 1)]
            back[i] = (b[0] / sum(b), b[1] / sum(b))
        p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, back)]
        assert np.allclose(got, p, atol=1e-9)
        x = m.document @ np.array([1.0, max(p, default=0.0), math.log1p(sum(p))])
        assert score == pytest.approx(1 / (1 + math.exp(-x)))


def test_mix_draws_rows_of_one_id_by_their_texts(spark):
    """Rows that share an id and a size but not the text: reruns over other partitions take the same ones."""
    rows = [(1, f"w{i} x", "a") for i in range(40)] + [(i, "one two three", "a") for i in range(2, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = [Counter(r["text"] for r in mixing.emit(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert took[0] == took[1] == took[2]


def _near_texts():
    rng = random.Random(21)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    base = lambda n: [rng.choice(common) if rng.random() < 0.45 else rng.choice(rare) for _ in range(n)]
    out = []
    for size in (1, 1, 1, 2, 2, 3, 5, 8, 40):
        for _ in range(6):
            words = base(rng.randint(60, 400))
            out.append(words)
            for _ in range(size - 1):
                copy = list(words)
                for _ in range(rng.randint(1, max(1, len(words) // 60))):
                    copy[rng.randrange(len(copy))] = rng.choice(rare)
                out.append(copy)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def test_near_copies_by_five_words(spark):
    """What goes is in a group of texts with a Jaccard index of 0.8 or more by brute force, each group keeps one, and few are missed."""
    texts = _near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, near_digest string").repartition(7)
    sets = [frozenset(tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    stay = {r["doc_id"] for r in kept.collect()}
    assert {root(i) for i in range(len(texts))} <= stay
    ideal = sum(root(i) != i for i in range(len(texts)))
    assert ideal > 200 and len(texts) - len(stay) >= 0.9 * ideal
    assert sorted(simhash.shingles(texts[0]).tolist()) == simhash.shingles(texts[0]).tolist() and len(simhash.shingles(texts[0])) == len(sets[0])


def test_near_copies_on_edge_cases(spark):
    long = " ".join(f"w{i % 977} v{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a c"), (7, long), (8, long + " end"), (8, long + " end"), (None, long + " stop"), (9, "one two three four five six"), (3, "zwei"), (12, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in simhash.drop_similar(docs).collect())
    # Empty texts are near copies of each other and go by the least id; so are texts of the same words, and the long ones.
    assert left == Counter([(1, None), (4, "a b"), (6, "a c"), (7, long), (9, "one two three four five six"), (3, "zwei")])
    assert simhash.drop_similar(docs.limit(0)).count() == 0
    assert simhash.drop_similar(docs.where("doc_id = 9")).count() == 1


def test_no_near_copy_is_missed(spark):
    """Groups as by brute force, where few words or a whole passage differ, at 0.8 and just below, in chains and in a large group."""
    rng = random.Random(5)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = fresh(90), []
    for n in (45, 46, 47, 60, 100, 104, 200, 300):
        for _ in range(4):
            base = fresh(n)
            texts += [base, base + fresh((n - 4) // 4), base + fresh((n - 4) // 4 + 1), [*base[: n // 2], *fresh(1), *base[n // 2 + 1 :]]]
    for _ in range(4):
        chain = fresh(150)
        for _ in range(5):
            texts.append(chain)
            chain = [*chain[12:], *fresh(12)]
    # A passage that many texts begin with, alike only where little else follows, and a large group of texts with two or three edits.
    texts += [passage + fresh(rng.randint(5, 30)) for _ in range(120)]
    base = fresh(130)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(2, 3)):
            copy[rng.randrange(len(copy))] = fresh(1)[0]
        texts.append(copy)
    rng.shuffle(texts)
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    groups = simhash.similar_groups(docs)
    got = docs.join(groups, F.md5("text") == groups["digest"], "left").select("doc_id", F.coalesce("best.id", "doc_id")).collect()
    assert {i: r for i, r in got} == {i: root(i) for i in range(len(texts))}
    assert sum(root(i) != i for i in range(len(texts))) > 200


def test_near_copies_make_few_pairs_and_move_no_texts(spark, monkeypatch):
    """Texts of one passage and 15 % of their own share shingles but are no copies: none are paired. What is compared in full is read without a join."""
    rng = random.Random(11)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    passage, base = fresh(174), fresh(1200)
    texts = [passage + fresh(30) for _ in range(120)] + [base, [*base[:600], *fresh(1), *base[601:]]] + [fresh(1200) for _ in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows, plans, write = {}, [], simhash.written

    def counted(df, label):
        if label == "similar-sets":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = write(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    found = simhash.similar_groups(docs).collect()
    assert {r["best"]["id"] for r in found} == {120} and len(found) == 2
    assert rows["similar-meet"] == [0]
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    assert rows["similar-sets"][0] == 2


def test_sketches_of_long_texts_tell_them_apart(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    sets = [(draw(2000), draw(2000))]
    for n in (1, 500, 512, 520, 1020, 3000):
        one = draw(n)
        sets.append((one, np.union1d(one, draw(max(1, n // 9)))))
    pairs = spark.createDataFrame([tuple(simhash.sketch(x).tolist() for x in p) for p in sets], "a array<bigint>, b array<bigint>")
    got = [r[0] for r in pairs.coalesce(1).select(simhash.differing("a", "b")).collect()]
    assert got[0] > 0.222 * 4000 / 2
    for (a, b), bits in zip(sets, got):
        assert 0 < bits <= len(np.setxor1d(a, b))
