"""The corpus operators against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lintarium.llm import bpe, brown, common, exact_dedup, mixing, quality, sharding, simhash, token_counts, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int, word string"


def _texts() -> list[str | None]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    near = [" ".join([*long.split()[:8999], f"x{i}"]) for i in range(5)]
    return [None, "", " \t\n", "A b\x0bC", "ab c", "Ä é ñ 東京", "<|endoftext|> x <|endoftext|>", "line\nline\nline one two three four five six", *plain, *plain[:9], *(t.replace(" ", "  ") for t in plain[:5]), long, *near, "z" * 5000]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i * 3 if i != 7 else None, t, ["en", "fr", None][i % 3], ["a", "a", "a", "b", None][i % 5], None if t is None else len(t), "x", 1, "w") for i, t in enumerate(texts)]
    return [*out, out[12], out[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def _fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == 1


def test_brown(docs, rows, none):
    got = sorted((tuple(r) for r in brown.score(docs, head=40, endings=16, classes=6, sent_words=50).collect()), key=str)
    counts = Counter()
    for r in rows:
        if not _fold(r[0], 5):
            counts.update(w.lower() for w in _words(r[1]))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*(w.lower() for w in _words(r[1])), "end"]
        want.append((r[0], _fold(r[0], 5), len(tokens), sum(t in counts for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    want.sort(key=str)
    key = lambda r: (str(r[0]), r[2], r[3])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] < 0 and a[7] >= 1
    assert brown.score(none).count() == 0


def _brown_classes(model, rare):
    """Class of a word, by the list, the table of rare words, or the ending."""
    lexicon = brown.Lexicon(*model.lexicon)
    placed = {bytes(r["word"]): r["cls"] for r in rare.collect()}
    assert not placed.keys() & set(lexicon.words)

    def of(word):
        if word in lexicon.place:
            return int(lexicon.cls[lexicon.place[word]])
        return placed.get(word, int(lexicon.ending_cls[lexicon.buckets([word])[0]]))

    return of


def test_brown_probabilities_sum_to_one(spark):
    words = [f"a{i}" for i in range(12)]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    train = spark.createDataFrame([(t,) for t in texts], "_text string")
    counts = brown.word_counts(train)
    m, rare = brown.fit(train, counts, head=4, endings=4, classes=3, sent_words=6)
    of = _brown_classes(m, rare)
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for before in range(3):
        total = 0.0
        for w, c in known.items():
            total += m.both(m.weight[before, of(w)], c, m.base(c), 1.0)
        for k in range(3):
            total += m.both(m.weight[before, k], 0, m.base(0), 1 / 3)
        assert total == pytest.approx(1.0)


@pytest.mark.parametrize("sent_words", [300, 50, 0])
def test_brown_score_matches_a_plain_computation(docs, rows, sent_words):
    """Pairs of classes, emissions and scores from the words' classes alone, with lists of several lengths."""
    sizes = {"head": 20, "endings": 8, "classes": 5, "sent_words": sent_words, "least": 3}
    train = docs.where(~common.held_out(docs["doc_id"], 5)).select(common.text_of(docs, "text").alias("_text"))
    m, rare = brown.fit(train, brown.word_counts(train), **sizes)
    of, lexicon = _brown_classes(m, rare), brown.Lexicon(*m.lexicon)
    assert len(lexicon.words) <= sent_words
    tokens = lambda t: [*(w.lower() for w in _words(t)), brown.END]
    counts, table = Counter(), np.zeros((5, 5))
    for r in rows:
        if not _fold(r[0], 5):
            here = tokens(r[1])
            counts.update(here)
            for p, w in zip([brown.END, *here], here):
                # A rare word before a rare one still counts with the class of its ending.
                early = p not in lexicon.place and w not in lexicon.place
                table[lexicon.ending_cls[lexicon.buckets([p])[0]] if early else of(p), of(w)] += 1
    kinds = np.bincount([of(w) for w in counts], minlength=5)
    size, n = table.sum(axis=0), sum(counts.values())
    step = (table + brown.PSEUDO * size / n) / (table.sum(axis=1)[:, None] + brown.PSEUDO)
    want = []
    for r in rows:
        here, total = tokens(r[1]), 0.0
        for p, w in zip([brown.END, *here], here):
            c = counts[w]
            emission = (c + 0.5) / (size[of(w)] + 0.5 * (kinds[of(w)] + 1))
            share = 1.0 if c else 1 / 5
            total += math.log10((1 - brown.MIXED) * step[of(p), of(w)] * emission + brown.MIXED * (c + 0.5) / (n + 0.5 * (len(counts) + 1)) * share)
        want.append((str(r[0]), len(here), total))
    got = [(str(r["doc_id"]), r["n_tokens"], r["score"]) for r in brown.score(docs, **sizes).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_brown_places_words_beyond_the_head_by_their_contexts(spark):
    rng = random.Random(8)
    # Two kinds of words that take turns; endings say nothing of the kind, and most words aren't among the eight of the head.
    kinds = [[f"{k}{i}x{i % 3}" for i in range(60)] for k in "pq"]
    pick = lambda ws: ws[min(int(rng.expovariate(0.15)), 59)]
    train = spark.createDataFrame([(" ".join(pick(kinds[j % 2]) for j in range(40)),) for _ in range(200)], "_text string")
    counts = brown.word_counts(train)
    m, rare = brown.fit(train, counts, head=8, endings=4, classes=3, sent_words=20)
    of = _brown_classes(m, rare)
    assert len(brown.Lexicon(*m.lexicon).words) <= 20
    often = [r["word"].decode() for r in counts.where("n >= 10").collect() if bytes(r["word"]) != brown.END]
    found = {k: {of(w.encode()) for w in often if w[0] == k} for k in "pq"}
    assert len(often) > 40 and not found["p"] & found["q"]


def test_brown_merges_rows_of_a_word_across_batches():
    flat = np.array([(0, 2), (4, 1), (1, 5), (0, 7)], brown._CONTEXT)
    batches = [brown._contexts([b"a", b"b"], flat[:3], np.array([0, 2, 3])), brown._contexts([b"b"], flat[3:], np.array([0, 1])), brown._contexts([], flat[:0], np.array([0]))]
    got = {w: c.tolist() for words, counts in brown._merged(iter(batches), 6) for w, c in zip(words, counts)}
    assert got == {b"a": [2, 0, 0, 0, 1, 0], b"b": [7, 5, 0, 0, 0, 0]}


def test_exchange_finds_two_kinds_of_words():
    pairs = np.zeros((8, 8))
    for a in range(4):
        for b in range(4, 8):
            pairs[a, b] = pairs[b, a] = 10 + a
    cls = brown.exchange(pairs, 2)
    assert len(set(cls[:4])) == 1 and len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    step, first = np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
    sizes, e = [1, 5, 7, 2], rng.normal(size=15) * 2
    starts = np.cumsum([0, *sizes[:-1]])
    got = toxicity.Chain(step, first).marginals(e, starts)[0]
    for s, n in zip(starts, sizes):
        total, ones = 0.0, np.zeros(n)
        for code in range(1 << n):
            states = [(code >> i) & 1 for i in range(n)]
            weight = first[states[0]] * math.exp(sum(e[s + i] for i in range(n) if states[i]))
            for a, b in zip(states, states[1:]):
                weight *= step[a, b]
            total += weight
            ones += weight * np.array(states)
        assert np.allclose(got[s : s + n], ones / total)


def test_toxicity_learns_and_finds_spans(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ba", "to", "ri", "me", "lo", "su") for b in ("na", "ke", "pi", "du", "so", "ver")]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randint(0, len(text)), rng.choice(["Grobol!", "zunkert", "zunkig"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(None, None), (9001, ""), (9002, "grobol " * 3000)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert got[None]["predicted"] == got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1
    for i, text in rows[:50:5]:
        found = " ".join(text[s["start"] : s["end"]] for s in got[i]["spans"]).split()
        assert found and all(w.startswith(("Grobol", "zunk")) for w in found)
    assert toxicity.keep_clean(docs, model).count() == len(rows) - 81
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, known.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(w.decode() for w in _words(r[1]))].append(r)
    got = exact_dedup.content_sort(docs, salts=4, hot_share=0.001).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(g for g in groups.values() if any(x[0] == r["doc_id"] for x in g) and hashlib.sha256("".join(w.decode() for w in _words(g[0][1])).encode()).hexdigest() == r["text_sha256"])
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert r["keep_id"] == best[0] and r["group_size"] == len(own)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r["text_sha256"]: 1 for r in got})
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns
    assert exact_dedup.drop_duplicates(docs).count() == len(groups)
    assert exact_dedup.content_sort(none).count() == 0


def test_quality(docs, rows, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for r in rows:
        text, words = r[1] or "", [w.decode() for w in _words(r[1])]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
        lines = [x for x in text.split("\n") if _words(x)]
        g = by[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"]) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (g["n_dup_lines"], g["n_repeat_words"]) == (len(lines) - len(set(lines)), len(inside))
        assert g["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (g["base_failed"] and g["kept"])
    assert quality.judge(none).count() == 0


def test_quality_judges_words_of_short_texts(spark):
    rng = random.Random(6)
    common, rare = quality.COMMON["en"], [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    rows = [(i, prose(rng.choice([70, 90, 400])), "en", 1) for i in range(200)]
    junk = [(1000 + i, " ".join(rng.sample(rare, 60)), "en", 0) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, good int")).collect()}
    assert not any(got[1000 + i] for i in range(5)) and sum(got[i] for i in range(200)) >= 194


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    again = sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert sorted(map(str, got)) == again and len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(_words(r[1]))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def _fingerprint(text):
    words = [w.lower().decode() for w in _words(text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    prints = [(r[0], _fingerprint(r[1])) for r in rows]
    up = {f: f for _, f in prints}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for _, a in prints:
        for _, b in prints:
            if (a ^ b).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[root(f)].append(i)
    want = Counter((i, f"{f:016x}", min(least[root(f)], default=None)) for i, f in prints)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {x[2] for x in want}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_tells_rows_of_one_id_apart(spark):
    """Clashing names, one id with two texts of which one is a copy, repeated rows, nulls and an empty table."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    schema = "doc_id long, text string, _goes long, gone_id string, fp long, v long, _digest string, best string"
    more = (1, "x", 2, 3, "y", "z")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (None, a), (9, None), (10, " ")]
    docs = spark.createDataFrame([(*r, *more) for r in rows], schema)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(1, a): 1, (5, b): 1, (9, None): 1})
    lone = spark.createDataFrame([(None, a, *more), (None, a, *more)], schema)
    assert simhash.drop_near_duplicates(lone).count() == 2
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_simhash_crowd_links_are_exact(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        x = rng.choice([*prints][:40])
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()

    def classes(pairs):
        up = {p: p for p in prints}

        def root(f):
            while up[f] != f:
                f = up[f]
            return f

        for a, b in pairs:
            up[root(a)] = root(b)
        groups = defaultdict(set)
        for p in prints:
            groups[root(p)].add(p)
        return {frozenset(g) for g in groups.values()}

    near = [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3]
    assert classes([(e["u"] % 2**64, e["v"] % 2**64) for e in edges]) == classes(near)


def test_sharding(docs, rows, none):
    got = sharding.shard(docs, [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == crc
    assert sharding.shard(none, [1.0] * 8).count() == 0


def test_warc_round_trip(spark, rows):
    pages = [(i if i != 11 else None, [f"http://Ex.com/{i % 7}", None, "no url"][i % 3 if i > 20 else 0], r[1]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    folder, directory = warc.archive(table)
    got = warc.lookup(warc.keys_of(table), folder, directory).collect()
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        first[p] = min([x for x in (first.get(p), i) if x is not None], default=None)
    want = Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        revisit = i != first[p]
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    some = warc.lookup(spark.createDataFrame([("com,ex)/3",), ("com,none)/",)], "key string"), folder, directory).collect()
    assert {r["page_id"] for r in some} == {i for i, u, _ in pages if u == "http://Ex.com/3"}
    folder, directory = warc.archive(table.limit(0))
    assert warc.lookup(warc.keys_of(table), folder, directory).count() == 0


def test_token_counts(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path, cache = token_counts.default_tokenizer(), str(tmp_path / "cache")
    t = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows)
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == want
    before = spark.read.parquet(cache).count()
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect())) == want
    assert spark.read.parquet(cache).count() == before
    assert token_counts.count_tokens(none, path).count() == 0


def test_bpe(docs, rows, none):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    found = bpe.encode(docs, path)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode(found, path).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows)
    assert bpe.encode(none, path).count() == 0


def test_text_cast_from_other_types(spark):
    numbers = spark.range(5).select(F.col("id").alias("doc_id"), F.col("id").alias("text"))
    assert exact_dedup.content_sort(numbers).count() == 5
