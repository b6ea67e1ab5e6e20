"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import bpe, exact_dedup, fingerprints, html_pages, html_text, licenses, mixing, near_dedup, queries, suffix_dedup, token_counts, toxicity
from quarry.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with those the operators make."""
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "a", "ab cd", "ab  cd", "a\x00b", "été 東京 🙂", "x" * 5000, "word " * 3000, "the quick brown fox jumps over the lazy dog " * 30, "the quick brown fox jumps over the lazy dog " * 30]


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r.doc_id: r.text for r in rows}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    return {r[0]: r for r in df.collect()}


# --- 8 exact dedup, 1 licences: SQL -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = c.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


def test_exact_dedup_odd(spark):
    got = {r.id: r for r in exact_dedup.exact_groups(docs_of(spark, ODD)).collect()}
    assert got[0].keep_id == got[1].keep_id == got[2].keep_id == 2 and got[2].group_size == 3
    assert got[4].keep_id == 5 and got[10].keep_id == 10 and not got[11].kept
    twice = exact_dedup.exact_groups(docs_of(spark, ["same"] * 3, ids=[7, 7, None])).collect()
    assert sum(r.kept for r in twice) == 1 and {r.group_size for r in twice} == {3}
    assert exact_dedup.keep_one(docs_of(spark, ODD)).count() == len(ODD) - 4
    assert exact_dedup.exact_groups(docs_of(spark, ODD).limit(0)).count() == 0


def test_collision_of_the_hash_splits_a_group(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(F.substring(c, 1, 1)))
    got = {r.id: r for r in exact_dedup.exact_groups(docs_of(spark, ["ab", "ac", "a b", "b"])).collect()}
    assert got[0].keep_id == got[2].keep_id == 2 and got[0].group_size == 2 and got[1].kept and got[1].group_size == 1


def test_license_odd(spark):
    texts = [*ODD, "Intro.\nReleased under the MIT License.\nEnd.", "licensed UNDER the apache license version 2.0", "\n".join(["x y z"] * 50 + ["This work is licensed under the GNU General Public License, version 3."])]
    got = {r.id: r for r in licenses.best_license(docs_of(spark, texts)).collect()}
    n = len(ODD)
    assert [got[n + i].license for i in range(3)] == ["MIT", "Apache-2.0", "GPL-3.0"] and all(got[i].license is None for i in range(n))


def test_license_anchors_are_in_every_match():
    chosen = set(licenses.anchors())
    for _, grams in licenses.table():
        free = [g for g in grams if not chosen & set(g.split())]
        assert len(free) < licenses.THRESHOLD * len(grams) / (2 - licenses.THRESHOLD)


# --- 2 pages ------------------------------------------------------------------------------------


def test_extraction_on_held_out_pages():
    model, wrong, total = html_text.trained(), 0, 0
    for page in html_pages.pages(120, seed=99):
        x, y = html_text.labelled(page)
        wrong += sum(a != b for a, b in zip(y, model.decode(x)))
        total += len(y)
    assert wrong / total < 0.02


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    model = html_text.Model(r.normal(size=html_text.WIDTH), r.normal(size=(2, 2)), r.normal(size=2))
    rows = [tuple(r.integers(0, 50, 3)) for _ in range(7)]

    def value(path):
        v = model.start[path[0]] + sum(model.emit[list(x)].sum() * y for x, y in zip(rows, path))
        return v + sum(model.move[a, b] for a, b in zip(path, path[1:]))

    paths = [[k >> i & 1 for i in range(7)] for k in range(128)]
    assert value(model.decode(rows)) == pytest.approx(max(map(value, paths)))


def test_extraction_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>only &amp; text"), (4, "u", "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A  title\n here</h1><p>Some long text, with a stop. And more of it follows here.</p></article><footer>&copy; x</footer>")]
    got = {r.id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[4] == "A title here\nSome long text, with a stop. And more of it follows here."


# --- 3 toxicity ---------------------------------------------------------------------------------


def test_toxicity_learns_words_and_ignores_held_out(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(60))
    texts = [plain() + (" vile rotten " if i % 3 == 0 else " ") + plain() for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {x.id: x.score for x in toxicity.score(docs, toxicity.fit_labels(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(400))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(i % 3 != 0 for i in range(400))
    folds = {x.doc_id: x.h for x in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    import zlib

    assert folds == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}


def test_toxicity_keeps_no_more_weights_than_its_bound(spark, monkeypatch):
    docs = docs_of(spark, [f"word{i} vile" if i % 2 else f"word{i} fine" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_WEIGHTS", 1)
    with pytest.raises(ValueError):
        toxicity.fit_labels(docs, labels, l1=0.0)
    monkeypatch.undo()
    assert len(toxicity.fit_labels(docs, labels, most_bytes=0)) == 1


def test_toxicity_odd(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert docs.count() == toxicity.score(docs, toxicity.fit_labels(docs, none)).count()
    again = spark.createDataFrame([(3, 1), (3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit_labels(docs, again)).collect())


# --- 4 mixing -----------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    size, weight = dict(sizes), {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= cap * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(cap * size[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def test_mixing_positions_invert_the_integral(spark):
    """Against a fine sum of each source's schedule; sources' shares change over time."""
    r = random.Random(12)
    docs = docs_of(spark, ["w " * r.randint(1, 30) for _ in range(2000)], sources=[f"s{i % 5}" for i in range(2000)])
    rows = mixing.mix(docs).collect()
    names = sorted({x.source for x in rows})
    steps = np.linspace(0, 1, 200_001)
    early, late = Counter(), Counter()
    for i, name in enumerate(names):
        knots = mixing.SCHEDULES[i % len(mixing.SCHEDULES)]
        rate = np.interp(steps, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        own = [x for x in rows if x.source == name]
        taken = [(x.position, x.taken_first) for x in own if x.position is not None] + [(x.position_again, x.taken_again) for x in own if x.position_again is not None]
        begin = 0
        for at, words in sorted(taken):
            assert abs(np.interp(at, steps, demand / demand[-1]) - begin / own[0].target) < 1e-6
            begin += words
            early[name] += words * (at < 0.25)
            late[name] += words * (at >= 0.75)
    share = lambda c, n: c[n] / sum(c.values())
    assert share(early, "s0") > 1.2 * share(late, "s0") and share(late, "s1") > 1.2 * share(early, "s1")


@pytest.mark.parametrize("share,cap", [(0.05, 2.0), (1.5, 2.0), (2.0, 2.0), (1.2, 1.3)])
def test_mixing_targets(spark, share, cap):
    r = random.Random(13)
    sizes = [(f"s{i}é" if i % 7 else f"S{i}", r.choice([0, 1, 5, 1000, 100_000]) * r.randint(1, 9)) for i in range(60)] + [(None, 77), ("\U0001f642", 9), ("\uffff", 8)]
    got = mixing.with_targets(spark.createDataFrame(sizes, "source string, source_size long").repartition(5), share=share, cap=cap).collect()
    want = targets_by_hand(sizes, share=share, cap=cap)
    assert {x.source: round(x.target, 4) for x in got} == {s: round(want[s], 4) for s, _ in sizes}


def test_mixing_contract(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(rows).collect()
    size = Counter()
    for r in got:
        size[r.source] += r.size
    goal = targets_by_hand(list(size.items()))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size) and sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(rows.repartition(3)).collect()), key=str)


def test_mixing_odd(spark):
    docs = docs_of(spark, ODD, sources=["b", None, "a", "b", "a", None, "é", "b", "a", "é", None, "a"])
    assert mixing.mix(docs).count() == len(ODD) and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert targets_by_hand([("a", 100), ("b", 10), (None, 10)]) == {"b": 20.0, "a": pytest.approx(180 - 20 - 20 + 0.0, abs=20), None: pytest.approx(20, abs=20)}


# --- 5 suffix dedup -----------------------------------------------------------------------------


def repeated(texts, length=400):
    seen, data = Counter(), [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for b in data:
        on = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                on[k : k + length] = True
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~on].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("few", [0, 64])
def test_suffix_dedup_brute_force(spark, few):
    r = random.Random(few)
    fresh = lambda n: "".join(r.choice("abcdefgh ,.é") for _ in range(n))
    hot = fresh(390)
    texts = [*ODD, fresh(399), hot + "x", "periodic " * 80]
    texts += [fresh(r.randint(0, 300)) + hot + fresh(r.randint(0, 300)) for _ in range(30)]
    texts += [fresh(50) + texts[20][: r.randint(380, 420)] + fresh(50) for _ in range(8)] + [texts[16], texts[16][3:]]
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(docs_of(spark, texts), few_contexts=few).collect()}
    assert [got[i] for i in range(len(texts))] == repeated(texts)


def test_multikey_quicksort():
    rows = np.random.default_rng(2).integers(0, 3, (500, 6)).astype(np.uint64)
    assert rows[suffix_dedup.multikey_quicksort(rows)].tolist() == sorted(rows.tolist())


# --- 6 token counts, 9 BPE ----------------------------------------------------------------------


def test_token_counts(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = [*ODD, "It's <|endoftext|> here", "İstanbul ΑΣ ﬁ ½²", "\x85a\xa0b", *list(small.values())[:40]]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.id: r for r in token_counts.count_tokens(docs_of(spark, texts), WORDS).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want and got[7].n_bytes == len(ODD[7].encode())


def test_token_cache_encodes_misses_only(spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(docs_of(spark, ["a b", "a b", "c"]), WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    got = token_counts.count_tokens(docs_of(spark, ["c", "d e f", "c"]), WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == 3 and {r.id: r.n_tokens for r in got} == {0: 1, 1: 3, 2: 1}


def test_a_second_query_encodes_nothing(spark):
    first = queries.op6_token_counts(spark, SF).collect()
    cache = token_counts.shared_cache(spark, WORDS)
    rows = spark.read.parquet(cache).count()
    assert sorted(map(tuple, queries.op6_token_counts(spark, SF).collect())) == sorted(map(tuple, first)) and spark.read.parquet(cache).count() == rows
    assert token_counts.tokenizer_digest(WORDS) != token_counts.tokenizer_digest(RANKS)


def test_bpe_of_a_very_long_word():
    ranks, r = bpe.read_ranks(RANKS), random.Random(5)
    for _ in range(200):
        word = "".join(r.choice("aehinorst é") for _ in range(r.randint(1, 90))).encode()
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[word]] if word in ranks else [ranks[p] for p in parts]
        assert bpe.fold(word, ranks) == want
        assert word in ranks or bpe._fold_long(word, ranks) == want
    pieces = {i: p for p, i in ranks.items()}
    assert b"".join(pieces[i] for i in bpe.fold(b"xyzzy" * 40_000, ranks)) == b"xyzzy" * 40_000


def test_bpe_is_the_library(spark, small):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "It's  don't　x\x1cy\x85z\n\n  ", *list(small.values())[:30]]
    want = [library.encode_ordinary(t or "") for t in texts]
    docs = docs_of(spark, texts)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.id: list(r.ids) for r in coded.collect()} == dict(enumerate(want))
    assert {r.id: bytes(r.bytes) for r in bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    few = docs.where("doc_id < 8")
    assert {r.id: list(r.ids) for r in bpe.encode_native(few, RANKS, public_tokenizers.PATTERN).collect()} == {i: want[i] for i in range(8)}


# --- 7 fingerprints -----------------------------------------------------------------------------


def test_fingerprints(spark, small):
    got = run(spark, "op7_fingerprints")
    ids = sorted(small)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        changed = fingerprints.edited(small[i], small[j])
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(small[i])
        assert got[i].fingerprint == fingerprints.fingerprint(small[i]) and got[i].edited_fingerprint == fingerprints.fingerprint(changed)
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.1 > np.mean([r.near_next for r in got.values()])


def test_fingerprints_of_text_ids(spark):
    r = random.Random(21)
    names = [f"doc-{r.choice('aé東')}{r.randint(0, 10**12)}" for _ in range(60)] + ["doc-", "doc-a", None]
    texts = [f"text {i} " * r.randint(1, 20) for i in range(len(names))]
    rows = spark.createDataFrame(list(zip(names, texts)), "doc_id string, text string")
    got = {x.id: x for x in fingerprints.fingerprints(rows).collect()}
    order = sorted(zip(names, texts), key=lambda p: (p[0] is not None, (p[0] or "").encode()))
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        assert got[i].edited_sha256 == hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest()


def test_fingerprints_odd(spark):
    out = fingerprints.fingerprints(docs_of(spark, ODD, ids=[None, 5, 5, *range(10, 10 + len(ODD) - 3)])).collect()
    assert len(out) == len(ODD) and fingerprints.fingerprints(docs_of(spark, ["one"])).first().near_next == 1.0
    assert fingerprints.fingerprints(docs_of(spark, ODD).limit(0)).count() == 0
    a, b = "\n".join(f"line {i} of the text" for i in range(40)), "\n".join(f"line {i} of the {'edit' if i == 17 else 'text'}" for i in range(40))
    assert len(fingerprints.differing(fingerprints.fingerprint(a), fingerprints.fingerprint(b))) == 1


# --- 10 near dedup ------------------------------------------------------------------------------


def test_alignment_is_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randrange(r.choice([3, 50])) for _ in range(r.randint(0, 60))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randrange(len(b) + 1), r.randrange(50))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (row[-1] <= most)


def classes_by_force(texts):
    h = [near_dedup.word_hashes(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similar(h[i], h[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_dedup_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [r.choice(words) for _ in range(n)]
    base, passage = fresh(120), fresh(60)
    texts = list(ODD)
    for _ in range(40):  # one large group of near copies
        copy = list(base)
        for k in r.sample(range(120), 4):
            copy[k] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(passage + fresh(60)) for _ in range(40)]  # a common passage is no near copy
    texts += ["Same, words HERE.", "same words here"]
    got = {x.id: x.class_id for x in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_force(texts)


def edited(r, base, edits, words):
    copy = list(base)
    for k in r.sample(range(len(base)), edits):
        copy[k] = r.choice(words)
    return copy


def test_near_dedup_scattered_edits(spark):
    """Pairs down to the threshold, of every length."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(20000)]
    texts, at = [], []
    for n in [5, 6, 7, 8, 9, 10, 12, 14, 15, 18, 25, 40, 80, 120, 200, 400] * 3:
        for share in (0.1, 0.15, 0.19):
            base = [r.choice(words) for _ in range(n)]
            at.append(len(texts))
            texts += [" ".join(base), " ".join(edited(r, base, max(1, int(share * n)), words))]
    got = {x.id: x.class_id for x in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert [i for i in at if got[i] != got[i + 1]] == []


def test_near_dedup_copies_within_a_passage(spark):
    """Near copies among texts that all share half of their words."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(20000)]
    fresh = lambda n: [r.choice(words) for _ in range(n)]
    passage, texts = fresh(100), []
    texts += [" ".join(passage + fresh(100)) for _ in range(600)]
    bases = [fresh(100) for _ in range(20)]
    texts += [" ".join(passage + edited(r, b, 15, words)) for b in bases for _ in range(3)]
    got = {x.id: x.class_id for x in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_force(texts)


def test_near_dedup_links_all_pairs_of_a_bucket(spark):
    """All texts in one bucket: near copies that are neither its first nor its last node are linked too."""
    r = random.Random(10)
    words = [f"w{i}" for i in range(50)]  # no word is rare for itself
    bases = [[r.choice(words) for _ in range(n)] for n in (5, 12, 40, 41, 42, 90) * 4]
    texts = [" ".join(x) for b in bases for x in (b, edited(r, b, len(b) // 5, words))]
    r.shuffle(texts)
    hashes = [near_dedup.word_hashes(t) for t in texts]
    nodes = near_dedup._numbered(docs_of(spark, texts).selectExpr("struct(false as z, doc_id as id) as first", "text", "size(split(text, ' ')) as n", "array(7L) as keys"))
    digests = spark.createDataFrame([(t, xxhash.xxh3_128_digest(h.tobytes())) for t, h in zip(texts, hashes)], "text string, digest binary")
    nodes = near_dedup.cut(nodes, "nodes").join(digests, "text")
    label = {x.node: x.label for x in near_dedup.components(near_dedup.links(nodes, docs_of(spark, texts), "doc_id", "text", near_dedup.SIMILARITY)).collect()}
    at = {x.first.id: label.get(x.node, x.node) for x in nodes.collect()}
    want = classes_by_force(texts)
    assert len({(at[i], want[i]) for i in range(len(texts))}) == len(set(at.values())) == len(set(want)) <= len(bases)


def test_alignment_of_long_texts(monkeypatch):
    r = random.Random(12)
    pairs = []
    for _ in range(30):
        a = [r.randrange(400) for _ in range(r.randint(60, 300))]
        b = edited(r, a, int(r.uniform(0.05, 0.4) * len(a)), list(range(400)))
        del b[: r.randint(0, 9)]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64), r.randint(9, 90)))
    got = [near_dedup.edits_within(*p) for p in pairs]
    monkeypatch.setattr(near_dedup, "BITS", 0)
    assert got == [near_dedup.edits_within(*p) for p in pairs] and None in got and len(set(got)) > 5


def test_near_dedup_crowd_pairs_are_few_and_whole(spark, monkeypatch):
    """A crowd that shares most of a passage: each pair that aligns is found once, and pairs don't come by each word and bucket that they share."""
    r = random.Random(11)
    fresh = iter(range(10**6))
    passage = [f"p{i}" for i in range(80)]
    texts = [passage[: 80 - i % 24] + [f"f{next(fresh)}" for _ in range(18)] for i in range(120)]
    bases = [[r.choice(passage) for _ in range(60)] + [f"f{next(fresh)}" for _ in range(60)] for _ in range(6)]
    texts += [edited(r, b, 15, passage) for b in bases for _ in range(3)]
    hashes = [near_dedup.word_hashes(" ".join(t)) for t in texts]
    table = spark.createDataFrame([(i, h.tobytes()) for i, h in enumerate(hashes)], "node long, words binary")
    crowd = table.selectExpr("explode(array(7L, 8L, 9L)) as key", "node")
    meetings = near_dedup._meetings(crowd, table, spark.createDataFrame([], "node long, label long"), near_dedup.SIMILARITY)
    pairs = near_dedup._crowd_pairs(meetings)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near_dedup.similar(hashes[i], hashes[j])}
    found = {tuple(x) for x in pairs.collect()}
    assert want and want <= found and len(found) < len(want) + len(texts) * (len(texts) - 1) // 4
    for tile in (2, 32):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        aligned = [tuple(x) for x in near_dedup._aligned_in_tiles(pairs, table, near_dedup._blocks(meetings), near_dedup.SIMILARITY).collect()]
        assert sorted(aligned) == sorted(want)


def test_near_dedup_crowd_rows_are_few(spark):
    """Near copies around the threshold: a pair comes at its first common word alone, and pairs whose words differ too much aren't aligned; none that aligns is lost."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    # the later texts each share a passage of a third with the crowd, in texts much longer or as long
    texts = [edited(r, base, 26 + i % 8, [f"e{i}x{j}" for j in range(99)]) for i in range(60)]
    texts += [[*base[:100], *(f"f{i}x{j}" for j in range(n))] for i, n in enumerate([200] * 20 + [900])]
    hashes = [near_dedup.word_hashes(" ".join(t)) for t in texts]
    number = [(i << near_dedup.LENGTH_BITS) + int(math.log2(len(t)) * near_dedup.STEPS) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(n, h.tobytes()) for n, h in zip(number, hashes)], "node long, words binary")
    want = {(number[i], number[j]) for j in range(len(texts)) for i in range(j) if near_dedup.similar(hashes[i], hashes[j])}
    labelled = table.selectExpr("7L as key", "node", "node as label")
    others = near_dedup._with_others(labelled, "key", near_dedup._rough("node"), near_dedup.SIMILARITY)
    assert {x.node for x in others.collect()} == set(number[:-1])
    meetings = near_dedup._meetings(others.select("key", "node"), table, spark.createDataFrame([], "node long, label long"), near_dedup.SIMILARITY)
    ends = [meetings.select("word", meetings.node.alias(x), meetings.before.alias(f"{x}_before")) for x in "uv"]
    joined = ends[0].join(ends[1], "word").where("u < v and not arrays_overlap(u_before, v_before)").select("u", "v")
    pairs = near_dedup._crowd_pairs(meetings)
    found, close = [{tuple(x) for x in p.collect()} for p in (pairs, near_dedup._close(pairs, near_dedup._with_parities(table), near_dedup.SIMILARITY))]
    assert want and want <= close <= found and joined.count() < 1.5 * len(texts) ** 2 / 2
    aligned = {tuple(x)[:2] for x in near_dedup._aligned(near_dedup._small_pairs(labelled, near_dedup.SIMILARITY), table, near_dedup.SIMILARITY).where("good").collect()}
    assert aligned == want


def test_near_dedup_crowd_pairs_past_the_threshold_go_early(spark):
    """Pairs that differ in some words more than the threshold allows go in the join; none that aligns is lost."""
    r = random.Random(3)
    texts = []
    for i in range(100):
        own = {p: f"e{i}x{p}" for p in r.sample(range(100), 13)}
        texts.append([own.get(p, f"b{p}") for p in range(100)])
    hashes = [near_dedup.word_hashes(" ".join(t)) for t in texts]
    table = spark.createDataFrame([(i, h.tobytes()) for i, h in enumerate(hashes)], "node long, words binary")
    meetings = near_dedup._meetings(table.selectExpr("7L as key", "node"), table, spark.createDataFrame([], "node long, label long"), near_dedup.SIMILARITY)
    found = {tuple(x) for x in near_dedup._crowd_pairs(meetings).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near_dedup.similar(hashes[i], hashes[j])}
    assert want and want <= found and len(found) < len(want) + len(texts) * (len(texts) - 1) // 10


def test_near_dedup_parities():
    r = random.Random(8)
    for n, m in [(1, 1), (5, 40), (300, 290), (300, 700)]:
        a, b = (np.array([r.getrandbits(64) for _ in range(k)], np.uint64) for k in (n, m))
        b[: min(n, m) // 2] = a[: min(n, m) // 2]
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.6 * apart <= near_dedup._apart(near_dedup._parities(a), near_dedup._parities(b)) <= apart


def test_near_dedup_odd(spark):
    assert near_dedup.classes(docs_of(spark, ODD).limit(0)).count() == 0
    out = near_dedup.keep_one(docs_of(spark, ODD))
    assert out.columns == docs_of(spark, ODD).columns and out.count() < len(ODD)


def test_near_dedup_of_ids_on_different_texts(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "red green blue black white brown pink grey gold teal " * 3
    rows = [(7, a), (7, b), (3, b + "extra"), (7, b), (8, a + "more"), (8, a.replace(" ", "  ")), (None, b), (9, "short"), (9, None)]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((str(r.doc_id), r.text) for r in near_dedup.keep_one(df).collect()), key=str)
    assert got == sorted([("7", a), ("3", b + "extra"), ("9", "short"), ("9", None)], key=str)


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        out = stage(spark, before, SF)
        if name != "byte_bpe":
            assert out.columns == columns
        n, m = before.count(), out.count()
        assert m <= (2 * n if name == "mixing" else n) and m > 0
        if name == "byte_bpe":
            got = out.collect()
            assert all(x.decoded_sha256 == hashlib.sha256(small[x.doc_id].encode()).hexdigest() for x in got)
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "byte_bpe" else out
    assert re.fullmatch("[0-9a-f]{64}", got[0].ids_sha256)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stage_on_odd_tables(spark, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table: no stage fails or loses a text."""
    name, run_stage = corpus_pipeline.STAGES[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [*ODD, "one two three four five six", "one two three four five six", "long " * 20_000]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "text of a row without an id, of nine words", None, None, None)]
    out = run_stage(spark, spark.createDataFrame(rows, schema), SF)
    got = [r.text for r in out.collect()] if name != "byte_bpe" else [r.decoded_sha256 for r in out.collect()]
    if name == "byte_bpe":
        assert sorted(got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    elif name == "mixing":
        assert set(got) <= {r[1] for r in rows} and all(t and t.strip() for t in got)
    elif name == "toxicity":
        assert sorted(map(str, got)) == sorted(str(r[1]) for r in rows)
    else:
        assert len(got) == len(set(got)) and {"".join((r[1] or "").split()) for r in rows} >= {"".join((t or "").split()) for t in got}
        want = {"".join((r[1] or "").split()) for r in rows}
        assert len(got) == len(want) if name == "exact_dedup" else len(got) <= len(want)
    none = run_stage(spark, spark.createDataFrame([], schema), SF)
    assert none.count() == 0 and (name == "byte_bpe" or none.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_empty_tables_and_repeated_rows(spark):
    empty = docs_of(spark, ODD).limit(0)
    assert licenses.best_license(empty).count() == 0 and bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert toxicity.score(empty, [(-1, 0.0)]).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0
    assert token_counts.count_tokens(empty, WORDS).count() == 0
    pages = "page_id long, url string, html string, id string, text string"
    assert html_text.extract(spark.createDataFrame([], pages)).count() == 0
    page = (1, "u", "<html><body><article><p>A paragraph, with enough words to be the text of a page.</p></article></body></html>", "x", "y")
    long = (2, "u", "<article>" + "<p>A paragraph, with enough words to be the text of a page.</p>" * 3000 + "</article>", None, None)
    got = html_text.extract(spark.createDataFrame([page, page, long], pages)).collect()
    assert len(got) == 3 and len({r.text for r in got if r.id == 1}) == 1
    same = docs_of(spark, ["a b c"] * 3, ids=[4, 4, None])
    assert [r.n_tokens for r in bpe.round_trip(same, RANKS, public_tokenizers.PATTERN).collect()] == [3] * 3
    assert [r.n_tokens for r in token_counts.count_tokens(same, WORDS).collect()] == [3] * 3
    twins = docs_of(spark, ["x" * 500, "x" * 500, None], ids=[None, None, None])
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(twins).collect()) == [0, 500, 500]
    near = near_dedup.classes(docs_of(spark, ["one two three four five six seven", "one two three four five six eight", "other"], ids=[None, 7, 7])).collect()
    assert len(near) == 3 and {r.class_size for r in near if r.class_id == 7} >= {1}
