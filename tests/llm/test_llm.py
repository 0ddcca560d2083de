import collections
import itertools
import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import byte_bpe, components, embedding_dedup, exact_dedup, language_id, lm_scoring, near_dedup, packing, quality, registry, sentencepiece_codec, toxicity, url_filters

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, id long, label string, digest string, leader long"
LONG = "lorem ipsum dolor " * 20000


def docs(spark, texts, langs=itertools.cycle(["en"])):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, 0, None, None, 0) for (i, t), lang in zip(texts, langs)], DOCS)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "b a"), (6, "ba"), (7, LONG), (8, LONG + "x"), (9, "é中😀 !!"), (10, "one two three four five six"), (11, "One two  three FOUR five six")]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark, duck, same):
    same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


def test_exact(spark):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, EDGE)).collect()}
    assert rows[1]["keep_id"] == rows[2]["keep_id"] == 3 and rows[1]["group_size"] == 3  # most code points
    assert rows[5]["kept"] and rows[6]["keep_id"] == 5
    assert rows[4]["group_size"] == 2
    kept = exact_dedup.kept_rows(docs(spark, EDGE))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_groups(docs(spark, EDGE).limit(0)).count() == 0


def test_exact_null_identifiers(spark):
    rows = [(None, "a"), (None, "a "), (None, " b"), (3, "b"), (None, "c"), (None, "c"), (5, "d"), (5, "d  "), (5, "d")]
    frame = docs(spark, rows)
    got = sorted(((r["doc_id"] or 0), r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(frame).collect())
    assert got == [(0, 0, 2, True)] * 5 + [(3, 0, 2, False)] + [(5, 5, 3, True)] * 3
    kept = exact_dedup.kept_rows(frame)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, " b"), (0, "a "), (0, "c"), (5, "d  ")]


def test_trie_spills(monkeypatch):
    trie, rng, seen = exact_dedup.RadixTrie(), np.random.default_rng(0), collections.Counter()
    out = collections.Counter()
    for i in range(3000):
        key = bytes(rng.integers(97, 100, rng.integers(0, 7)).tolist())
        seen[key] += 1
        trie.insert(key, len(key), i)
        if trie.size > 20_000:
            out.update({k: o.rows for k, o in trie.spill(5_000)})
    for k, o in trie.terminals():
        out[k] += o.rows
    assert out == seen


def shingles(text):
    words = (text or "").encode().lower().split()  # of bytes: ASCII only
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(5)), strict=False))


def brute_components(sets, percent=85):
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            name[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(words, 120)) for _ in range(8)]
    texts = []
    for i in range(120):
        words_ = list(base[i % 8])
        for _ in range(int(rng.integers(0, 4))):
            words_[int(rng.integers(0, 120))] = "z" + str(rng.integers(0, 10**6))
        texts.append((i, " ".join(words_)))
    texts += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, LONG), (205, LONG)]
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    sets = {i: shingles(t) for i, t in texts}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(sets)
    assert near_dedup.near_groups(docs(spark, texts).limit(0)).count() == 0


def test_near_cloud(spark, monkeypatch):
    """A cloud of copies edited again and again: chains of links, many pairs just below the threshold, more members than a block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(7)
    base = [f"v{i}" for i in range(150)]
    texts = [(i, " ".join(base)) for i in range(3)]
    for i in range(3, 300):
        words_ = list(texts[int(rng.integers(0, i))][1].split()) if i % 3 else list(base)
        for _ in range(int(rng.integers(1, 9))):
            words_[int(rng.integers(0, 150))] = "y" + str(rng.integers(0, 10**6))
        texts.append((i, " ".join(words_)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert got == brute_components({i: shingles(t) for i, t in texts})


def test_near_repeated_identifiers(spark):
    """Rows that share an identifier, or have none, keep the links of their own texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (4, c), (None, c + " more"), (None, "alone " * 9), (5, c.upper())]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_dedup.near_groups(docs(spark, texts)).collect())
    assert got == [(0, 1, 0, True), (0, 57, 4, False), (1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 56, 4, True), (4, 56, 4, True), (5, 56, 4, False)]


def test_near_stray_members_of_large_buckets(spark, monkeypatch):
    """A stray member of a bucket is sent to its blocks; the blocks of the largest component are not sent to each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in range(100)]
    texts = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 100, 150).tolist())]
    texts += [(500 + i, " ".join(base[:k] + [f"z{i}{j}" for j in range(9 + i)] + base[k + 9 + i :])) for i, k in enumerate(range(10, 60, 10))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert got == brute_components({i: shingles(t) for i, t in texts})


def stages_of(spark, run):
    """How many stages Spark makes of what run does: on many partitions and few rows they are the time."""
    sc = spark.sparkContext
    sc.setJobGroup(group := uuid.uuid4().hex, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    return len({s for j in jobs for s in j.stageIds})


def chains(parts=12):
    """Near copies edited again and again in a few texts' chains, so that the leaders' links are no stars and buckets hold several components."""
    rng = np.random.default_rng(13)
    texts = []
    for c in range(parts):
        words_ = [f"c{c}w{i}" for i in range(150)]
        for _ in range(12):
            texts.append(" ".join(words_))
            for k in rng.integers(0, 150, 2).tolist():
                words_[k] = f"e{rng.integers(0, 10**9)}"
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def test_near_has_few_stages(spark):
    texts, got = chains(), {}
    stages = stages_of(spark, lambda: got.update({r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs(spark, texts)).collect()}))
    assert got == brute_components({i: shingles(t) for i, t in texts})
    assert stages <= 240  # 319 when three searches for components made twice the shuffles in a round


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 900)).astype(np.uint64)
    b[:800] = a[:800]  # similarity 0.8
    at = np.array([0, 900, 1800])
    values = near_dedup.registers(np.concatenate([a, b]), at)
    union = near_dedup.registers(np.union1d(a, b), np.array([0, 1000]))
    assert (near_dedup.merged(values[0], values[1]) == union[0]).all()
    found, may = near_dedup.estimated(values[:1], values[1:], np.array([900.0]), np.array([900.0]), 0.85)
    assert abs(found[0] - 0.8) < 0.12 and may[0]


def brute_links(rows, threshold=0.98):
    """{position: (links, position of the smallest identifier reached)} of usable (id, label, vector) rows, by all pairs."""
    good = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, name = dict.fromkeys(range(len(rows)), 0), {i: i for i in range(len(rows))}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for group in {(rows[i][1], len(rows[i][2])) for i in good}:
        own = [i for i in good if (rows[i][1], len(rows[i][2])) == group]
        unit = np.array([rows[i][2] for i in own])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        for a, row in zip(own, linked):
            links[a] = int(row.sum())
            for b in np.flatnonzero(row):
                x, y = root(a), root(own[b])
                name[y] = x
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {i: (links[i], least[root(i)]) for i in range(len(rows))}


def embedding_rows(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("id", F.lit(1)).withColumn("list", F.lit(1)).withColumn("class", F.lit(1))
    return [tuple(r) for r in embedding_dedup.embedding_groups(frame, **options).select("vec_id", "n_links", "component_id", "kept").collect()]


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(i, str(i % 2), (base[i % 30] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(700)]
    rows += [(900, None, [1.0] * 16), (901, "0", None), (902, "0", [0.0] * 16), (903, "0", [1.0, None]), (904, "0", [float("nan")]), (905, "0", rows[0][2]), (906, "0", []), (907, "0", [1.0, 2.0]), (908, "0", [2.0, 4.0])]
    # one identifier with two vectors: the links of both are kept
    rows += [(910, "x", [1.0, 0.0, 0.0]), (910, "x", [0.0, 1.0, 0.0]), (911, "x", [1.0, 0.01, 0.0]), (912, "x", [0.0, 1.0, 0.01])]
    want = sorted((rows[i][0], n, c, rows[i][0] == c) for i, (n, c) in brute_links(rows).items())
    assert sorted(embedding_rows(spark, rows, exact=True)) == want
    got = sorted(embedding_rows(spark, rows))
    assert sum(n for _, n, *_ in got) >= 0.99 * sum(n for _, n, *_ in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    assert [g for g in got if g[0] >= 900] == [w for w in want if w[0] >= 900]
    assert embedding_rows(spark, rows[:0] or [(1, None, None)]) == [(1, 0, 1, True)]
    assert embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").limit(0)).count() == 0


@pytest.mark.parametrize(("dimension", "clusters", "noise"), [(16, 60, 0.12), (64, 40, 0.13), (256, 3, 0.12), (768, 5, 0.1)])
def test_embeddings_recall(spark, monkeypatch, dimension, clusters, noise):
    """Dense and spread clusters in low and high dimension; lists of single pivots and of pairs find the same links."""
    rng = np.random.default_rng(dimension)
    base = rng.normal(size=(clusters, dimension))
    rows = [(i, "a", (base[i % clusters] + rng.normal(scale=noise, size=dimension)).tolist()) for i in range(900)]
    brute = brute_links(rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    got = sorted(embedding_rows(spark, rows))
    found, true = sum(n for _, n, *_ in got), sum(n for n, _ in brute.values())
    assert true > 1000 and found >= 0.98 * true and all(n <= brute[i][0] for i, n, *_ in got)
    if found == true:
        assert [c for _, _, c, _ in got] == [brute[i][1] for i in range(len(rows))]
    monkeypatch.setattr(embedding_dedup, "LONG", 1)
    assert sorted(embedding_rows(spark, rows)) == got


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "http://example.org", "https://x.com/de/1#a", "http://org/", "http://borg/", "http://example.org/en/1", "http://example.org/en/1"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x"))
    got = [tuple(r) for r in url_filters.judged(frame, url_filters.rules_table(spark, url_filters.RULES)).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3:] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("x.com", "/de/1", "com/de/", "block"), ("org", "/", "org/", "allow"),
        ("borg", "/", None, "allow"), ("example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
    ]
    long = spark.createDataFrame([(1, "http://" + "a." * 20000 + "org/x"), (2, "http://" + "x." * 20000 + "org./x"), (3, "http://.org/x")], "page_id long, url string")
    assert [r["rule"] for r in url_filters.judged(long, url_filters.rules_table(spark, url_filters.RULES)).orderBy("page_id").collect()] == ["org/", None, "org/"]
    assert url_filters.judged(frame.limit(0), url_filters.rules_table(spark, url_filters.RULES)).count() == 0
    assert url_filters.judged(frame.limit(0), url_filters.rules_table(spark, [])).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*EDGE[:9], (20, "x  y \n z\t\tw  "), *((i, "word " * i) for i in range(100, 160))]
    got = packing.packed(docs(spark, texts), window=128).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for i, t in texts}
    want = collections.Counter()
    for i, _ in texts:
        want[i] += len(ids[i])
    assert got.groupby("doc_id").length.sum().to_dict() == want
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    padding = 0
    for _, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 128
        padding += 128 - part.length.sum()
    assert padding < 128
    assert packing.packed(docs(spark, texts).limit(0)).count() == 0


def test_packing_tokenises_prose_without_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    expected = [e.ids for e in Tokenizer.from_file(packing.default_tokenizer()).encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]
    handed = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            handed.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **options)

    ours = packing._tokenizer(packing.default_tokenizer())
    monkeypatch.setattr(ours, "tokenizer", Counted(ours.tokenizer))
    got = ours.encoded(pa.array(texts), 1) if hasattr(ours, "encoded") else [x + np.uint32(1).tobytes() for x in ours.batch(["" if t is None else t for t in texts])]
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [[*x, 1] for x in expected]
    assert sum(handed) < 0.01 * sum(len(t or "") for t in texts)


def test_byte_bpe_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(packing.default_tokenizer()), byte_bpe.ByteBpe(packing.default_tokenizer())
    assert ours.covered

    def same_ids(texts):
        got = [np.frombuffer(x, np.uint32).tolist() for x in ours.encoded(pa.array(texts, pa.string()), 7)]
        assert got == [[*e.ids, 7] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    parts = ["a", "b", "the", "S", "ing", *" " * 3, "\n", "\t", "'", "'s", "'re", "'LL", "'ll", "1", "23", ".", ",", "%%%", "é", "ß", "中", "😀", "\u00a0", "\u2003", "\u3000", "\u1680", "\u0085", "\x00", "\x1c", "\u200b", "\u180e", "\u0300", "²", "Ⅷ", "\U0002a6d6", "\ua7c2"]
    pick = np.random.default_rng(5)
    same_ids(["".join(pick.choice(parts, pick.integers(0, 40)).tolist()) for _ in range(5000)])
    same_ids([None, "", " ", "  ", "'", "'s", " 's", "don't we'rest I'll 'tis ''s ,'s's", "x<|endoftext|> y <|endoftext|>", "aaaa" * 9 + "aaaaa", "aaaa" * 500 + " x", LONG[:5000], "\ufffd"])
    known = np.flatnonzero(ours.classes != byte_bpe._UNKNOWN).tolist()
    same_ids([f"a{c}a {c}1{c}1 {c},{c}, {c}{c} {c}\n{c} " for c in map(chr, known)])
    monkeypatch.setattr(byte_bpe, "_PART", 10)
    same_ids(["one two  three \ua7c2 four\n five, six " * 5, "\ua7c2" * 30])
    ours.covered = False
    same_ids(["one two  three", None, "<|endoftext|>"])
    assert ours.encoded(pa.array([], pa.string()), 7) == []
    with pytest.raises(pa.ArrowInvalid):
        ours.encoded(pa.array([b"a\xffb"]).view(pa.string()), 7)


def test_least_squares_covers():
    counts = {5: 10, 3: 10, 4: 7, 8: 2}
    x = packing.least_squares(packing.combinations(counts, 8), counts)
    assert min(x) >= 0
    used = collections.Counter()
    for length, lo, hi, *_ in packing.solved(counts, 8):
        used[length] += hi - lo
    assert used == counts


def test_language(spark):
    train = {"en": "the and of this that with from have", "de": "der die das und nicht auch eine werden"}
    texts = [(i, " ".join(np.random.default_rng(i).permutation(train["en" if i % 2 else "de"].split()))) for i in range(200)]
    got = {r["doc_id"]: r for r in language_id.predicted(docs(spark, [*texts, (300, None), (301, "12 !"), (302, LONG + train["de"])], ["de", "en"] * 100 + [None] * 3)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(200))
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[302]["lang_pred"] == "de"
    assert language_id.predicted(docs(spark, [(1, "x")], [None])).first()["lang_pred"] == "und"
    assert language_id.predicted(docs(spark, texts).limit(0)).count() == 0


def test_language_fallback_is_the_commonest(spark, monkeypatch):
    """Both languages fill their sample; a text without any hit gets the one with more rows, not the first by name."""
    monkeypatch.setattr(language_id, "SAMPLE", 5)
    texts = [(i, "the and of this that" if i % 3 else "der die das und nicht") for i in range(60)]
    frame = docs(spark, [*texts, (100, "qqqqq xxxxx")], [*("en" if i % 3 else "de" for i in range(60)), None])
    got = language_id.predicted(frame).filter("doc_id = 100").first()
    assert got["lang_pred"] == "en" and got["score"] == 0.5


def test_ngrams_do_not_depend_on_the_place():
    """The last text of a call has the same n-grams as one before others."""
    for text in (b"der", b"ab", b"a", b"", b"two words", b"x 1 y"):
        alone, at = language_id.ngrams([text])
        first, places = language_id.ngrams([text, b"der", b"langer"])
        last, ends = language_id.ngrams([b"langer", text])
        assert alone.tolist() == first[: places[1]].tolist() == last[ends[1] :].tolist() and at.tolist() == [0, len(alone)]
    assert len(language_id.ngrams([b"der"])[0]) == 6 and len(language_id.ngrams([b"ab"])[0]) == 3


def test_more_than_64_languages(spark):
    """Every language is learnt, the rarest ones too; the rarest has the last bit of the second word."""
    rng = np.random.default_rng(2)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(70)]
    texts, langs = [], []
    for k in range(70):
        for _ in range(12 if k < 64 else 8):
            texts.append((len(texts), " ".join(rng.permutation(words[k]))))
            langs.append(f"l{k:02}")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs(spark, texts, langs)).collect()}
    assert got == dict(enumerate(langs))
    assert language_id.learnt([("x", b"12", 1), ("y", b"", 1)]).decide([b"abc"])[0].tolist() == [0]


def test_largest_elsewhere():
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(5)]
    shares = [rng.integers(1, 4, len(g)) / 8 for g in grams]
    held = [dict(zip(g.tolist(), s.tolist())) for g, s in zip(grams, shares)]
    for k, found in enumerate(language_id._largest_elsewhere(grams, shares)):
        assert found.tolist() == [max((h.get(g, 0.0) for j, h in enumerate(held) if j != k)) for g in grams[k].tolist()]


def test_filters_have_no_false_negatives():
    texts = [b"alpha beta gamma delta", b"epsilon zeta eta theta"]
    filters = language_id.LanguageFilters(["x", "y"])
    for k, t in enumerate(texts):
        filters.add(k, language_id.ngrams([t])[0])
    for k, t in enumerate(texts):
        assert (filters.containing(language_id.ngrams([t])[0]) >> k & 1).all()


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(module, column, spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(words, 60)) if i % 2 else " ".join(["nasty"] * 30 + list(rng.choice(words, 20)))) for i in range(400)]
    one = 0 if column == "toxic" else 1
    labels = spark.createDataFrame([(i, int(i % 2 == one), int(i % 2 == one)) for i, _ in texts], "doc_id long, quality int, toxic int")
    edge = [(900, None), (901, ""), (902, LONG)]
    got = {r["doc_id"]: r for r in module.scored(docs(spark, texts + edge), labels).collect()}
    held = [i for i, _ in texts if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == int(i % 2 == one) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert module.scored(docs(spark, texts).limit(0), labels).count() == 0
    assert module.scored(docs(spark, edge), labels.limit(0)).count() == 3


def test_block_max_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    for dense_lists, width in ((0, 40), (8, 40), (8, 400), (1024, 40)):
        monkeypatch.setattr(toxicity, "DENSE", dense_lists)
        monkeypatch.setattr(toxicity, "BLOCK", 16)
        dense = rng.random((500, width)) * (rng.random((500, width)) < 6 / width)
        dense = np.rint(dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12) * 2**20) / 2**20
        dense[400:] = dense[:100]  # repeated rows and so ties
        index = pickle.loads(pickle.dumps(toxicity.BlockMaxIndex([(np.flatnonzero(r), r[r > 0]) for r in dense], width)))
        queries = [(np.flatnonzero(q), q[q > 0]) for q in dense[:50]]
        for i, (near, cosine) in enumerate(index.nearest(queries, 15)):
            every = dense @ dense[i]
            want = [j for j in np.lexsort((np.arange(500), -every))[:15] if every[j] > 0]
            assert near.tolist() == want and cosine.tolist() == every[want].tolist()
        for i, (near, _) in enumerate(index.nearest(queries, 15, list(range(50)))):
            assert i not in near


def test_rare_toxic_terms_are_searched():
    """A word of few toxic examples and of no clean one finds them, though its likelihood-ratio statistic is low."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    clean = [" ".join(rng.choice(words[:2000], 40)).encode() for _ in range(262)]
    toxic = [" ".join([*rng.choice(words[:2000], 20), *[f"zz{'qvwxy'[i % 5]}{'rstuklmn'[i // 5]}k"] * 4]).encode() for i in range(38)]
    rows = [(i, t, int(i >= 262)) for i, t in enumerate(clean + toxic)]
    model = toxicity.NearestExamples((i, y, t, 38 if y else 262) for i, t, y in rows)
    for i in range(262, 300):
        word = rows[i][1].split()[-1]
        _, evidence = model.scores([word + b" unseen"])
        assert evidence[0][0] == i
    assert len(model.known) == len(np.unique(toxicity.features([t for _, t, _ in rows])[1]))


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    texts = [*EDGE[:6], (9, EDGE[9][1]), (20, "  a\tb\n\n"), (21, "a▁ b <s> <0x41>"), (22, "ненавижу 漢字 مرحبا ①"), (23, "a" * 300)]
    rows = {r["doc_id"]: r for r in sentencepiece_codec.coded(docs(spark, texts)).collect()}
    for i, t in texts:
        assert rows[i]["ids"] == (None if t is None else library.encode(t)) and rows[i]["round_trip"] in (None if t is None else True,)
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs(spark, texts)))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: None if t is None else t.replace("▁", " ") for i, t in texts}
    assert sentencepiece_codec.coded(docs(spark, texts).limit(0)).count() == 0


def test_unigram_viterbi():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.4, "ba": -3.5, "bb": -9.0}
    vocabulary = sentencepiece_codec.Vocabulary({p: (i + 1, s) for i, (p, s) in enumerate(pieces.items())}, "unigram")
    words = sorted({"".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)})

    def best(word):
        options = [(pieces[word[:k]] + best(word[k:])) for k in range(1, len(word) + 1) if word[:k] in pieces]
        return max(options) if word else 0.0

    score = {i + 1: s for i, s in enumerate(pieces.values())}
    for word, ids in zip(words, sentencepiece_codec.shared_prefix_encode(words, vocabulary)):
        assert sum(score[i] for i in ids) == pytest.approx(best(word))


def test_lm_brute_force(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in lm_scoring.scored(docs(spark, EDGE), order=3).collect()}
    words = [(i, (t or "").encode().lower().split()) for i, t in EDGE]
    counts = collections.Counter(tuple(w[a : a + n]) for _, w in words for n in range(1, 4) for a in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def score(context, word):
        gram = (*context, word)
        if not context:
            return counts[gram] / total
        return counts[gram] / counts[tuple(context)] if counts[gram] >= 2 else 0.4 * score(context[1:], word)

    for i, w in words:
        want = sum(int(np.rint(np.log(score(w[max(0, k - 2) : k], x)) * 1e6)) for k, x in enumerate(w))
        row = got[(i, len(w))]
        assert abs(row["log_prob_micro"] - want) <= len(w)
        assert row["n_backoff"] == sum(counts[tuple(w[max(0, k - 2) : k + 1])] < 2 for k in range(1, len(w)))
        assert row["mean_log_prob"] == (pytest.approx(row["log_prob_micro"] / 1e6 / len(w)) if w else None)
    assert lm_scoring.scored(docs(spark, EDGE).limit(0)).count() == 0
    many = lm_scoring.scored(docs(spark, [(None, "a b a b")] * 50 + [(1, None)])).collect()
    assert len(many) == 51 and {r["n_words"] for r in many} == {0, 4}


def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    now = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, DATA)
        assert now.columns == frame.columns
        now = spark.createDataFrame(now.collect(), frame.schema)
        assert 0 < now.count() <= before.count()
        if name == "MinHash near-dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(i for i, c in brute_components(sets, 80).items() if i == c)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert pieces.select("doc_id").distinct().count() == now.count()


def test_pipeline_edges(spark):
    """Repeated and null identifiers, null and empty texts, clashing columns and an empty table."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    good, other = (r["text"] for r in corpus_pipeline.good_quality(spark, frame, DATA).filter("length(text) > 300").orderBy("doc_id").limit(2).collect())
    bad = quality.scored(frame, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 0").join(frame, "doc_id").orderBy("doc_id").first()["text"]
    at = 10**6
    rows = [(None, good), (at + 7, other), (at + 7, bad), (at + 7, bad), (at + 8, None), (at + 9, ""), (at + 10, other + " end"), (at + 11, other)]
    extra = frame.withColumn("id", F.lit(0)).withColumn("mark", F.lit(0)).withColumn("class", F.lit("x"))
    filled = dict.fromkeys(extra.columns) | {"id": 0, "mark": 0, "class": "y"}
    # beside the whole table, whose labels and languages are learnt from; its identifiers are others
    docs_ = extra.unionByName(spark.createDataFrame([tuple((filled | {"doc_id": i, "text": t, "source": "added"}).values()) for i, t in rows], spark.createDataFrame([], extra.schema).schema))
    now = docs_
    for _, stage in corpus_pipeline.STAGES[:2]:
        now = stage(spark, now, DATA)
    assert now.columns == extra.columns
    now = spark.createDataFrame(now.filter("source = 'added'").collect(), docs_.schema)
    left = sorted((r["doc_id"] or 0, r["text"]) for r in now.collect())
    assert left == sorted([(0, good), (at + 7, other), (at + 10, other + " end"), (at + 11, other)])
    for _, stage in corpus_pipeline.STAGES[2:4]:
        now = spark.createDataFrame(stage(spark, now, DATA).collect(), docs_.schema)
        assert now.columns == extra.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in now.collect()) == sorted([(0, good), (at + 7, other)])
    nothing = extra.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


def test_numerals_are_no_letters(spark):
    texts = [(i, "the and of this that") for i in range(30)] + [(100, "½ ² Ⅷ 12"), (101, "é"), (102, "漢")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs(spark, texts)).collect()}
    assert got[100] == "und" and got[101] == got[102] == "en"


def test_classifier_ties(spark):
    """Repeated rows score alike, equal examples of both labels and identifiers with both labels don't disturb, and the order of rows doesn't matter."""
    texts = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} word{i % 3}") for i in range(40)] + [(i % 40, f"alpha beta gamma word{i % 3}") for i in range(7)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 0, 0), (2, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        frame = docs(spark, texts)
        got = sorted((r["doc_id"], r["score"]) for r in module.scored(frame, labels).collect())
        again = sorted((r["doc_id"], r["score"]) for r in module.scored(frame.orderBy(F.desc("text")).repartition(5), labels).collect())
        assert got == again and len(got) == 47
        by_text = collections.defaultdict(set)
        for r in module.scored(frame, labels).join(frame.select("doc_id", "text").distinct(), "doc_id").filter("doc_id > 6").collect():
            by_text[r["text"]].add(r["score"])
        assert all(len(v) == 1 for v in by_text.values())


def component_rows(spark, edges):
    return sorted(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))


def test_components_of_stars_take_no_round(spark, monkeypatch):
    def round_made(edges):
        raise AssertionError("stars that point at their least node need no round")

    monkeypatch.setattr(components, "_large_star", round_made)
    assert component_rows(spark, [(5, 1), (1, 7), (1, 7), (9, 2), (4, 4)]) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert component_rows(spark, []) == []
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):  # a node below another, and one of two roots
        with pytest.raises(AssertionError):
            component_rows(spark, edges)


def test_components_round_shuffles(spark):
    """Two exchanges of edges and two of minima each step at most, none for what is only written."""
    edges = spark.range(1000).selectExpr("id + 1 AS u", "id AS v")
    plan = components._small_star(components._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 5


def test_components_of_repeated_edges(spark):
    edges = [(2, 1), (1, 2), (2, 1), (3, 3), (5, 4), (5, 4)]
    assert component_rows(spark, edges) == [(1, 1), (2, 1), (4, 4), (5, 4)]
    assert component_rows(spark, edges * 2 + [(2, 5), (5, 2)] * 3) == [(1, 1), (2, 1), (4, 1), (5, 1)]


def test_components_of_paths_rings_and_hubs(spark):
    rng = np.random.default_rng(7)
    names = rng.permutation(400).tolist()
    path, ring, hub = ([names[i : i + 1] + names[i + 1 : i + 2] for i in range(59)], [[names[60 + i], names[60 + (i + 1) % 30]] for i in range(30)], [[names[100], names[i]] for i in range(101, 160)])
    stray = rng.choice(names[200:], (90, 2)).tolist()
    edges = path + ring + hub + stray + [[7, -3]]
    least = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in least:
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert component_rows(spark, edges) == sorted(least.items())
