"""Quality rules, language identification, pieces and toxicity against brute force, round trips and held-out rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import language, pieces, quality, toxicity

SF = "/root/testdata/sf0.01"


# ---- quality -----------------------------------------------------------------------------------------

def slow_repeated(words, window=5):
    grams = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if grams[tuple(words[i:i + window])] > 1:
            hit.update(range(i, i + window))
    return len(hit)


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality.repeated_words(words) == slow_repeated(words)


def test_quality_edge_cases(docs_of):
    import string
    rng = random.Random(1)
    clean = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    noise = " ".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(100))
    rows = [(1, None), (2, ""), (None, clean), (3, clean), (3, clean), (4, "x " * 500), (5, noise), (6, "a\x85b \x1c c\xa0d " + "#*" * 3),
            (7, "one line\n\n  \none line\nother")]
    got = quality.quality(docs_of(rows)).select("row.doc_id", "row.key", "quality.*").collect()
    assert len(got) == len(rows) and all(r["key"] == "x" for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    assert by[3]["kept"] and by[None]["kept"]
    assert by[4]["base_failed"] and by[4]["n_repeat_words"] == 500
    assert not by[5]["base_failed"] and by[5]["reason"] == "incompressible"
    # only ASCII white space splits, \x85, \x1c and \xa0 do not: a\x85b, \x1c, c\xa0d and the symbols
    assert by[6]["n_words"] == 4 and by[6]["n_symbols"] == 6
    assert by[7]["n_dup_lines"] == 1
    assert quality.quality(docs_of([]).filter("false")).count() == 0


def test_bands_depend_on_length():
    assert quality.band(50)[1] > quality.band(5000)[1] and quality.band(50)[0] < quality.band(500)[0]


# ---- language ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict(docs.filter(language.held_out()), model)
    got = rows.select("row.lang", "lang_pred").filter("lang IS NOT NULL").collect()
    assert len(got) > 150 and np.mean([r[0] == r[1] for r in got]) >= 0.97


def test_forward_backward_equals_enumeration(model):
    """Block-wise forward-backward against the plain recursion on one text, over several blocks."""
    rng = np.random.default_rng(0)
    lab = language.Labeller(model)
    k = len(model.languages)
    for n in (1, 5, 63, 64, 65, 300):
        e = rng.random((n, k)).astype(np.float32) + 0.01
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = e[0]
        for t in range(1, n):
            a[t] = (a[t - 1] @ lab.step) * e[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = lab.step @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        got = lab.probabilities(np.concatenate([e, e[:7]]), np.array([n, min(7, n)]))[:n]
        assert np.allclose(got, want, atol=1e-4)


def test_code_switched_words_keep_their_runs(spark, model):
    by = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang IN ('en', 'fr') AND length(text) > 500").limit(60).collect()}
    en, fr = (" ".join(by[x].split()[:30]) for x in ("en", "fr"))
    labels = [k for _, k in language.word_labels(model, f"{en} {fr} {en}")]
    assert np.mean([a == "en" for a in labels[:25]]) > 0.9 and np.mean([a == "fr" for a in labels[33:55]]) > 0.9


def test_language_edge_cases(docs_of, model):
    rows = [(1, None), (2, ""), (3, "12 -- !?"), (None, "the and of"), (4, "the and of"), (4, "the and of"), (5, "x " * 900_000)]
    got = language.predict(docs_of(rows), model, keep=["doc_id", "key"]).select("row.*", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and by[3]["score"] == 0
    assert by[None]["lang_pred"] == by[4]["lang_pred"] != "und" and 0 <= by[4]["score"] <= 1
    assert by[5]["lang_pred"] != "und"
    empty = language.train({})
    assert [r["lang_pred"] for r in language.predict(docs_of([(1, "abc")]), empty).collect()] == ["und"]
    assert language.predict(docs_of([]).filter("false"), model).count() == 0


def test_prediction_ignores_labels(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    changed = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    one = [tuple(r) for r in language.predict(docs, model, keep=["doc_id"]).collect()]
    assert one == [tuple(r) for r in language.predict(changed, model, keep=["doc_id"]).collect()]


# ---- pieces --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def random_text(rng):
    return "".join(rng.choice(rng.choice(["ab", "the an on", "é中 \n▁\x00", "  x", "aaaa"])) for _ in range(rng.randint(1, 110)))


def best_by_enumeration(v, text):
    """Best score over all segmentations, by trying every one of a short text."""
    if not text:
        return 0.0
    return max(v.scores.get(text[:j], v.unknown if j == 1 else float("-inf")) + best_by_enumeration(v, text[j:]) for j in range(1, len(text) + 1))


def test_search_is_the_best_of_all_segmentations(vocabulary):
    rng = random.Random(4)
    for _ in range(40):
        t = " " + "".join(rng.choice("thean o") for _ in range(rng.randint(1, 9)))
        assert vocabulary.best(t)[0] == best_by_enumeration(vocabulary, t)


def test_words_together_equal_one_search(vocabulary):
    rng = random.Random(5)
    words = pieces.Words(vocabulary)
    for _ in range(150):
        t = random_text(rng)
        ids = pieces.encode_texts(words, [t])[0]
        assert ids.tobytes() == vocabulary.best(" " + t)[1]
        assert vocabulary.decode(ids.tolist()) == t


def test_parallel_scan_equals_one_search(vocabulary):
    rng = random.Random(6)
    words = pieces.Words(vocabulary)
    for _ in range(120):
        s = " " + random_text(rng)
        want = vocabulary.best(s)[1]
        for size in (16, 23, 40):
            parts = [pieces.Chunk(words, s[max(0, i - 1):i], s[i:i + size], s[i + size:i + size + vocabulary.longest - 1]) for i in range(0, len(s), size)]
            state = np.where(np.arange(vocabulary.longest) == 0, 0.0, float("-inf"))
            matrices, middles = zip(*(c.transfer() for c in parts))
            scores = []
            for m in matrices:
                scores.append(state.tolist())
                state = pieces.max_plus(state, m)
            whole = matrices[0]
            for m in matrices[1:]:
                whole = pieces.max_plus(whole, m)
            assert whole[0, 0] == state[0]
            ends, x = [0] * len(parts), 0
            for i in range(len(parts) - 1, -1, -1):
                ends[i], x = x, parts[i].entries(scores[i])[x]
            assert b"".join(c.pieces(a, b, m) for c, a, b, m in zip(parts, scores, ends, middles, strict=True)) == want


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-50, 0, (6, 6)).astype(float) for _ in range(3))
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()


def test_scan_over_many_groups_equals_one_search(docs_of, vocabulary, monkeypatch):
    """Texts of up to 300 chunks in groups of 3: six levels of products."""
    rng = random.Random(8)
    texts = ["".join(random_text(rng) for _ in range(n)) for n in (1, 4, 30, 110)] + ["q" * 1500]
    monkeypatch.setattr(pieces, "GROUP", 3)
    got = pieces.encode(docs_of(list(enumerate(texts))), keep=["doc_id"], chunk=20).collect()
    for r in got:
        assert np.array(r["ids"], np.int32).tobytes() == vocabulary.best(" " + texts[r["row"]["doc_id"]])[1]


def test_search_equals_a_unigram_encoder():
    """A vocabulary written by hand, with scores that leave no ties, against the search of a public unigram encoder."""
    from tokenizers import Tokenizer, models
    rng = random.Random(9)
    names = sorted({*"abcd", *("".join(rng.choices("abcd", k=rng.randint(2, 6))) for _ in range(120))})
    scores = {p: -float(rng.randrange(1 << 20)) / 1024 - 1 for p in names}
    v = pieces.Vocabulary({p: i for i, p in enumerate(names)}, scores, [p.encode() for p in names], [0] * 256, 6, -1e6)
    encoder = Tokenizer(models.Unigram(list(scores.items()), unk_id=None, byte_fallback=False))
    words = pieces.Words(v)
    for _ in range(300):
        t = "".join(rng.choices("abcd", k=rng.randint(1, 90)))
        want = encoder.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(v.best(t)[1], np.int32).tolist() == want
        assert np.frombuffer(v.best_of_many([t])[0][1], np.int32).tolist() == want
        chunks = [pieces.Chunk(words, "", t[i:i + 7], t[i + 7:i + 12]) for i in range(0, len(t), 7)]
        whole = chunks[0].transfer()[0]
        for c in chunks[1:]:
            whole = pieces.max_plus(whole, c.transfer()[0])
        assert whole[0, 0] == v.best(t)[0]


def test_encode_decode_round_trip(docs_of, vocabulary):
    import sentencepiece
    long = "thandedble " * 40 + "x" * 700 + "\n  é中文 ▁ \U0001f600 " * 30
    rows = [(1, None), (2, ""), (3, "Hello  world\n x"), (3, "Hello  world\n x"), (None, long), (4, long), (5, " ")]
    out = {}
    for chunk in (64, 1 << 15):
        got = pieces.decode(pieces.encode(docs_of(rows), keep=["doc_id", "key"], chunk=chunk)).collect()
        assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in got)
        out[chunk] = sorted((r["row"]["doc_id"] or 0, r["ids"]) for r in got)
    assert out[64] == out[1 << 15]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sp.decode(dict(out[64])[3]) == "Hello  world\n x"
    assert pieces.encode(docs_of([]).filter("false")).count() == 0


# ---- toxicity ------------------------------------------------------------------------------------------

def test_toxic_documents_are_found(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    chain = toxicity.learn_chain(docs, labels.filter(~fold), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    held = toxicity.predict(docs, chain, keep=["doc_id"]).select("row.doc_id", F.col("p")[1].alias("p")).join(labels.filter(fold), "doc_id").collect()
    toxic, clean = ([r["p"] >= 0.5 for r in held if r["toxic"] == x] for x in (1, 0))
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.45  # about two fifths of the toxic labels have no trace in the text


def test_held_out_recall_by_language(spark):
    """Five folds; texts that share one of their 12 smallest 8-word shingles are in one fold, so no copy helps."""
    import xxhash
    from tieout.llm.minhash import WordHashes, shingle_set
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id").orderBy("doc_id").collect()
    codes, hashes = toxicity.WordCodes(), WordHashes()
    words = [np.array(sorted({codes[t] for t in (r["text"] or "").split()} - {-1}), np.int64) for r in rows]
    dense = np.array([toxicity.shares(r["text"] or "") for r in rows])
    y = np.array([[r["quality"] == 0, r["toxic"] == 1] for r in rows]).astype(int)
    inner = np.array([xxhash.xxh3_64_intdigest((r["text"] or "").encode()) % toxicity.FOLDS for r in rows])
    group, seen = list(range(len(rows))), {}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, r in enumerate(rows):
        for h in np.sort(shingle_set(r["text"], 8, hashes) * np.uint64(0x9E3779B97F4A7C15))[:12].tolist():
            group[find(i)] = find(seen.setdefault(h, i))
    outer = np.array([xxhash.xxh3_64_intdigest(str(find(i)).encode()) % 5 for i in range(len(rows))])
    p = np.zeros(len(rows))
    for f in range(5):
        use, rest = np.flatnonzero(outer != f), np.flatnonzero(outer == f)
        inputs = dense[rest]
        for m in toxicity.fit_chain([words[i] for i in use], dense[use], y[use], inner[use]):
            p[rest] = toxicity._scores(m, [words[i] for i in rest], inputs)
            inputs = np.column_stack([inputs, p[rest]])
    found, toxic, english = p >= 0.5, y[:, 1] == 1, np.array([r["lang"] == "en" for r in rows])
    for lang in sorted({r["lang"] for r in rows}):
        its = np.array([r["lang"] == lang for r in rows])
        print(lang, found[its & toxic].sum(), (its & toxic).sum(), found[its & ~toxic].sum(), (its & ~toxic).sum())
    assert found[toxic & english].mean() > 0.9 and found[toxic & ~english].mean() > 0.82
    assert found[~toxic & english].mean() < 0.005 and found[~toxic & ~english].mean() < 0.005


def test_chain_uses_earlier_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    rows = [np.array([1 if f else 2] + [int(rng.integers(10, 500))]) for f in first]
    labels = np.column_stack([first, first]).astype(int)
    chain = toxicity.fit_chain(rows, np.zeros((600, 0)), labels, np.arange(600) % 3)
    assert len(chain[0].dense) == 0 and len(chain[1].dense) == 1 and chain[1].dense[0] > 0.5


def test_toxicity_edge_cases(docs_of, spark):
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, "you idiot"), (3, "you idiot"), (4, "fine " * 50_000)]
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.learn_chain(docs_of(rows), labels, {"toxic": F.col("toxic") == 1})
    got = toxicity.predict(docs_of(rows), chain, keep=["doc_id", "key"]).collect()
    assert len(got) == len(rows) and all(0 <= r["p"][0] <= 1 for r in got)
    none = toxicity.learn_chain(docs_of(rows), labels.filter("false"), {"toxic": F.col("toxic") == 1})
    assert all(r["p"][0] < 1e-9 for r in toxicity.predict(docs_of(rows), none).collect())
    assert toxicity.predict(docs_of([]).filter("false"), chain).count() == 0
