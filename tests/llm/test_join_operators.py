"""URL rules, suffix removal, decontamination, chat, WARC, near-duplicates and the pipeline against brute force and round trips."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tieout.llm import chat, decontam, minhash, suffix, warc
from tieout.llm.common import content_key
from tieout.llm.queries import ORACLES, QUERIES
from tieout.llm.url_filter import apply_url_rules
from tieout.session import scratch_path

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple("" if v is None else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert plain(QUERIES[name](spark, SF).select(columns).collect()) == plain(want.fetchall())


# ---- URL rules -----------------------------------------------------------------------------------------

def slow_rule(host, path, rules):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return (best[1], best[2]) if best else (None, "allow")


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    labels, paths = ["a", "b", "a-b", "ab", "com"], ["", "/", "/x", "/x/y", "/xy", "/y/"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(paths)): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'z'])}") for i in range(700)]
    urls += [(1000 + i, "https://a.com/x/y") for i in range(400)] + [(2000, None), (2001, "no scheme"), (None, "x://A.COM/"), (2002, "x://"), (2000, None)]
    df = spark.createDataFrame(urls, "id long, url string").withColumn("key", F.lit("k")).withColumn("Host", F.lit("clash"))
    got = apply_url_rules(df.repartition(7), spark.createDataFrame(rules + [(None, "/", "block"), ("a", None, "allow")], "host string, path string, verdict string"))
    want = []
    for i, u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        want.append((i, h, p, *(slow_rule(h, p, rules) if h else (None, "allow"))))
    assert plain(got.select("row.id", "host", "path", "rule", "verdict").collect()) == plain(want)
    assert apply_url_rules(df.filter("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in apply_url_rules(df, none, default="block").collect()} == {"block"}


# ---- repeated passages -----------------------------------------------------------------------------------

def slow_spans(texts, size):
    from collections import Counter
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + size)
                else:
                    spans.append((i, i + size))
        out.append(spans)
    return out


@pytest.mark.parametrize("hot", [40, 1 << 20])
def test_repeated_spans_equal_brute_force(docs_of, hot):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(50)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaa", "", "short"]
    texts += texts[:3]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(5, None)]
    docs = docs_of(rows)
    found = suffix.kept_bytes(suffix.repeated_spans(F.col("text"), docs, size=20, gram=9, block_bytes=500, hot_bytes=hot))
    got = docs.select(content_key(F.col("text")).alias("key"), "text").join(found, "key", "left").select("text", "kept", "spans").collect()
    data = [(t or "").encode() for _, t in rows]
    want = {d: s for d, s in zip(data, slow_spans(data, 20), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        d = (r["text"] or "").encode()
        spans = [(s["start"], s["end"]) for s in r["spans"] or []]
        assert spans == want[d]
        if spans:
            assert bytes(r["kept"]) == suffix.cut(d, spans)
    assert suffix.repeated_spans(F.col("text"), docs.filter("false")).count() == 0


@pytest.mark.parametrize("at_once", [3, 1 << 16])
def test_repeated_starts_equal_brute_force(monkeypatch, at_once):
    from collections import Counter
    monkeypatch.setattr(suffix, "FRONTIER_ROWS", at_once)
    rng = random.Random(31)
    for letters, size in (("ab", 20), ("abcdefgh", 11), ("ab", 5), ("\u00e9\u4e2d", 30)):
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(6)]
        parts = ["".join(rng.choice(pieces) for _ in range(4)).encode() + bytes(size) for _ in range(60)]
        own, weights = [len(p) - size + 1 for p in parts], [rng.choice([1, 1, 1, 2, 300, 1 << 40]) for _ in parts]
        seen = Counter()
        for p, n, w in zip(parts, own, weights, strict=True):
            for i in range(n):
                seen[p[i:i + size]] += w
        got = suffix.repeated_starts(parts, own, weights, size)
        assert [g.tolist() for g in got] == [[seen[p[i:i + size]] >= 2 for i in range(n)] for p, n in zip(parts, own, strict=True)]


def test_memory_of_blocks_is_bounded():
    import tracemalloc

    import pyarrow as pa
    rng = random.Random(37)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(90)).encode()[:500] for _ in range(3000)]
    parts = [t for t in texts for _ in range(2)]  # each anchor has two segments, the second changed in its last byte
    parts = [p if i % 2 else p[:-1] + b"#" for i, p in enumerate(parts)]
    batch = pa.RecordBatch.from_pydict({"anchor": [i // 2 for i in range(len(parts))], "seg": list(range(len(parts))), "copies": [1] * len(parts),
                                        "own": [len(p) - 399 for p in parts], "part": parts})
    tracemalloc.start()
    try:
        out = [r for b in suffix._blocks(400, suffix.BLOCK_BYTES)(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == len(parts) and {(r["first"], r["last"] - len(parts[r["seg"]]) + 400) for r in out} == {(0, -1)}
    assert peak < 48 << 20, peak >> 20  # two tasks run in each executor


def slow_near_dedup(rows):
    """(id, text) of the row that stays of each component; texts without a word only lose repeated rows with an id."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    best, out = {}, []
    for (d, t), (_, size, g) in zip(rows, slow_groups(numbered, 5), strict=True):
        if size:
            best[g] = min(best.get(g, (2,)), (d is None, d or 0, hashlib.sha256(t.encode()).digest(), d, t))
        elif d is None or (d, t) not in out:
            out.append((d, t))
    return out + [b[3:] for b in best.values()]


def test_near_dedup_decides_rows_on_their_texts(spark, docs_of):
    import corpus_pipeline as c
    rng = random.Random(23)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    a, b, x, y, z, u, v, w = (text() for _ in range(8))
    rows = [(3, a), (5, near(a)), (5, b)]  # b stands under the id of a near copy
    rows += [(11, z), (13, x), (13, near(z)), (15, near(x))]  # x stands under the id of a near copy of z
    rows += [(20, text()) for _ in range(30)]  # one id on many different texts
    rows += [(30, y), (30, near(y)), (30, y)]  # near copies under one id
    rows += [(None, u), (None, near(u)), (None, u), (None, v), (40, near(v)), (None, w)]
    rows += [(50, ""), (50, ""), (50, " "), (None, ""), (None, ""), (51, "")]
    docs = docs_of(rows)
    got = c.near_dedup(spark, docs.repartition(5), SF)
    assert got.columns == docs.columns
    assert plain(got.select("doc_id", "text").collect()) == plain(slow_near_dedup(rows))


def slow_cut(texts, n):
    """Texts without the words in windows of ``n`` words that stand twice."""
    from collections import Counter
    words = [t.split() for t in texts]
    plain_words = [[w.strip('".,') for w in t] for t in words]
    seen = Counter(tuple(w[i:i + n]) for w in plain_words for i in range(len(w) - n + 1))
    out = []
    for w, p in zip(words, plain_words, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(p[i:i + n])] > 1 for j in range(i, i + n)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_pipeline_cuts_passages_of_over_50_short_words(spark, docs_of):
    import corpus_pipeline as c
    rng = random.Random(17)
    word = lambda low, high: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(low, high)))
    line = lambda n, low=1, high=3: " ".join(word(low, high) for _ in range(n))
    rows = []
    for n in (*range(51, 61), 50, 45, 20):  # 60 words of up to 3 letters are fewer than 240 bytes
        passage = line(n)
        rows += [(len(rows), f"{line(80)} \"{passage}.\" {line(30)}"), (len(rows) + 1, f"{line(25)} {passage}, {line(90)}")]
    both = [line(30), line(30)]  # two repeated passages of 30 words side by side are not one of 60
    rows += [(100, f"{line(20)} {both[0]} {both[1]} {line(20)}"), (101, f"{line(20)} {both[0]} {line(20)}"), (102, f"{line(20)} {both[1]} {line(20)}")]
    whole = line(51)
    rows += [(103, whole), (104, f" {whole}\n"), (105, line(40, 11, 12)), (106, None), (None, f"{line(9)} {whole}")]
    rows += [(107, "x" + "\u4e2d\u6587\u5b57" * 17 + "y"), (108, "z " + "\u4e2d\u6587\u5b57" * 17)]
    got = {r["doc_id"]: r["text"] for r in c.passage_dedup(spark, docs_of(rows), SF).collect()}
    spaced = [(d, t) for d, t in rows if d not in (107, 108)]
    want = {d: t for (d, _), t in zip(spaced, slow_cut([t or "" for _, t in spaced], 51), strict=True)}
    gone = {d for d, t in want.items() if not t and d != 106}
    assert gone == {103, 104} and set(got) == {d for d, _ in rows} - gone and got[106] is None
    assert {d: " ".join(t.split()) for d, t in got.items() if d not in (106, 107, 108)} == {d: t for d, t in want.items() if d not in gone | {106}}
    assert all(len(got[i].split()) == len(rows[i][1].split()) - 51 - i // 2 for i in range(20))
    assert (got[107], got[108]) == ("xy", "z ")


def test_memory_of_word_codes_is_bounded():
    import tracemalloc

    from tieout.llm.passages import WordCodes, text_codes
    codes = WordCodes()
    text_codes("warm up", codes)
    tracemalloc.start()
    try:
        for i in range(0, 300_000, 1000):
            text_codes(" ".join(f"w{j}" for j in range(i, i + 1000)), codes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20, peak >> 20
    assert text_codes("w5 w5", codes) == text_codes("w5 w5", WordCodes())


# ---- decontamination -----------------------------------------------------------------------------------

def slow_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    hit, found = set(), set()
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at:at + window]
            for s in range(len(words) - len(part) + 1):
                if words[s:s + len(part)] == part:
                    hit.update(range(s, s + len(part)))
                    found.add("null" if i is None else str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [7, 200_000])
def test_items_equal_brute_force(docs_of, spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    rng = random.Random(11)
    vocab = ["a", "B", "c", "é", "9", "the"]
    line = lambda n: rng.choice([" ", ", ", "\x7f"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randint(0, 9))) for i in range(12)] + [(None, "a a a a a a"), (3, None), (4, "a B c"), (4, "a B c")]
    rows = [(i, line(rng.randint(0, 60))) for i in range(40)] + [(1, None), (None, ""), (2, items[0][1] or "x"), (2, items[0][1] or "x")]
    got = decontam.find_items(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), window=6, shingle=3)
    got = got.select("text", "row.key", "n_words", decontam.n_hit().alias("n_hit"), "items", decontam.contaminated().alias("bad")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, h, found = slow_hits(r["text"], items, 6)
        assert (r["n_words"], r["n_hit"], r["items"], r["bad"]) == (n, h, found, h > 0 and 20 * h >= n)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n"] for r in decontam.find_items(docs_of(rows), none).select(F.size("items").alias("n")).collect()} == {0}
    assert decontam.find_items(docs_of([]).filter("false"), none).count() == 0


# ---- chat ------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|", "<\\\\|x", "<", "|im_end|>", "", None, "a\n<|nl|>b", "é\U0001f600<"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(9) for t, r in enumerate(["user", "assistant", "sy\nst<|nl|>em", None])]
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (3, 0, "user", "tie"), (3, None, "user", "first"), (50, 1, "user", "same"), (50, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1)).withColumn("output", F.lit("o")).drop("output")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(chat.frame_turns(df, "conv_id"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, _, r, x in turns]
        assert got[c]["loss_texts"] == [x for _, _, r, x in turns if r == "assistant"]
        assert got[c]["formatted"].count("<|im_start|>") == got[c]["formatted"].count("<|im_end|>\n") == len(turns)
    assert chat.format_chats(chat.frame_turns(df.filter("false"), "conv_id")).count() == 0


def test_layouts_by_fingerprint(spark):
    records = ['{"prompt": "p", "response": "r", "extra": {"deep": 1}}', '{"instruction": "i", "input": "x", "output": "o"}', '{"instruction": "i", "output": "o"}',
               '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}]}',
               '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"other": 1}', "no json", None]
    df = spark.createDataFrame(list(enumerate(records)), "id long, rec string")
    got = {}
    for r in chat.json_turns(df, "id", "rec").orderBy("conv_id", "turn").collect():
        got.setdefault((r["conv_id"], r["layout"]), []).append((r["role"], r["text"]))
    assert got[0, "prompt_response"] == [("user", "p"), ("assistant", "r")]
    assert got[1, "instruction_input"] == [("user", "i\n\nx"), ("assistant", "o")] and got[2, "instruction"][0] == ("user", "i")
    assert got[3, "messages"] == [("system", "s"), ("user", "")] and got[4, "from_value"] == [("user", "h"), ("assistant", "g")]
    assert all(got[i, None] == [(None, None)] for i in (5, 6, 7))
    typed = spark.createDataFrame([(1, "p", "r", 5)], "id long, Prompt string, Response string, n int")
    assert [(r["role"], r["text"]) for r in chat.frame_turns(typed, "id").orderBy("turn").collect()] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.frame_layout(spark.createDataFrame([(1, "p")], "id long, prompt string"))


# ---- WARC ------------------------------------------------------------------------------------------------

def test_bundles_round_trip_and_seek(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    big = "<p>é</p>" * 300
    pages = [(i, f"https://x.org/{i} \n", big if i % 3 == 0 else f"page {i}\r\n\r\n" * (i % 5)) for i in range(60)]
    pages += [(100, None, None), (101, "u", ""), (None, "u", big), (57, "dup", big), (200, "long", "z" * 400_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(warc.plan_records(df), folder)
    got = warc.read_bundles(index, folder).collect()
    largest = max(i for i, _, h in pages if i is not None and h == big)
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], r)
    for i, _, h in pages:
        data = (h or "").encode()
        r = by[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        again = len(data) >= 1000 and h == big and i != largest
        assert (r["record_type"], r["refers_to"]) == (("revisit", largest) if again else ("response", None))
        assert r["payload"] is None if again else bytes(r["payload"]) == data
    rows = index.collect()
    store, path = warc.file_system(folder)
    for name in {r["bundle"] for r in rows}:
        table = warc.read_seek_table(store, f"{path}/bundles/{name}")
        assert {(r["frame"], r["frame_bytes"]) for r in rows if r["bundle"] == name} == {(n, c) for n, (c, _) in enumerate(table)}
    some = warc.lookup(index, folder, spark.createDataFrame([(7,), (200,), (7,), (999,)], "page_id long")).collect()
    assert sorted(r["page_id"] for r in some) == [7, 200]
    assert warc.archive(spark, df.filter("false")).count() == 0


# ---- near-duplicates -----------------------------------------------------------------------------------

def slow_groups(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return out


@pytest.mark.parametrize("small", [1, 6])
def test_groups_equal_brute_force(docs_of, monkeypatch, small):
    """With ``small`` = 1 all second-round comparisons go through blocks."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(90):  # near copies of one text, each with some words changed: many pairs lie just at the threshold
        rows.append((1000 - i, " ".join(w if rng.random() > 0.06 else f"x{rng.randint(0, 999)}" for w in base)))
    rows += [(i, "A b  c") for i in range(3)] + [(5, "one"), (6, "ONE"), (7, ""), (8, None), (None, "A b c"), (None, "solo words here"), (2, "A b c"), (2, "A b c")]
    got = minhash.near_duplicates(docs_of(rows), words=2).select("id", "n_shingles", "component_id", "kept").collect()
    want = slow_groups(rows, 2)
    assert plain(r[:3] for r in got) == plain(want)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(docs_of([]).filter("false")).count() == 0


def test_circulant_signature_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    s, t = minhash.signature(a[:700], 512), minhash.signature(a[200:], 512)
    assert abs((s == t).mean() - 500 / 900) < 0.08


# ---- pipeline --------------------------------------------------------------------------------------------

def slow_passages(texts, size):
    """Texts without the words of any window of ``size`` words (compared without the punctuation around them) that starts twice or more."""
    words = {d: [re.sub(r"^[\W_]+|[\W_]+$", "", w) or w for w in t.split()] for d, t in texts.items()}
    starts = {}
    for d, ws in words.items():
        for i in range(len(ws) - size + 1):
            starts.setdefault(tuple(ws[i:i + size]), []).append((d, i))
    gone = {(d, j) for places in starts.values() if len(places) > 1 for d, i in places for j in range(i, i + size)}
    out = {}
    for d, t in texts.items():
        at = [0, *[m.start() for m in re.finditer(r"\S+", t)][1:], len(t)]
        out[d] = "".join(t[at[i]:at[i + 1]] for i in range(len(at) - 1) if (d, i) not in gone) if words[d] else t
    return out


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34", None, "s", 5)], docs.schema)
    docs = docs.unionByName(extra).withColumn("row", F.lit("clash")).withColumn("spans", F.lit(3))
    assert [n for n, _ in c.STAGES] == ["language_id", "near_dedup", "passage_dedup", "decontamination", "encoding"]
    before = docs
    for name, stage in c.STAGES:
        after = stage(spark, before, SF)
        path = scratch_path(spark, name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns[:len(docs.columns)] == docs.columns and (name == "encoding" or len(after.columns) == len(docs.columns))
        if name == "language_id":
            assert after.filter("doc_id > 90000").count() == 0 and after.count() == docs.count() - 2
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, g in slow_groups(rows, 5) if d == g)
        if name == "passage_dedup":
            data = {r["doc_id"]: r["text"] for r in before.collect()}
            want = slow_passages(data, 51)
            assert sum(want[d] != t for d, t in data.items()) > 5
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {d: t for d, t in want.items() if t}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != data[r["doc_id"]])
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {r["doc_id"] for r in before.collect() for n, h, _ in [slow_hits(r["text"], items, 13)] if h and 20 * h >= n}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
        before = after
    assert before.filter(F.size("piece_ids") == 0).count() == 0
