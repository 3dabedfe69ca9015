"""Operators against brute-force versions, round trips and held-out accuracy; edge cases of each."""

import gzip
import hashlib
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import decontaminate, langid, lm_score, media, packing, queries, secret_scan, storage, subwords, suffix_dedup, textkit, url_filter, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "word " * 60_000), (6, "né à l'été 42"), (6, "né à l'été 42"), (None, "no id here"), (7, "tie tie tie"), (8, "tie tie tie")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string")).withColumn("position", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_words_agree_with_a_regular_expression():
    texts = ["Hello, wörld  42!", None, "", "a b", "naïve; x=3 \n", "ÀB-c", "x" * 5000]
    w = textkit.words(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.begin[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower()) for t in texts]
    by_word = defaultdict(set)
    for i, h in enumerate(w.hash.tolist()):
        by_word[bytes(w.data[w.begin[i] : w.end[i]])].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len({h for x in by_word.values() for h in x}) == len(by_word)


def test_slices_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10] * 25 + [None] + ["b" * 1000])})
    parts = list(textkit.slices(batch, limit=64))
    assert sum(p.num_rows for p in parts) == 27 and max(p.num_rows for p in parts) <= 7


def test_subwords_equal_the_model():
    texts = ["Hello wörld, it's 42!", None, "", "a b\nc", "zzqx " * 50]
    e = subwords.encoder()
    ids, at = e.encode(pa.array(texts))
    want = [[x for word in (t or "").split() for x in e.model.encode(word)] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert e.lengths(pa.array(texts)).tolist() == list(map(len, want))


def test_subwords_with_a_crowded_memo(monkeypatch):
    """Words that find no slot, and a memo that begins anew."""
    monkeypatch.setattr(subwords, "MEMO_SLOTS", 16)
    monkeypatch.setattr(subwords, "_SHIFT", np.uint64(60))
    monkeypatch.setattr(subwords, "PROBES", 2)
    monkeypatch.setattr(subwords, "MEMO_WORDS", 40)
    e = subwords.Encoder(subwords.TOKENIZER)
    rng = np.random.default_rng(14)
    for _ in range(20):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 30)) for _ in range(3)]
        ids, at = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[x for word in t.split() for x in e.model.encode(word)] for t in texts]


def test_encoder_words_decoded_together():
    """Words are decoded in one piece, and have the ids that each has by itself: also next to bytes that aren't UTF-8, and to other separators."""
    words = ["cat".encode(), "naïve".encode(), b"\xe4\xb8", b"\xff\xfe", "中文".encode(), b"a\x85b", "x\u2028y\x1cz".encode(), b"\xf0\x9f", "\u2581".encode(), b"cat"]
    e = subwords.Encoder(subwords.TOKENIZER)
    raw = b"\n".join(words[:5]) + b" \t\r\n" + b" ".join(words[5:])
    ids, at = e.encode(pa.array([raw], pa.binary()).view(pa.string()))
    assert ids.tolist() == [x for word in words for x in e.model.encode(word.decode("utf-8", "replace"))] and at.tolist() == [0, len(ids)]


# 1: language-model scores


def slow_score(flat, v, ids):
    """One id at a time, with its window cut out and no batches."""
    w, total = lm_score.split(flat.astype(np.float64)), 0.0
    rows = [lm_score._START, *v.row[ids]]
    soft = lambda s, i: s[i] - s.max() - np.log(np.exp(s - s.max()).sum())
    for t in range(len(ids)):
        k = max(0, -(-(t + 1 - lm_score.WINDOW) // lm_score.STRIDE))
        x = w["e"][rows[k * lm_score.STRIDE : t + 1]]
        n = len(x)
        a = x[-1] @ w["m"] @ x.T + w["r"][n - 1 - np.arange(n)]
        a = np.exp(a - a.max())
        h = x[-1] + (a / a.sum()) @ x @ w["v"]
        kind, place = v.kind[ids[t]], v.place[ids[t]]
        low, high = v.begin[kind], v.begin[kind + 1]
        total += soft(h @ w["c"].T + w["b"], kind) + soft(h @ w["o"][low:high].T + w["u"][low:high], place - low)
    return total


def some_weights(v, rng):
    flat = lm_score.initial(v)
    return flat + rng.standard_normal(len(flat)).astype(np.float32) * 0.2


def test_lm_scores_equal_one_by_one():
    rng = np.random.default_rng(5)
    v = lm_score.Vocabulary.of(rng.integers(0, 50, 5000))
    flat = some_weights(v, rng)
    size = [0, 1, 5, lm_score.WINDOW, lm_score.WINDOW + 1, 150]
    at = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, 5000, at[-1]).astype(np.uint16)
    got = lm_score.score(flat, v, ids, at)
    assert got == pytest.approx([slow_score(flat, v, ids[a:b]) for a, b in zip(at, at[1:])], rel=1e-3, abs=1e-3)
    for stride in (lm_score.STRIDE, lm_score.WINDOW):
        n = sum(np.bincount(text, scored.sum(axis=1), len(size)) for _, _, scored, text in lm_score.blocks(v, ids, at, stride))
        assert n.tolist() == size
    assert np.exp(v.inside[v.begin[3] : v.begin[4]]).sum() == pytest.approx(1, rel=1e-5)


def test_lm_gradient():
    rng = np.random.default_rng(6)
    v = lm_score.Vocabulary.of(rng.integers(0, 50, 5000))
    flat = lm_score.initial(v)
    inputs = rng.integers(0, 50, (4, lm_score.WINDOW)).astype(np.int32)
    kind = rng.integers(0, lm_score.CLASSES, inputs.shape)
    mask = rng.random(inputs.shape) < 0.8
    g, _, _ = lm_score.gradient(lm_score.split(flat), inputs, kind, mask)
    direction, step = np.zeros_like(flat), 1e-2
    direction[: lm_score.SIZE] = g / np.linalg.norm(g)
    up, down = (lm_score.gradient(lm_score.split(flat + s * step * direction), inputs, kind, mask)[1] for s in (1, -1))
    assert (up - down) / (2 * step) == pytest.approx(np.linalg.norm(g), rel=0.02)


def test_lm_gradient_in_parts(monkeypatch):
    """A batch cut into parts has the same gradient, also where masked, with a last part of another size, and with logits beyond the range."""
    rng = np.random.default_rng(16)
    v = lm_score.Vocabulary.of(rng.integers(0, 50, 5000))
    inputs = rng.integers(0, 50, (19, lm_score.WINDOW)).astype(np.int32)
    kind = rng.integers(0, lm_score.CLASSES, inputs.shape)
    mask = rng.random(inputs.shape) < 0.8
    for far in (0, 100):
        w = lm_score.split(some_weights(v, rng))
        w["b"][3] += far
        got = []
        for windows in (19, 8, 1):
            monkeypatch.setattr(lm_score, "PART", windows)
            got.append(lm_score.gradient(w, inputs, kind, mask))
        for g, loss, hidden in got[1:]:
            assert g == pytest.approx(got[0][0], rel=1e-3, abs=1e-6) and loss == pytest.approx(got[0][1], rel=1e-5)
            assert np.allclose(hidden, got[0][2], atol=1e-6)
        logits = np.clip(got[0][2] @ w["c"].T + w["b"], -60, 60).astype(np.float64)
        want = logits[np.arange(len(logits)), kind.ravel()] - np.log(np.exp(logits).sum(axis=1))
        assert lm_score.class_log_probs(w, got[0][2], kind.ravel()) == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_lm_gradient_of_each_weight():
    """Every group of weights has the slope of the loss, with the loss left out as in training too."""
    rng = np.random.default_rng(17)
    v = lm_score.Vocabulary.of(rng.integers(0, 50, 5000))
    flat = some_weights(v, rng)
    inputs = rng.integers(0, 50, (5, lm_score.WINDOW)).astype(np.int32)
    kind = rng.integers(0, lm_score.CLASSES, inputs.shape)
    mask = rng.random(inputs.shape) < 0.8
    hidden = np.empty((*inputs.shape, lm_score.WIDTH), np.float32)
    g, none, same = lm_score.gradient(lm_score.split(flat), inputs, kind, mask, hidden)
    whole = lm_score.gradient(lm_score.split(flat), inputs, kind, mask)
    assert none is None and np.shares_memory(same, hidden) and np.array_equal(g, whole[0]) and np.array_equal(same, whole[2])
    for _, _, a, b in lm_score._SPANS:
        direction, step = np.zeros_like(flat), 1e-2
        direction[a:b] = g[a:b] / np.linalg.norm(g[a:b])
        up, down = (lm_score.gradient(lm_score.split(flat + s * step * direction), inputs, kind, mask)[1] for s in (1, -1))
        assert (up - down) / (2 * step) == pytest.approx(np.linalg.norm(g[a:b]), rel=0.03)


def test_lm_pieces_change_no_result(monkeypatch):
    """Softmaxes within classes are taken in pieces of rows: weights and scores are those of whole ones."""
    rng = np.random.default_rng(18)
    v = lm_score.Vocabulary.of(rng.integers(0, 50, 5000))
    ids = rng.integers(0, 5000, 40_000).astype(np.uint16)
    at, got = np.array([0, 7, 7, 30_000, len(ids)]), []
    for cells in (1 << 30, 1 << 8):
        monkeypatch.setattr(lm_score, "NEAR_CELLS", cells)
        flat, seen = lm_score.train(some_weights(v, np.random.default_rng(19)), v, iter([(ids, at)]))
        got.append((flat, lm_score.score(flat, v, ids, at)))
        assert seen == len(ids)
    assert np.allclose(got[0][0], got[1][0], atol=1e-4) and got[1][1] == pytest.approx(got[0][1], rel=1e-5)


def test_lm_learns_within_classes():
    """Two ids of one class, told apart by the id before them."""
    v = lm_score.Vocabulary.of(np.array([100, 100, 100, 100] + [1] * 60))
    ids = np.random.default_rng(3).permutation(np.repeat([[0, 1], [2, 3]], 2000, axis=0)).ravel().astype(np.uint16)
    flat = lm_score.initial(v)
    before = lm_score.score(flat, v, ids, np.array([0, len(ids)]))[0]
    for _ in range(20):
        flat, seen = lm_score.train(flat, v, iter([(ids, np.array([0, len(ids)]))]))
    assert seen == len(ids) and lm_score.score(flat, v, ids, np.array([0, len(ids)]))[0] > 0.6 * before


def test_lm_beats_frequencies(spark):
    """Per id, better than the frequency of ids in the whole corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score_documents(docs).agg(F.sum("log_prob").alias("lp"), F.sum("n_tokens").alias("n")).collect()[0]
    texts = pa.array([x.text for x in docs.select("text").collect()])
    ids, _ = subwords.encoder().encode(texts)
    counts = np.bincount(ids)
    p = counts[ids] / len(ids)
    assert r.n == len(ids) and -r.lp / r.n < -np.log(p).mean() - 0.2


def test_lm_learns_from_every_document(spark):
    size = subwords.encoder().vocabulary
    for rows in ([(i, "the cat sat on the mat and the dog sat on the cat")] for i in (1, 2, 3, None)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        flat, v = lm_score.fit(lm_score.encoded(docs), size)
        assert not np.array_equal(flat, lm_score.initial(v))
    docs = spark.createDataFrame([(i, f"cat {i} and dog {i}") for i in range(3)], "doc_id long, text string")
    assert lm_score.fit(lm_score.encoded(docs), size) and lm_score.score_documents(docs).where("nll > 0").count() == 3


def test_lm_scores_dont_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(lm_score, "SHARD_IDS", 1 << 14)
    one, eight = ({(r.doc_id, r.n_tokens): r.log_prob / max(r.n_tokens, 1) for r in lm_score.score_documents(docs.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and max(abs(one[k] - eight[k]) for k in one) < 1e-3


def test_lm_edge_cases(odd, empty):
    rows = lm_score.score_documents(odd).collect()
    assert len(rows) == len(ODD) and all((r.n_tokens == 0) == (r.nll is None) for r in rows)
    assert next(r.n_tokens for r in rows if r.doc_id == 5) >= 60_000
    for same in ((7, 8), (6, 6)):
        a, b = (r.log_prob for r in rows if r.doc_id in same)
        assert a == pytest.approx(b, rel=1e-4)
    assert lm_score.score_documents(empty).count() == 0


# 2: decontamination


def test_decontamination_finds_passages(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())) + " "
    held = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in held if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(spark, docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_decontamination_in_several_passes(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 200)
    assert sum(1 for _ in decontaminate._passes(items)) > 2
    assert one and sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect()) == one
    kept = {r.doc_id for r in decontaminate.drop_contaminated(spark, docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r[0] for r in one}


def brute_similarity(a, b):
    grams = lambda w: Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    x, y, weigh = grams(a), grams(b), lambda c: sum(n * sum(len(s.encode()) for s in g) for g, n in c.items())
    return weigh(x & y) / weigh(x | y)


def test_decontamination_of_edited_passages():
    """Windows that line up with an item at an edit rate, against the similarity of all windows, down to the threshold."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    items = [[word() for _ in range(40)] for _ in range(20)]
    index, found, wanted = decontaminate.Index(list(range(20)), [" ".join(i) for i in items]), 0, 0
    for trial in range(240):
        k, rate = trial % 20, rng.choice([0.03, 0.07, 0.1])
        passage = [word() if rng.random() < rate else w for w in items[k]]
        text = [word() for _ in range(100)] + passage + [word() for _ in range(30)]
        best = max(brute_similarity(text[i : i + 40], items[k]) for i in range(len(text) - 39))
        got = {i for _, i, _, _, _ in index.matches(pa.array([" ".join(text)]))}
        if best >= decontaminate.THRESHOLD:
            wanted += 1
            found += k in got
        assert got <= {k}
    assert wanted > 150 and found >= 0.99 * wanted


def test_hamming_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    index = decontaminate.Index(list(range(60)), [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(60)])
    near = index.prints[rng.integers(0, 60, 200)].copy()
    for i in range(200):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*(x.tolist() for x in index.within(near))))
    assert got == {(i, j) for i in range(200) for j in range(60) if int(near[i] ^ index.prints[j]).bit_count() <= decontaminate.RADIUS}


def test_decontamination_edge_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "tie tie"), (4, "tie tie tie"), (4, "tie tie tie"), (None, "one")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(odd, items).collect()} == {7, 8}
    unnamed = spark.createDataFrame([(None, "tie tie tie")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, unnamed).collect()} == {(7, None), (8, None)}
    assert decontaminate.drop_contaminated(spark, odd, unnamed).count() == len(ODD) - 2
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long + " the quick brown fox jumps over it " + long)], "doc_id long, text string")
    assert [r.first_word for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, "the quick brown fox jumps over it")], "item_id long, text string")).collect()] == [100_000]
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.drop_contaminated(spark, odd, items).count() == len(ODD) - 2


# 3: language ID


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    r = langid.identify(test, langid.fit_on(train)).join(test.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("kept")).collect()[0]
    assert r.right > 0.98 and r.kept > 0.99


def test_language_kernel_equals_sets():
    texts = ["the cat sat on the mat and the dog", "der hund und die katze sitzen auf", "the dog and the cat"]
    model = langid.fit(texts[:2], ["en", "de"])
    data, at = textkit.buffers(pa.array(texts))
    seen, _ = model.presence(data, at)
    kernel = seen.astype(np.float32) @ model.landmarks / np.sqrt(seen.sum(axis=1, keepdims=True))
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = {langid.fit(texts[:2], ["en", "de"]).languages[k]: grams(texts[1 - k]) for k in (0, 1)}
    known = marks["de"] | marks["en"]
    for i, t in enumerate(texts):
        mine = grams(t) & known
        assert kernel[i] == pytest.approx([len(mine & marks[k]) / np.sqrt(len(mine) * len(marks[k])) for k in ("de", "en")], rel=1e-5)


def test_language_sample_of_equal_rows(spark):
    """Rows of one id and text lie on one hash, whatever the language's size."""
    rows = [(None, "le chat et le chien sont dans la maison", "fr")] * 2000 + [(i, f"the cat and the dog number {i} are in the house", "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_on(docs).languages == ["en", "fr"]


def test_language_edge_cases(spark, odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and not any(r.accepted for r in rows)
    model = langid.fit(["the cat and the dog", "le chat et le chien"], ["en", "fr"])
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[1].language is None and not got[2].accepted and not got[3].accepted and got[5].language in ("en", "fr")
    assert langid.identify(empty).count() == 0 and langid.keep_identified(spark, empty).count() == 0


FOREIGN = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
}


def test_languages_without_labels_are_rejected():
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist() if r["text"].strip()]
    train, held = [r for r in rows if r["doc_id"] % 2 == 0], [r for r in rows if r["doc_id"] % 2]
    accepted = lambda model, texts: langid.classify(model, pa.array(texts))[3]
    model = langid.fit([r["text"] for r in train], [r["lang"] for r in train])
    assert not accepted(model, list(FOREIGN.values())).any() and accepted(model, [r["text"] for r in held]).mean() > 0.99
    for unseen in model.languages:
        others = [r for r in train if r["lang"] != unseen]
        part = langid.fit([r["text"] for r in others], [r["lang"] for r in others])
        assert accepted(part, [r["text"] for r in held if r["lang"] == unseen]).mean() < 0.2
        assert accepted(part, [r["text"] for r in held if r["lang"] != unseen]).mean() > 0.99
    for few in (["en"], ["de", "es"]):
        part = langid.fit([r["text"] for r in train if r["lang"] in few], [r["lang"] for r in train if r["lang"] in few])
        assert accepted(part, [r["text"] for r in held if r["lang"] in few]).mean() > 0.95
        assert not accepted(part, list(FOREIGN.values())).any()


# 4: URL filters


def test_url_hits():
    machine = url_filter.automaton()
    hit = lambda u: url_filter.hits(machine, u)[:2]
    assert hit("http://www.CASINO-win.com/a") == (["casino"], ["win"])
    assert hit("http://mycasinos.com/windows") == ([], [])
    assert hit("http://a.com/free/bets?bet=1") == ([], ["bet", "bets", "free"])
    assert hit("") == ([], [])
    assert hit("http://a.com/%63asino%2Dwin") == (["casino"], ["win"]) and hit("http://a.com/%ff%") == ([], [])
    assert hit("http://a.com/payday-loans") == (["payday-loans"], ["loans"])
    rejects = lambda u: url_filter.rejects(*hit(u), url_filter.SOFT)
    assert rejects("http://casino.example") and rejects("http://a.com/bet/bonus")
    assert not rejects("http://a.com/bet") and not rejects("http://a.com/free/download")


def test_url_vocabulary_of_a_table(spark, monkeypatch):
    rows = [("Foo", True, 0.7), ("foo", False, 0.1), ("bar", False, None), (" baz", None, 0.2), (None, True, 1.0), ("", True, 1.0)]
    table = spark.createDataFrame(rows, "term string, strict boolean, weight double")
    strict, soft = url_filter.vocabulary(table)
    assert (strict, soft) == ({"foo": 0.7}, {"bar": 1.0, "baz": 0.2})
    pages = spark.createDataFrame([(1, "http://x/foo"), (2, "http://x/bar/baz"), (3, "http://x/baz")], "page_id long, url string")
    assert sorted((r.page_id, r.rejected) for r in url_filter.judge(pages, strict=strict, soft=soft).collect()) == [(1, True), (2, True), (3, False)]
    monkeypatch.setattr(url_filter, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        url_filter.vocabulary(table)


def test_url_edge_cases(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://casino"), (3, "http://casino"), (None, "http://free-bets/" + "x" * 100_000)], "page_id long, url string").withColumn("weight", F.lit("clash"))
    got = sorted((r.page_id or 0, r.rejected) for r in url_filter.judge(pages).collect())
    assert got == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert url_filter.judge(pages.limit(0)).count() == 0


# 5: media columns


def test_sequence_order_captions_and_sources():
    page = (
        "<head><title>no</title></head><body><!-- x --><p>One <b>bold</b> &amp; more<br>line</p><figure><img src='/a.png' alt=A><img data-src=b.png>"
        "<figcaption>Both <i>of</i> them</figcaption></figure><script>var t='<p>';</script><video><source src='v.mp4'></video><p>Two<img src='data:text/plain;base64,aGk='>Three<img alt=none></body>"
    )
    got = [(x["position"], x["kind"], x.get("text") or x.get("src"), x.get("caption")) for x in media.sequence(page, "http://h/d/p.html")]
    assert got == [
        (0, "text", "One bold & more", None), (1, "text", "line", None), (2, "image", "http://h/a.png", "Both of them"), (3, "image", "http://h/d/b.png", "Both of them"),
        (4, "video", "http://h/d/v.mp4", None), (5, "text", "Two", None), (6, "image", "data:text/plain;base64,aGk=", None), (7, "text", "Three", None),
    ]
    assert media.digest("data:text/plain;base64,aGk=") == hashlib.sha256(b"hi").hexdigest() and media.digest("http://h/a") == hashlib.sha256(b"http://h/a").hexdigest()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><p>Hello</p><img src=a.png>", ["Hello", "a.png"]),
        ("<head><meta charset=x><p>Hello", ["Hello"]),
        ("<img src='data:image/gif;base64,R0lGOD' data-src=real.png>", ["real.png"]),
        ("<img srcset='s.png 320w, l.png 640w, m.png 480w'>", ["l.png"]),
        ("<picture><source srcset='w.webp 1x'><img alt=x></picture>", ["w.webp"]),
        ("<picture><source srcset='w.webp'><img src=f.jpg></picture>", ["f.jpg"]),
        ("<img data-src=a.png><noscript><img src=a.png></noscript><noscript><img src=b.png></noscript>", ["a.png", "b.png"]),
        ("<svg><title>no</title><text>no</text><image href=i.png><p>out", ["i.png", "out"]),
        ("<base href='http://b/c/'><img src=d.png>", ["http://b/c/d.png"]),
        ("a<!-- <p>b --><!-->c<script>'</p>'</script>d<p <img src=x.png>e", ["acd", "e"]),
        ("1 < 2 &lt; 3<p title='>'>x</p><a href=\"unclosed", ["1 < 2 < 3", "x"]),
        ("<object data=o.swf><p>instead</p></object><iframe src=f.html>no</iframe><input type=image src=i.png>", ["o.swf", "instead", "f.html", "i.png"]),
    ],
)
def test_markup_as_browsers_read_it(page, want):
    assert [x.get("text") or x["src"] for x in media.sequence(page, None)] == want


class Parsed(HTMLParser):
    """Text and image addresses of a page, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.sources, self.hidden = [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        if tag == "img" and dict(attrs).get("src"):
            self.sources.append(dict(attrs)["src"].strip())

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_sequences_equal_the_standard_parser_on_random_pages():
    rng = np.random.default_rng(13)
    pieces = ["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<li>", "<br/>", "<hr>", " word ", "&amp; x", "&eacute;", "&#33;", "<!-- <p>no</p> -->", "<td x=1>", "<script>if (a<b) '</p>';</script>", "<style>p{}</style>", "</nothing>", "<a href=\"x>y\">", "<P ID=q>", "<custom-tag>"]
    for trial in range(300):
        chosen = [pieces[k] if k < len(pieces) else f"<img {'alt=z ' * int(rng.integers(2))}src={q}i{trial}-{n}.png{q}{' ' if not q else ''}>" for n, (k, q) in enumerate(zip(rng.integers(0, len(pieces) + 4, 40), rng.choice(["'", '"', ""], 40)))]
        page = "<!DOCTYPE html><html><head><title>t &lt;b></title><meta charset=x>" + "</head><body>" * int(rng.integers(2)) + "".join(chosen)
        got, want = media.sequence(page, None), Parsed(page)
        squeeze = lambda parts: "".join("".join(parts).split())
        assert squeeze(x["text"] for x in got if x["kind"] == "text") == squeeze(want.text), page
        assert [x["src"] for x in got if x["kind"] == "image"] == want.sources, page


def test_long_and_broken_pages_take_time_in_proportion():
    for piece in ("<", "<a ", "<a b='", "<!--", "<p title=\"", "<svg>", "</", "<script>", "<figure>", "&amp", "<img src=x>"):
        begun = time.process_time()
        media.sequence(piece * 60_000, "http://h/")
        assert time.process_time() - begun < 8, piece


def test_media_payloads_stay_aligned(spark):
    place = lambda k: f"http://h/{k}.png"
    rows = [(1, "http://h/", f"<p>a</p><img src={place(1)}><p>b</p><img src={place(2)}><img src={place(1)}>"), (2, None, None), (3, None, ""), (4, "http://h/", "<p><b>broken <figure><img src=1.png>"), (4, "http://h/", "<p><b>broken <figure><img src=1.png>"), (None, "http://h/", "<img src=1.png>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    stored = spark.createDataFrame([(hashlib.sha256(place(1).encode()).hexdigest(), b"z", "m"), (hashlib.sha256(place(1).encode()).hexdigest(), b"y", "m"), (None, b"n", "m")], "digest string, payload binary, mime string")
    got = media.interleaved(pages, stored).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.page_id == 1)
    assert [(x.kind, bytes(x.payload) if x.payload else None) for x in one["items"]] == [("text", None), ("image", b"y"), ("text", None), ("image", None), ("image", b"y")]
    assert [r.n_resolved for r in got if r.page_id == 4] == [1, 1] and [r.n_resolved for r in got if r.page_id is None] == [1]
    assert media.interleaved(pages.limit(0), stored).count() == 0


def test_media_of_the_tables_equal_a_lookup(spark):
    """The query against the kernel and a dictionary of payloads."""
    got = {r.page_id: r for r in queries.op5_media_columns(spark, SF).collect()}
    place = lambda k: f"https://media.example.org/{k}.bin"
    stored = {hashlib.sha256(place(r.vec_id).encode()).hexdigest() for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        mine = got[p.page_id]
        keys = [] if p.page_id % 3 == 0 else [p.page_id] if p.page_id % 3 == 1 else [p.page_id, p.page_id * 7]
        want = [(place(k), f"Vector {k}", hashlib.sha256(place(k).encode()).hexdigest() in stored) for k in keys]
        assert [(x.src, x.caption, x.payload is not None) for x in mine["items"] if x.kind == "image"] == want
        plain = [x["text"] for x in media.sequence(p.html, p.url)]
        assert [x.text for x in mine["items"] if x.kind == "text"] == plain and mine.n_text == len(plain) and mine.n_resolved == sum(w[2] for w in want)


# 6: repeated passages


def brute_passages(rows, n=suffix_dedup.MIN_WORDS):
    where = defaultdict(set)
    words = [(d, re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())) for d, t in rows if d is not None]
    for d, w in words:
        for p in range(len(w) - n + 1):
            where[tuple(w[p : p + n])].add((d, p))
    return {x for hits in where.values() if len({d for d, _ in hits}) > 1 for x in hits}


def test_repeated_passages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    starts = brute_passages([tuple(r) for r in docs.collect()])
    covered = {(d, q) for d, p in starts for q in range(p, p + suffix_dedup.MIN_WORDS)}
    got = suffix_dedup.repeated_passages(docs).collect()
    assert covered and covered == {(r.doc_id, q) for r in got for q in range(r.first_word, r.first_word + r.n_words)}


def test_repeated_passages_edge_cases(spark, odd, empty):
    assert suffix_dedup.repeated_passages(odd).count() == 0 and suffix_dedup.repeated_passages(empty).count() == 0
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a b " + passage), (2, passage + " c"), (3, " ".join(passage.split()[:49])), (4, passage.upper() + " " + passage), (None, passage)], "doc_id long, text string").withColumn("position", F.lit("x"))
    got = sorted(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect())
    assert got == [(1, 2, 60), (2, 0, 60), (4, 0, 120)]


def test_repeated_passages_of_rows_that_share_an_id(spark):
    passage, filler = " ".join(f"w{i}" for i in range(60)), " ".join(f"f{i}" for i in range(200))
    docs = spark.createDataFrame([(1, filler + " " + passage), (1, "short text"), (1, None), (2, passage)], "doc_id long, text string")
    assert sorted(tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()) == [(1, 200, 60), (2, 0, 60)]


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_refinements_reach_any_depth(rows):
    """Kernels alone, over batches of any size: buckets after each refinement against the words themselves."""
    rng = np.random.default_rng(9)
    docs = {d: rng.integers(0, 2, 300) for d in range(3)}
    docs[2][50:200] = docs[0][100:250]
    at = [(d, p) for d in docs for p in range(len(docs[d]) - 3)]
    grams = {(d, p): int("".join(map(str, docs[d][p : p + 4])), 2) for d, p in at}
    depth, goal = 4, 30
    assert suffix_dedup.steps(depth, goal) == [4, 8, 14] and len(suffix_dedup.steps()) == 2
    buckets = sorted((d, p, grams[d, p]) for d, p in at)

    def cut(columns, names):
        table = [np.array(c, np.int64) for c in zip(*columns)] if columns else [np.zeros(0, np.int64)] * len(names)
        return (pa.RecordBatch.from_arrays([pa.array(c[k : k + rows]) for c in table], names=names) for k in range(0, len(table[0]), rows))

    for step in suffix_dedup.steps(depth, goal):
        pairs = [tuple(r.values()) for b in suffix_dedup.pointed(cut(buckets, ["doc_id", "position", "bucket"]), step) for r in b.to_pylist()]
        have = {(d, p): b for d, p, b in buckets}
        # What stands near the end of the last text can't be looked up, and needn't be.
        assert {(d, p): (b1, b2) for b1, b2, d, p in pairs} == {(d, p): (b, have[d, p + step]) for (d, p), b in have.items() if (d, p + step) in have}
        depth += step
        got = [tuple(r.values()) for b in suffix_dedup.refined(cut(sorted(pairs, key=lambda x: x[:3]), ["b1", "b2", "doc_id", "position"])) for r in b.to_pylist()]
        same = defaultdict(set)
        for _, _, d, p in pairs:
            same[tuple(docs[d][p : p + depth])].add((d, p))
        want = {frozenset(x) for x in same.values() if len({d for d, _ in x}) > 1}
        by_bucket = defaultdict(set)
        for d, p, b in got:
            by_bucket[b].add((d, p))
        assert {frozenset(x) for x in by_bucket.values()} == want and want
        buckets = sorted(got)


def test_a_passage_in_many_documents(spark):
    """One bucket of thousands of suffixes, and passages that differ in their last word only."""
    passage = " ".join(f"w{i}" for i in range(50))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} b', id) AS text")
    docs = docs.unionByName(spark.range(3000, 3010).selectExpr("id AS doc_id", f"concat('{passage[:-3]} x', id) AS text"))
    got = suffix_dedup.repeated_passages(docs).collect()
    assert {tuple(r) for r in got} == {(i, 1, 50) for i in range(3000)}


# 7: WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 300_000), (2, None, "é\r\n\r\nWARC/1.1"), (3, "http://b", None), (3, "http://b", None), (4, "", "")], "page_id long, url string, html string").withColumn("md5", F.lit(1))
    got = sorted((r.page_id, r.url or "", r.n_bytes, r.md5) for r in warc.round_trip(pages).collect())
    want = sorted((r.page_id, r.url or "", len((r.html or "").encode()), hashlib.md5((r.html or "").encode()).hexdigest()) for r in pages.collect())
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_members_and_broken_files(spark, tmp_path):
    parts = [warc.record(f"http://{i}", f"urn:{i}", bytes([65 + i]) * (10 + i)) for i in range(5)]
    whole = b"".join(parts)
    cases = {"mono": gzip.compress(whole), "members": b"".join(map(gzip.compress, parts)), "short": gzip.compress(whole[:-40]), "cut": gzip.compress(whole)[:-30], "empty": b"", "junk": gzip.compress(b"hello\r\n\r\n")}
    for name, data in cases.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    (tmp_path / "out").mkdir()
    for name in cases:
        rows = warc.normalise_file(str(tmp_path / f"{name}.warc.gz"), str(tmp_path / "out"))
        ok = [r for r in rows if r["status"] == "ok"]
        assert {"mono": 5, "members": 5, "short": 4, "empty": 0, "junk": 0}.get(name, len(ok)) == len(ok)
        if name in ("short", "junk"):
            assert rows[-1]["status"] == {"short": "truncated", "junk": "malformed"}[name]
        for i, r in enumerate(ok):
            raw = open(r["path"], "rb").read()
            assert gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]) == parts[i]


def test_warc_goes_on_after_a_malformed_record(spark, tmp_path):
    good = [warc.record(f"http://{i}", f"urn:{i}", bytes([65 + i]) * 50) for i in range(4)]
    bad = [good[1].replace(b"Content-Length: 50", b"Content-Length: x"), good[1].replace(b"Content-Length: 50", b"Content-Length: -5"), b"junk line\r\n\r\nmore junk\r\n" * 100_000]
    (tmp_path / "out").mkdir()
    for k, middle in enumerate(bad):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(good[0] + middle + good[2] + good[3]))
        rows = warc.normalise_file(str(tmp_path / f"{k}.warc.gz"), str(tmp_path / "out"))
        assert [(r["status"], r["uri"]) for r in rows if r["status"] == "ok"] == [("ok", "http://0"), ("ok", "http://2"), ("ok", "http://3")]
        assert [r["status"] for r in rows] == ["ok", "malformed", "ok", "ok"]
    index = warc.normalise(spark, [str(tmp_path / f"{k}.warc.gz") for k in range(3)], str(tmp_path / "out"))
    assert index.where("status = 'ok'").count() == 9 and warc.read_records(index).count() == 9


# 8: packing


def test_nnls_satisfies_the_optimality_conditions():
    rng = np.random.default_rng(10)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.standard_normal(12)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g >= -1e-6).all() and abs(g @ x) < 1e-6


def best_fit(histogram):
    """Sequences that best-fit decreasing opens, one length at a time."""
    rooms, opened = Counter(), 0
    for length in range(len(histogram), 0, -1):
        for _ in range(histogram[length - 1]):
            room = next((r for r in range(length, len(histogram)) if rooms[r]), None)
            if room is None:
                opened += 1
                room = len(histogram)
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return opened


def test_plan_places_every_length_once():
    rng = np.random.default_rng(11)
    for scale in (1, 5, 3000):
        histogram = rng.integers(0, scale + 1, 32)
        used = Counter()
        total = 0
        for shape, times in packing.plan(histogram):
            assert times > 0 and sum(shape) <= 32
            total += times
            for s in shape:
                used[s] += times
        assert [used[k + 1] for k in range(32)] == histogram.tolist()
        assert total <= 1.01 * best_fit(histogram) + 1


@pytest.mark.parametrize("pieces_a_shard", [packing.SHARD_PIECES, 3])
def test_packs_hold_every_piece_once(spark, odd, empty, monkeypatch, pieces_a_shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", pieces_a_shard)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packs = packing.pack(docs).collect()
    sizes = dict(zip([r.doc_id for r in docs.collect()], subwords.encoder().lengths(pa.array([r.text for r in docs.collect()])).tolist()))
    held = Counter()
    for p in packs:
        assert p.n_tokens == sum(p.lengths) and sum(-(-n // packing.GRAIN) for n in p.lengths) <= packing.SEQUENCE // packing.GRAIN
        for d, piece, n in zip(p.doc_ids, p.pieces, p.lengths):
            held[d, piece] += 1
            assert n == min(packing.SEQUENCE, sizes[d] - piece * packing.SEQUENCE)
    assert set(held.values()) == {1} and {d for d, _ in held} == {d for d, n in sizes.items() if n}
    assert len(packs) == len({p.pack_id for p in packs})
    odd_ids = Counter(d for p in packing.pack(odd).collect() for d in p.doc_ids)
    assert odd_ids[1] == odd_ids[2] == odd_ids[3] == 0 and odd_ids[6] == 2 and odd_ids[None] == 1 and odd_ids[5] > 10
    assert packing.pack(empty).count() == 0


# 10: secrets


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ('password = "hunter2A9x"', ["hunter2A9x"]),
        ("API_KEY: 'abc123def456ghi7'", ["abc123def456ghi7"]),
        ('BASE = "sk9ab8f7"\nsecret_token = BASE + "x81q"', ["sk9ab8f7", "x81q"]),
        ('a = "x9y8z7w6"\nb = a\npassword = b', ["x9y8z7w6"]),
        ('{"client_secret": "Zx81-aab2-cc", "n": 3}', ["Zx81-aab2-cc"]),
        ("export DB_PASSWORD=s3cr3t-P4ss", ["s3cr3t-P4ss"]),
        ('cfg["password"] = "q9w8e7r6"', ["q9w8e7r6"]),
        ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]),
        ("password: must be long", []),
        ('token_count = "1234567"', []),
        ('password = "changeme"', []),
        ('password = os.getenv("PASSWORD")', []),
        ("if password == 'abc123def': pass", []),
        ("The key: a good night's sleep. Its token = of love", []),
        ('colour = "9233A8ECF7C5B09FE5949719"', []),
        ('password = ("hunter2"  # first\n  "A9x81")', ["hunter2", "A9x81"]),
        ('password = """hunter2A9x"""', ["hunter2A9x"]),
        ("db:\n  password: |\n    hunter2A9x\n    zz81\n  user: bob", ["hunter2A9x", "zz81"]),
        ("<config><password>hunter2A9x</password></config>", ["hunter2A9x"]),
        ('<add key="password" value="hunter2A9x"/>', ["hunter2A9x"]),
        ('pw = os.environ.get("DB_PASSWORD", "hunter2A9x")', ["hunter2A9x"]),
        ("define('DB_PASSWORD', 'hunter2A9x');", ["hunter2A9x"]),
        ('#define API_KEY "hunter2A9x"', ["hunter2A9x"]),
        ('const apiKey: string = "hunter2A9x";', ["hunter2A9x"]),
        ('var password string = "hunter2A9x"', ["hunter2A9x"]),
        ('char password[] = "hunter2A9x";', ["hunter2A9x"]),
        ('A = "hun"\nA += "ter2A9x"\npassword = A', ["hun", "ter2A9x"]),
        ('password = process.env.PW || "hunter2A9x"', ["hunter2A9x"]),
        ('BASE=hun7er2A\nexport PASSWORD="${BASE}x81q"', ["hun7er2A", "x81q"]),
        ('b = "x9"\npassword = f"ab{b}cd77Zz"', ["x9", "ab", "cd77Zz"]),
        ('password = SecretStr("hunter2A9x")', ["hunter2A9x"]),
        ('passwords = ["hunter2A9x", "zz81kk29"]', ["hunter2A9x", "zz81kk29"]),
        ('$password = "hunter2" . "A9x";', ["hunter2", "A9x"]),
        ("don't. password = \"hunter2A9x\" it's", ["hunter2A9x"]),
        ("my_" * 200 + 'password = "hunter2A9x"', ["hunter2A9x"]),
        ('password = get_password("hunter2A9x")', []),
    ],
)
def test_secret_literals(text, literals):
    assert [text[a:b] for _, a, b, _ in secret_scan.findings(text)] == literals
    assert secret_scan._candidates(pa.array([text])) == [0] or not literals


@pytest.mark.parametrize("lead", [10, 3000, 30_000, 2_000_000])
def test_secrets_anywhere_in_a_text_and_in_a_value(lead):
    """Far behind a text's beginning, and in the middle of a long value."""
    line, key = "# a line of text\n", "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----\n"
    before, after = line * (lead // len(line) + 1), line * 400
    text = before + 'password = "hunter2A9x"\n' + before
    assert [text[a:b] for _, a, b, _ in secret_scan.findings(text)] == ["hunter2A9x"]
    long = before + key + after
    assert [b - a for _, a, b, _ in secret_scan.findings(f'private_key = """{long}"""\n')] == [len(long)]
    assert len(secret_scan.findings(f'x = """{before}-----BEGIN RSA PRI"""\nprivate_key = x + """VATE KEY-----\n{after}"""\n')) == 2
    assert not secret_scan.findings(f'private_key = """{before}{after}"""\n')
    ends = "x" * 3000
    mixed = ends + "Ab9k" * max(lead, 3000) + ends
    assert [b - a for _, a, b, _ in secret_scan.findings(f'secret_key = "{mixed}"')] == [len(mixed)]
    assert not secret_scan.findings(f'secret_key = "{ends * 2}"') and not secret_scan.findings(f'secret_key = "${"A" * lead}"')


def test_secrets_of_many_lines_take_time_in_proportion():
    lines = ["x = x + x\n", "password = password + 'abc1'\n", "password = x /* ", 'password = ("a" + ', "key: str[", "key='", '"key":', "a=(\n#", 'f("key", ']
    for line in lines:
        begun = time.process_time()
        secret_scan.findings('x = "a8Fk29dk"\npassword = "a8Fk29dk"\n' + line * 10_000 + "\npassword = x\n")
        assert time.process_time() - begun < 5, line
    assert len(secret_scan.findings('x = "a8Fk29dk"\n' + "x = x + x\n" * 10_000 + "password = x")) == 1


def test_constants_equal_a_brute_force_evaluator():
    """Random programs of sums and extensions, against one that joins the strings."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        held, lines, want, at = {}, [], {}, 0
        for k in range(12):
            name = ["a", "b", "c", "password", "api_token"][rng.integers(5)]
            terms, value, shown = [], [], []
            line_at = at + len(name)
            extends = name in held and rng.random() < 0.3
            op = " += " if extends else " = "
            place = line_at + len(op)
            for _ in range(rng.integers(1, 4)):
                if held and rng.random() < 0.4:
                    other = list(held)[rng.integers(len(held))]
                    shown.append(other)
                    value += held[other]
                    place += len(other) + 3
                else:
                    literal = "".join(rng.choice(list("abcXYZ0123456789"), rng.integers(1, 9)))
                    shown.append(f'"{literal}"')
                    value.append((literal, place + 1, place + 1 + len(literal)))
                    place += len(literal) + 5
            if extends:
                value = held[name] + value
            held[name] = value
            line = f"{name}{op}{' + '.join(shown)}\n"
            lines.append(line)
            at += len(line)
            score = secret_scan.name_score(name) * secret_scan.Value.of("".join(v for v, _, _ in value)).score()
            if score >= secret_scan.THRESHOLD:
                for _, a, b in value:
                    want[a, b] = max(want.get((a, b), 0.0), score)
        got = secret_scan.findings("".join(lines))
        assert [(a, b) for _, a, b, _ in got] == sorted(want) and [x[3] for x in got] == pytest.approx([want[k] for k in sorted(want)])


def test_secrets_survive_the_prefilter(spark):
    names = ["$secret->value", "password->plain", "secretÄ", "пароль_token", "Auth::a::b::c", "connectionString", "cfg.keys.first-one", *secret_scan._SENSITIVE, *("_".join(p).upper() for p in secret_scan._PAIRS), *(w + "s" for w in secret_scan._SENSITIVE)]
    texts = [None, *(f'{n}{op}"a8Fk29dkQ0zz{k}"' for k, n in enumerate(names) for op in (" = ", ": ", " => ", " := ", "="))]
    want = [i for i, t in enumerate(texts) if t and secret_scan.findings(t)]
    assert len(want) > 0.8 * len(texts) and set(want) <= set(secret_scan._candidates(pa.array(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in secret_scan.scan(docs).collect()) == want
    masked = {r.doc_id for r in secret_scan.redact(spark, docs).collect() if secret_scan.MASK in (r.text or "")}
    assert masked == set(want)


def test_secrets_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = Counter(r.doc_id for r in docs.collect() for _ in re.findall(r'(?i)token = "[0-9a-f]{40}"', r.text))
    assert want and Counter(r.doc_id for r in secret_scan.scan(docs).collect()) == want
    clean = secret_scan.redact(spark, docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and secret_scan.scan(clean).count() == 0
    assert clean.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_secret_edge_cases(spark, odd, empty):
    assert secret_scan.scan(odd).count() == 0 and secret_scan.scan(empty).count() == 0
    assert secret_scan.redact(spark, odd).count() == len(ODD)
    long = "x = y " * 100_000 + 'password = "hunter2A9x"'
    docs = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string").withColumn("name", F.lit("clash"))
    assert [r.begin for r in secret_scan.scan(docs).collect()] == [len(long) - 11] * 3


def test_work_tables_need_a_shared_folder_on_a_cluster(spark):
    assert storage.shared_dir(spark)
    assert [storage.one_machine(m) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,1024]", "spark://h:7077", "yarn")] == [True] * 3 + [False] * 3


def test_tables_are_there():
    assert pq.read_metadata(f"{SF}/documents.parquet").num_rows
