import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
from surveyspark.llm import jaccard_join, katz, language_id, mixing, pii, sentencepiece_codec, training_order

SMOKE = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def typed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def given(ready):
    return ready.read.parquet(f"{SMOKE}/documents.parquet")


# ---- language

def test_language_held_out_accuracy(given):
    found = language_id.predict(given.select("doc_id", "lang", language_id.held_out().alias("held"), "text"), language_id.learn(given)).collect()
    held = [r for r in found if r["held"]]
    assert held and all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in found)


def test_code_length_equals_plain_ppm():
    langs = {"a": "abracadabra abra", "b": "xyzzy plugh xyz"}

    def coded(texts):
        codes, _ = language_id.byte_codes(pa.array(texts))
        return np.unique(codes, return_counts=True)

    trees = language_id.Trees(list(langs), [coded([t]) for t in langs.values()])
    for text in ("abra xyz", "é", "", "zzz" * 9):
        for j, seen in enumerate(langs.values()):
            data, learned, bits = b"\n" * 3 + text.encode(), b"\n" * 3 + seen.encode(), 0.0
            for i in range(3, len(data)):
                for k in range(3, -1, -1):
                    at = [m for m in range(3, len(learned)) if learned[m - k:m] == data[i - k:i]]
                    after = [learned[m] for m in at]
                    if not after:
                        continue
                    hit, whole = after.count(data[i]), len(after) + len(set(after))
                    bits -= np.log2((hit or len(set(after))) / whole)
                    if hit:
                        break
                else:
                    bits += 8
            assert abs(trees.code_lengths(pa.array([text]))[0, j] - bits) < 1e-9


def test_language_of_odd_rows(odd_docs, no_docs):
    found = language_id.predict(odd_docs, language_id.learn(odd_docs)).collect()
    assert len(found) == odd_docs.count() and set(odd_docs.columns) <= set(found[0].asDict())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if not re.search(r"[^\W\d_]", r["text"] or ""))
    none = language_id.predict(odd_docs, language_id.learn(no_docs)).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and language_id.keep_known(no_docs).count() == 0
    kept = language_id.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns and {r["score"] for r in kept.collect()} == {"kept"}


# ---- near copies

def test_join_equals_brute_force(given):
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(given).collect())
    assert got == sorted(brute.jaccard(pairs(given)))


def test_join_of_large_groups_is_whole(ready, monkeypatch):
    """Many copies and near copies of one text, cut into blocks: no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(40)]
    for i in range(40, 140):
        w = list(words)
        w[int(rng.integers(60))] = f"n{i % 30}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(rng.permutation(words))) for i in range(140, 170)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(typed(ready, rows)).collect())
    assert got == sorted(brute.jaccard(rows))


def test_bands_reach_the_target():
    bands, rows = jaccard_join.choose_bands(0.8)
    assert bands * rows <= jaccard_join.MAX_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= jaccard_join.TARGET_RECALL


def test_intersections_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 80, 30)).astype(np.uint64) for _ in range(50)]
    want = np.triu([[len(set(a) & set(b)) for b in sets] for a in sets], 1)
    for dense in (2, 8, 1000):
        monkeypatch.setattr(jaccard_join, "DENSE", dense)
        got = jaccard_join._intersections(np.concatenate(sets), np.repeat(np.arange(50), [len(x) for x in sets]), 50)
        assert (got == want).all()


def test_join_of_odd_rows(odd_docs, no_docs):
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(odd_docs).collect()), key=key)
    assert got == sorted(brute.jaccard(pairs(odd_docs)), key=key)
    assert jaccard_join.jaccard_join(no_docs).count() == 0
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]


def test_unrelated_texts_under_one_id_stay(ready):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (8, ""), (8, a + " more")]
    found = [(r["doc_id"], r["class_id"]) for r in jaccard_join.jaccard_join(typed(ready, rows)).collect()]
    assert len(found) == 7 and len({c for _, c in found}) == 4
    kept = jaccard_join.keep_one(typed(ready, rows))
    assert sorted(pairs(kept)) == [(3, b), (5, a), (7, c), (8, "")]
    both = jaccard_join.jaccard_join(typed(ready, [(5, a), (5, b)])).collect()
    assert len({r["class_id"] for r in both}) == 2
    assert sorted(pairs(jaccard_join.keep_one(typed(ready, [(5, a), (5, b)])))) == [(5, a), (5, b)]


# ---- personal data

def test_base_spans_equal_brute_force(ready, given):
    tricky = ["a@b.c_d@e.f g@h", "1.2.3.4.5 256.1.1.1 01.002.0003.4 x1.1.1.1", "4111 1111 1111 1111-", "4111-1111-1111-1111 2",
              "+1 (212) 555-0153..+1+22 333 444 5555(", "é 🎉 mail é@x.y ñ.a@b-c.d.", "1" * 9000, "+" * 500 + "1" * 12, None, "",
              "4111111111111111 4111111111111112", "a" * 50_000 + "@", "12 34-56 78 90 12 34 56", "5 - 5  55"]
    rows = [(i, t) for i, t in enumerate(tricky)] + [(1000 + i, t) for i, t in pairs(given)]
    got = {r["doc_id"]: r for r in pii.report(typed(ready, rows)).collect()}
    for i, t in rows:
        want = brute.base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("term")] == want
        assert got[i]["n_email"] == sum(s.startswith("email") for s in want)


def test_disclosing_terms_go_and_others_stay(ready):
    common = "the quick brown fox jumps over lazy dogs while many other people walk home".split()
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(common, n))
    rows = [(i, f"{say(9)} zorblax {say(3)} joe{0}@mail.example {say(9)}") for i in range(8)]
    rows += [(100 + i, f"{say(30)} zorblax" if i == 0 else say(30)) for i in range(300)]
    docs = typed(ready, rows).selectExpr("*", "length(text) as n_chars", "'x' as base", "'y' as key")
    spans = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i in range(8):
        found = {rows[i][1][int(a):int(b)] for k, a, b in (s.split(":") for s in spans[i]["spans"].split(",")) if k == "term"}
        assert found == {"zorblax"}
    out = {r["doc_id"]: r for r in pii.sanitise_stage(docs).collect()}
    assert len(out) == len(rows) and out[0]["base"] == "x" and out[0]["key"] == "y"
    assert "joe0" not in out[0]["text"] and "[EMAIL]" in out[0]["text"] and "zorblax" not in out[0]["text"]
    assert out[0]["n_chars"] == len(out[0]["text"])
    # documents without personal data stay as they are
    assert all(out[d]["text"] == t for d, t in rows if d >= 100)


def test_terms_of_a_value_seen_twice_go_in_the_whole_document(ready):
    """Too few contexts for a count per value; plain rare words stay, and a term goes far from the value too."""
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu")]
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(common, n))
    # every document has a rare word of its own
    rows = [(i, f"{say(40)} rare{chr(97 + i % 26)}{chr(97 + i // 26)} {say(3)}") for i in range(400)]
    rows[7] = (7, f"{rows[7][1]} ann@mail.example {say(90)} Quibble {say(9)}")
    rows[9] = (9, f"{say(5)} Quibble {say(90)} {rows[9][1]} ann@mail.example")
    spans = {r["doc_id"]: r for r in pii.report(typed(ready, rows)).collect()}
    for i in (7, 9):
        found = {rows[i][1][int(a):int(b)] for k, a, b in (s.split(":") for s in spans[i]["spans"].split(",")) if k == "term"}
        assert found == {"Quibble"}
    assert sum(r["n_term"] for r in spans.values()) == 2


def test_a_value_seen_once_can_be_disclosed(ready):
    """A word seen once discloses a value seen once where such words are no everyday thing."""
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(rng.choice(["kara", "lose", "miti", "nuvo"], n))
    rows = [(i, say(30)) for i in range(400)]
    rows[3] = (3, f"Zorblax {say(60)} bob@mail.example {say(60)} Zorblax, zorblax")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise_stage(typed(ready, rows)).collect()}
    assert "zorblax" not in out[3].lower() and "[EMAIL]" in out[3] and all(out[i] == t for i, t in rows if i != 3)


def test_pii_of_odd_rows(odd_docs, no_docs):
    assert pii.report(odd_docs).count() == odd_docs.count() and pii.report(no_docs).count() == 0
    out = pii.sanitise_stage(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all("555" not in (r["text"] or "") and r["base"] == "kept" for r in out.collect())


# ---- mixing

def test_domains_are_learned_and_rates_meet_the_targets(ready):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "star"], 20)) + (" scum idiot" if i % 5 == 0 else "") + ("  %%% &&& *** $$$" * 9 if i % 5 == 1 else ""))
            for i in range(400)]
    labels = ready.createDataFrame([(i, int(i % 5 != 1), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    found = mixing.mix(typed(ready, rows), labels).toPandas().set_index("doc_id").sort_index()
    want = [{0: "toxic", 1: "poor"}.get(i % 5, "good") for i in range(200, 400)]
    assert np.mean(found.loc[200:399, list(mixing.DOMAINS)].idxmax(axis=1) == want) >= 0.98
    assert np.allclose(found[list(mixing.DOMAINS)].sum(axis=1), 1) and (found.rate >= 0).all()
    weight = found.n_tokens * found.copies
    for d, share in mixing.TARGETS.items():
        assert abs((weight * found[d] * found.rate).sum() / weight.sum() - share) <= 0.01 * share


def test_rates_go_on_until_the_targets_are_met(ready):
    """Overlapping posteriors and small domains, where 60 steps miss a target by over 2 %."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([6, 1, 1], 200)
    w = rng.integers(5, 2000, len(p))
    rows = [(i, i, 1, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(w, p))]
    found = ready.createDataFrame(rows, "doc_id long, text_hash long, copies long, n_tokens long, good double, poor double, toxic double")
    out = mixing.rates(found).toPandas()
    for d, share in mixing.TARGETS.items():
        assert abs((out.n_tokens * out[d] * out.rate).sum() / out.n_tokens.sum() - share) <= 0.005 * share


def test_mixing_of_odd_rows(ready, odd_docs, no_docs):
    labels = ready.createDataFrame([(1, 1, None), (2, None, None), (None, 1, 1), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["domain"] for r in mixing.domains_of(labels).collect()} == {1: "good", 6: "toxic"}
    assert mixing.mix(odd_docs, labels).count() == 10 and mixing.mix(no_docs, labels).count() == 0
    out = mixing.resample_stage(odd_docs, labels.limit(0))
    assert out.columns == odd_docs.columns and {r["rate"] for r in out.collect()} == {"kept"}


# ---- SentencePiece

def test_codec_round_trip_and_parity(given, odd_docs, no_docs):
    for docs in (given, odd_docs):
        found = sentencepiece_codec.round_trip(docs).collect()
        assert len(found) == docs.count() and all(r["round_trip"] and r["parity"] and r["n_tokens"] == len(r["ids"]) for r in found)
    out = sentencepiece_codec.encode_stage(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns) and sentencepiece_codec.round_trip(no_docs).count() == 0
    assert all(r["ids"] == [] for r in out.collect() if not r["text"])


def test_codec_equals_the_reference():
    with open(sentencepiece_codec.MODEL, "rb") as f:
        own = sentencepiece_codec.Codec(f.read())
    rng = np.random.default_rng(1)
    parts = ["a", "B", " ", "  ", "\n", "▁", "é", "日本", "🎉", "<s>", "<0x41>", "ing", "\u0000", "x" * 40]
    texts = ["", *["".join(rng.choice(parts, int(rng.integers(1, 20)))) for _ in range(500)]]
    ids, bad = own.encode(texts)
    assert [x.tolist() for x in ids] == own.reference.encode(texts) and not bad.any()
    lists = pa.array([x.tolist() for x in ids] + [[3 + 0xC3], [5, 3 + 0x80, 7]], pa.list_(pa.int32()))
    assert own.decode(lists).to_pylist() == own.tokenizer.decode_batch(lists.to_pylist(), skip_special_tokens=False)


# ---- training order

@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    order = training_order.Permutation(n, 99)
    slots = order(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.inverse(slots) == np.arange(n)).all()


def test_shards_hold_every_id_once_in_order(ready, given, tmp_path):
    docs = given.coalesce(1)
    path = f"file://{tmp_path}/shards"
    n = training_order.write_shards(docs, path, key=5, seq_len=64, rows_per_shard=50)
    rows = sorted(training_order.read_slots(ready, path).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(n))
    assert [r["seq_id"] for r in rows] == training_order.Permutation(n, 5).inverse(np.arange(n)).tolist()
    own = training_order.Encoder(training_order.VOCABULARY)
    want = [i for _, t in pairs(docs) for i in [*own.bpe.encode_ordinary(t or ""), training_order.END_ID]]
    by_number = sorted(rows, key=lambda r: r["seq_id"])
    assert [i for r in by_number for i in r["ids"][:r["n_ids"]]] == want
    part = sorted(training_order.read_slots(ready, path, 45, 120).collect(), key=lambda r: r["slot"])
    assert part == rows[45:120]


def test_units_equal_the_whole_text():
    own, rng = training_order.Encoder(training_order.VOCABULARY), np.random.default_rng(8)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "'", "!", "　", "\xa0", "\x1c", "日本", "🎉", " "]
    for _ in range(1500):
        text = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert np.frombuffer(own.encode(text), "<u2").tolist() == own.bpe.encode_ordinary(text), repr(text)


def test_order_of_odd_rows(odd_docs, no_docs):
    found = training_order.materialise(odd_docs, seq_len=256)
    assert found.agg({"n_ids": "sum"}).first()[0] > 60_000 and training_order.materialise(no_docs).count() == 0


# ---- Katz

@pytest.mark.parametrize("hot", [5, 20_000])
def test_scores_equal_plain_recursion(given, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = given.limit(60)
    rows = pairs(docs)
    got = {r["doc_id"]: r for r in katz.score_corpus(docs).collect()}
    for (doc, _), (n, known, base, score) in zip(rows, brute.katz_scores(rows)):
        r = got[doc]
        assert (r["n_tokens"], r["n_known"]) == (n, known) and abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6


def test_katz_of_odd_rows(odd_docs, no_docs, ready):
    rows = pairs(odd_docs)
    got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score_corpus(odd_docs).collect())
    assert got == sorted((n, k, round(b, 6), round(s, 6)) for n, k, b, s in brute.katz_scores(rows))
    assert katz.score_corpus(no_docs).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    only = katz.score_corpus(typed(ready, [(i, "a b") for i in held])).collect()
    assert len(only) == len(held) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in only)


def _field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_equals_the_reference(squeeze):
    """A hand-made unigram model: scores, byte fallback and white-space rules are rebuilt."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -s, 1) for p, s in (("▁", 2.0), ("a", 4.0), ("b", 4.5), ("c", 5.0), ("▁a", 3.1), ("ab", 6.2), ("▁ab", 5.3),
                                       ("bc", 7.1), ("abc", 8.9), ("▁abc", 9.7), ("▁▁", 3.3), ("ca", 6.6))]
    data = b"".join(_field(1, _field(1, p) + _field(2, s) + _field(3, t)) for p, s, t in pieces)
    data += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, "identity") + _field(3, 1) + _field(4, squeeze) + _field(5, 1))
    own = sentencepiece_codec.Codec(data)
    assert own.model.kind == 1 and own.model.byte_fallback and not own.model.splits_at_marks
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(["a", "b", "c", " ", "  ", "é", "\n"], int(rng.integers(0, 25)))) for _ in range(400)]
    ids, bad = own.encode(texts)
    assert [x.tolist() for x in ids] == own.reference.encode(texts)
    assert bad.sum() <= 0.1 * len(texts)  # ties of equal score only
