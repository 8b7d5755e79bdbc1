"""Language, copies, passages, benchmark items and tokens against plain Python."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.llm import bpe, decontam, langid, queries, simhash, substring

DOCS = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd(spark, extra=()):
    """Null, empty, blank, repeated, long and clashing rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    data = [(None, "a b c d"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c d"), (4, "a b c d"), (4, "other words here"), (5, long), *extra]
    return spark.createDataFrame(data, DOCS).withColumns({"id": F.lit("x"), "fp": F.lit(1), "h": F.lit(2), "kept": F.lit("k"), "key": F.lit(0), "score": F.lit(7.0)})


# ---- language

def test_languages_of_held_out_documents(spark, small_dir):
    found = queries.op7_langid(spark, small_dir)
    truth = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id").toPandas()
    assert len(both) == 200
    assert (both.held_out == both.doc_id.map(lambda i: brute.remainder(i, 4) == 2)).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_predictions_equal_plain_sets(spark, small_dir):
    """What the filters tell, corrected for chance, is what sets of n-grams tell."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang").toPandas()

    def grams(text):
        text = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").lower().encode())
        padded = b" " + text + b" "
        return [padded[i:i + n] for n in (3, 4) for i in range(len(padded) - n + 1) if 32 not in padded[i + 1:i + n - 1]]

    counts = {}
    for i, text, lang in docs.itertuples(index=False):
        if brute.remainder(i, 4) != 2 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    known = {lang: {g for g, n in c.items() if n >= sum(c.values()) * langid.SHARE} for lang, c in counts.items()}
    found = {r["doc_id"]: r for r in queries.op7_langid(spark, small_dir).collect()}
    clear = 0
    for i, text, _ in docs.itertuples(index=False):
        own = grams(text)
        rates = sorted(((sum(g in known[lang] for g in own) / max(1, len(own)), lang) for lang in known), reverse=True)
        if any(c.isalpha() for c in text or ""):
            assert found[i]["score"] == pytest.approx(rates[0][0], abs=0.02)
            if rates[0][0] - rates[1][0] > 0.03:
                clear += 1
                assert found[i]["lang_pred"] == rates[0][1]
        else:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert clear > 150


def test_filters_name_all_languages_of_an_ngram():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 1 << 33, 3000)
    langs = rng.integers(0, 70, 3000)
    filters = langid.build([f"l{i:02d}" for i in range(70)], grams, langs)
    found = filters.has(grams.astype(np.uint64))
    assert all(found[lang // 64, i] >> np.uint64(lang % 64) & np.uint64(1) for i, lang in enumerate(langs.tolist()))
    other = filters.has(rng.integers(1 << 34, 1 << 35, 20_000).astype(np.uint64))
    assert np.bitwise_count(other).sum() < 20_000 * (filters.by_chance.sum() * 3 + 0.01)


def test_odd_texts_have_a_language(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "xx"), ("x", None)], "text string, lang string")
    filters = langid.learn(train)
    assert filters.languages == ["de", "en"]
    asked = odd(spark, [(6, "THE AND"), (7, "12 34 !"), (8, "ß"), (9, "Katze")])
    found = langid.identify(asked, filters)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[6][0] == "en" and got[9] == ("de", pytest.approx(1.0, abs=0.2)) and got[8][0] in ("de", "en")
    assert found.columns.count("score") == 1 and found.count() == 12
    nothing = langid.learn(train.where("false"))
    assert {r["lang_pred"] for r in langid.identify(asked, nothing).collect()} == {"und"}
    assert langid.identify(asked.where("false"), filters).count() == 0


def test_long_rows_count_like_short_ones():
    import pyarrow as pa

    from crivo.llm.common import utf8_pieces
    text = " ".join(f"word{i}" for i in range(5000))
    whole = langid._grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    parts = [langid._grams(d, o) for _, d, o in utf8_pieces(pa.array([text, None, ""]), 1000)]
    assert sorted(np.concatenate([p[0] for p in parts]).tolist()) == sorted(whole.tolist())


def test_long_words_are_hashed_whole():
    import pyarrow as pa

    from crivo.llm.common import hashed_rows
    rng = random.Random(9)
    texts = ["", None, "a\x00b\x1fc " * 40, "é" * 130, " " * 200, "x" * 100 + " ", "\x01" * 64 + "y"]
    texts += ["".join(rng.choice("ab\x00 \n") if rng.random() < 0.2 else rng.choice("abc") * rng.randint(1, 70) for _ in range(40)) for _ in range(30)]
    want, got = {}, {}
    for size, out in ((1 << 20, want), (64, got), (7, got)):
        for first, hashes, bounds in hashed_rows(pa.array(texts), size):
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                out[first + i] = hashes[a:b].tolist()
        assert sorted(out) == list(range(len(texts)))
        assert [len(out[i]) for i in out] == [len(brute.words(texts[i])) for i in out]
        assert out == want
    said = {w: h for i, t in enumerate(texts) for w, h in zip(brute.words(t), want[i])}
    assert len(set(said.values())) == len(said)


# ---- copies

def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    near = words ^ simhash._leaders()[simhash._syndromes(words)]
    assert (simhash._syndromes(near) == 0).all()
    assert (np.bitwise_count(near ^ words) <= 3).all()
    assert simhash.fuzzy_values(words)[0].size <= 6 * len(words)


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_near_fingerprints_share_a_key(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    def sets(fps):
        out = [set() for _ in fps]
        for row, key in zip(*simhash.keys(fps)):
            out[row].add(int(key))
        return out
    assert all(x & y for x, y in zip(sets(a), sets(b)))


def test_fingerprints_and_components_equal_brute_force(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in queries.op5_simhash(spark, small_dir).collect()}
    prints = [brute.fingerprint(t, 3) for _, t in docs]
    for (i, _), p in zip(docs, prints):
        assert found[i]["fingerprint"] == f"{p:016x}"
    for group in brute.reachable(prints):
        least = min(docs[g][0] for g in group)
        assert {found[docs[g][0]]["component_id"] for g in group} == {least}


def test_chains_and_large_groups_of_near_fingerprints(spark):
    rng = random.Random(3)
    prints, at = [], rng.getrandbits(64)
    for _ in range(60):  # a chain: each within three bits of the one before
        prints.append(at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    centre = rng.getrandbits(64)
    prints += [centre ^ 1 << a ^ 1 << b for a in range(24) for b in range(a)]
    prints += [rng.getrandbits(64) for _ in range(200)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    for group in brute.reachable(prints):
        if len(group) > 1:
            assert len({roots[signed[g]] for g in group}) == 1
            assert roots[signed[group[0]]] == min(signed[g] for g in group)
        else:
            assert signed[group[0]] not in roots


def test_one_document_of_each_group_stays(spark):
    docs = odd(spark, [(9, "x y z x y z"), (8, "x y z x y z")])
    found = simhash.classes(docs, width=3).collect()
    assert len(found) == docs.count()
    blank = [r for r in found if r["id"] in (1, 2, 3)]
    assert {(r["fp"], r["component"]) for r in blank} == {(0, 1)}
    kept = simhash.one_of_each(docs, width=3)
    assert kept.columns == docs.columns
    # Row 4 stands for the null id's equal text, once; its other text is a document of its own.
    assert sorted((r["doc_id"], (r["text"] or "")[:7]) for r in kept.collect()) == [
        (1, ""), (4, "a b c d"), (4, "other w"), (5, "w0 w1 w"), (8, "x y z x")]
    alone = spark.createDataFrame([(None, "q r s"), (None, "q r s"), (None, "t u v")], DOCS)
    assert simhash.one_of_each(alone).count() == 2
    assert simhash.one_of_each(docs.where("false")).count() == 0


# ---- passages

def test_passages_equal_brute_force(spark, small_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in queries.op10_substring(spark, small_dir).collect()}
    for i, kept, n in brute.without_repeats(docs, 20):
        assert (found[i]["n_words"], found[i]["n_removed"]) == (n, n - len(kept))
        assert found[i]["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_passages_after_a_long_word(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    data = [(1, passage), (2, "a" * (3 << 19) + " own words " + passage), (3, "b\x00" * (1 << 20) + " " + passage + " end")]
    found = {r["doc_id"]: r for r in substring.without_repeats(spark.createDataFrame(data, DOCS), width=20).collect()}
    for i, kept, n in brute.without_repeats(data, 20):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept"]) == (n, n - len(kept), " ".join(kept))


@pytest.mark.parametrize("often", [2, 256])
@pytest.mark.parametrize("block", [500, 1 << 20])
def test_passages_of_small_alphabets(spark, monkeypatch, often, block):
    """Overlaps, periods and a line that all share, in small blocks and with anchors dealt by window."""
    monkeypatch.setattr(substring, "OFTEN", often)
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "SHARD_WORDS", 50)
    rng = random.Random(often)
    line = "one two three four five six seven eight nine"
    data = []
    for i in range(60):
        own = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        data.append((i, " ".join(own) + ("\n" + line if i % 2 else "")))
    data += [(100, "x " * 50), (101, "x " * 50), (102, data[3][1]), (-5, data[4][1])]
    found = {r["doc_id"]: r for r in substring.without_repeats(spark.createDataFrame(data, DOCS).repartition(3), width=8).collect()}
    for i, kept, n in brute.without_repeats(sorted(data), 8):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept"]) == (n, n - len(kept), " ".join(kept))


def test_odd_rows_keep_their_columns(spark):
    docs = odd(spark)
    found = substring.without_repeats(docs, width=6)
    assert sorted(found.columns) == sorted([*docs.columns, "n_words", "n_removed"])
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(None, 4, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 4, 0), (4, 4, 0), (4, 3, 0), (5, 60_000, 60_000 - 997)], key=str)
    copies = spark.createDataFrame([(7, "p q r s t u"), (7, "p q r s t u"), (None, "p q r s t u"), (8, "p q r s t u v")], DOCS)
    kept = sorted((r["doc_id"] or 0, r["kept"]) for r in substring.without_repeats(copies, width=6).collect())
    assert kept == [(0, "p q r s t u"), (7, ""), (7, ""), (8, "v")]
    assert substring.without_repeats(docs.where("false"), width=6).count() == 0
    with pytest.raises(ValueError):
        substring.without_repeats(docs, width=2)


def test_verdicts_on_passages_come_from_automata(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(5)], DOCS)
    assert {r["n_removed"] for r in substring.without_repeats(docs).where("doc_id > 0").collect()} == {40}
    monkeypatch.setattr(substring.SuffixAutomaton, "first_ends", lambda self, words, width: [None] * len(words))
    assert {r["n_removed"] for r in substring.without_repeats(docs).collect()} == {0}


def test_automaton_finds_first_places():
    rng = random.Random(7)
    for _ in range(50):
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 15))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for number, text in enumerate(texts):
            automaton.add(number, text)
        for text in texts:
            for end, first in enumerate(automaton.first_ends(text, 3)):
                want = None
                if end >= 2:
                    want = next((n, e) for n, t in enumerate(texts) for e in range(2, len(t)) if t[e - 2:e + 1] == text[end - 2:end + 1])
                assert first == want


# ---- benchmark

@pytest.mark.parametrize("broadcast", [True, False])
def test_benchmark_hits_equal_brute_force(spark, small_dir, broadcast):
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontam.contaminated(docs, items, broadcast=broadcast)
    want = brute.contaminated([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_items(spark, broadcast):
    docs = odd(spark, [(6, "A B, c D e"), (7, "a b c é d"), (8, "b c")])
    items = spark.createDataFrame([(1, "a b c d"), (2, "B C"), (3, None), (4, "..."), (None, "a b"), (2, "a b c d"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")],
                                  "item_id long, text string").withColumn("words", F.lit("x"))
    found = decontam.contaminated(docs, items, broadcast=broadcast)
    want = brute.contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], [(r[0], r[1]) for r in items.collect()])
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str) == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items, broadcast=broadcast).collect()) == [1, 2, 3, 4]
    assert decontam.contaminated(docs, items.where("false"), broadcast=broadcast).where("n_hit > 0").count() == 0
    assert decontam.contaminated(docs.where("false"), items, broadcast=broadcast).count() == 0


# ---- tokens

@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.WordBpe(queries.tokenizer_json()))


def same(tokenizer, encoder, texts):
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert encoder.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_tokens_equal_the_library(spark, small_dir, tokenizer):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op8_bpe(spark, small_dir).collect():
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_texts_and_special_strings(tokenizer, encoder):
    rng = random.Random(2)
    pools = ["abcdefghij", "thero'sndve ll'", "ÀÉîßΣςİıǅﬁ é \u0085\x1c\t\r\n\x0b", "0123٣५½²", "😀👍🏽‍中文かな한국", "!?.,;:#$%&*()|/\\\"`~^_-+=", "<|endoftext|> <|startoftext|> a"]
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|", "<|ENDOFTEXT|>", "the" * 700]
    for _ in range(3000):
        pool = "".join(rng.sample(pools, rng.randint(1, 3)))
        texts.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))))
    vocabulary = sorted(tokenizer.get_vocab())
    texts += ["".join(rng.choice(vocabulary).replace("</w>", " ") for _ in range(6)) for _ in range(1000)]
    same(tokenizer, encoder, texts)


def test_borders_tell_wrong_guesses(encoder):
    """What passes the check is what merging gives, and nothing that merging gives fails it."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    guesses, exact = [encoder.bpe.guess(w) for w in words], encoder.bpe.merged(words)
    assert encoder.bpe.encode_words(words) == exact
    assert 0 < sum(g != e for g, e in zip(guesses, exact)) < len(words)
    for ids in exact:
        if len(ids) > 1:
            assert encoder.bpe.compatible(np.array(ids[:-1]), np.array(ids[1:])).all()


def test_odd_rows_are_encoded(spark, tokenizer):
    docs = odd(spark)
    found = bpe.encode(docs, queries.tokenizer_json())
    assert found.count() == docs.count()
    got = {r["id"]: bytes(r["ids"]) for r in found.collect()}
    assert got[1] == got[2] == got[3] == b""
    assert len(got[5]) // 4 == len(tokenizer.encode(" ".join(f"w{i % 997}" for i in range(60_000)), add_special_tokens=False).ids)
    assert bpe.digests(bpe.encode(docs.where("false"), queries.tokenizer_json())).count() == 0
