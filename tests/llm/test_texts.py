"""Exact dedup, mixing, packing and language ID against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import exact_dedup, langid, mixing, packing
from lodestrata.llm.shared import table

WHITE = " \t\n\v\f\r"
ROWS = [(4, "a b", "s1"), (2, "ab", "s1"), (9, "a\tb ", "s2"), (7, None, None), (3, "", "s2"), (5, " \n", "s2"), (None, "ab", "s1"), (2, "ab", "s1"), (8, " ab", "s3"), (6, "x " * 5000, "s3")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, keep_id string")


def test_exact_dedup_keeps_the_longest_then_smallest(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark)).collect()}
    assert got == {(4, 9, 5, False), (2, 9, 5, False), (9, 9, 5, True), (None, 9, 5, False), (7, 5, 3, False), (3, 5, 3, False), (5, 5, 3, True), (8, 8, 1, True), (6, 6, 1, True)}


def test_exact_dedup_of_repeated_rows_and_nulls_keeps_one(spark):
    rows = [(1, "x", None), (1, "x", None), (1, "y", None), (None, "z", None), (None, "z", None)]
    kept = exact_dedup.deduplicate(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "keep_id"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "z"), (1, "x"), (1, "y")]
    assert exact_dedup.deduplicate(frame(spark, [])).count() == exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_equal_hashes_of_different_texts_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 2))
    rows = [(i, f"text {i % 300}", None) for i in range(600)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert all(r["keep_id"] == r["doc_id"] % 300 and r["group_size"] == 2 for r in got) and len(got) == 600


def mix_by_hand(rows, most=3):
    size = [len((t or "").split()) if t else 0 for _, t, _ in rows]
    by = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, capped = sum(size), {}, set()
    while True:
        rest = total - sum(most * by[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: most * by[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > most * by[s]}
        if not over:
            return size, by, target
        capped |= over


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(5)
    sources = ["b", "a", None, "c", "tiny", "é"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))) or None, sources[min(5, int(rng.integers(0, 7)))] if i > 3 else "tiny") for i in range(4000)]
    size, by, target = mix_by_hand(rows)
    got = {r["doc_id"]: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    taken = Counter()
    for (k, _, s), n in zip(rows, size, strict=True):
        r = got[k]
        assert (r["size"], r["source_size"]) == (n, by[s]) and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] == n * r["copies"] <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in by)
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == frame(spark).columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: r["copies"] for k, r in got.items() if r["copies"]})
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows).repartition(7)).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    empty = [(1, None, "a"), (2, "", None)]
    assert {r["taken"] for r in mixing.mix(frame(spark, empty)).collect()} == {0}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


TEXTS = [None, "", " \n", "One two, three. ONE", "l'été d'Ånström isn't <|endoftext|> <|EndOfText|> \x01 a\x01b", "x." * 3000, "wörd " * 9000, "é́ ΣΑΣ İ 中文 １２ a b \x1c c", "3.14!?; foo?!bar."]


def test_ids_are_the_tokenizers(tokenizer):
    texts = [(t or "").encode() for t in TEXTS]
    for t, ids in zip(TEXTS, packing._tokens(packing.default_tokenizer()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB ,.'\n\t!<|>éÉßΣς１́ \x01"), max_size=40), max_size=5))
def test_ids_of_odd_texts(tokenizer, texts):
    got = packing._tokens(packing.default_tokenizer()).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    tokens = packing._Tokens(packing.default_tokenizer())
    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(20)]
    for t in texts:
        (ids,) = tokens.encode([t.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    texts = TEXTS + ["tok " * (37 * i % 300) for i in range(300)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None)] * 50 + [(None, "x", None), (2**62 + 1, "y", None)]
    got = packing.pack_documents(frame(spark, rows), capacity=512, with_ids=True).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for k, t in enumerate(texts):
        if k != 3:
            parts = sorted(by[k], key=lambda r: r["piece"])
            assert [x for r in parts for x in r["ids"]] == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert [r["start"] for r in parts] == [512 * r["piece"] for r in parts] and all(r["length"] == 512 for r in parts[:-1])
    assert len(by[3]) == 51 and len(by[None]) == len(by[2**62 + 1]) == 1
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 512) + 8
    assert packing.pack_documents(frame(spark, [])).count() == 0


@given(st.lists(st.integers(1, 100), max_size=60))
def test_swaps_keep_items_and_never_add_bins(lengths):
    n = np.array(lengths, np.int64)
    first = packing.best_fit(n, 100)
    start = [[i] for i in range(len(lengths))]
    for bins in (packing.swap_search([list(b) for b in first], n, 100), packing.swap_search(start, n, 100)):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(n[b].sum() <= 100 for b in bins)
    assert len(packing.swap_search([list(b) for b in first], n, 100)) <= len(first)


def test_swaps_empty_a_bin_that_best_fit_leaves():
    n = np.array([6, 4, 7, 3, 5, 5], np.int64)
    assert len(packing.swap_search([[0, 3], [4, 1], [5], [2]], n, 10)) == 3


def test_language_id(spark):
    en, fr = "the thing that they were thinking of was there ", "les choses dont ils pensaient étaient là où "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)] + [(50, None, "en"), (51, en, None), (52, fr * 2, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(df)
    assert f.languages == ["en", "fr"]
    asked = [(1, "they were there"), (2, "ils étaient là"), (3, None), (4, ""), (5, "123 !? ²"), (6, "中"), (7, en * 20000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), f).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: f.languages[f.usual], 7: "en"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[1][1] > 0.8
    kept = langid.keep_identified(df, f)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {50}


def test_language_filters_hold_many_languages_and_correct_false_hits():
    rng = np.random.default_rng(0)
    names = [f"l{i:03}" for i in range(150)]
    grams = rng.integers(0, 2**32, (150, 30), dtype=np.uint64).astype(np.uint32)
    bits = np.zeros((1 << 13, 3), np.uint64)
    for b, own in enumerate(grams):
        for p in langid.positions(own, len(bits)):
            bits[p, b // langid.WORD] |= np.uint64(1 << b % langid.WORD)
    f = langid.Filters(names, bits, np.full(150, (60 / 8192) ** 2), 0)
    for b in (0, 62, 63, 149):
        hits = f.hits(grams[b])
        assert hits[b] == 30 and np.delete(hits, b).max() <= 3


def test_no_labels_no_language(spark):
    f = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert f.predict("words") == ("und", 0.0)


def test_identified_texts_have_a_gram_of_some_language(spark):
    rows = [("the river and the other rivers", "en")] * 5 + [("der fluss und die anderen wege", "de")] * 5
    f = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([("the other river",), ("zzqx kkwv qqqq",), ("12 !!",), (None,)], "text string")
    assert [r["text"] for r in langid.keep_identified(asked, f).collect()] == ["the other river"]


@pytest.mark.parametrize("lang", [None, "en"])
def test_without_labels_or_learned_grams_texts_with_letters_stay(spark, lang):
    df = spark.createDataFrame([("some words", lang), ("12 !!", None), (None, None), ("", None)], "text string, lang string")
    assert [r["text"] for r in langid.keep_identified(df, langid.learn(df)).collect()] == ["some words"]


def test_underfull_bins_of_blocks_are_packed_together(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 300).tolist()
    parts = table(spark.createDataFrame(list(enumerate(lengths)), "row long, length long"))
    got = packing.pack(parts, capacity=1000, block=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1000
    whole = packing.swap_search(packing.best_fit(np.array(lengths), 1000), np.array(lengths), 1000)
    assert sorted(r["length"] for r in got) == sorted(lengths)
    assert len(by) <= len(whole) + 12


def test_least_bins_and_search_against_all_packings():
    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, fills):
            nonlocal best
            if len(fills) >= best:
                return
            if i == len(lengths):
                best = len(fills)
                return
            for f in {f for f in fills if f + lengths[i] <= capacity}:
                at = fills.index(f)
                place(i + 1, [*fills[:at], f + lengths[i], *fills[at + 1 :]])
            place(i + 1, [*fills, lengths[i]])

        place(0, [])
        return best

    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(4, 30))
        n = rng.integers(1, capacity + 1, rng.integers(1, 9))
        best = fewest(sorted(n.tolist(), reverse=True), capacity)
        got = packing.swap_search(packing.best_fit(n, capacity), n, capacity)
        assert packing.least_bins(n, capacity) <= best <= len(got) <= best + 1
        assert sorted(i for b in got for i in b) == list(range(len(n))) and all(n[b].sum() <= capacity for b in got)


def test_search_goes_on_past_bins_without_an_exchange():
    n = np.random.default_rng(6).integers(1000, 2000, 600)
    first = packing.best_fit(n, 4096)
    got = packing.swap_search([list(b) for b in first], n, 4096)
    assert len(got) < len(first) and sorted(i for b in got for i in b) == list(range(600)) and all(n[b].sum() <= 4096 for b in got)
