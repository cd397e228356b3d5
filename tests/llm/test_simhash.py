import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash


def naive_components(codes, limit):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= limit:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def clustered(seed, centres, spread):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64).tolist():
        out.add(c)
        for _ in range(spread):
            c ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_links_give_the_components_of_all_close_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    codes = [c - 2**64 if c >= 2**63 else c for c in clustered(1, 60, 12)]
    df = spark.createDataFrame([(c,) for c in codes], "fingerprint long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    unsigned = lambda c: c & (2**64 - 1)
    want = naive_components([unsigned(c) for c in codes], 2)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    mine = groups({unsigned(c): unsigned(got.get(c, c)) for c in codes})
    assert mine == groups(want)
    assert 60 <= len(mine) < len(codes) / 3


def test_index_finds_every_close_pair():
    words = np.array(clustered(2, 20, 20), np.uint64).view(np.int64)
    index = simhash.GrayIndex(words, words)
    found = set()
    for q, n in index.pairs(words, np.full(len(words), -1, np.int64), 2):
        found |= set(zip(q.tolist(), n.tolist()))
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if (int(words[i] ^ words[j]) & (2**64 - 1)).bit_count() <= 2}
    assert found == want


def test_fingerprint_is_the_majority_of_shingle_bits():
    for text in ("", "   \n", "One", "one TWO", "one two three", "a b c d e f a b c d", "é ü x y z"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole


def test_nulls_ties_and_extra_columns(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (7, None, "z"), (5, "", "z"), (None, "a b c d", "w"), (9, "other words here entirely", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 1), (1, 1), (1, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    assert {r["fingerprint"] for r in got if r["doc_id"] in (5, 7)} == {"0" * 16}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_null_and_repeated_keys_keep_their_unlinked_texts(spark):
    rows = [(None, "one text about rivers and hills"), (None, "another on ships at sea today"), (None, "another on ships at sea today"), (None, "some words that an id shares"), (4, "first of the repeated ids here"), (4, "second text wholly unlike that one"), (2, "some words that an id shares")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[5], rows[6]]))


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("docs", [8, 1024])
def test_near_copies_beyond_the_fingerprint_limit_are_dropped(spark, monkeypatch, docs):
    """Against all pairs: groups of near copies, and unlike texts that share a passage."""
    monkeypatch.setattr(simhash, "DOCS", docs)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5_000, n)]
    texts, passage = [], word(60)
    for size in (40, 2, 2, 3):
        base = word(120)
        for _ in range(size):
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join(passage + word(40)) for _ in range(30)]
    for n in (1, 2, 4, 5, 9):  # short ones, once with other case and once with another end
        base = word(n)
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, "end"])]
    sets = [shingles(t) for t in texts]
    codes = [simhash.fingerprint(t.encode()) & (2**64 - 1) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8}
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2}
    assert any((codes[i] ^ codes[j]).bit_count() > 2 for i, j in near)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near | close:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(root)
    assert len(kept) == 34 + 9


def test_similar_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 20, np.uint64) for _ in range(6)]
    sets = [np.unique(np.append(np.delete(base[k % 6], rng.integers(0, 20, k % 3)), rng.integers(0, 2**63, k % 2, np.uint64))) for k in range(40)]
    want = {(i, j) for i in range(40) for j in range(40) if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}

    def groups(pairs):
        root = list(range(40))
        for _ in root:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups(simhash.similar(sets, None, 0.8)) == groups(want)
    across = {(i, j) for i, j in want if i < 15 <= j}
    got = {(i, j + 15) for i, j in simhash.similar(sets[:15], sets[15:], 0.8)}
    assert got <= across and groups(got) == groups(across)


def test_extra_columns_and_names_of_its_own(spark):
    rows = [(1, "some text of a few words", "x", 1), (2, "some text of a few words", "y", 2), (3, "other", None, 3)]
    for names in ("__rid string, n long", "root string, fingerprint long", "rid string, drawn long", "__stays string, a long"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        kept = simhash.drop_near_duplicates(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_index_splits_large_parts(monkeypatch):
    words = np.array(clustered(5, 3, 60), np.uint64).view(np.int64)
    pairs = lambda: {(q, n) for a, b in simhash.GrayIndex(words, words).pairs(words, np.full(len(words), -1, np.int64), 2) for q, n in zip(a.tolist(), b.tolist(), strict=True)}
    whole = pairs()
    monkeypatch.setattr(simhash, "STEP", 16)
    assert pairs() == whole


def test_blocks_with_many_guests_are_compared_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "GUESTS", 8)
    codes = [c - 2**64 if c >= 2**63 else c for c in clustered(9, 2, 150)]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(c,) for c in codes], "fingerprint long"))).collect()}
    want = naive_components([c & (2**64 - 1) for c in codes], 2)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({c & (2**64 - 1): got.get(c, c) & (2**64 - 1) for c in codes}) == groups(want)


def written(monkeypatch):
    """Rows of each table that near-dedup writes, by its columns."""
    rows, write = {}, simhash.table

    def table(df):
        out = write(df)
        key = " ".join(sorted(out.columns))
        rows[key] = rows.get(key, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "table", table)
    return rows


def template_texts(rng, n, shared, own):
    word = lambda k: [f"w{i}" for i in rng.integers(0, 10**6, k)]
    template = word(shared)
    return [" ".join(template + word(own)) for _ in range(n)]


@pytest.mark.parametrize("most", [16, 2048])
def test_texts_that_share_a_template_cost_sketches_only(spark, monkeypatch, most):
    """400 texts of similarity 0.33 to each other: no text of theirs is compared, whether
    their buckets are small or divided by further codes."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(6)
    texts = template_texts(rng, 400, 150, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = written(monkeypatch)
    assert simhash.drop_near_duplicates(df).count() == 400
    assert rows["bucket hub last n"] > 100  # they do share codes
    assert rows["hub n"] == 0 and rows["bucket n root size"] == 0


@pytest.mark.parametrize("most", [8, 64])
def test_links_among_template_texts_are_found_in_divided_buckets(spark, monkeypatch, most):
    """A large dense group, pairs that only reach 0.8 with each other, and a chain, all on one template."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "DOCS", 16)
    rng = np.random.default_rng(7)
    texts = template_texts(rng, 120, 100, 100)

    def changed(text, k):
        words = text.split()
        for i in rng.choice(len(words), k, replace=False):
            words[int(i)] = f"x{rng.integers(10**6)}"
        return " ".join(words)

    texts += [changed(texts[0], 1) for _ in range(90)]
    for i in range(1, 30):
        texts.append(changed(texts[i], 4))  # similarity around 0.82
    for _ in range(6):
        texts.append(changed(texts[-1], 3))
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8}
    codes = [simhash.fingerprint(t.encode()) & (2**64 - 1) for t in texts]
    near |= {(i, j) for i in range(len(texts)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2}
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == set(root)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    for size in (8, 60, 200, 3000):
        base = rng.integers(0, 2**63, size, np.uint64)
        missed = passed = 0
        for _ in range(60):
            keep = int(round(size * 0.89))
            near = np.concatenate([base[:keep], rng.integers(0, 2**63, size - keep, np.uint64)])  # 0.8
            far = np.concatenate([base[: size // 2], rng.integers(0, 2**63, size - size // 2, np.uint64)])  # 0.33
            a, b, c = (np.frombuffer(simhash.draws(x)[1], np.uint8) for x in (base, near, far))
            missed += not simhash.may_be(a, b, np.array(size), 0.8)
            passed += bool(simhash.may_be(a, c, np.array(size), 0.8))
        assert missed == 0 and (size < 200 or passed == 0)


@pytest.mark.parametrize("most", [8, 2048])
def test_pairs_of_one_common_code_are_found_in_large_buckets(spark, monkeypatch, most):
    """Forty texts with one code in common and no other; similar ones among them are linked, in one task or many."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 200)) for _ in range(20)]
    texts += [t + f" end{i}" for i, t in enumerate(texts)]
    rows = []
    for n, t in enumerate(texts):
        words = t.encode().split()
        found = np.unique(simhash.widened(simhash.shingle_hashes(words, 3, 42), words, 3, 5))
        rows.append((n, bytes([n]), len(found), [7, *(1_000 * n + k for k in range(1, simhash.DRAWS))], simhash.draws(found)[1]))
    df = spark.createDataFrame(rows, "n long, rid binary, size long, drawn array<long>, sketch binary")
    edges = simhash.similar_texts(df, spark.createDataFrame([(bytes([n]), t) for n, t in enumerate(texts)], "rid binary, text string"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {n: n % 20 for n in range(40)}
