"""The language model against counts in Python, the pipeline against brute force, SQL against DuckDB."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from lodestrata.llm import ngram_lm, packing, queries
from lodestrata.llm.shared import load, table

SF = "/root/testdata/sf0.001"


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.c, self.big, self.ctx, self.follow, self.cont = Counter(), Counter(), Counter(), defaultdict(Counter), Counter()
        for t in texts:
            for a, b in zip([None, *t], t):
                self.c[b] += 1
                self.big[a, b] += 1
                self.ctx[a] += 1
        for (a, b), n in self.big.items():
            self.follow[a][min(n, 3)] += 1
            self.cont[b] += 1
        self.n, self.v, self.b = sum(self.c.values()), len(self.c), len(self.big)
        self.d, self.e = self.discounts(self.big.values()), self.discounts(self.cont.values())
        self.spare = sum(self.e[min(x, 3)] for x in self.cont.values()) / self.b

    def discounts(self, counts):
        n = [0, *(sum(x == i for x in counts) for i in (1, 2, 3, 4))]
        if not n[1] or not n[2]:
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k - 1e-3) if n[k] else 0.5 for k in (1, 2, 3)]

    def p(self, a, b):
        low = max(self.cont[b] - self.e[min(self.cont[b], 3)], 0) / self.b + self.spare / (self.v + 1)
        if not self.ctx[a]:
            return low
        n = self.big[a, b]
        return (n - self.d[min(n, 3)] + sum(self.d[k] * self.follow[a][k] for k in (1, 2, 3)) * low) / self.ctx[a]


def words(t):
    return (t or "").encode().lower().split() + [b"\n"]


@pytest.mark.parametrize("step", [4000, 1 << 20])
def test_model_equals_counts(spark, monkeypatch, step):
    monkeypatch.setattr(ngram_lm, "COUNT_STEP", step)
    monkeypatch.setattr(ngram_lm, "SCORE_STEP", step)
    docs = load(spark, SF, "documents").select("doc_id", "text").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "neverseen words qqq")]
    train = [r for r in rows if r[0] % 3]
    model = ngram_lm.train(spark.createDataFrame(train, "doc_id long, text string"))
    plain = Plain([words(t) for _, t in train])
    assert (model.tokens, model.types, model.bigrams) == (plain.n, plain.v, plain.b)
    got = {r["doc_id"]: r for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        w = words(t)
        base = sum(math.log10((plain.c[x] + 1) / (plain.n + plain.v + 1)) for x in w)
        full = sum(math.log10(plain.p(a, b)) for a, b in zip([None, *w], w))
        r = got[k]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in plain.c for x in w))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(full)
    for a in (None, b"the", b"neverseen"):
        assert sum(plain.p(a, b) for b in plain.c) + plain.p(a, b"unseen") == pytest.approx(1)


def test_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.train(none)
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = ngram_lm.score(one, model).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
    assert ngram_lm.score(none, ngram_lm.train(one)).count() == 0


def test_frequent_contexts_are_spread(spark):
    rows = [(i, f"hot w{i} hot v{i} hot u{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.train(df)
    sizes = [len(ngram_lm._map(a, "<u8")) for a, _ in model.pairs if a]
    assert sum(sizes) == model.bigrams and max(sizes) < 5 * sum(sizes) / len(sizes)
    plain = Plain([words(t) for _, t in rows])
    for r in ngram_lm.score(df.limit(20), model).collect():
        w = words(dict(rows)[r["doc_id"]])
        assert r["score"] == pytest.approx(sum(math.log10(plain.p(a, b)) for a, b in zip([None, *w], w)))


def simhash(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_pipeline_takes_empty_tables_and_clashing_names(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, rid string, __h string, size long, __keep long"
    rows = [(1, "one text about rivers", "en", "s", 21, "x", "y", 1, 2), (2, None, None, None, None, None, None, None, None), (None, "ships at sea", "en", None, 3, "x", "y", 1, 2)]
    for given in ([], rows):
        docs = table(spark.createDataFrame(given, kinds))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = table(stage(spark, docs, SF))
            assert out.columns == docs.columns
            docs = out
            if name != "mixing":  # which may leave out or repeat
                assert docs.count() == (2 if given else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_stages(spark):
    """Every stage but the mix and the packing against plain Python; those by their invariants."""
    docs = load(spark, SF, "documents")
    odd = [(10_001, None, "en", "s", 0), (10_002, "!! 12", "en", None, 0), (10_003, "", None, "s", 0)]
    docs = table(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = table(stage(spark, seen[-1], SF))
        assert out.columns == docs.columns
        seen.append(out)
    ids = [Counter(r["doc_id"] for r in df.select("doc_id").collect()) for df in seen]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids[0] - ids[1] == Counter([10_001, 10_002, 10_003])
    groups = defaultdict(list)
    for k in ids[1]:
        groups["".join(text[k].split())].append(k)
    assert set(ids[2]) == {min(g, key=lambda k: (-len(text[k]), k)) for g in groups.values()}
    fps = {k: simhash(text[k]) for k in ids[2]}
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(fps)
    words = {k: text[k].encode().lower().split() for k in names}
    runs = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(ids[3]) == {find(k) for k in names} and set(ids[3].values()) == {1}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    tok = packing._tokens(packing.default_tokenizer())
    lengths = Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    for k, n in ids[4].items():
        (x,) = tok.encode([text[k].encode()])
        assert lengths[k] == n * (len(x) // 4 + 1)
    full = Counter()
    for r in packed:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 4096 and len(full) <= -(-sum(full.values()) // 4096) + 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_op1_holds_out_a_third_and_gets_it_right(spark):
    got = queries.op1_language_id(spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
