"""The corpus operators against brute force, on small tables with the odd cases in them."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import (
    bpe,
    common,
    embed_dedup,
    exact_dedup,
    lm,
    mixing,
    ngram_join,
    quality,
    sharding,
    texthash,
    toxicity,
    url_filter,
)

FOLD = str.maketrans({k: k + 32 for k in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, a string, size int, digest string, label int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingles(text, k):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def docs_frame(spark, texts, sources=None, ids=None):
    """Documents with further columns whose names clash with the operators' own."""
    rows = [
        (ids[i] if ids else i, t, "en", sources[i] if sources else "s", len(t or ""), 1, "x", 2, "d", 3) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Near copies by edits, exact copies, a shared passage, empty, blank, short and long texts."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    base = [[word() for _ in range(rnd.randint(30, 90))] for _ in range(25)]
    passage = " ".join(word() for _ in range(25))
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(12):
            w = list(b)
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [f"{passage} {' '.join(word() for _ in range(rnd.randint(1, 12)))}" for _ in range(40)]
    texts += [texts[0].upper(), texts[0], texts[3], "", None, "  \n ", "one", "ONE", "two words", "a b c", "a b c d", "Ünï çödé ünï"]
    texts.append(" ".join(word() for _ in range(30_000)))
    return texts


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "percent", "frequent"), [(4, 85, 16), (5, 80, 4), (3, 60, 4)])
def test_ngram_join_matches_brute_force(spark, corpus, k, percent, frequent):
    got = ngram_join.ngram_jaccard_join(docs_frame(spark, corpus), words=k, percent=percent, frequent=frequent).collect()
    sets = [shingles(t, k) for t in corpus]
    want = components(sets, percent)
    assert len(got) == len(corpus)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]]


def test_ngram_join_keeps_representatives(spark, corpus):
    kept = ngram_join.keep_representatives(docs_frame(spark, corpus), words=4, percent=85)
    want = components([shingles(t, 4) for t in corpus], 85)
    assert kept.columns == docs_frame(spark, corpus).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in enumerate(want) if c == i)


def test_ngram_join_hub_with_rare_tokens(spark):
    """A hub shares its rare tokens with one of two linked texts: they don't count twice."""
    some = lambda name, n: [f"{name}{i}" for i in range(n)]
    f, g, t, v = some("f", 190), some("g", 40), some("t", 20), some("v", 20)
    texts = [f + g + t, f + t, f + v]
    texts += [f + some(f"p{i}x", 40) for i in range(20)] + [g + some(f"q{i}x", 200) for i in range(60)]
    got = ngram_join.ngram_jaccard_join(docs_frame(spark, [" ".join(x) for x in texts]), words=1, percent=80).collect()
    want = components([frozenset(x) for x in texts], 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want)) and want[2] == 0


def test_set_ids_that_clash_are_made_anew():
    tokens = np.arange(40, dtype=np.uint64)
    offsets, kinds = np.array([0, 20, 40]), np.zeros(40, np.uint8)
    node, second = ngram_join.nodes_of(tokens, offsets, kinds)
    again, same = ngram_join.nodes_of(tokens, offsets, kinds, frozenset([int(node[0])]))
    assert again[0] != node[0] and again[1] == node[1] and (again >= 0).all() and (same == second).all()


def test_a_task_remembers_few_sets():
    fresh = ngram_join._Fresh()
    nodes = np.array([5, 9, 5, 7])
    assert fresh.of(nodes, np.array([0, 1, 2, 3, 3])).tolist() == [0, 1]
    assert fresh.of(np.array([9, 5 + ngram_join.RECENT]), np.array([0, 1, 2])).tolist() == [1]
    assert fresh.of(np.array([5]), np.array([0, 1])).tolist() == [0]


def test_ngram_join_sends_no_rows_of_sets_to_the_driver(spark, corpus, monkeypatch):
    """Frequent tokens aside, no table is pulled row by row, so no fingerprints of all documents are."""
    pulled, pull = [], type(spark.range(0)).toLocalIterator
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda df, *a, **b: pulled.append(df.columns) or pull(df, *a, **b))
    ngram_join.ngram_jaccard_join(docs_frame(spark, corpus[:20]), words=4, percent=85)
    assert all("node" not in columns for columns in pulled)


def test_ngram_join_odd_rows(spark):
    empty = docs_frame(spark, ["x"]).where("false")
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    df = docs_frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[5, 5, None, None])
    rows = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df).collect()), key=str)
    assert rows == sorted([(5, 5), (5, 5), (None, 5), (None, None)], key=str)


def test_signatures_always_meet():
    """Two sets that link share a signature, whatever the classes of their tokens."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = int(rnd.integers(1, 120))
        base = rnd.integers(1, 2**63, n, dtype=np.uint64)
        x, y = set(base.tolist()), set(base.tolist())
        kinds = {t: int(rnd.integers(0, 4)) * int(rnd.random() < rnd.random()) for t in x}
        for s in (x, y):
            for t in list(s):
                if rnd.random() < 0.06:
                    s.discard(t)
                    new = int(rnd.integers(1, 2**63))
                    kinds[new] = int(rnd.integers(0, 3))
                    s.add(new)
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        both = []
        for s in (x, y):
            tokens = np.array(sorted(s), np.uint64)
            rare, combos = ngram_join.signatures(tokens, np.array([kinds[t] for t in tokens.tolist()], np.uint8), 85)
            both.append(set(rare.tolist()) | set(combos.tolist()))
        assert both[0] & both[1]


def test_packed_values_round_trip():
    for values in ([], [5], [0, 0, 1], [3, 2**63, 2**64 - 1]):
        a = np.array(values, np.uint64)
        assert ngram_join._unpack_sorted(ngram_join._pack_sorted(a)).tolist() == values
    rng = np.random.default_rng(7)
    for bits in (1, 7, 8, 17, 48, 64):
        for n in (2, 3, 9, 4000):
            a = np.sort(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
            assert (ngram_join._unpack_sorted(ngram_join._pack_sorted(a)) == a).all()
    even = np.sort(rng.integers(0, 2**48, 4000, dtype=np.uint64))
    assert len(ngram_join._pack_sorted(even)) < 4000 * (48 - 12 + 3) / 8 + 17


def test_discarded_tables_leave_the_shared_folder(spark):
    kept, gone = common.materialize(spark.range(10)), common.materialize(spark.range(20))
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    common.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 10


def test_word_hashes(monkeypatch):
    texts = [None, "", " ", "a", "A b\x0bc", "x" * 5000, "é É", "one  two\nthree " * 400]
    h, counts = texthash.word_hashes(pa.array(texts))
    assert counts.tolist() == [len(words(t)) for t in texts]
    known = {}
    for w, v in zip((w for t in texts for w in words(t)), h.tolist(), strict=True):
        assert known.setdefault(w, v) == v
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(texthash, "WINDOW", 100)
    assert texthash.word_hashes(pa.array(texts))[0].tolist() == h.tolist()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(7, 7), (None, 3)]
    roots = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges[:-1]:
        parent[find(a)] = find(b)
    assert set(roots) == set(parent)
    for a, b in itertools.combinations(sorted(roots)[::7], 2):
        assert (roots[a] == roots[b]) == (find(a) == find(b))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact dedup


def test_exact_dedup(spark, corpus):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_frame(spark, corpus)).collect()}
    groups = {}
    for i, t in enumerate(corpus):
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            assert got[i]["keep_id"] == max(ids) and got[i]["group_size"] == len(ids) and got[i]["kept"] == (i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.keep_last_copies(docs_frame(spark, corpus))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_odd_rows(spark):
    assert exact_dedup.exact_dedup(docs_frame(spark, ["x"]).where("false")).count() == 0
    df = docs_frame(spark, ["A", "a", "b", None, ""], ids=[1, None, None, 4, 4])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (None, 1, 2, False), (None, None, 1, True), (4, 4, 2, True), (4, 4, 2, True)], key=str)
    gone = docs_frame(spark, ["B"])
    live = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_frame(spark, ["a", "b"]), withdrawn=gone).collect()}
    assert live[0]["kept"] and not live[1]["kept"] and live[1]["group_size"] == 0


def test_exact_dedup_stage_keeps_texts_of_repeated_ids(spark):
    df = docs_frame(spark, ["a", "b", "a", "b", "c", None, ""], ids=[1, 1, 2, None, None, 5, 6])
    kept = exact_dedup.keep_last_copies(df)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "b"), (2, "a"), (None, "c"), (6, "")], key=str)


def test_cuckoo_index():
    rnd = random.Random(4)
    index, live = exact_dedup.CuckooIndex(4), {}
    for step in range(6000):
        d = hashlib.sha256(str(rnd.randrange(2500)).encode()).digest()
        if rnd.random() < 0.35:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            index.put(d, step)
            live[d] = step
    assert len(index) == len(live) and index.resizes > 3
    assert dict(index.items()) == live
    for i in range(2500):
        d = hashlib.sha256(str(i).encode()).digest()
        assert index.get(d) == live.get(d)


def test_cuckoo_overflow_of_one_bucket():
    """Digests that agree in everything the filter sees force resizes and stay apart."""
    index = exact_dedup.CuckooIndex(2)
    same = [hashlib.sha256(b"x").digest()[:20] + bytes([i]) * 12 for i in range(7)]
    for i, d in enumerate(same):
        index.put(d, i)
    assert [index.get(d) for d in same] == list(range(7))


# ---- classifiers


def test_grammar_marks():
    scorer = toxicity.Scorer({"idiot": 2.0}, np.zeros(toxicity.CLASSES + 3))
    marks = lambda t: {i for i, v in enumerate(scorer.features(t)[: toxicity.CLASSES]) if v}
    assert marks("the idiot ran") == {1}
    assert marks("you are an idiot") == {2}
    assert marks("you are not an idiot") == {4}
    assert marks("she said you are an idiot") == {6}
    assert marks("not you. an idiot") == {1}
    assert marks("idiot, you are") == {2} and marks("you idiot, he said") == {6}
    assert marks("you " + "w " * 60 + "idiot") == {2}
    assert marks("not nice but an idiot") == {1} and marks("so idiot") == {9}
    assert marks("i will kill you") == {26} and marks("you, i will hurt") == {26} and marks("ich werde dich töten") == {26}
    assert marks("he kills you") == {18} and marks("they kill the lights") == set()
    assert marks("") == set() and marks("plain words") == set()
    assert scorer.features("idiot " * 50_000).shape == (toxicity.CLASSES + 2,)


def test_grammar_equals_brute_force():
    """The bimachine against the rules read off each clause by itself."""
    terms = {"idiot": 2.0, "scum": 1.5}
    scorer = toxicity.Scorer(terms, np.zeros(toxicity.CLASSES + 3))
    lists = [
        ("target", toxicity.TARGETS), ("negator", toxicity.NEGATORS), ("reporter", toxicity.REPORTERS), ("turn", toxicity.TURNS),
        ("insult", terms), ("harm", toxicity.HARM_FORMS), ("intent", toxicity.INTENTS), ("stress", toxicity.STRESS),
    ]
    kind_of = lambda w: next((k for k, held in lists if w in held), "")
    rnd = random.Random(3)
    pool = ["idiot", "scum", "you", "dich", "not", "said", "but", "kill", "hurts", "will", "so", "der", "x", "y", "z", "plain"]
    for _ in range(400):
        text = "".join(rnd.choice(pool) + rnd.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rnd.randint(1, 40)))
        want = [0.0] * toxicity.CLASSES
        for clause in re.split(r"[.!?;\n]", text):
            ws = re.findall(r"\w+", clause)
            kinds = [kind_of(w) for w in ws]
            if not set(kinds) & {"insult", "harm"}:
                continue
            for i, k in enumerate(kinds):
                others, seen, before = kinds[:i] + kinds[i + 1 :], set(kinds[: i + 1]), set(kinds[:i])
                both = {"harm", "target"}
                if k == "insult":
                    kind, weight = (1 if i and kinds[i - 1] in ("insult", "stress") else 0), terms[ws[i]]
                elif both <= seen and (not both <= before or k == "harm" or (k == "intent" and "intent" not in before)):
                    kind, weight = (3 if "intent" in seen else 2), 1.0
                else:
                    continue
                negated = any(kinds[j] == "negator" and "turn" not in kinds[j:i] for j in range(max(0, i - 3), i))
                bits = (kind >= 2 or "target" in others) + 2 * negated + 4 * ("reporter" in others)
                want[1 + 8 * kind + bits] += weight
        assert np.expm1(scorer.features(text)[: toxicity.CLASSES]) == pytest.approx(want), text


@pytest.mark.parametrize("run", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_on_odd_rows(spark, run):
    """Null and repeated ids, repeated labels, null and very long texts, a threshold that is hit exactly."""
    docs, labels, _ = labelled(spark, 200)
    odd = docs_frame(spark, [None, "", "zzidiot you", "zzidiot you", "word " * 200_000], ids=[None, None, 7, 7, 5000])
    again = labels.unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality", "CAST(NULL AS INT) AS toxic"))
    rows = run(docs.unionByName(odd), again).collect()
    assert len(rows) == 207
    score = next(r["score"] for r in rows if r["doc_id"] == 5000)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    edge = {r["doc_id"]: r for r in run(docs.unionByName(odd), again, threshold=score).collect()}
    assert edge[5000]["predicted"] == 1
    few = run(docs, labels, sample_rows=20).collect()
    assert len(few) == 202 and all(0 <= r["score"] <= 1 for r in few)


def labelled(spark, n=900):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    insults = ["zzidiot", "zzmoron", "zzscum"]
    texts, rows = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 3 != 0
        w = [word() for _ in range(rnd.randint(20, 60))]
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(insults))
        if not good:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
        rows.append((i, int(good), int(toxic)))
    return docs_frame(spark, [*texts, "", None]), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize(("which", "column"), [("toxicity", 2), ("quality", 1)])
def test_classifiers_on_held_out_rows(spark, which, column):
    docs, labels, rows = labelled(spark)
    run = toxicity.toxicity_scores if which == "toxicity" else quality.quality_scores
    got = {r["doc_id"]: r for r in run(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if got[r[0]]["held_out"]]
    right = sum(got[r[0]]["predicted"] == r[column] for r in held)
    assert right / len(held) > 0.95
    # labels of held-out rows don't matter
    flipped = labels.selectExpr("doc_id", *(f"IF(pmod(crc32(cast(doc_id as string)), 3) = 1, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")))
    again = {r["doc_id"]: r["score"] for r in run(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


@pytest.mark.parametrize("run", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_without_rows_or_labels(spark, run):
    docs, labels, _ = labelled(spark, 30)
    assert run(docs.where("false"), labels).count() == 0
    scores = [r["score"] for r in run(docs, labels.where("false")).collect()]
    assert len(scores) == 32 and all(abs(s - 0.5) < 1e-6 for s in scores)


def test_drop_toxic_keeps_clean_rows(spark):
    docs, labels, rows = labelled(spark)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert {r[0] for r in rows if not r[2]} <= kept and {900, 901} <= kept
    assert not kept & {r[0] for r in rows if r[2]}


def test_gam_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_gam(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}


# ---- language model


class Backoff:
    """The model by its recursion: an n-gram that was seen, or the weight of failing and a shorter one."""

    def __init__(self, texts, strengths):
        self.counts, self.strengths = Counter(), strengths
        for t in texts:
            at = ["\0end", *t]
            for k in range(1, len(strengths) + 2):
                self.counts.update(tuple(at[i : i + k]) for i in range(1 if k == 1 else 0, len(at) - k + 1))
        self.n = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.counts)

    def p(self, history, w):
        if not history:
            return (self.counts[w,] + 1) / (self.n + self.v + 1)
        c, k = self.counts[history], self.strengths[len(history) - 1]
        if not c:
            return self.p(history[1:], w)
        fail = k / (c + k)
        return self.counts[*history, w] / (c + k) + fail * self.p(history[1:], w)

    def text(self, t):
        at, longest = ["\0end", *t], len(self.strengths)
        return sum(math.log10(self.p(tuple(at[max(0, i - longest) : i]), at[i])) for i in range(1, len(at)))


@pytest.mark.parametrize("strengths", [(20.0, 5.0), (3.0,), (8.0, 4.0, 2.0), ()])
def test_lm_matches_brute_force(spark, corpus, strengths, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    got = {r["doc_id"]: r for r in lm.lm_score(docs_frame(spark, corpus), strengths=strengths).collect()}
    tokens = {i: [*words(t), "\0end"] for i, t in enumerate(corpus)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    model = Backoff([tokens[i] for i in train], strengths)
    uni = lambda w: model.p((), w)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i not in train, len(t), model.n)
        assert r["n_known"] == sum(model.counts[w,] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10(uni(w)) for w in t))
        assert r["score"] == pytest.approx(model.text(t))
    # a state's arcs and its failure arc sum to one
    words_seen = [g[0] for g in model.counts if len(g) == 1]
    for history in list(model.counts)[:40:7]:
        history = history[: len(strengths)]
        assert sum(model.p(history, w) for w in words_seen) + model.p(history, "never seen") == pytest.approx(1)


def test_packed_counts_round_trip():
    for counts in ([], [0], [3, 2, 1, 0, 254, 255, 256, 2**40], list(range(600))):
        a = np.array(counts, np.int64)
        assert lm._unpack_counts(*lm._pack_counts(a), len(a)).tolist() == counts


def test_lm_odd_tables(spark):
    assert lm.lm_score(docs_frame(spark, ["x"]).where("false")).count() == 0
    got = lm.lm_score(docs_frame(spark, ["a b", "a b", None], ids=[None, None, None])).collect()
    assert len(got) == 3 and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


# ---- embeddings


def test_embedding_dedup_matches_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(120, 12))
    vectors = [*base, *(base[i % 30] + rnd.normal(size=12) * 0.06 for i in range(150)), *base[:5], base[0] * 3]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3) if i < 200 else 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 12, 0), (n + 2, [float("nan")] * 12, 0), (n + 3, rows[0][1], None), (n + 4, [], 0), (n + 5, [1.0, None], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, space string, key int")
    got = {r["vec_id"]: r for r in embed_dedup.cosine_near_dedup(df).collect()}
    ok = {i: np.array(v, np.float64) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    label = {i: lab for i, _, lab in rows}
    near = {i: {j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.98} for i in ok}
    assert len(got) == len(rows)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i]["n_links"] == len(near.get(i, ())) and got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert embed_dedup.cosine_near_dedup(df.where("false")).count() == 0


def test_embedding_cells_and_blocks(spark, monkeypatch):
    """Many pivots and tiny blocks give the same links."""
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(40, 6))
    rows = [(i, [float(x) for x in base[i % 40] + rnd.normal(size=6) * 0.05], 0) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    read = lambda: sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.cosine_near_dedup(df).collect())
    plain = read()
    monkeypatch.setattr(embed_dedup, "PER_PIVOT", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    assert read() == plain


# ---- mixing


def water(sizes, weights, share, passes):
    """Targets by rounds: what a capped source can't take is shared out again."""
    total, target, left = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in left)
        level = rest / sum(weights[i] for i in left)
        over = {i for i in left if weights[i] * level > passes * sizes[i]}
        for i in over or left:
            target[i] = passes * sizes[i] if over else weights[i] * level
        left -= over or left
    return target


def test_mixing_targets_and_positions(spark):
    rnd = random.Random(6)
    texts = ["w " * rnd.choice([0, 1, 5, 30, 200]) for _ in range(300)]
    sources = [rnd.choice(["b", "a", "a", "a", None, "é", "Z"]) for _ in texts]
    docs = docs_frame(spark, texts, sources)
    got = mixing.mix_sources(docs).collect()
    order = sorted({s for s in sources if s}) + [None]
    sizes = [sum(len(words(t)) for t, s in zip(texts, sources, strict=True) if s == o) for o in order]
    target = dict(zip(order, water(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    taken = Counter()
    for r in got:
        i = r["doc_id"]
        assert r["size"] == len(words(texts[i])) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[sources[i]]) and r["source_size"] == sizes[order.index(sources[i])]
        assert len(r["positions"]) == math.ceil(r["taken"] / max(1, r["size"])) and all(0 <= p <= 1 for p in r["positions"])
        taken[sources[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    first = [r["positions"][0] for r in got if r["positions"]]
    assert first == sorted(first)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # positions invert the source's cumulative demand, over all passes
    for k, s in enumerate(order):
        a, b = mixing.SCHEDULES[k % 3]
        demand = lambda t: (a * t + (b - a) * t * t / 2) / ((a + b) / 2)  # noqa: B023, E731
        stream = sorted((p, r["size"], n) for r in got if sources[r["doc_id"]] == s for n, p in enumerate(r["positions"]))
        begin = 0
        for p, size, _ in stream:
            assert demand(p) * target[s] == pytest.approx(begin, abs=1e-3 * max(1, target[s]))
            begin += size
        if target[s] == 2 * sizes[k]:
            assert {n for *_, n in stream} == {0, 1} and stream[-1][0] > 0.8
            assert max(p for p, _, n in stream if n == 0) < min(p for p, _, n in stream if n == 1)
    mix = mixing.take_mix(docs)
    assert mix.columns == docs.columns
    times = Counter(r["doc_id"] for r in mix.collect())
    assert all(abs(times[r["doc_id"]] * r["size"] - r["taken"]) <= r["size"] / 2 for r in got if r["size"])


def test_mixing_odd_tables(spark):
    assert mixing.mix_sources(docs_frame(spark, ["x"]).where("false")).count() == 0
    got = mixing.mix_sources(docs_frame(spark, ["", None, " "])).collect()
    assert [(r["size"], r["taken"], r["positions"]) for r in got] == [(0, 0, [])] * 3
    twice = mixing.mix_sources(docs_frame(spark, ["a b", "a b"], ids=[1, 1])).collect()
    assert sum(r["taken"] for r in twice) == 6


def test_mixing_plan_has_no_python(spark, corpus):
    plan = mixing.mix_sources(docs_frame(spark, corpus))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


# ---- sharding


def test_sharding(spark):
    rnd = random.Random(1)
    texts = ["é" * rnd.randint(0, 900) for _ in range(400)] + ["big" * 5000, "same", "same", None]
    ids = [*range(401), 401, 401, None]
    limit = 6000
    got = sharding.shard_documents(docs_frame(spark, texts, ids=ids), limit_bytes=limit).collect()
    hashes = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16) for i, t in zip(ids, texts, strict=True)]
    size = lambda t: len((t or "").encode())
    bits = [f"{h:060b}" for h in hashes]

    def depth(b):
        for d in range(61):
            inside = [i for i, x in enumerate(bits) if x.startswith(b[:d])]
            if sum(size(texts[i]) for i in inside) <= limit or len({bits[i] for i in inside}) == 1:
                return d
        return 60

    want = Counter((i, size(t), b[: depth(b)]) for i, t, b in zip(ids, texts, bits, strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["shard"]) for r in got) == want
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["n_bytes"]
    for r in got:
        assert len(r["shard"]) == r["depth"] and sums[r["shard"]] == r["shard_bytes"]
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
    assert sharding.shard_documents(docs_frame(spark, ["x"]).where("false")).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(docs_frame(spark, ["a", "b"])).collect()} == {""}


def test_written_shards(spark, tmp_path):
    docs = docs_frame(spark, [f"text {i}" * 10 for i in range(60)])
    sharding.write_shards(docs, str(tmp_path / "out"), limit_bytes=1500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() > 1
    twice = docs_frame(spark, ["a", "a", "b", "c", None], ids=[1, 1, 1, None, None]).withColumnRenamed("a", "shard")
    sharding.write_shards(twice, str(tmp_path / "odd"), limit_bytes=1)
    got = sorted(((r["doc_id"], r["text"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "odd")).collect()), key=str)
    assert got == sorted([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, "c", "x"), (None, None, "x")], key=str)
    sharding.write_shards(twice.where("false"), str(tmp_path / "none"))


# ---- BPE

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rnd = random.Random(12)
    alphabet = "abc'sté ß漢字🙂\u00a0\u2003  \n\n\t\r.,!?0123456789#<|>ABC"
    out = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (1, 5, 50, 400, 3000, 9000)]
    out += ["x" * 6000, " " * 5000, "\n" * 3001 + "a", "ab" * 4000, "'s" * 3000, "12" * 3000, "漢" * 4000, "!?" * 3000]
    out += ["a <|endoftext|> b" * 300, "<|endof", "<|endoftext|>" * 400, "word " * 3000, "the quick  brown fox's " * 500, "", " ", "a"]
    return out


def test_tree_concatenation_equals_whole_encoding(library):
    of = bpe.codec(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert of.encode(text) == want
        for piece in (700, 1024, 4001):
            if len(text) > piece:
                parts = [of.encode(text[i : i + piece]) for i in range(0, len(text), piece)]
                assert of.join_tree(parts) == want, (text[:30], piece)
        assert of.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_roundtrip(spark, library, monkeypatch):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*odd_texts(), None, "one two " * 20_000, "one two " * 20_000]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    monkeypatch.setattr(bpe, "LONG_CHARS", 2000)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 900)
    got = Counter(tuple(r) for r in bpe.bpe_roundtrip(docs_frame(spark, texts, ids=ids), path).collect())
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        e = library.encode(t or "", add_special_tokens=False).ids
        d = library.decode(e, skip_special_tokens=False)
        want[i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.bpe_roundtrip(docs_frame(spark, ["x"]).where("false"), path).count() == 0
    first = bpe.bpe_tokens(docs_frame(spark, ["a b", None]), path).orderBy("doc_id").collect()
    assert list(first[0]["ids"]) == library.encode("a b").ids and list(first[1]["ids"]) == []


# ---- URL filters


def test_url_filter(spark):
    urls = [
        "http://www.example.net/en/1", "https://EXAMPLE.net/de/", "http://example.net", "http://net/", "ftp://a.b.example.com/de/x?q#f",
        "http://example.org/fr/1", "http://example.org/", "no scheme", None, "", "http://", "x://h?/en/", "http://badexample.com/de/", "http://a.net/#://b", "http://a.net/?://c/",
        "http://example.com/de/", "http://example.com/de/", "://net/\n",
    ]
    df = spark.createDataFrame([(i, u, "h", "host") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = url_filter.rule_table(spark, url_filter.DEFAULT_RULES)

    def want(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(df, rules).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    same = url_filter.url_filter(df.selectExpr("1L AS page_id", "url").where("url LIKE '%com/de/'"), rules)
    assert same.count() == 3
    assert url_filter.url_filter(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(df, rules.where("false")).collect()} == {"allow"}
    shuffled = rules.unionByName(spark.createDataFrame([("net", "/", "allow")], rules.schema))
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_filter(df, shuffled).collect()}[3] == "block"


def test_url_filter_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.url_filter(df, spark.sql("SELECT 'net' AS host, '/' AS path, 'block' AS verdict"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])
