"""Document operators against brute force, and on odd and empty tables."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orogen.llm import line_quality, mixing, ngram_join, packing, queries, sharding, suffix_dedup, toxicity, word_bpe

SF = "/root/testdata/sf0.001"


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# --- toxicity and quality ---


def scores_of(spark, name, label, folds, held):
    out = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % folds == held for i in out.doc_id]).all()
    return out[out.held_out].merge(labels, on="doc_id").rename(columns={label: "y"})


def auc(frame):
    rank, good = frame.score.rank(), frame.y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_toxicity_held_out(spark):
    got = scores_of(spark, "op1_toxicity", "toxic", 3, 1)
    assert auc(got) > 0.85 and not ((got.predicted == 1) & (got.y == 0)).mean() > 0.02
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_held_out(spark):
    got = scores_of(spark, "op9_quality_classifier", "quality", 5, 0)
    assert auc(got) > 0.98 and ((got.predicted == 1) & (got.y == 1)).sum() >= 0.97 * (got.y == 1).sum()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_ftrl_is_sparse():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [np.unique(np.concatenate([rng.integers(10, 500, 30), [1 if v else 2]])) for v in y]
    at, w = toxicity.ftrl(rows, y.astype(float), dim=512)
    weight = dict(zip(at, w))
    assert weight[1] > 1 and weight[2] < -1 and len(at) < 250
    assert toxicity.ftrl([], np.empty(0), dim=8)[0].size == 0


def test_ftrl_by_a_plain_loop():
    """The vectorised passes against FTRL-proximal written out one coordinate at a time."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 60).astype(float)
    rows = [np.unique(np.concatenate([rng.integers(8, 40, 6), [1 if y else 2]])).astype("i4") for y in labels]
    dim, alpha, beta, l1, l2 = 64, 0.8, 1.0, 0.3, 0.5
    at, w = toxicity.ftrl(rows, labels, dim, 3, alpha, beta, l1, l2)
    times = collections.Counter(int(c) for r in rows for c in r)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(c):
        pull = 0.0 if c == dim else l1
        if abs(z[c]) <= pull:
            return 0.0
        return -(z[c] - math.copysign(pull, z[c])) / ((beta + math.sqrt(n[c])) / alpha + l2)

    order = np.random.default_rng(1)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            own = [int(c) for c in rows[i] if times[int(c)] >= toxicity.LEAST] + [dim]
            now = {c: weight(c) for c in own}
            g = 1 / (1 + math.exp(-sum(now.values()))) - labels[i]
            for c in own:
                sigma = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha
                z[c] += g - sigma * now[c]
                n[c] += g * g
    want = {c: weight(c) for c in z if weight(c) != 0}
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[c] for c in at.tolist()])


def test_fit_follows_the_gradient_of_the_likelihood():
    """Gradients of weights and steps against differences of the log-likelihood, by enumeration."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    counts = np.array([4, 1, 3])
    bins = rng.integers(0, line_quality.BINS, (8, line_quality.GROUPS))
    labels = np.array([1, 1, 1, 1, 0, 1, 0, 0.0])
    weight = np.ones(8)
    chain = line_quality.Chain(rng.normal(size=(line_quality.GROUPS, line_quality.BINS)), rng.normal(size=(2, 2)))

    def likelihood():
        total, at, e = 0.0, 0, chain.leaning(bins)
        for size in counts:
            def value(ys, at=at):
                return sum(e[at + t] * y for t, y in enumerate(ys)) + sum(chain.step[int(a), int(b)] for a, b in itertools.pairwise(ys))

            total += value(labels[at : at + size]) - np.log(sum(np.exp(value(ys)) for ys in itertools.product((0, 1), repeat=size)))
            at += size
        return total

    g_w, g_s = line_quality.gradients(chain, counts, bins, labels, weight)
    for table, found in ((chain.w, g_w), (chain.step, g_s)):
        for k in range(0, table.size, 7) if table.size > 4 else range(4):
            old = table.flat[k]
            sides = []
            for move in (1e-5, -1e-5):
                table.flat[k] = old + move
                sides.append(likelihood())
            table.flat[k] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - found.flat[k]) < 1e-4


def test_forward_backward_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    chain = line_quality.Chain(rng.normal(size=(line_quality.GROUPS, line_quality.BINS)), rng.normal(size=(2, 2)))
    bins = rng.integers(0, line_quality.BINS, (9, line_quality.GROUPS))
    e, counts = chain.leaning(bins), np.array([4, 1, 4])
    f, b = chain.messages(e, counts)
    for start, n in ((0, 4), (4, 1), (5, 4)):
        p = np.zeros((n, 2))
        for ys in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(e[start + t] * y for t, y in enumerate(ys)) + sum(chain.step[a, c] for a, c in itertools.pairwise(ys)))
            for t, y in enumerate(ys):
                p[t, y] += s
        assert np.allclose(np.log(p[:, 1] / p[:, 0]), (f + b)[start : start + n])


def test_classifiers_on_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, line_quality):
        out = module.classify(odd_docs, labels)
        assert out.count() == odd_docs.count() and out.where("score between 0 and 1 and predicted is not null and held_out is not null").count() == odd_docs.count()
        assert module.classify(no_docs, labels).count() == 0
        assert module.classify(odd_docs, labels.limit(0)).select("score").distinct().collect() == [(0.5,)]
    assert line_quality.good_documents(odd_docs, labels.limit(0)).columns == odd_docs.columns


# --- sharding ---


def test_sharding(spark, odd_docs, no_docs, tmp_path):
    got = queries.queries()["op2_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    want = texts(spark, "/root/testdata/sf0.01")
    assert sorted(got.doc_id) == sorted(want)
    assert all(r.size == len(want[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id].encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples())
    loads = got.groupby("shard")["size"].sum()
    assert sorted(loads.index) == list(range(16)) and loads.max() <= 1.01 * loads.min()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    odd = sharding.shard_documents(odd_docs, n_shards=3, map_path=str(tmp_path))
    rows = odd.toPandas()
    assert len(rows) == odd_docs.count() and all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])
    stored = sharding.load_map(spark, str(tmp_path), 1)
    assert stored.n_shards == 3 and all(stored.shards[r.virtual_slot] == r.shard for r in rows[["virtual_slot", "shard"]].itertuples())
    assert sharding.shard_documents(no_docs).count() == 0
    again = sharding.shard_documents(odd_docs, n_shards=4, map_path=str(tmp_path)).toPandas()
    assert set(again.map_version) == {2} and sharding.latest_version(spark, str(tmp_path)) == 2 and set(again.shard) <= set(range(4))


def test_equal_texts_share_a_shard(spark):
    """However heavy a group of equal texts is, it stays whole; the other shards stay near equal."""
    made = [(i, "same text " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * 20) for i in range(3000)] + [(5000, None), (5001, "")]
    got = sharding.shard_documents(spark.createDataFrame(made, "doc_id long, text string"), n_shards=16).toPandas().merge(__import__("pandas").DataFrame(made, columns=["doc_id", "text"]), on="doc_id")
    assert got.fillna("").groupby("text")["shard"].nunique().max() == 1 and len(got) == len(made)
    loads = sorted(got.groupby("shard")["size"].sum())
    assert loads[-2] <= 1.05 * loads[0] and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_rebalance_moves_little():
    rng = random.Random(0)
    sizes = {s: rng.randrange(1, 1000) for s in range(512)}
    old = sharding.rebalance(sharding.first_map(8, 512), sizes)
    sizes[7] += 5000
    new = sharding.rebalance(old, sizes)
    assert new.version == 2 and sum(a != b for a, b in zip(old.shards, new.shards)) < 60
    load = [sum(v for s, v in sizes.items() if new.shards[s] == k) for k in range(8)]
    assert max(load) - min(load) <= 40


# --- n-gram join ---


def shingles(text, n=5):
    w = text.split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def links_of(sets, threshold=0.8):
    """Brute force: links and smallest reachable id of each id."""
    ids = sorted(sets)
    near = {i: set() for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    low = {}
    for i in ids:
        if i not in low:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in low:
                    low[j] = i
                    todo += near[j]
    return near, low


def near_copies(n, base, rng, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join(spark):
    want = texts(spark)
    near, low = links_of({i: shingles(t) for i, t in want.items()})
    got = {r["doc_id"]: r for r in queries.queries()["op3_ngram_jaccard_join"](spark, SF).collect()}
    assert all(got[i]["n_links"] == len(near[i]) and got[i]["class_id"] == low[i] and got[i]["kept"] == (low[i] == i) for i in want)


def test_ngram_join_of_one_large_group(spark):
    """More near copies of one text than a block holds: every link is counted, across blocks, too."""
    rng = random.Random(5)
    made = near_copies(3 * ngram_join.BLOCK, " ".join(f"w{i}" for i in range(150)), rng, 6) + near_copies(20, " ".join(f"v{i}" for i in range(60)), rng, 4)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    near, low = links_of({i: shingles(t) for i, t in enumerate(made)})
    got = {r["doc_id"]: r for r in ngram_join.join_documents(docs).collect()}
    missed = sum(len(near[i]) - got[i]["n_links"] for i in got)
    assert 0 <= missed <= 0.002 * sum(map(len, near.values())) and all(got[i]["class_id"] == low[i] for i in got)


def test_ngram_join_on_odd_tables(odd_docs, no_docs):
    got = [tuple(r) for r in ngram_join.join_documents(odd_docs).select("doc_id", "class_id", "n_links").collect()]
    by = {g[0]: g for g in got if g[0] is not None}
    assert len(got) == odd_docs.count() and by[1][1:] == (1, 3) and by[3][1:] == (1, 3) and by[5] == (5, 5, 0) and by[8][1:] == (8, 1)
    assert {g[1:] for g in got if g[0] is None} == {(8, 1), (None, 0)}
    first = ngram_join.first_of_each(odd_docs)
    ids = [r["doc_id"] for r in first.select("doc_id").collect()]
    assert first.columns == odd_docs.columns and ids.count(1) == 1 and not {2, 3} & set(ids) and {4, 5, 6, 7, 9, 10} <= set(ids)
    assert ngram_join.join_documents(no_docs).count() == 0 and ngram_join.first_of_each(no_docs).count() == 0


def test_first_of_each_class_of_one_class_id(spark):
    """Classes whose smallest doc_id is the same, or null, stay apart."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, a + " x"), (None, b), (None, b), (7, c), (9, c), (7, d), (11, d + " x"), (None, None), (None, ""), (None, "")]
    got = [tuple(r) for r in ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(i is None and (t or "").startswith("a0 ") for i, t in got) == 1
    assert sorted(map(str, (g for g in got if not (g[1] or "").startswith("a0 ")))) == sorted(map(str, [(None, b), (7, c), (7, d), (None, None), (None, "")]))


# --- mixing ---


def water(sizes, weights=(5, 2, 1)):
    """Targets by the rule's words: share by weight, cap, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, wrest = total - sum(3 * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * w[s] / wrest for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(got, words):
    sizes = collections.Counter()
    for s, n in words:
        sizes[s] += n
    target = water(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mixing(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [(r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    got = mixing.mix_documents(docs).collect()
    check_mix(got, words)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(7)).collect()))
    rows = odd_docs.select("source", "text").collect()
    check_mix(mixing.mix_documents(odd_docs).collect(), [(r["source"], len([x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])) for r in rows])
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.take_words(no_docs).count() == 0


def test_mixing_caps_in_turn(spark):
    made = [(i, "a b c", "s1") for i in range(2)] + [(i, "a b c d", "s2") for i in range(10, 60)] + [(i, "x", "s3") for i in range(100, 400)] + [(900, "q", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    check_mix(mixing.mix_documents(docs).collect(), [(s, len(t.split())) for _, t, s in made])


def test_taken_words(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.mix_documents(docs).collect()}
    taken, old = collections.Counter(), texts(spark)
    for r in mixing.take_words(docs).collect():
        assert old[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(taken[i] == r["taken"] for i, r in plan.items())
    out = mixing.take_words(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0


def test_taken_words_of_each_source(spark):
    """Rows of several sources that agree in doc_id and size: each source gets its own takings."""
    made = [(i, " ".join(f"{s}{k}" for k in range(10)), s or None) for s, n in (("a", 40), ("b", 6), ("c", 1), ("", 3)) for i in [None] * n + [7]]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    want, got = collections.Counter(), collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r["source"], r["doc_id"]] += r["taken"]
    for r in mixing.take_words(docs).collect():
        assert all(w.startswith(r["source"] or "") for w in r["text"].split())
        got[r["source"], r["doc_id"]] += len(r["text"].split())
    assert got == +want


# --- packing ---


def whole_ids(all_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids + [1] for e in t.encode_batch(all_texts, add_special_tokens=False)]


def check_packing(rows, ids_of):
    import numpy as np

    seen = collections.Counter()
    for r in rows:
        ids = ids_of.get(r["doc_id"])
        if ids is None:
            continue
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return seen, by


def test_packing(spark, odd_docs, no_docs):
    want = texts(spark, "/root/testdata/sf0.01")
    ids = dict(zip(want, whole_ids(list(want.values()))))
    rows = queries.queries()["op5_packing"](spark, "/root/testdata/sf0.01").collect()
    seen, by = check_packing(rows, ids)
    assert all(seen[i] == len(x) for i, x in ids.items()) and sum(seen.values()) > 0.99 * packing.WINDOW * len(by)
    odd = [r for r in odd_docs.select("doc_id", "text").collect()]
    made = packing.pack_documents(odd_docs, keep_ids=True).collect()
    ids = {r["doc_id"]: x for r, x in zip(odd, whole_ids([r["text"] or "" for r in odd])) if r["doc_id"] is not None}
    check_packing(made, ids)
    assert sum(r["length"] for r in made) == sum(len(x) for x in whole_ids([r["text"] or "" for r in odd])) and all(len(r["ids"]) == 4 * r["length"] for r in made)
    assert packing.pack_documents(no_docs).count() == 0


def test_best_fill_by_enumeration():
    import itertools

    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(1, 60)
        sums = {sum(k * n for k, n in zip(counts, pick)) for pick in itertools.product(*[range(c + 1) for c in counts.values()])}
        got = packing.best_fill(dict(counts), room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in got.items())


def test_word_ids_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE", 300)
    ids = word_bpe.TextIds(packing.default_tokenizer())
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "İ", "Σ", "ς", "ß", " ", "\n", "\x85", "\xa0", "\u3000", "\x1c", "'s", "'LL", "12", "½", "²", "<|endoftext|>", "中", "\u0301", "ﬁ", "Å", "-", "!?", "'", "😀", "_", "\x00", "ŉ", "\u212a"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["x" * 200, "é" * 60, ""]
    import numpy as np

    assert [np.frombuffer(b, "<u4").tolist() for b in ids.batch(made)] == [x[:-1] for x in whole_ids(made)]


# --- suffix-array dedup ---


def brute_removed(all_bytes, length):
    times = collections.Counter(b[i : i + length] for b in all_bytes for i in range(len(b) - length + 1))
    out = []
    for b in all_bytes:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(gone)
    return out


def check_repeats(rows, length, got):
    data = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), b, gone in zip(rows, data, brute_removed(data, length)):
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert want == collections.Counter(tuple(r)[:5] for r in got)


def test_suffix_dedup(spark):
    check_repeats(list(texts(spark).items()), 400, queries.queries()["op7_suffix_array_dedup"](spark, SF).collect())


def test_suffix_dedup_of_edited_copies(spark):
    """Passages, edits, periodic text and matches inside one text, at a length that brute force bears."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    passage, base = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        w = base.split()
        if i % 3 == 0:
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join([word() for _ in range(rng.randrange(20))] + ([passage] if i % 4 == 0 else []) + (w if i % 2 else []))))
    rows += [(100, "ab" * 150), (101, passage + " " + passage), (102, "é" * 120), (103, "short"), (104, None), (104, None), (105, base), (105, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, length=80, q=16).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    check_repeats(rows, 80, got)


def test_suffix_dedup_spans_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[131_000:132_000] + "y"), (3, long[250_000:250_399])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 1000 and got[2]["n_removed"] == 1000 and got[3]["n_removed"] == 0
    assert [tuple(s) for s in got[1]["spans"]] == [(131_000, 132_000)] and got[2]["kept_text"] == "xy"


def test_suffix_dedup_at_span_borders(spark):
    """Long texts whose spans share a suffix at their border, in several row orders: each run is read in its own bytes."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=280_000 + i))) for i in range(6)]
    rows += [(10, "x" + rows[2][1][130_900:131_900] + "y"), (11, rows[4][1][262_000:262_399])]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "n_removed", "spans").collect()
        spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
        assert spans == {i: [] for i, _ in rows} | {2: [(130_900, 131_900)], 10: [(1, 1001)]}


def test_suffix_dedup_of_runs_of_two_sizes(spark):
    """Near copies that differ in the length of a stretch of dashes alone: equal end blocks are not equal runs."""
    rows = []
    for i in range(8):
        a, b = ("".join(random.Random(i).choices("abcdefgh", k=80))[k : k + 40] for k in (0, 40))
        rows += [(10 * i, a + "-" * 30 + b), (10 * i + 1, a + "-" * 33 + b), (10 * i + 2, a + "-" * 33 + b + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, length=80, q=16).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    check_repeats(rows, 80, got)


def brute_words(rows, length):
    """Per row: which words are covered by a string of `length` words that also starts elsewhere."""
    words = [(t or "").encode().split() for _, t in rows]
    times = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if times[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return words, out


def planted(rng):
    """Documents of their own words, some with passages that others have too: of 51 to 80 words, or of 30 to 50."""
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages, short = [prose(n) for n in (51, 52, 60, 80)], [prose(n) for n in (30, 50)]
    rows = [(i, prose(rng.randrange(20, 200))) for i in range(40)]
    rows += [(100 + i, "\n".join([prose(rng.randrange(30)), passages[i % 4], prose(rng.randrange(1, 30))])) for i in range(24)]
    rows += [(200 + i, prose(40) + " \t" + short[i % 2] + "  " + prose(40)) for i in range(12)]
    return rows + [(300, passages[0] + " x " + passages[0]), (301, None), (302, ""), (303, " \n"), (304, "same " * 90)], passages, short


def test_repeated_passages_of_words(spark):
    rows, _, _ = planted(random.Random(21))
    words, want = brute_words(rows, 51)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 51, 8, "word").collect()}
    for (i, text), w, gone in zip(rows, words, want):
        assert got[i]["kept_text"].encode().split() == [x for x, g in zip(w, gone) if not g], i
        assert got[i]["n_spans"] == sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert any(gone) or got[i]["kept_text"] == (text or "")


def test_pipeline_takes_planted_passages_out(spark):
    """Passages of over 50 words go wherever they stand; documents without one stay as they are."""
    import corpus_pipeline

    rows, passages, short = planted(random.Random(22))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeats"](spark, docs, SF).collect()}
    assert not any(p in t for p in passages for t in got.values())
    assert all(got[i] == t for i, t in rows if t and i < 100) and all(got[i] == t for i, t in rows if 200 <= i < 300)


def test_op7_counts_passages(spark):
    rows = list(texts(spark).items())
    words, want = brute_words(rows, 51)
    got = {r["doc_id"]: r for r in queries.queries()["op7_suffix_array_dedup"](spark, SF).collect()}
    for (i, text), gone in zip(rows, want):
        first, end = suffix_dedup.word_edges(text.encode())
        edges = [k for k in range(len(gone) + 1) if (k < len(gone) and gone[k]) != (k > 0 and gone[k - 1])]
        assert (got[i]["n_passages"], got[i]["n_passage_bytes"]) == (len(edges) // 2, sum(int(end[b - 1] - first[a]) for a, b in zip(edges[::2], edges[1::2])))


def test_column_names_with_dots(spark):
    """Names with dots and quotes pass through every operator that keeps the columns of its table."""
    docs = spark.createDataFrame([(i, "some words in a row " * 30 + str(i), "s", i, "x") for i in range(4)], "doc_id long, text string, source string, `a.b` int, `row.text` string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (line_quality.good_documents(docs, labels), ngram_join.first_of_each(docs), suffix_dedup.without_repeats(docs), mixing.take_words(docs)):
        assert out.columns == docs.columns and {r["row.text"] for r in out.collect()} == {"x"}


def test_suffix_dedup_on_odd_tables(odd_docs, no_docs):
    out = suffix_dedup.without_repeats(odd_docs)
    rows = [r for r in out.select("doc_id", "text", "n_chars", "row").collect()]
    assert out.columns == odd_docs.columns and len(rows) == odd_docs.count() and {r["row"] for r in rows} == {"clash"}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] == "" and by[3]["text"] == " tail" and by[10]["text"] == "" and by[8]["text"] == "one two" and by[3]["n_chars"] == 5
    assert suffix_dedup.without_repeats(no_docs).count() == 0
