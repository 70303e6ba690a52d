"""Vector and URL operators against brute force and SQL, and on odd and empty tables; the pipeline's stages."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from orogen.llm import common, embedding_dedup, queries, topk_search, url_filter

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame, columns):
    return sorted(tuple("null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def vectors(spark, made, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in made], f"vec_id long, embedding array<{kind}>, node string")


def near(n, dim, rng, spread):
    centre = rng.normal(size=dim)
    return centre + rng.normal(size=(n, dim)) * spread


def brute_links(made, threshold=0.95):
    good = [(i, np.array(v, "f4").astype("f8")) for i, v in made if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.stack([v / np.sqrt((v * v).sum()) for _, v in good])
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    low = np.arange(len(good))
    while True:
        new = np.array([min([low[i], *low[hit[i]]]) for i in range(len(good))])
        if (new == low).all():
            break
        low = new
    return {good[k][0]: (int(hit[k].sum()), good[low[k]][0]) for k in range(len(good))}


def test_embedding_dedup(spark, monkeypatch):
    """Dense groups larger than a block, random rows, copies, and rows that take no part."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    made = [*near(250, 32, rng, 0.12), *near(60, 32, rng, 0.25), *rng.normal(size=(300, 32))]
    made = list(enumerate(made + [made[0], made[0]]))
    want = brute_links(made)
    made += [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None] * 32), (1004, []), (1005, [float("inf")] * 32)]
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(vectors(spark, made)).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(1000, 1006)) and len(got) == len(made)
    found, true = sum(got[i]["n_links"] for i in want), sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items()) and found >= 0.99 * true
    assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.link_embeddings(vectors(spark, [])).count() == 0
    twin = embedding_dedup.link_embeddings(vectors(spark, [(1, [1, 2]), (1, [1, 2]), (None, [2, 4]), (5, [1, 2, 3])], "double")).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in twin) == [(0, 5), (2, 1), (2, 1), (2, 1)]


def test_tables_reach_the_recall():
    for bits in (8, 14, 20):
        n = embedding_dedup.tables_for(0.95, 0.998, bits)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** n >= 0.998


def test_top_k_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    made = [(i, base[i % 6] if i < 200 else rng.normal(size=8)) for i in range(260)]  # many ties
    made += [(300, None), (320, [float("nan")] * 8), (340, [None] * 8), (20, made[20][1]), (None, base[0])]
    frame = vectors(spark, made)
    got = {}
    for r in topk_search.top_k(frame, frame.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = [(i, np.floor(64 * np.array(v, "f4").astype("f8")).astype("i8")) for i, v in made if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = dict(good)
    assert set(got) == {i for i in q if i % 20 == 0}
    for i, found in got.items():  # a repeated row is a candidate each time
        best = sorted(((-int(q[i] @ v), j) for j, v in good if j != i))[:7]
        assert [found[r + 1] for r in range(7)] == [(j, -s) for s, j in best]
    few = vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])])
    assert topk_search.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk_search.top_k(few.limit(0), few).count() == 0 and topk_search.top_k(few, few.limit(0)).count() == 0
    lone = vectors(spark, [(0, [1, 0])])
    assert topk_search.top_k(lone, lone).count() == 0
    ragged = vectors(spark, [(0, [1, 0]), (1, [1, 1]), (2, [1, 0, 3]), (3, [2, 2, 2]), (4, []), (0, [1, 0, 1])])
    found = sorted(tuple(r) for r in topk_search.top_k(ragged, ragged.where("vec_id = 0")).collect())
    assert found == [(0, 1, 1, 4096), (0, 1, 2, 16384), (0, 2, 3, 16384)]


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x?q", "https://a.b.example.org/en/1x#y", "http://notexample.org/en/1", "http://x.com/de/", "http://x.com/fr", "com://com/fr/", "http://org", None, "", "nothing", "http://É.org/", "a://b://c.org/", "http://u:p@x.com:80/de/", "http://../org/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "clash", "clash")] * 2, "page_id long, url string, host string, best string")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES))
    got = [tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(got) == len(urls) + 2 and out.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    by = {g[0]: g[1:] for g in got}
    assert by[0] == ("example.org", "/es/x", "example.org/es/", "block") and by[1][2:] == ("example.org/en/1", "block") and by[2][2:] == ("org/", "allow")
    assert by[3][2:] == ("com/de/", "block") and by[4][2:] == (None, "allow") and by[5][2:] == ("com/fr/", "allow") and by[6] == ("org", "", None, "allow")
    assert all(by[i] == ("", "", None, "allow") for i in (7, 8, 9)) and by[10][0] == "É.org" and by[11] == ("b:", "//c.org/", None, "allow") and by[12][0] == "u:p@x.com:80" and by[13][2] is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES).limit(0)).where("rule is not null").count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if None not in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_each_way_to_join(spark, monkeypatch):
    """A hot centre, chains and chance edges give the same components whether sides are small, hot or neither."""
    rng = np.random.default_rng(2)
    edges = [(9000, int(x)) for x in range(5000, 6200)] + [(i + 1, i) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 700, (400, 2))]
    table, found = spark.createDataFrame(edges, "a long, b long"), []
    for small, hot in ((1 << 16, 256), (0, 4), (0, 256)):
        monkeypatch.setattr(common, "SMALL", small)
        monkeypatch.setattr(common, "HOT", hot)
        found.append({r["node"]: r["component"] for r in common.connected_components(table).collect()})
    assert found[0] == found[1] == found[2]
    assert {found[0][x] for x in [9000, *range(5000, 6200)]} == {5000} and {found[0][x] for x in range(61)} == {0}


def test_pipeline(spark, odd_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, SF), name)
        assert (docs.count() > 0) == (start is odd_docs)
