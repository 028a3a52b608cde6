"""Top-k search, URL filter and sharding against brute force and by their defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bloom_cascade, budget, hilbert, kd_search


def brute(ids, vectors, k):
    out = {}
    for q, x in zip(ids, vectors, strict=True):
        scores = sorted((-int(np.dot(x, y)), i) for i, y in zip(ids, vectors, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (200, 8))
    vectors[100:150] = vectors[3]  # one vector a quarter of all rows
    rows = spark.createDataFrame([(k, [float(x) / 1024 for x in v]) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    all_rows = kd_search.quantised(rows, "vec_id", "embedding")
    found = {}
    for r in kd_search.top_k(all_rows, all_rows.where("vec_id % 10 = 0"), 5, shard_rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute(range(200), vectors, 5)
    assert found == {q: expected[q] for q in range(0, 200, 10)}


def test_rows_that_repeat_an_id_and_large_components(spark):
    # a query's own rows, eleven of one vector, leave room for another id with that vector
    rows = spark.createDataFrame([(0, [1.0])] * 11 + [(1, [1.0]), (2, [0.5]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    good = kd_search.quantised(rows, "vec_id", "embedding")
    found = [tuple(r) for r in kd_search.top_k(good, good.where("vec_id = 0"), 10).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 19)]
    large = kd_search.quantised(spark.createDataFrame([(0, [1e16]), (1, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="beyond 64 bits"):
        kd_search.top_k(large, large).collect()


def test_vectors_that_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    good = kd_search.quantised(rows, "vec_id", "embedding")
    assert [tuple(r) for r in kd_search.top_k(good, good).orderBy("query_id").collect()] == [(0, 1, 5, 1536 * 1024), (5, 1, 0, 1536 * 1024)]
    assert kd_search.top_k(good.where("false"), good.where("false")).count() == 0


_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_hosts_paths_and_rules(spark):
    urls = ["https://A.Example.net/en/x?q#f", "http://notexample.net/en/", "http://x.org/fr/", "x.org/fr/", None, "http://example.com/de", "http://b.example.com/de/1", "http://h?x", "http://h#/a"]
    url = F.col("url")
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(bloom_cascade.host_of(url).alias("host"), bloom_cascade.path_of(url).alias("path"))
    rule, verdict = bloom_cascade.rule_of(F.col("host"), F.col("path"), _RULES)
    found = [tuple(r) for r in rows.select("host", "path", rule, verdict).collect()]
    assert found[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[1][2:] == ("net/", "block")
    assert found[2][2:] == ("org/fr/", "allow")
    assert found[3] == found[4] == ("", "", None, None)
    assert found[5][2] is None
    assert found[6][2:] == ("example.com/de/", "block")
    assert found[7] == ("h", "", None, None) and found[8] == ("h", "", None, None)


@pytest.mark.parametrize("most", [bloom_cascade.MAX_FILTER_BYTES, 100])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, most):
    monkeypatch.setattr(bloom_cascade, "MAX_FILTER_BYTES", most)
    monkeypatch.setattr(bloom_cascade, "EXPECTED_PASSES", 0.0125 if most > 100 else 0.5)
    rows = spark.range(3000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("host"), F.lit(1).alias("listed"), "id")
    rows = rows.union(rows.limit(500)).union(spark.createDataFrame([(None, 1, -1), ("", 1, -2), ("x" * 100_000, 1, -3)], "host string, listed int, id long"))
    listed = F.pmod(F.xxhash64("host"), F.lit(10)) < 3
    hosts = rows.where(listed & F.col("host").isNotNull() & (F.col("host") != "")).select("host", F.lit(0).alias("listed"))
    hosts = hosts.union(hosts.limit(9)).union(spark.createDataFrame([("elsewhere", 0), (None, 0)], "host string, listed int"))
    judged, name = bloom_cascade.mark_listed(rows, hosts)
    assert name == "_listed" and judged.columns == [*rows.columns, name]
    assert judged.count() == 3503
    expected = judged.join(hosts.distinct().withColumnRenamed("listed", "l"), "host", "left").withColumn("expected", F.col("l").isNotNull())
    assert expected.where(F.col("expected") != F.col(name)).count() == 0 and expected.where(name).count() > 900
    assert bloom_cascade.mark_listed(rows, hosts.where("false"))[0].where("_listed").count() == 0
    assert bloom_cascade.mark_listed(rows.where("false"), hosts)[0].count() == 0


def test_curve_visits_neighbours():
    table = hilbert.curve_table(3, 4)
    assert sorted(table) == list(range(4096))
    cells = np.empty((4096, 3), int)
    for code, at in enumerate(table):
        cells[at] = code >> 8, code >> 4 & 15, code & 15
    assert (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all()
    with pytest.raises(ValueError, match="dimensions"):
        hilbert.curve_table(4, 4)


def test_columns_and_repeated_rows_of_sharded_tables(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "PIECE_ROWS", 3)
    names = ["_total", "_key", "_piece", "_row", "_before", "total", "cell", "piece", "order", "row", "before", "shard", "size"]
    rows = spark.createDataFrame([(k % 4, None if k % 3 else "", "hot") for k in range(50)], "doc_id long, text string, source string")
    rows = rows.withColumns({n: F.lit(n) for n in names}).withColumn("lang", F.lit(None).cast("string"))
    placed = hilbert.hilbert_shards(rows, hilbert.document_axes(F.octet_length("text")), F.struct("doc_id", "text"), 7)
    assert placed.columns == [*(c for c in rows.columns if c != "shard"), "curve_index", "shard", "slot"]
    found = placed.toPandas()
    assert len(found) == 50 and all((found[n] == n).all() for n in names if n != "shard")
    counts = found.groupby("shard").size()
    assert len(counts) == 7 and counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_places_match_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "PIECE_ROWS", 4)
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("t"), F.col("id") * 7 % 50).alias("text"))
    axes = hilbert.document_axes(F.col("doc_id"))
    placed = hilbert.hilbert_shards(rows, axes, F.struct("doc_id", "text"), 7).withColumn("hash", F.xxhash64(F.struct("doc_id", "text"))).collect()
    cells = {}
    for r in placed:
        cells.setdefault(r["curve_index"], []).append(r)
    ordered = []
    for cell in sorted(cells):
        pieces = -(-len(cells[cell]) // 4)
        ordered += sorted(cells[cell], key=lambda r: (r["hash"] % pieces, r["doc_id"]))
    starts = [-(-k * 300 // 7) for k in range(8)]
    expected = {r["doc_id"]: next((k, at - starts[k]) for k in range(7) if starts[k] <= at < starts[k + 1]) for at, r in enumerate(ordered)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in placed} == expected


@pytest.mark.parametrize("n", [0, 5, 1000])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, "hot").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit("kept").alias("slot"))
    placed = hilbert.hilbert_shards(rows, hilbert.document_axes(F.col("doc_id")), F.struct("doc_id")).toPandas()
    assert len(placed) == n
    if n:
        counts = placed.groupby("shard").size().reindex(range(24), fill_value=0)
        assert counts.max() - counts.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in placed.groupby("shard"))
        assert placed.sort_values(["shard", "slot"])["curve_index"].is_monotonic_increasing
        sharded = spark.createDataFrame(placed[["shard", "curve_index"]])
        assert hilbert.zone_map(sharded, ["curve_index"]).count() == placed["shard"].nunique()


def share(spark, capacity, weight, total):
    rows = [("p", f"c{k}", c, w, total) for k, (c, w) in enumerate(zip(capacity, weight, strict=True))]
    nodes = spark.createDataFrame(rows, "parent string, name string, capacity long, weight long, budget long")
    return [r["target"] for r in budget.share_out(nodes, ["parent"], "name").orderBy("name").collect()]


def test_shortages_go_to_siblings(spark):
    assert share(spark, [100, 100, 100], [1, 1, 1], 90) == [30, 30, 30]
    assert share(spark, [10, 100, 100], [1, 1, 2], 90) == [10, 26, 53]
    assert share(spark, [10, 20, 30], [1, 1, 1], 90) == [10, 20, 30]
    assert share(spark, [0, 100], [1, 1], 50) == [0, 50]


def test_shortage_stays_in_the_family_before_it_goes_up(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "z", 200)], "domain string, source string, tokens long")
    found = {r["source"]: r["target"] for r in budget.leaf_targets(leaves, ["domain", "source"], {}, 50, 1).collect()}
    # half of 310 is 155: 77 for each domain; x's shortage goes to y, not to z
    assert found == {"x": 10, "y": 67, "z": 77}


def test_prefix_and_epochs(spark):
    docs = spark.createDataFrame([(k, "a b c d e", None if k % 4 == 0 else "en", "src1") for k in range(40)] + [(99, None, "en", None)], "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    rows = budget.mix(docs, levels, {"lang": {"(null)": 9}}, tokens=budget.tokens_of(F.col("text")), budget_percent=60, epochs=2).toPandas()
    assert len(rows) == 41
    by = rows.assign(t=rows["n_tokens"] * rows["copies"]).groupby(["lang", "source"]).agg(t=("t", "sum"), target=("leaf_target", "first"), most=("n_tokens", "max"))
    assert ((by["t"] <= by["target"]) & (by["t"] + by["most"] > by["target"] - 1)).all()
    assert by.loc[("(null)", "src1"), "target"] == 100  # two epochs of ten documents
    assert budget.mix(docs.where("false"), levels, {}, tokens=budget.tokens_of(F.col("text"))).count() == 0


def test_ties_and_repeated_rows_of_a_mixture(spark, monkeypatch):
    monkeypatch.setattr(budget, "PIECE_ROWS", 5)
    docs = spark.createDataFrame([(k // 4, "a " * (1 + k % 3)) for k in range(80)] + [(None, "x"), (None, None), (7, "w " * 100_000)], "doc_id long, text string")
    levels = {"lang": F.lit(None).cast("string"), "half": F.pmod("doc_id", F.lit(2))}
    found = [budget.mix(docs.repartition(p), levels, {}, tokens=budget.tokens_of(F.col("text")), budget_percent=50).toPandas() for p in (1, 5)]
    key = ["half", "doc_id", "n_tokens", "copies"]
    assert found[0][key].sort_values(key).values.tolist().__repr__() == found[1][key].sort_values(key).values.tolist().__repr__()
    own = found[0].assign(t=found[0]["n_tokens"] * found[0]["copies"]).groupby("half").agg(t=("t", "sum"), target=("leaf_target", "first"))
    assert (own["t"] <= own["target"]).all()
    with pytest.raises(ValueError, match="n_tokens"):
        budget.mix(docs, {"n_tokens": F.lit("x")}, {}, tokens=F.lit(1))


def test_drawn_rows_are_those_of_the_mixture(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(budget, "PIECE_ROWS", 5)
    texts = [(k, "a " * (k % 7), None if k % 5 == 0 else "en", f"src{k % 3}", k % 2) for k in range(200)]
    texts += [(3, "a " * 60, "en", "src0", 1), (None, "x y", "en", "src1", 0), (201, None, None, None, 0), (202, "lone", "fr", None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, Epochs int")
    levels = {"domain": budget.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    for percent in (0, 37, 90, 100):
        mixed = budget.mix(docs, levels, {"lang": {"en": 4}}, tokens=budget.tokens_of(F.col("text")), budget_percent=percent, epochs=1)
        expected = sorted((r["doc_id"], r["n_tokens"]) for r in mixed.where("copies > 0 and doc_id is not null").collect())
        found = budget.drawn(docs, levels, {"lang": {"en": 4}}, tokens=budget.tokens_of(F.col("text")), budget_percent=percent)
        assert found.columns == docs.columns
        assert sorted((r["doc_id"], len((r["text"] or "").split())) for r in found.collect()) == expected
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
    assert budget.drawn(docs.where("false"), levels, {}, tokens=budget.tokens_of(F.col("text"))).count() == 0


def test_rows_that_repeat_a_query_leave_room_for_its_neighbours():
    tree = kd_search.KDTree(np.array([1, 1, 1, 2, 3]), np.ones((5, 2), np.int64), 2)
    assert sorted(tree.search(1, np.ones(2, np.int64), 2, None)) == [(2, -3), (2, -2)]
