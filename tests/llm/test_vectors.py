"""Vector operators against brute force, classifiers by held-out accuracy, the pipeline by its own parts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import labels, neardup, quality, queries, simhash, topk, toxicity

VEC = "vec_id long, embedding array<float>, label int, n_links string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    x = np.concatenate([base] + [base[:15] + rng.standard_normal((15, 16)).astype(np.float32) * s for s in (0.05, 0.1, 0.15)] + [base[:3]])
    rows = [(i, [float(v) for v in r], int(i % 15 % 3), "clash") for i, r in enumerate(x)]
    odd = [(900, None, 1, "c"), (901, [0.0] * 16, 1, "c"), (902, [float("nan")] + [1.0] * 15, 1, "c"), (903, [None] + [1.0] * 15, 1, "c"), (904, rows[0][1], None, "c"), (950, [float("inf")] * 16, 1, "c"), (905, [], 1, "c"), (906, [1.0, 2.0], 1, "c"), (rows[1][0], rows[1][1], rows[1][2], "c")]
    return spark.createDataFrame(rows + odd, VEC)


@pytest.mark.parametrize("tile", [1500, 4])
def test_near_duplicates(vectors, tile):
    good = [(r.vec_id, np.array(r.embedding, float), r.label) for r in vectors.collect() if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    n, parent = [0] * len(good), list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if good[a][2] == good[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                pa, pb = parent[a], parent[b]
                parent = [pb if p == pa else p for p in parent]
    least = {p: min(good[i][0] for i in range(len(good)) if parent[i] == p) for p in set(parent)}
    want = sorted([(good[i][0], n[i], least[parent[i]]) for i in range(len(good))] + [(i, 0, i) for i in (900, 901, 902, 903, 904, 905, 950)])
    got = neardup.near_duplicates(vectors, tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want and sum(n) > 20
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_one_id_of_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (1, [1.0, 0.0], 2), (0, [1.0, 0.0], 2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_no_vectors(vectors):
    assert neardup.near_duplicates(vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [16_384, 10])
def test_top_k(vectors, size):
    """Repeated rows are candidates and queries of their own."""
    vectors = vectors.unionByName(vectors.where("vec_id = 50")).unionByName(vectors.where("vec_id = 7").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    rows = [(r.vec_id, [int(np.floor(256 * np.float64(np.float32(v)))) for v in r.embedding]) for r in vectors.collect()
            if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()]
    want = []
    for i, q in rows:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, candidates=size, queries=size)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_k_of_clusters(spark):
    """Cells that cannot matter are not met, and the result is whole all the same."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(24) * 3 + rng.standard_normal((60, 24)) * 0.2 for _ in range(12)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, len(x), 50):
        order = sorted((-int(q[i] @ q[k]), k) for k in range(len(x)) if k != i)[:5]
        want += [(i, k + 1, v, -s) for k, (s, v) in enumerate(order)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=25).collect()) == sorted(want)


@pytest.fixture(scope="module")
def cost(spark):
    """The model of a whole table's texts and of some thousand sentences with the words to restore."""
    import random

    rng = random.Random(1)
    words = "idiot stupid asshole fuck shit ass bitch leet good hall scum trash clown loser".split()
    plain = [(" ".join(rng.choice(words) for _ in range(8)),) for _ in range(3000)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").unionByName(spark.createDataFrame(plain, "text string"))
    return toxicity.language_model(docs)


OBFUSCATED = {"1diot": "idiot", "!diot": "idiot", "@sshole": "asshole", "id10t": "idiot", "f*ck": "fuck", "sh*t": "shit", "a$$": "ass", "b!tch": "bitch", "l33t": "leet", "$tup1d": "stupid", "looooser": "loser",
              "i.d.i.o.t": "idiot", "s t u p i d i d i o t": "stupid idiot", "clow|\\|": "clown", "7rash": "trash", "i-d-i-0-t": "idiot", "an i  d  1 o t and a l0s3r": "an idiot and a loser", "$cum": "scum"}


@pytest.mark.parametrize("written", sorted(OBFUSCATED))
def test_viterbi_restores_words(cost, written):
    assert toxicity.restore(written, cost) == OBFUSCATED[written]


@pytest.mark.parametrize("word", ["good", "hall", "3rd", "10th", "mp3", "stop", "4k", "town", "rows 1 2 3 4 5"])
def test_clean_words_stay(cost, word):
    assert toxicity.restore(word, cost) == word and toxicity.traits(word)[:1] == [t for t in toxicity.readings(word, cost)[:1]]


def test_pairs_of_letters_are_settled_one_by_one(cost):
    """As the whole lattice does."""
    import random

    rng = random.Random(6)
    words = ["good", "hall", "stuupid", "aa", "eessoo", "aabbccdd", "ééa"] + ["".join(c * rng.choice((1, 1, 2)) for c in dict.fromkeys(rng.choice("aeistlémno") for _ in range(rng.randrange(1, 9)))) for _ in range(300)]
    assert all(toxicity.undoubled(w, cost) == toxicity.decode(w, cost) for w in words) and any(toxicity.undoubled(w, cost) != w for w in words)


def test_viterbi_is_the_best_of_all_readings(cost):
    """Every reading of short words is priced; none is cheaper than the decoded one."""
    import itertools
    import random

    def price(letters, extras):
        a = b = 0
        total = sum(extras)
        for letter in letters:
            if not letter or letter == " " and b == 0:
                continue
            kind = toxicity._kind(letter)
            total += cost[a, b, kind] if kind or letter == " " else 0.0
            a, b = b, kind
        return total + (cost[a, b, 0] if b else 0.0)

    rng = random.Random(5)
    words = ["1d10t", "a$$", "oo", "ooo", "f*k", "l33t", "a b c", "x.y", "3rd", "!!", "4", "*", "", "a--b"] + ["".join(rng.choice("aeist10!$*. -b") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    for word in words:
        every = [price(*zip(*way)) if way else price((), ()) for way in itertools.product(*toxicity._choices(word))]
        found = toxicity.decode(word, cost)
        ways = [("".join(x for x, _ in way), price(*zip(*way)) if way else price((), ())) for way in itertools.product(*toxicity._choices(word))]
        mine = min(p for text, p in ways if " ".join(text.split(" ")).strip() == found or " ".join(text.split()) == found)
        assert mine <= min(every) + 1e-9, (word, found)


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,cut", [("op7_toxicity", "toxic", 0.5), ("op8_quality", "quality", 0.3)])
def test_classifiers_on_held_out_rows(spark, name, label, cut):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and all(r.predicted == int(r.score >= cut) for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) > 0.9


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = labels.training_rows(docs.withColumn("lang", F.lit("x")), known, "toxic", 50)
    assert rows.count() == 50
    held = labels.training_rows(docs, known.where(labels.held_out()), "toxic", 50)
    assert held.count() == 0


@pytest.mark.parametrize("module,column", [(toxicity, "toxicity"), (quality, "quality")])
def test_classifiers_without_rows(spark, module, column):
    kind = f"doc_id long, text string, {column} string"
    docs = spark.createDataFrame([(1, None, "clash"), (None, "", "clash"), (1, "x" * 50_000, "clash"), (1, "x" * 50_000, "clash")], kind)
    model = module.train(docs, spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int"))
    got = module.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r[column] <= 1 for r in got)
    assert module.score(docs.limit(0), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == columns
        if name == "simhash":
            groups = simhash.simhash_groups(left)
            want = {r.doc_id for r in groups.where("doc_id = component_id").collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        left = after.persist()
        assert 0 < left.count() <= docs.count()
    pieces = p.STAGES[-1][1](spark, left, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert [tuple(r) for r in p.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()] == [
        tuple(r) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, nulls in any column, empty and long texts, repeated rows and further columns that clash go through every stage; an empty table gives nothing."""
    import corpus_pipeline as p

    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 400")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, "a row without an id that is read all the same", None, None, None), (None, "a row without an id that is read all the same", None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0),
           (5002, "long words " * 30_000, "en", "s", 330_000), (5003, "the very same text in three rows of one id", "en", "s", 1), (5003, "the very same text in three rows of one id", "en", "s", 1), (5003, "and another one", "en", "s", 1)]
    docs = known.unionByName(spark.createDataFrame(odd, kind))
    for c in ("toxicity", "quality", "component_id", "_row", "label", "fingerprint", "part", "start", "length"):
        docs = docs.withColumn(c, F.lit("clash"))
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels_of = spark.read.parquet(f"{SF}/labels.parquet").withColumn("label", F.lit("clash")).unionByName(spark.createDataFrame([(None, 1, 1, "x"), (3, None, None, None)], "doc_id long, quality int, toxic int, label string"), allowMissingColumns=True)
    labels_of.write.parquet(f"{folder}/labels.parquet")
    left = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, left = left, stage(spark, left, folder).persist()
        assert left.columns == docs.columns and 0 < left.count() <= before.count(), name
    pieces = p.STAGES[-1][1](spark, left, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left.collect()} and all(0 < r.length <= 2048 for r in pieces)
    places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
    assert left.where("doc_id is null").count() in (0, 2) and left.where("doc_id = 5003").count() <= 1
    none = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    labels_of.limit(0).write.parquet(f"{none}/labels.parquet")
    assert p.run(spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(found)


def test_sql_of_links_with_odd_vectors(spark, vectors, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    vectors.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    found = con.execute(queries.ORACLES["op9_embedding_near_dedup"]).fetchall()
    assert sorted(tuple(r) for r in neardup.near_duplicates(vectors).collect()) == sorted(found)


def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
