import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import chat_format, language_id, license_scan, mixing, near_dedup, neighbours, packing, quality_rules, queries, shared, token_counts, token_ids, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one two", "a b c d", "x " * 3000, "é ü a\x1cb", "A b C\na B c\nA b C\n", "cc by cc by all rights reserved"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string")


def test_chat_round_trip(spark):
    turns = [("user", "<|im_end|>\\<|x"), ("assistant", "\n ok <"), ("assistant", ""), ("", "é<|im_start|>")]
    f = chat_format.format_conversation(turns, chat_format.token_path())
    assert chat_format.read_turns(f.text) == turns
    assert "".join(chat_format.read_loss(f)) == "\n ok <"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db, sql = duckdb.connect(), queries.SQL[name]
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(db.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())


def test_token_counts(odd):
    h = token_counts.length_histogram(odd).orderBy("length").collect()
    sizes = [r["length"] for r in h for _ in range(r["n_docs"])]
    assert len(sizes) == 2 * len(ODD)
    for r in h:
        assert r["truncated_total"] == sum(min(s, r["length"]) for s in sizes)
        assert r["tokens_from"] == sum(s for s in sizes if s >= r["length"])


def test_license_places(odd):
    r = license_scan.scan(odd).where("doc_id = 8").first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (7, 3, 0, 4, "cc-by,reserved")


def documents_sql(docs, columns):
    db = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    db.sql("CREATE TABLE documents AS SELECT * FROM documents")
    return Counter(db.sql(f"SELECT {', '.join(columns)} FROM ({license_scan.sql()})").fetchall())


def test_short_notices_get_their_labels(spark):
    texts = ["x y\nLicensed under the Apache License, Version 2.0.\nz", "Released under the MIT license.", "Released under the BSD license.", "Licensed under the GNU License, Version 2.0.", "Licensed under CC BY 4.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in license_scan.scan(docs).orderBy("doc_id").collect()] == ["apache-2.0", "mit", "", "", "cc-by"]


def test_wrapped_notices_get_their_labels(spark):
    fill = lambda t, n: "\n".join("# " + " ".join(t.split()[i : i + n]) + "\n#" for i in range(0, len(t.split()), n))
    texts = [f"start of a file {fill(t, n)}\nend of it" for _, t in license_scan.TEMPLATES for n in (1, 4, 9)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = license_scan.scan(docs)
    for r in got.where("text <> ''").collect():
        assert license_scan.TEMPLATES[r["doc_id"] // 3][0] in r["labels"].split(",")
    got = got.drop("text")
    assert Counter(map(tuple, got.collect())) == documents_sql(docs, got.columns)


def test_altered_notices_match_down_to_the_threshold(spark):
    rng = np.random.default_rng(4)
    long = [t for t in license_scan.TEMPLATES if len(set(license_scan.words_of(t[1]))) >= license_scan.WHOLE]
    rows = []
    for label, t in long:
        words = license_scan.words_of(t)
        for share in (0.1, 0.15, 0.2, 0.3):
            gone = set(rng.permutation(sorted(set(words)))[: int(share * len(set(words)))])
            rows.append((len(rows), "a b " + " ".join(f"zz{i}" if w in gone else w for i, w in enumerate(words)) + " c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs, keep=["doc_id"])
    assert Counter(map(tuple, got.collect())) == documents_sql(docs, got.columns)
    own = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert all((long[i // 4][0] in own[i]) for i in own if i % 4 == 0) and any(own[i] == "" for i in own if i % 4 == 3)


def brute_measures(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark, odd):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [quality_rules.measure(t)[:5] for t in texts] == [brute_measures(t) for t in texts]
    assert quality_rules.measures(odd).count() == 2 * len(ODD)


def test_coverage_alone_rejects(spark):
    same = [f"w{i}" for i in range(40)]
    texts = [" ".join([*same, *(f"a{k}_{i}" for i in range(60)), *same, *(f"b{k}_{i}" for i in range(60))]) for k in range(2)] + [" ".join(f"c{i}" for i in range(200))]
    rows = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "measures.*")
    for r in rows.withColumn("base_failed", quality_rules.base_failed()).withColumn("kept", quality_rules.verdict()).collect():
        assert not r["base_failed"] and r["dup_line_share"] == 0 and r["n_symbols"] == 0 and r["shouted_share"] == 0
        assert r["kept"] == (r["doc_id"] == 2) and (r["doc_id"] == 2 or 0.22 < r["cover_10"] < 0.45)


def test_mixing_meets_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "a").when(F.col("id") < 1500, "b").when(F.col("id") < 1600, None).otherwise("c").alias("source"), (F.col("id") % 17).alias("size"))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 3000 and all(r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_stage_mixes_rows_not_ids(spark):
    rows = [(None, "s", f"null {i} " + "w " * (i % 7 + 1)) for i in range(200)] + [(None, "s", "same text of five words")] * 40
    rows += [(i, "s", f"own {i} x y") for i in range(100)] + [(5, "s", f"one id {i} z") for i in range(60)] + [(i, "t", "a b c d") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "st"}
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")).collect()}
    got = mixing.mixing_stage(spark, docs, SF).collect()
    for s in "st":
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == s) - goal[s]) <= 6
    most = Counter(map(tuple, rows))
    assert all(n <= 2 * most[r] for r, n in Counter(map(tuple, got)).items())
    assert mixing.mixing_stage(spark, docs.limit(0), SF).count() == 0


def test_word_ids_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.word_path())
    texts = [x or "" for x in ODD] + ["it's <|endoftext|> ́x 12ab--c I'LL"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    assert [i.tolist() for i in token_ids.word_encoder(token_ids.word_path()).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(odd):
    rows = packing.pack(packing.pieces(odd, limit=64), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= sum(r["length"] for r in rows) / 64 + 2


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    low = {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), s in zip(rows, sets):
            for (b, _), r in zip(rows, sets):
                if a < b and s and 100 * len(s & r) >= percent * len(s | r):
                    low[a] = low[b] = min(low[a], low[b])
    return {(i, len(s), low[i]) for (i, _), s in zip(rows, sets)}


def test_near_dedup_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(ODD[:6])]
    for base in range(4):
        words = [f"w{base}_{k}" for k in range(60)]
        for c in range(9):
            own = [w if rng.random() > 0.012 * c else f"e{rng.integers(1 << 30)}" for w in words]
            rows.append((10 + base * 10 + c, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(map(tuple, near_dedup.components(df, 3, 85, 7).collect())) == brute_components(rows, 3, 85)
    assert near_dedup.components(df.limit(0)).count() == 0


def test_neighbours_skip_bad_vectors(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(50)] + [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect()
    good = {i: np.array(e) for i, e in rows[:50]}
    for q in (0, 20, 40):
        best = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        assert [(r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in best]
    assert {r["query_id"] for r in got} == {0, 20, 40}


def test_spans_of_long_texts_hash_alike():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 3, 8, 40, 600, 5000)]
    text = b" ".join(words * 40)
    raw = np.frombuffer(text, np.uint8)
    by = {}
    for h, a, b in zip(shared.word_hashes(raw).tolist(), *shared.word_spans(raw), strict=True):
        by.setdefault(text[a:b], set()).add(h)
    assert len(text) > 3 * shared.SLICE and all(len(h) == 1 for h in by.values()) and len(set().union(*by.values())) == len(words)


def test_token_lengths_totals_and_quantiles(spark):
    texts = [t for t in ODD] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    from tokenizers import Tokenizer

    import public_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # another library with the same vocabulary
    sizes = [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    h = token_counts.length_histogram(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).persist()
    assert Counter({r["length"]: r["n_docs"] for r in h.collect()}) == Counter(sizes)
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(h, limit).first()["n_tokens"] == sum(min(s, limit) for s in sizes)
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        least = next(s for s in sorted(sizes) if sum(x <= s for x in sizes) >= q * len(sizes))
        assert token_counts.quantile(h, q).first()["length"] == least
    none = token_counts.length_histogram(spark.createDataFrame([], "text string"))
    assert token_counts.truncated_total(none, 5).first()["n_tokens"] == 0 and token_counts.quantile(none, 0.5).first()["length"] is None


def test_language_machine_reaches_its_optimum():
    rng = np.random.default_rng(1)
    for n, d in ((12, 40), (60, 20), (400, 30)):
        x = rng.normal(size=(n, d)).astype(np.float32)
        y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0.4, 1.0, -1.0)
        w = language_id.svm(x, y).astype(float)
        xb, c = language_id.with_bias(x.astype(float)), 4.0 * language_id.weights(y)
        value = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (xb @ w)) ** 2).sum()
        # Newton steps on the active rows solve the same problem another way.
        v = np.zeros(d + 1)
        for _ in range(200):
            active = 1 - y * (xb @ v) > 0
            a = xb[active]
            new = np.linalg.solve(np.eye(d + 1) + 2 * a.T @ (c[active, None] * a), 2 * a.T @ (c[active] * y[active]))
            if np.allclose(new, v):
                break
            step = 1.0
            while value(v + step * (new - v)) > value(v) and step > 1e-6:
                step /= 2
            v = v + step * (new - v)
        assert value(w) <= value(v) * (1 + 2 * language_id.GAP)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op4_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    share = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97 and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_language_sample_is_never_empty(spark):
    rows = [(None, "the cat sat on the mat", "en")] * 300 + [(None, f"le chat {i} est ici", "fr") for i in range(50)] + [(1, None, "fr"), (2, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, per_lang=3)
    assert m.families == [["en"], ["fr"]]
    got = language_id.predict(docs.withColumn("score", F.lit("mine")).withColumn("a.b", F.lit(1)), m).select("text", "score", F.col("`a.b`"), "language.lang_pred").collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {"mine"}
    assert {(r["text"] or "")[:3]: r["lang_pred"] for r in got if r["text"]}["the"] == "en" and next(r for r in got if r["text"] is None)["lang_pred"] == "und"
    assert language_id.fit(docs.limit(0)) is None and language_id.predict(docs, None).where("language.lang_pred <> 'und'").isEmpty()
    assert language_id.enough(400, 10**15) > 0 and toxicity.enough(toxicity.SAMPLE, 10**15) * 10**15 > toxicity.SAMPLE


def scalar_ftrl(rows):
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i, l: 0.0 if abs(z[i]) <= l else -(z[i] - np.sign(z[i]) * l) / ((beta + n[i] ** 0.5) / alpha + (l2 if l else 0.0))
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = rows[k]
            w = {i: weight(i, l1) for i in at.tolist()} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30))) - y
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i, l1) for i in z if i != "bias" and weight(i, l1)}, weight("bias", 0.0)


def test_toxicity_follows_ftrl_coordinate_by_coordinate():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(150):
        some = [words[i] for i in rng.integers(0, 30, 12)]
        rows.append((toxicity.features(" ".join(some)), int("w3" in some or "w4" in some)))
    at, values, bias = toxicity.train(rows)
    want, b = scalar_ftrl(rows)
    assert sorted(want) == at.tolist() and np.allclose([want[i] for i in sorted(want)], values, atol=1e-5) and abs(b - bias) < 1e-9


def test_toxicity_on_held_out_rows_and_odd_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.01
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x", 3), (1, "x", 3)], "doc_id long, text string, score int")
    model = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int"))
    assert model == toxicity.NO_LABELS
    kept = toxicity.score(docs, model, out="_s").collect()
    assert all(abs(r["_s"] - 0.2689414) < 1e-6 for r in kept) and [r["score"] for r in kept] == [1, 2, 3, 3]
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int"), sample=1)[2] is not None


def brute_neighbours(rows, asked, top=20):
    good = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    out = {}
    for q, x in good:
        if asked(q):
            out[q] = [i for _, i in sorted((-float(x @ v), i) for i, v in good if i != q and len(v) == len(x))[:top]]
    return out


def test_neighbours_over_many_parts(spark):
    """Clustered vectors: ten parts and more in several levels, a searched share well under half, and the recall."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6000 + i, x[0].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = lambda i: i % 20 == 0
    index = neighbours.build(df, asked, per_part=150)
    sizes = {r["node"]: r["n"] for r in index.counts.collect()}
    queries_ = index.placed.where("asked").select("h1", "h2", "embedding")
    searched = [sum(sizes[r["node"]] for r in g) for _, g in itertools.groupby(sorted(index.ranked(queries_, index.probes).collect(), key=lambda r: r["h1"]), key=lambda r: r["h1"])]
    share = np.mean(searched) / sum(sizes.values())
    got = {}
    for r in neighbours.search(df, asked, index=index).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_neighbours(rows, asked)
    hit = np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want])
    assert len(sizes) >= 10 and len(index.levels) >= 1 and share < 0.4 and hit >= 0.9, (len(sizes), index.probes, share, hit)
    vectors = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - np.dot(vectors[q], vectors[v])) < 1e-9 for _, v, s in found)


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(30)] + [(100 + 20 * i, [1.0, 2.0, float(i)]) for i in range(5)] + [(None, [1.0, 2.0]), (60, None), (80, []), (200, [nan, 1.0]), (220, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("mine")).withColumn("h1", F.lit(1))
    got = {}
    for r in neighbours.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == brute_neighbours(rows, lambda i: i % 20 == 0)
    assert neighbours.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def brute_place(lengths, limit):
    """Every place of every document is tried: the squared counts of open bins per gap after it decide."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for k in [*sorted(range(len(gaps)), key=lambda k: gaps[k]), None]:
            gap = limit if k is None else gaps[k]
            if gap < s:
                continue
            after = Counter(g for j, g in enumerate(gaps) if j != k)
            after[gap - s] += 1
            after.pop(0, None)
            score = (sum(n * n for n in after.values()), gap)
            if best is None or score < best[0]:
                best = (score, k)
        gaps = gaps + [limit - s] if best[1] is None else [g - s if j == best[1] else g for j, g in enumerate(gaps)]
        out.append((best[0][1], limit - best[0][1]))
    return [o for _, o in out], sorted(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_packing_places_by_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 41, 120)
    bins, offsets = packing.place(lengths, 40)
    want, gaps = brute_place(lengths.tolist(), 40)
    assert offsets.tolist() == want
    assert sorted(40 - np.bincount(bins, lengths)) == gaps


def test_pieces_are_whole_and_in_order(spark, odd):
    from tokenizers import Tokenizer

    t, got = Tokenizer.from_file(token_ids.word_path()), {}
    more = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).withColumn("doc_id", F.col("doc_id") + 1000))
    for r in packing.pieces(more, limit=50).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for r in more.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(n, a, len(ids[a : a + 50]), zlib.crc32(ids[a : a + 50].tobytes())) for n, a in enumerate(range(0, len(ids), 50))]
        assert sorted(got[r["doc_id"]]) == want


def test_shared_ids_are_one_document(spark):
    w, v = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(3, w), (7, w), (7, v), (9, v), (None, w), (11, ""), (11, "u a b c"), (12, None)], "doc_id long, text string")
    got = Counter(map(tuple, near_dedup.components(df, 3, 85, 7).collect()))
    assert got == Counter({(3, 38, 3): 1, (7, 38, 3): 2, (9, 38, 3): 1, (None, 38, None): 1, (11, 0, 11): 1, (11, 2, 11): 1, (12, 0, 12): 1})
    kept = near_dedup.near_dedup_stage(spark, df.withColumn("key", F.lit(1)), SF)
    assert kept.columns == ["doc_id", "text", "key"]
    assert Counter((r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()) == Counter({(3, "w"): 1, (7, "v"): 1, (11, ""): 1, (11, "u"): 1, (12, ""): 1})


def test_large_families_and_shared_passages(spark):
    """Families of copies around their originals, a passage that all texts share, and chains of near copies."""
    rng = np.random.default_rng(7)
    passage, rows = [f"p{i}" for i in range(25)], []
    for base in range(3):
        words = passage + [f"o{base}_{k}" for k in range(55)]
        for _ in range(40):
            rows.append((len(rows) * 3 + 1, " ".join(w if rng.random() > 0.02 else f"n{rng.integers(1 << 40)}" for w in words)))
        now = list(words)
        for _ in range(12):
            now[int(rng.integers(len(now)))] = f"c{rng.integers(1 << 40)}"
            rows.append((len(rows) * 3 + 1, " ".join(now)))
    rows += [(len(rows) * 3 + 1 + 3 * i, t) for i, (_, t) in enumerate(rows[:30])]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    assert set(map(tuple, near_dedup.components(df, 3, 85, 7).collect())) == brute_components(rows, 3, 85)
    assert set(map(tuple, near_dedup.components(df, 5, 80, 5).collect())) == brute_components(rows, 5, 80)


def test_bitmap_keeps_all_that_is_asked_for(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("key"))
    some = rows.where("id % 97 = 0").select("key")
    got = near_dedup.among(rows, "key", some)
    assert got.columns == ["id", "key"] and got.join(some, "key", "left_semi").count() == some.count() and got.count() < 3 * some.count() + 700
    assert near_dedup.among(rows, "key", some.limit(0)).count() == 0


def test_mixing_of_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a", "x y z")] * 400 + [(1, "a", "x y")] * 30 + [(i, None, "q " * (i % 5)) for i in range(100)] + [(5, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.size_of()).withColumns({"range": F.lit(1), "row": F.lit(2), "target": F.lit("mine")})
    got = mixing.mix_sources(docs, key=("doc_id", "text")).collect()
    assert len(got) == len(rows) and {r["range"] for r in got} == {1} and {r["row"] for r in got} == {2}
    for s in ("a", None):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    counted = spark.createDataFrame([("a", 250_001), ("b", 1)], "k string, n long")
    assert {r["k"]: (r["count"], r["low"], r["high"]) for r in mixing.numbered(counted, "n", "u").groupBy("k").agg(F.count("*").alias("count"), F.min("u").alias("low"), F.max("u").alias("high")).collect()} == {"a": (250_001, 1, 250_001), "b": (1, 1, 1)}


def rules_of(text):
    m = dict(zip([x.split()[0] for x in quality_rules.MEASURES.split(", ")], quality_rules.measure(text), strict=True))
    if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
        return False
    w = [(k.start(), len(k[0]), k[0]) for k in WORD.finditer(text)]
    for n, most in quality_rules.COVERAGE.items():
        grams = Counter(tuple(x[2] for x in w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {i + k for i in range(len(w) - n + 1) if grams[tuple(x[2] for x in w[i : i + n])] > 1 for k in range(n)}
        if sum(w[i][1] for i in inside) > most * sum(x[1] for x in w):
            return False
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    total = sum(x[1] for x in w)
    loud = sum(1 for x in w if not re.search("[a-z]", x[2]) and len(re.findall("[A-Z]", x[2])) >= 2)
    return dup <= quality_rules.LINE_COVERAGE * total and m["n_symbols"] <= quality_rules.SYMBOLS_PER_WORD * len(w) and loud <= quality_rules.SHOUTED * len(w)


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).persist()
        out.append((name, docs, kept))
        docs = kept
    return out


def test_stages_against_brute_force(spark, staged):
    (_, docs, ruled), (_, _, clean), (_, _, single), (_, _, mixed), (_, _, packed) = staged
    assert [n for n, _, _ in staged] == ["quality_rules", "toxicity", "near_dedup", "mixing", "packing"]
    for _, before, kept in staged[:4]:
        assert kept.columns == before.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    assert ids(ruled) == Counter(i for i, t in text.items() if rules_of(t or ""))
    at, values, bias = toxicity.fit(ruled.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    w = dict(zip(at.tolist(), values.tolist(), strict=True))
    assert ids(clean) == Counter(i for i in ids(ruled) if sum(w.get(f, 0.0) for f in toxicity.features(text[i]).tolist()) + bias < 0)
    of = {i: c for i, _, c in brute_components([(i, text[i]) for i in ids(clean)], 5, 80)}
    assert ids(single) == Counter(set(of.values()))
    size = {i: len(WORD.findall(text[i])) for i in ids(single)}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    took = Counter()
    for i, n in ids(mixed).items():
        assert n <= 2 and i in size
        took[source[i]] += n * size[i]
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sums.items()], "source string, source_size long, n_rows long")).collect()}
    assert all(abs(took[s] - goal[s]) <= max(n for i, n in size.items() if source[i] == s) for s in goal)
    pieces = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert pieces == ids(mixed)


def test_pipeline_runs_its_stages(spark, staged):
    names = [f"{c}" for c in staged[-1][2].columns if c not in ("sequence_id", "offset")]
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(map(tuple, staged[-1][2].select(*names).collect()))


EXTRA = ["score", "row", "key", "key_a", "id", "words", "flat", "label", "measures", "toxic_score", "language", "copies", "range", "size", "n_words", "target", "a.b", "x`y", "fp", "sig", "bands", "n", "k"]


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_tables(spark, k):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and columns with clashing names."""
    good = " ".join(f"word{i} goes here" for i in range(80))
    rows = [(None, None, None, None), (1, None, "en", "s"), (1, "", None, None), (None, good, "en", None), (None, good, "en", None), (2, good + " more", "en", "s"), (2, good + " more", "en", "s"), (3, "x" * 200_000, None, "s"), (4, " ".join(f"l{i}" for i in range(60_000)), "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA)))
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and all(r[c] == i for r in got.collect() for i, c in enumerate(EXTRA))
    assert stage(spark, docs.limit(0), SF).count() == 0
    if k == 2:
        assert Counter((r["doc_id"], len(r["text"] or "")) for r in got.collect())[2, len(good) + 5] == 1


def test_queries_take_odd_tables(spark, tmp_path):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(None, None, None, None), (None, "a b", "en", None), (1, "", None, "s"), (1, long, "de", "s"), (2, "cc by cc by", "en", "s"), (2, "cc by cc by", "en", "s")]
    for name, n in (("odd", len(rows)), ("none", 0)):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").limit(n).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 1)], "doc_id long, quality int, toxic int").limit(n).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None, None, None), (None, 1, "user", None), (2, 2, "assistant", long), (2, 2, "assistant", long)], "conv_id long, turn long, role string, text string").limit(n).write.parquet(f"{at}/conversations.parquet")
        spark.createDataFrame([(0, [1.0, 2.0]), (20, None), (None, [1.0, 1.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5])], "vec_id long, embedding array<double>").limit(n).write.parquet(f"{at}/embeddings.parquet")
        for q, f in queries.QUERIES.items():
            got = f(spark, at).collect()
            if q not in ("op1_chat_formatting", "op2_token_counts", "op6_nearest_neighbours", "op9_packing"):
                assert len(got) == n, (q, name)
            if q in queries.SQL:
                db = duckdb.connect()
                for t in ("documents", "conversations", "embeddings"):
                    db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
                columns = f(spark, at).columns
                assert Counter(map(tuple, got)) == Counter(db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[q]})").fetchall()), (q, name)
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() >= 0 and corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
