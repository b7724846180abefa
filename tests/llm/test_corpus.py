"""The corpus operators against SQL and brute force, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import common, decontaminate, licenses, line_dedup, lm_scores, mixing, ngram_join, queries, suffix_dedup, tokens, topk, toxicity

from ..compare import assert_same

SQL = queries.oracle_sql()
WORDS = [f"w{i}" for i in range(40)]
ODD = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "x " * 3000, "a"), (6, "one", None), (7, "ü" * 900, "b")]
SCHEMA = "doc_id long, text string, source string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def texts(seed, n, length=40):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            t = words(r.choice(out))
            t[r.randrange(len(t))] = r.choice(WORDS)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(1, length))))
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    docs = spark.createDataFrame(ODD, SCHEMA)
    if extra:
        docs = docs.withColumn("size", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("token", F.lit(0))
    n = len(ODD)
    assert mixing.mix_copies(docs).count() == n
    assert tokens.encoded_lengths(docs).count() == n
    assert lm_scores.backoff_scores(docs).count() == n
    assert suffix_dedup.remove_repeats(docs).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, 4, 85).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4, 7: 7}
    assert licenses.scan(docs).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for df in (mixing.mix_copies(docs), lm_scores.backoff_scores(docs), suffix_dedup.remove_repeats(docs), line_dedup.dedup_lines(docs), ngram_join.ngram_components(docs), licenses.scan(docs), tokens.context_report(tokens.length_histogram(tokens.encoded_lengths(docs)))):
        assert df.count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 0
    assert decontaminate.benchmark_matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    for first, hashes, at in common.document_words(pa.array(["A b\tb", None, "", "b  a", "ä x\u000bÄ"])):
        assert first == 0 and at.tolist() == [0, 3, 3, 3, 5, 8]
        assert hashes[1] == hashes[2] == hashes[3] and hashes[0] == hashes[4]
        assert len({int(h) for h in hashes}) == 5


@pytest.mark.parametrize("block", [3, 4096])
def test_ngram_components_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = list(enumerate(texts(5, 160)))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == {i: (len(sets[i]), find(i)) for i in range(len(rows))}


def test_line_dedup_brute_force(spark):
    rows = [(d, "\n".join(texts(100 + d, 6, 14))) for d in range(30)]
    seen, expected = [], {}
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            s = set(words(line))
            if not any(s and 180 * len(s & o) >= 80 * (len(s) + len(o)) for o in seen):
                kept.append(line)
            seen.append(s)
        expected[d] = "\n".join(kept)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == expected


def test_suffix_dedup_brute_force(spark, monkeypatch):
    r = random.Random(2)
    passage = "".join(r.choice("abcdef ") for _ in range(700))
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.randint(0, 900))) + (passage[: r.randint(300, 700)] if i % 2 else "") + "tail" * r.randint(0, 2)) for i in range(16)]
    rows += [(16, "ab" * 500), (17, rows[1][1]), (18, "é" * 450)]
    starts = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 399):
            starts.setdefault(b[i : i + 400], []).append((d, i))
    gone = {d: np.zeros(len(t.encode()), bool) for d, t in rows}
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 400] = True
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in out:
        b = np.frombuffer(dict(rows)[row["doc_id"]].encode(), np.uint8)
        assert row["n_removed"] == gone[row["doc_id"]].sum()
        assert row["kept_sha256"] == hashlib.sha256(b[~gone[row["doc_id"]]].tobytes()).hexdigest()


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(120)]
    bad = [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf"), 1.0])]
    out = topk.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    ints = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows}
    expected = set()
    for q in (0, 50, 100):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in out} == expected


def test_mix_keeps_to_targets(spark, sf):
    rows = mixing.mix_copies(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.max("copies").alias("copies")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["largest"] * 2 and r["copies"] <= 3 for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(sum(r["source_size"] for r in rows))


def test_token_report(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(50)], "doc_id long, text string")
    lengths = [r["length"] for r in tokens.encoded_lengths(docs).collect()]
    for r in tokens.context_report(tokens.length_histogram(tokens.encoded_lengths(docs))).collect():
        assert r["tokens_truncated"] == sum(min(x, r["length"]) for x in lengths)
        assert r["docs_over"] == sum(x > r["length"] for x in lengths) and r["total_tokens"] == sum(lengths)


def test_toxicity_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.score_documents(*rows).join(rows[1].where("toxic is not null"), "doc_id").where("held_out")
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.9
    assert scored.where("score < 0 or score > 1").count() == 0


def test_counterfactual_penalty_narrows_the_gap():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 6)).astype(float)
    y = ((x[:, 0] + 0.8 * x[:, 1] + rng.normal(0, 0.3, 400)) > 1).astype(float)
    swapped = x.copy()
    swapped[:, 1] = 1 - swapped[:, 1]
    of = np.arange(400)
    gap = []
    for penalty in (0.0, 50.0):
        w = toxicity.fit_logistic(x, y, swapped, of, penalty=penalty)
        score = lambda m: 1 / (1 + np.exp(-(m @ w[:-1] + w[-1])))  # noqa: B023, E731
        gap.append(np.abs(score(x) - score(swapped)).mean())
    assert gap[1] < gap[0] / 2
    assert toxicity.swap_identities("Women and men, womens") == "men and girls, womens"


def test_benchmark_matches_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(12 + i))) for i in range(8)] + [(8, "tiny one"), (9, ""), (10, None)]
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(60)) + " " + (items[i % 8][1].upper() if i % 3 == 0 else "") + " end here") for i in range(24)] + [(99, None), (100, "Tiny, one!")]
    out = {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("similarity = 1").collect()}
    assert out == {(i, i % 8) for i in range(0, 24, 3)} | {(100, 8)}


def test_license_windows(spark):
    filler = " ".join(WORDS)
    docs = [(i, f"{filler[: 3 * i]} {text.upper() if i % 2 else text} {filler}") for i, text in enumerate(licenses.TEMPLATES.values())]
    out = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("containment = 1").collect()}
    assert out == set(enumerate(licenses.TEMPLATES))


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontaminate", "mix"]
    assert set(docs.columns) < set(out.columns) and out.select("doc_id").exceptAll(docs.select("doc_id").union(docs.select("doc_id")).union(docs.select("doc_id"))).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        docs = common.staged(docs)


MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'


def shingles(text):
    w = [x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def contained(text, template, span=licenses.SPAN):
    """The best share of a template's shingles in a stretch, by trying every stretch."""
    w, t = ([x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", s.lower()) if x] for s in (text, template))
    k = min(5, len(t))
    has = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    wanted = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    return max((len(wanted & set(has[i : i + span * (len(t) - k + 1)])) / len(wanted) for i in range(len(has))), default=0.0)


def test_license_scan_of_altered_notices_at_every_offset(spark):
    r = random.Random(4)
    docs = []
    for n, text in enumerate([*licenses.TEMPLATES.values(), MIT_GRANT]):
        for offset in range(14):
            w = text.split()
            for _ in range(offset % 3):
                w.insert(r.randrange(len(w)), r.choice(WORDS))
            docs.append((len(docs), " ".join([*WORDS[:offset], *w, *WORDS[20:30]])))
    found = {(x["doc_id"], x["license"]): x["containment"] for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), licenses.TEMPLATES).collect()}
    expected = {(d, name): c for d, text in docs for name, t in licenses.TEMPLATES.items() if (c := contained(text, t)) >= 0.8}
    # each document has one notice: of versions of it, those it holds most of
    alike = lambda a, b: len(shingles(a) & shingles(b)) * 2 >= min(len(shingles(a)), len(shingles(b)))
    expected = {(d, n): c for (d, n), c in expected.items() if not any(d == e and c < x and alike(licenses.TEMPLATES[n], licenses.TEMPLATES[o]) for (e, o), x in expected.items())}
    assert found == pytest.approx(expected)
    assert all((d, "mit-grant") in found for d in range(len(docs) - 14, len(docs), 3))


def test_license_scan_finds_short_notices_and_whole_texts(spark):
    texts_ = licenses.license_texts()
    assert {"text-gpl-3", "text-bsd-3-clause", "text-mit"} <= set(texts_)
    docs = [(-1, "We wrote this. All Rights  Reserved."), (-2, "all rights"), (-3, "it is CC BY 4.0 here")]
    docs += [(i, f"{' '.join(WORDS[:i])} {t} {' '.join(WORDS)}") for i, t in enumerate(texts_.values())]
    found = {(x["doc_id"], x["license"]): (x["containment"], x["start_word"]) for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: v for k, v in found.items() if k[0] < 0} == {(-1, "all-rights-reserved"): (1.0, 3), (-3, "cc-by-4"): (1.0, 2)}
    assert all(found[i, name][0] == 1.0 and found[i, name][1] >= i for i, name in enumerate(texts_))
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), {"none": "..."})


def test_pipeline_with_null_and_repeated_ids(spark, sf, tmp_path):
    import corpus_pipeline

    def text(seed, width):
        r = random.Random(seed)
        w = [f"v{r.randrange(9000)}" for _ in range(84)]
        return "\n".join(" ".join(w[i : i + width]) for i in range(0, 84, width))

    odd = [(None, text(1, 12)), (None, text(2, 12)), (None, text(2, 7)), (90001, text(3, 12)), (90001, text(3, 7)), (90001, text(3, 4)), (90002, text(4, 12)), (90002, text(5, 12)), (90002, text(6, 12)), (90000, text(7, 12)), (90003, text(7, 7))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).withColumn("source", F.lit("a")).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is null or doc_id >= 90000").collect()]
    # of one source each row that stays is taken once
    one = [x for x in out if x[0] == 90001]
    assert len(one) == 1 and one[0] in odd
    assert sorted(x for x in out if x[0] != 90001 and x[0]) == sorted(odd[6:10])
    assert sorted(x[1] for x in out if x[0] is None) == sorted(x[1] for x in odd[:3])
