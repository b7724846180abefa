"""Sharding, alignment and collocations: brute force, laws, and odd tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import alignment, collocations, queries, sharding
from tests.compare import assert_same

from .test_odd_rows import odd  # noqa: F401

TEXTS = [
    None, "", " ", "a", "a b", "  two  spaces ", "tab\tand\nline\r\n\r\nend", "It's they'll 12,345.67 naïve façade", "日本語 テキスト 🙂🙂 ẞ", "mark ▁ inside", "<|endoftext|> <s> </s> <unk> <0x41>",
    "x" * 5000, " ".join(["the cat sat"] * 800), "\x00\x01\x7f", "ﬁ ｆ ² ½", "é decomposed é", "  　wide​", "a b",
]


def draw(key, path, children):
    wait = lambda c: -math.log((int(hashlib.md5(f"{key}{path}/{c}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / children[c]
    return min(sorted(c for c in children if children[c] > 0), key=wait)


def leaf(key, tree):
    region = draw(key, "", {r: sum(sum(x.values()) for x in racks.values()) for r, racks in tree.items()})
    rack = draw(key, f"/{region}", {k: sum(x.values()) for k, x in tree[region].items()})
    return region, rack, draw(key, f"/{region}/{rack}", tree[region][rack])


def test_descent_and_movement(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.layout(12, 3, 2)
    tree["region1"]["rack0"][4] = 3.0
    less = {r: {k: dict(x) for k, x in racks.items()} for r, racks in tree.items()}
    less["region1"]["rack0"][4] = 0.5
    df = sharding.descended(keys, F.col("k"), tree)
    for name, t in (("less_", less), ("more_", sharding.grow(tree, 12, 2.0))):
        df = sharding.descended(df, F.col("k"), t, name)
    rows = df.collect()
    for r in rows[:500]:
        assert (r.region, r.rack, r["shard"]) == leaf(r.k, tree)
        assert (r.less_region, r.less_rack, r.less_shard) == leaf(r.k, less)
    share = Counter(r["shard"] for r in rows)
    assert abs(share[4] - 4000 * 3 / 14) < 120 and all(abs(share[s] - 4000 / 14) < 80 for s in range(12) if s != 4)
    # only rows into or out of the subtree whose weights changed move
    for r in rows:
        if "region1" not in (r.region, r.less_region):
            assert r["shard"] == r.less_shard
        if r.region == r.less_region == "region1" and "rack0" not in (r.rack, r.less_rack):
            assert r["shard"] == r.less_shard
        assert r.more_shard in (r["shard"], 12)
    assert abs(sum(r.more_shard == 12 for r in rows) - 4000 * 2 / 16) < 100
    with pytest.raises(ValueError):
        sharding.grow(tree, 3)
    with pytest.raises(ValueError):
        sharding.descended(keys, F.col("k"), {"a": {"b": {1: 0.0}}})


def test_shards_of_odd_rows(spark, odd):  # noqa: F811
    import zlib

    clash = odd
    for c in ("shard", "slot", "law", "region", "size", "_digest", "_n"):
        clash = clash.withColumn(c, F.lit("x"))
    found = sharding.shard_documents(clash).collect()
    rows = odd.select("doc_id", "text").collect()
    tree = sharding.layout()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), leaf("" if r.doc_id is None else r.doc_id, tree)[2]) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r["shard"]) for r in found) == want
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in found} == {"key"} and all(r.grown_shard in (r["shard"], 16) for r in found)
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_slots_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_BITS", 4)
    docs = spark.range(0, 500, 1, 3).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.shard_documents(docs).collect()
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert len(found) == 500 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards(spark, odd, tmp_path):  # noqa: F811
    path = f"{tmp_path}/shards"
    sharding.write_shards(odd, path, files=2)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    tree = sharding.layout()
    assert all(r["_shard"] == leaf("" if r.doc_id is None else r.doc_id, tree)[2] for r in back.collect())


def bytes_of(table, i):
    return table.data[table.at[i] : table.at[i] + table.size[i]].tobytes()


def brute_alignment(docs):
    from tokenizers import Tokenizer

    t, file = alignment.tokenizers(), Tokenizer.from_file(alignment.BYTE_LEVEL)
    file.encode_special_tokens = True
    rows, links = [], []
    for text in docs:
        whole = b" " + (text or "").encode()
        a = file.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        if not text or b"".join(bytes_of(t.a_table, i) for i in a) != whole or b"".join(bytes_of(t.b_table, i) for i in b) != whole:
            rows.append((0, 0, 0, 0, "", "")), links.append([])
            continue
        a_ends = {e: i + 1 for i, e in enumerate(np.cumsum([len(bytes_of(t.a_table, i)) for i in a]).tolist())}
        b_ends = {e: i + 1 for i, e in enumerate(np.cumsum([len(bytes_of(t.b_table, i)) for i in b]).tolist())}
        groups, own, at = [], [], (0, 0)
        for cut in sorted(set(a_ends) & set(b_ends)):
            groups.append("|".join(",".join(map(str, x[p : ends[cut]])) for x, p, ends in ((a, at[0], a_ends), (b, at[1], b_ends))))
            at = a_ends[cut], b_ends[cut]
            own.append((a[at[0] - 1], b[at[1] - 1]))
        written = ";".join(groups)
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(written.encode()).hexdigest(), written))
        links.append(own)
    n = Counter(x for own in links for x in own)
    highest = {}
    for (_, b), c in n.items():
        highest[b] = max(c, highest.get(b, 0))
    return [(*r, sum(n[x] == highest[x[1]] for x in own), sum(n[x] for x in own)) for r, own in zip(rows, links)]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 3000)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + TEXTS + ["a b"]
    docs = spark.createDataFrame([(i, x, "links") for i, x in enumerate(texts)], "doc_id long, text string, links string").repartition(3)
    want = brute_alignment(texts)
    found = {r.doc_id: r for r in alignment.align(docs).collect()}
    for i, w in enumerate(want):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (*w[:5], *w[6:]), texts[i]
    written = {r.doc_id: r.groups for r in alignment.aligned(docs, groups=True).collect()}
    assert [written[i] for i in range(len(texts))] == [w[5] for w in want]
    # a mark that stands for a space in the vocabulary changes a text; nothing else here does
    assert [texts[i] for i, w in enumerate(want) if texts[i] and not w[0]] == ["mark ▁ inside"]


def test_alignment_of_odd_rows(spark, odd):  # noqa: F811
    out = alignment.align(odd)
    assert out.count() == odd.count() and out.where("doc_id is null").count() == 2
    assert out.where("n_links = 0").count() == out.where("groups_sha256 = ''").count() == 3
    assert alignment.align(odd.limit(0)).count() == 0


def test_bitsets():
    g = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(g.integers(1, n + 1, n // 3), n)) for _ in range(2))
        cuts, up_a, up_b = alignment.shared_cuts(a, b, n)
        assert cuts.tolist() == sorted(set(a) & set(b))
        assert up_a.tolist() == [int((a <= c).sum()) for c in cuts] and up_b.tolist() == [int((b <= c).sum()) for c in cuts]


def brute_collocations(docs, least, covered=80, top=2000):
    import re

    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [c for (o, x), c in f.items() if o == lang and len(w) < len(x) and c >= least and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if longer and 100 * max(longer) >= covered * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("bits, top", [(24, 2000), (6, 5)])
def test_collocations(spark, monkeypatch, bits, top):
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "PARTS", 3)
    g = np.random.default_rng(1)
    words = ["a", "B", "b", "Éa", "éa", "c-d", "e'f", " ", "zu", "日本"]
    docs = [("".join(str(g.choice(words)) + str(g.choice([" ", "  ", "\t", ". ", "\n", " , ", "!"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(int(g.integers(1, 80)))), [None, "en", "", "und"][i % 4]) for i in range(60)]
    docs += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("a b a b a b a b", "en"), ("a b a b a b a b", "en")]
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("n", F.lit("x")).withColumn("phrase", F.lit("y")).repartition(4)
    found = sorted(tuple(r) for r in collocations.collocations(df, least=4, top=top, bits=bits).collect())
    want = brute_collocations(docs, 4, top=top)
    assert found == want and len(found) > 10


def test_collocations_of_odd_rows(spark, odd):  # noqa: F811
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd, bits=12, least=3).collect()) == brute_collocations(rows, 3)
    assert collocations.collocations(odd.limit(0), bits=12).count() == 0


def test_exact_score_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "x", 1, big + 2), ("en", "y", 1, big), ("en", "x y", 2, big)]
    found = collocations.scored_phrases(spark.createDataFrame(rows, "lang string, phrase string, m int, n long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in found] == [(big, big + 2, big, 2000000 * big // (2 * big + 2))]


@pytest.mark.parametrize("name", ["op11_shard", "op13_collocations"])
def test_same_as_sql(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_top_k_of_large_components(spark):
    from gradus.llm import topk

    rows = [(0, [1.0, 0.0]), (1, [1e7, 0.0]), (2, [2.0, 5.0]), (3, [0.0, 1e30]), (4, [-3e6, 1e12]), (50, [1e6, 0.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 4).collect()
    w = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for q in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(w[q], w[i])), i) for i in w if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in scores]
    beyond = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(beyond, F.col("vec_id") == 0).collect()


def test_labels_of_repeated_ids(spark):
    from gradus.llm import toxicity

    rows = [(i, "you vile awful thing" if i % 2 else "a calm plain day") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = toxicity.fit(spark.createDataFrame(rows * 3 + [(3, "zzz later text")], "doc_id long, text string"), labels)
    assert np.array_equal(once.table, many.table) and np.allclose(once.weights, many.weights)


def test_best_window_of_repeated_ids(spark, tmp_path):
    from gradus.llm import decontaminate

    item = " ".join(f"i{k}" for k in range(20))
    near = " ".join("other" if k == 2 else f"i{k}" for k in range(20))
    spark.createDataFrame([(1, "x y z " + item), (1, near + " tail")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (r,) = decontaminate.query(spark, str(tmp_path)).collect()
    assert (r.doc_id, r.item_id, r.similarity, r.start_word) == (1, 7, 1.0, 3)
