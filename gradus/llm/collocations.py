"""Phrase collocations by hash-filtered passes over the texts (PCY and DHP) with Apriori pruning.

Pass k counts phrases of k words exactly and, in the same reading, counts phrases of k + 1 words in hash buckets. A phrase
is counted in pass k + 1 only if its bucket reached the least count and both its parts of k words did (Apriori). Both tests
are bitmaps of 2**bits bits, so what is broadcast has a fixed size, whatever the corpus; a hash collision lets a phrase
through to be counted, never keeps one out. Bucket counts stop at the least count, so a task's are one byte each.

Everything is by language: a word hashes and counts as (language, word). Counts are summed in each task before they are
shuffled, so frequent words are one row a block of text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _STEP, chunks, mix64, scratch, staged, string_buffers, word_hashes

LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Buckets and bitmaps have 2**BITS places: 2 MB a bitmap, 16 MB of counts in a task. At 100 TB, 28 to 30 are right.
BITS = 24
#: Buckets of one shuffled row.
SLICE = 4096
#: Bytes of text counted at once.
BLOCK = 1 << 22
#: Parts of a language that are ranked on their own first.
PARTS = 64
_WORD, _BREAK = 0, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ids(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys from 0 in order of appearance, and the keys by number."""
    import pyarrow as pa

    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _hashes(strings) -> np.ndarray:
    data, at = string_buffers(strings)
    at = at - at[0] if len(at) else at
    return word_hashes(data[: at[-1]], at[:-1], at[1:], lower=False)


class _Block:
    """The words of a block of documents: ``words[word[i]]`` in ``langs[lang[i]]`` at place i, and whether the next place goes on in the same piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs):
        import pyarrow as pa

        data = _LOWER[data]
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == _WORD
        first, final = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first[edges], final[edges - 1] = inside[edges + 1], inside[edges]
        starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
        breaks, doc = np.cumsum(kind == _BREAK, dtype=np.int32)[starts], np.searchsorted(at, starts, "right") - 1
        self.n = len(starts)
        self.goes_on = np.zeros(self.n, bool)
        self.goes_on[:-1] = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))).dictionary_encode()
        langs = langs.dictionary_encode()
        self.words, self.langs = words.dictionary, langs.dictionary
        word, lang = words.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)[doc]
        self.unit, keys = _ids(word * len(self.langs) + lang)
        self.word, self.lang = keys // len(self.langs), keys % len(self.langs)
        self.hash = mix64(_hashes(self.words)[self.word] ^ (mix64(_hashes(self.langs) + np.uint64(1)))[self.lang])[self.unit]

    def runs(self, k: int) -> np.ndarray:
        """Whether a phrase of ``k`` words starts at each place."""
        out = np.ones(self.n, bool)
        for j in range(k - 1):
            out[: self.n - j] &= self.goes_on[j:]
            out[self.n - j :] = False
        return out

    def hashes(self, places: np.ndarray, k: int) -> np.ndarray:
        out, factor = np.zeros(len(places), np.uint64), 1
        for j in range(k):
            out += self.hash[places + j] * np.uint64(factor)
            factor = factor * _STEP % (1 << 64)
        return mix64(out + np.uint64(k))

    def phrases(self, places: np.ndarray, k: int):
        """A place of each distinct phrase of ``k`` words that starts at ``places``, and how often it does. Exact: by numbers of words, not by hashes."""
        ids = self.unit[places]
        for j in range(1, k):
            ids, _ = _ids(ids * len(self.word) + self.unit[places + j])
        at = np.zeros(ids.max() + 1 if len(ids) else 0, np.int64)
        at[ids[::-1]] = places[::-1]
        return at, np.bincount(ids, minlength=len(at))

    def texts(self, places: np.ndarray, k: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = [self.words.take(pa.array(self.word[self.unit[places + j]])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]


def _has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def count_pass(docs: DataFrame, k: int, known=None, bits: int = BITS, least: int = LEAST, last: bool = False) -> DataFrame:
    """(lang, phrase, hash, n, slice, counts): rows of phrases of ``k`` words with their counts in a block of text, and rows of slices of bucket counts of ``k`` + 1 words.

    ``known`` is a broadcast pair of bitmaps: frequent phrases of ``k`` - 1 words, and frequent buckets of ``k``. In pass
    1 a row without a phrase has the words of a block. The ``last`` pass counts no buckets.
    """
    schema = "lang string, phrase string, hash long, n long, slice int, counts binary"

    def run(batches):
        import pyarrow as pa

        shift, kind = np.uint64(64 - bits), np.uint8 if least < 256 else np.uint32
        seen = np.zeros(0 if last else 1 << bits, kind)
        names = [f.split()[0] for f in schema.split(", ")]

        def rows(lang, phrase, hashes, n):
            m = len(n)
            columns = [lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in chunks(offsets, BLOCK):
                block = _Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column("lang").slice(a, b - a))
                if not block.n:
                    continue
                going = block.runs(k)
                if k > 1:
                    frequent, buckets = known.value
                    part, before = np.flatnonzero(block.runs(k - 1)), np.zeros(block.n + 1, bool)
                    before[part] = _has(frequent, block.hashes(part, k - 1) >> shift)
                    going &= before[:-1] & before[1:]
                places = np.flatnonzero(going)
                if k > 1:
                    places = places[_has(buckets, block.hashes(places, k) >> shift)]
                else:
                    units = np.bincount(block.lang[block.unit], minlength=len(block.langs))
                    yield rows(block.langs, pa.nulls(len(units), pa.string()), np.zeros(len(units), np.int64), units)
                at, n = block.phrases(places, k)
                yield rows(block.langs.take(pa.array(block.lang[block.unit[at]])), block.texts(at, k), block.hashes(at, k).view(np.int64), n)
                if not last:
                    going = np.zeros(block.n + 1, bool)
                    going[places] = True
                    following = np.flatnonzero(going[:-1] & going[1:] & block.goes_on)
                    ids, bucket = _ids(block.hashes(following, k + 1) >> shift)
                    seen[bucket] = np.minimum(least, seen[bucket] + np.bincount(ids, minlength=len(bucket))).astype(kind)
        codec, size = pa.Codec("zstd", 1), min(SLICE, max(1, len(seen)))
        slices = seen.reshape(-1, size)
        for group in np.array_split(np.flatnonzero(slices.any(1)), 8):
            m = len(group)
            blobs = pa.array([codec.compress(slices[i].tobytes(), asbytes=True) for i in group.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(group, pa.int32()), blobs], names=names)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def bucket_bitmap(counted: DataFrame, bits: int = BITS, least: int = LEAST) -> np.ndarray:
    """A bitmap of the buckets of ``count_pass`` rows whose counts sum to ``least``: slices are dealt out, summed and reduced to bits by tasks."""
    kind, size = np.uint8 if least < 256 else np.uint32, min(SLICE, 1 << bits)

    def run(batches):
        import pyarrow as pa

        sums, codec = {}, pa.Codec("zstd", 1)
        for batch in batches:
            for at, blob in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                own = np.frombuffer(codec.decompress(blob.as_buffer(), size * np.dtype(kind).itemsize, asbytes=True), kind)
                sums[at] = np.minimum(least, own + sums[at].astype(np.int64)).astype(kind) if at in sums else own
        bits_of = [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits_of, pa.binary())], names=["slice", "bits"])

    found = counted.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for at, blob in zip(found.column("slice").to_pylist(), found.column("bits").to_pylist()):
        out[at * size // 8 : at * size // 8 + len(blob)] = np.frombuffer(blob, np.uint8)
    return out


def phrase_bitmap(phrases: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the hashes of ``phrases`` (hash)."""
    bucket = F.shiftrightunsigned("hash", 64 - bits)
    parts = phrases.select((bucket + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).toArrow()
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for at, blob in zip(parts.column("at").to_pylist(), parts.column("bits").to_pylist()):
        out[(at - 1) * 4096 : (at - 1) * 4096 + len(blob)] = np.frombuffer(blob, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, phrase, m, n): all phrases of 1 to ``longest`` words that occur ``least`` times in a language, and a row of m = 0 with the words of each language."""
    spark, levels, known = docs.sparkSession, [], None
    for k in range(1, longest + 1):
        with scratch(spark) as keep:
            counted = staged(count_pass(docs, k, known, bits, least, k == longest))
            summed = counted.where("slice is null").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
            level = staged(summed.where((F.col("n") >= least) | F.col("phrase").isNull()).select("lang", "phrase", "hash", F.when(F.col("phrase").isNull(), 0).otherwise(k).alias("m"), "n"))
            keep(level)
            if k < longest:
                known = spark.sparkContext.broadcast((phrase_bitmap(level.where("m > 0"), bits), bucket_bitmap(counted, bits, least)))
        levels.append(level.drop("hash"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def scored_phrases(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of ``frequent_phrases`` rows of two words and more that no longer phrase covers.

    The score is 2000000 * a / (l + r), rounded down, at the cut where it is lowest (of ties the first). Arithmetic is
    decimal, as products may pass 64 bits. A phrase is covered if a longer one that holds its words contiguously occurs at
    least ``covered`` percent as often.
    """
    words = phrases.where("m > 0").select("lang", "phrase", "n")
    candidates = phrases.where("m > 1").select("lang", "phrase", F.col("n").alias("a"), "m", F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    met = sides.join(words.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = candidates.where("m > 2").select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
    longer = inner.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    big = lambda c, times: F.col(c).cast("decimal(20, 0)") * times
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (big("_longer", 100) < big("a", covered)))
    return kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` rows with their ``rank``; parts of a language are cut to ``top`` on their own first, so no task ranks a language as a whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    cut = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (text, lang).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    Null languages are ``und``; null and empty texts have no words; repeated rows count each; other columns are ignored;
    an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        phrases = frequent_phrases(docs, longest, least, bits)
        out = staged(best(scored_phrases(phrases, covered), top).join(phrases.where("m = 0").select("lang", F.col("n").alias("_words")), "lang"))
        keep(out)
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("_words").alias("n"), "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1
), places AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) t(m)
), f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), cuts AS (
  SELECT *, unnest(range(1, m)) AS k FROM c
), costs AS (
  SELECT cuts.lang, cuts.phrase, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f + q.f))::BIGINT AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = array_to_string(w[1 : k], ' ') JOIN f q ON q.lang = cuts.lang AND q.phrase = array_to_string(w[k + 1 : cuts.m], ' ')
), lowest AS (
  SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, w, size, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM c)
), longer AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_ GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
