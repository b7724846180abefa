"""A toxicity classifier with a counterfactual regulariser.

Features are the 5-byte grams of the lower-cased letters of a text (other ASCII is space), present or not: words and
word stems alike, in any language. A logistic model is fitted on a bounded sample of labelled documents. In each
labelled document's sentences the identity terms are swapped for others of their group, and the squared change of the
score is penalised, so that neutral mentions of a group do not raise it. Every whole text is then scored in Arrow
batches; texts are not shuffled.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, staged, string_buffers

GRAM = 5
BUCKETS = 1 << 20
#: Labelled documents that a fit uses at most (those of the smallest hashes of their id), and features it selects.
MAX_TRAIN = 12_000
MAX_FEATURES = 512
#: Examples that a step of the fit takes at once.
FIT_ROWS = 1000
#: Terms of one group stand in for each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("immigrant", "refugee", "citizen", "native"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)

_LETTER = np.full(256, 32, np.uint64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(GRAM)]


def gram_pairs(column, table: np.ndarray | None = None):
    """For runs of documents: (first, n, document places, features), each pair once.

    A feature is a bucket of the gram's hash or, with ``table``, what it maps to (negative: none). Texts are read as
    if spaces stood before and after.
    """
    data, offsets = string_buffers(column)
    for first, last in chunks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        n = last - first
        # enough spaces around each document that a gram across two of them is all space
        pad = 2 * (GRAM - 1)
        letters = np.full(int(at[-1]) + pad * n, 32, np.uint64)
        place = np.repeat(pad * np.arange(n) + GRAM - 1, np.diff(at)) + np.arange(at[-1])
        letters[place] = _LETTER[data[offsets[first] : offsets[last]]]
        m = len(letters) - GRAM + 1
        grams = letters[:m] * _STEPS[0]
        for j in range(1, GRAM):
            grams += letters[j : m + j] * _STEPS[j]
        feature = (mix64(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)
        doc = np.repeat(np.arange(n), np.diff(at) + pad)[:m]
        if table is not None:
            feature = table[feature].astype(np.int64)
            hit = np.flatnonzero(feature >= 0)
            doc, feature = doc[hit], feature[hit]
        pairs = np.unique(doc * BUCKETS + feature)
        yield first, n, pairs // BUCKETS, pairs % BUCKETS


def swap_identities(text: str, groups=IDENTITY_GROUPS) -> str:
    """The text with each identity term replaced by the next of its group."""
    after = {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}
    return re.sub(r"[^\W\d_]+", lambda m: after.get(m[0].lower(), m[0]), text)


class ToxicityModel:
    """Weights of the selected features and the intercept; ``table`` maps a gram's bucket to its feature."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.table = np.full(BUCKETS, -1, np.int16)
        self.table[buckets] = np.arange(len(buckets))
        self.weights, self.intercept = np.asarray(weights, float), float(intercept)

    def score_column(self, column) -> np.ndarray:
        out = np.full(len(column), self.intercept)
        for first, n, doc, feature in gram_pairs(column, self.table):
            out[first : first + n] += np.bincount(doc, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    def below(self, docs: DataFrame, threshold: float) -> DataFrame:
        """The rows of ``docs`` that score less than ``threshold``; no column is added or read but ``text``."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array(self.score_column(batch.column("text")) < threshold))

        return docs.mapInArrow(run, docs.schema)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column ``score``; null and empty texts get the intercept's."""
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                scores = self.score_column(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

        schema = docs.drop("score").schema.add("score", "double")
        return docs.drop("score").mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, swapped: np.ndarray, of: np.ndarray, ridge: float = 1.0, penalty: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Newton steps for the log loss + ridge + penalty * (score(x[of]) - score(swapped))**2; the last weight is the intercept.

    Examples are taken FIT_ROWS at a time, so that no other matrix of their number is held.
    """
    w = np.zeros(x.shape[1] + 1)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    one = lambda m: np.hstack([m, np.ones((len(m), 1))])  # noqa: E731  doubles from here on
    sigma = lambda m: 1 / (1 + np.exp(-np.clip(m @ w, -35, 35)))
    for _ in range(rounds):
        grad, hess = keep * w, np.diag(keep)
        for a in range(0, len(x), FIT_ROWS):
            m = one(x[a : a + FIT_ROWS])
            p = sigma(m)
            grad += m.T @ (p - y[a : a + FIT_ROWS])
            hess += (m * (p * (1 - p) + 1e-6)[:, None]).T @ m
        for a in range(0, len(of), FIT_ROWS):
            m, s = one(x[of[a : a + FIT_ROWS]]), one(swapped[a : a + FIT_ROWS])
            q, r = sigma(m), sigma(s)
            slope = m * (q * (1 - q))[:, None] - s * (r * (1 - r))[:, None]
            grad += penalty * slope.T @ (q - r)
            hess += penalty * slope.T @ slope
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """A model of ``labels.toxic`` over texts of ``docs``, from at most ``max_train`` labelled documents.

    Null labels are left out, repeated ones count as their largest; labels without a text teach nothing, and of the texts
    of one id the smallest does. Without
    both classes the score is the share of toxic rows (0 without rows).
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded, so it can be broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that repeats teaches once, by the smallest of its texts
    train = staged(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not bad or not good:
        return ToxicityModel(np.zeros(0, int), np.zeros(0), 35.0 if bad else -35.0)

    def by_class(batches):
        import pyarrow as pa

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0.5
            for first, n, doc, feature in gram_pairs(batch.column("text")):
                at, inverse = np.unique(feature, return_inverse=True)
                here = toxic[first : first + n][doc]
                yield pa.RecordBatch.from_pydict({"feature": at, "bad": np.bincount(inverse, here, len(at)).astype(np.int64), "good": np.bincount(inverse, ~here, len(at)).astype(np.int64)})

    counts = train.mapInArrow(by_class, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total, a, b = F.lit(float(bad + good)), F.col("bad"), F.col("good")
    spread = a * F.lit(float(good)) - b * F.lit(float(bad))
    chi = total * spread * spread / (F.lit(float(bad) * good) * (a + b) * (total - a - b + F.lit(1.0)))
    top = counts.where(a + b >= 3).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    buckets = np.array([r["feature"] for r in top], int)
    table = np.full(BUCKETS, -1, np.int16)
    table[buckets] = np.arange(len(buckets))

    def examples(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            swapped = [swap_identities(t or "", groups) for t in texts]
            both = [(batch.column("text"), np.arange(len(texts)), False)]
            changed = np.array([i for i, (t, s) in enumerate(zip(texts, swapped, strict=True)) if s != (t or "")], int)
            if len(changed):
                both.append((pa.array([swapped[i] for i in changed]), changed, True))
            found = {False: [[] for _ in texts], True: [None for _ in texts]}
            for column, rows, kind in both:
                for i in rows:
                    found[kind][i] = []
                for first, _, doc, feature in gram_pairs(column, table):
                    for d, f in zip(doc, feature, strict=True):
                        found[kind][rows[first + d]].append(int(f))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "features": pa.array(found[False], pa.list_(pa.int32())), "swapped": pa.array(found[True], pa.list_(pa.int32()))})

    rows = train.mapInArrow(examples, "toxic double, features array<int>, swapped array<int>").toArrow()  # max_train rows at most

    def dense(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have the list, and a byte for each of their features."""
        lists = rows.column(name).combine_chunks()
        some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        out = np.zeros((len(lists), len(buckets)), np.uint8)
        out[np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())] = 1
        return some, out[some]

    of, swapped = dense("swapped")
    w = fit_logistic(dense("features")[1], rows.column("toxic").to_numpy(), swapped, of)
    return ToxicityModel(buckets, w[:-1], w[-1])


def held_out(doc_id):
    """Rows of the fold that is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


THRESHOLD = 0.3


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the folds that are not held out, for every row of ``docs``."""
    model = fit(docs, labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    out = model.score(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, same columns, without the rows whose score reaches ``threshold``.

    Each row is judged by its text alone: null ids, repeated rows and columns of any name stay as they are, null and
    empty texts have the score of the intercept. Without labels of both classes all go, or none, as in ``fit``.
    """
    return fit(docs, labels).below(docs, threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
