"""N-gram Jaccard join: links of documents whose shingle sets are alike, and their components.

1. Every document becomes a set of shingle hashes; equal sets are one class, and only its first document goes on.
2. Routing. A set can only reach the threshold if ceil(t n) of its shingles occur in another document. Packed runs
   of sorted hashes are dealt out by hash to find how many do; most sets are done then. For the rest, shingles are
   counted exactly, and the first n - ceil(t n) + 1 of each set, rarest first, are its prefix: two sets that reach
   the threshold share a shingle there. Sets that meet in a prefix form candidate groups.
3. Signature trees. Within a group, a tree is built over the sets in blocks; nodes hold the OR of their sets' token
   bitmaps, a size range and the largest number of tokens that a bitmap hides. Two trees (or one with itself) are
   traversed together; a pair of nodes is left when even the largest possible overlap is too small, or when all its
   sets are linked already. Leaves are verified on the sets themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_words, mix64, numbered, scratch, shingle_hashes, staged
from .components import connected_components

#: Sets in one block of a large candidate group.
BLOCK_SETS = 4096
LEAF_SETS = 4
FAN_OUT = 4


class SignatureTree:
    """A hierarchy over sorted hash sets; leaves hold up to LEAF_SETS sets that are neighbours by size and minimum."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]), i))
        self.sets = sets
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bit = flat & np.uint64(bits - 1)
        np.bitwise_or.at(self.maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        size = np.array([len(s) for s in sets])
        hidden = size - np.bitwise_count(self.maps).sum(1)
        # a node: (members, children, bitmap, smallest, largest, hidden)
        level = [self._node(order[a : a + LEAF_SETS], [], self.maps, size, hidden) for a in range(0, len(order), LEAF_SETS)]
        while len(level) > 1:
            level = [self._parent(level[a : a + FAN_OUT]) for a in range(0, len(level), FAN_OUT)]
        self.root = level[0]

    @staticmethod
    def _node(members, children, maps, size, hidden):
        m = np.array(members)
        return m, children, np.bitwise_or.reduce(maps[m], axis=0), int(size[m].min()), int(size[m].max()), int(hidden[m].max())

    @staticmethod
    def _parent(nodes):
        if len(nodes) == 1:
            return nodes[0]
        return np.concatenate([n[0] for n in nodes]), nodes, np.bitwise_or.reduce([n[2] for n in nodes], axis=0), min(n[3] for n in nodes), max(n[4] for n in nodes), max(n[5] for n in nodes)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def dual_links(left: SignatureTree, right: SignatureTree, percent: int, parent_left: np.ndarray, parent_right: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Links (place in left, place in right) that join sets not connected so far.

    ``parent`` is a union-find forest over the numbers that ``parent_left`` and ``parent_right`` give the sets.
    """

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    stack = [(left.root, right.root)]
    while stack:
        u, v = stack.pop()
        if u[4] * 100 < percent * v[3] or v[4] * 100 < percent * u[3]:
            continue
        # (100 + t) * overlap >= t * (|x| + |y|)
        most = int(np.bitwise_count(u[2] & v[2]).sum()) + min(u[5], v[5])
        if (100 + percent) * most < percent * (u[3] + v[3]):
            continue
        roots = {find(int(parent_left[i])) for i in u[0]}
        if len(roots) == 1 and roots == {find(int(parent_right[j])) for j in v[0]}:
            continue
        if not u[1] and not v[1]:
            for i in u[0]:
                for j in v[0]:
                    x, y = find(int(parent_left[i])), find(int(parent_right[j]))
                    if x == y:
                        continue
                    a, b = left.sets[i], right.sets[j]
                    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                        continue
                    if (100 + percent) * overlap(a, b) >= percent * (len(a) + len(b)):
                        links.append((int(i), int(j)))
                        parent[max(x, y)] = min(x, y)
        elif u is v:
            kids = u[1]
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif v[1] and (not u[1] or len(v[0]) >= len(u[0])):
            stack += [(u, w) for w in v[1]]
        else:
            stack += [(w, v) for w in u[1]]
    return links


def _bits(sets: list[np.ndarray]) -> int:
    """Bits of the maps: 16 for each token of the largest set, from 256 to 16384."""
    return int(min(16384, max(256, 1 << (16 * max(map(len, sets)) - 1).bit_length())))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): set size and two fingerprints of the set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id")
            for first, words, at in document_words(batch.column("text")):
                sets = [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(len(at) - 1)]
                n = [len(s) for s in sets]
                marks = [(int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(s * (s | np.uint64(1))).view(np.int64))) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array(n, pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


#: Documents in one packed run (the last number marks shingles that several of them have), and shingles dealt to a part.
RUN_DOCS = 255
PART_SHINGLES = 2_000_000
_PIECE = "part long, run long, high binary, low binary, doc binary"


def _pieces(k: int, parts: int):
    """Packed runs: sorted 40-bit hashes of the documents' shingles by part, and one row of (ids, sizes, shared inside)."""

    def run(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd", 1)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, words, at in document_words(batch.column("text")):
                for a in range(0, len(at) - 1, RUN_DOCS):
                    b = min(a + RUN_DOCS, len(at) - 1)
                    sets = [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(a, b)]
                    sizes = np.array([len(s) for s in sets], np.int32)
                    flat = np.concatenate(sets) >> np.uint64(24)
                    order = np.argsort(flat, kind="stable")
                    flat, doc = flat[order], np.repeat(np.arange(b - a), sizes)[order].astype(np.uint8)
                    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
                    several = ~new | np.concatenate([~new[1:], [False]]) if len(flat) else new
                    inside = np.bincount(doc[several], minlength=b - a).astype(np.int32)
                    doc = np.where(several, RUN_DOCS, doc)[new].astype(np.uint8)
                    flat = flat[new]
                    mine = ids[first + a : first + b].astype(np.int64).tobytes()
                    name = int(mix64(np.frombuffer(mine, np.uint64).copy()).sum().view(np.int64))
                    part = ((flat >> np.uint64(8)) * np.uint64(parts)) >> np.uint64(32)
                    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(flat) else np.zeros(1, int)
                    rows = {"part": [abs(name) % parts], "run": [name], "high": [None], "low": [mine], "doc": [sizes.tobytes() + inside.tobytes()]}
                    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
                        h = flat[c:d]
                        steps = np.diff((h >> np.uint64(16)).astype(np.int64), prepend=0).astype(np.uint32).tobytes()
                        rows["part"].append(int(part[c]))
                        rows["run"].append(name)
                        rows["high"].append(len(h).to_bytes(4, "little") + codec.compress(steps, asbytes=True))
                        rows["low"].append(h.astype(np.uint16).tobytes())
                        rows["doc"].append(doc[c:d].tobytes())
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int64()), ("run", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("doc", pa.binary())]))

    return run


def _count_shared(key, table):
    """For each run in a part: how many shingles of each document occur in another run. Rows of ids pass through."""
    import pyarrow as pa

    codec = pa.Codec("zstd", 1)
    runs, highs, lows, docs = (table.column(c).to_pylist() for c in ("run", "high", "low", "doc"))
    out = {"run": [], "ids": [], "counts": []}
    names, values, slots = [], [], []
    for run, high, low, doc in zip(runs, highs, lows, docs, strict=True):
        if high is None:
            out["run"].append(run), out["ids"].append(low), out["counts"].append(doc)
            continue
        n = int.from_bytes(high[:4], "little")
        top = np.cumsum(np.frombuffer(codec.decompress(high[4:], 4 * n, asbytes=True), np.uint32).astype(np.uint64))
        values.append(top << np.uint64(16) | np.frombuffer(low, np.uint16).astype(np.uint64))
        slots.append(np.frombuffer(doc, np.uint8).astype(np.int64) + len(names) * (RUN_DOCS + 1))
        names.append(run)
    if names:
        value, slot = np.concatenate(values), np.concatenate(slots)
        order = np.argsort(value, kind="stable")
        value = value[order]
        again = value[1:] == value[:-1]
        several = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        counts = np.bincount(slot[order[several]], minlength=len(names) * (RUN_DOCS + 1)).reshape(-1, RUN_DOCS + 1)
        for i in np.flatnonzero(counts[:, :RUN_DOCS].any(1)):
            out["run"].append(names[i]), out["ids"].append(None), out["counts"].append(counts[i, :RUN_DOCS].astype(np.int32).tobytes())
    return pa.table(out, schema=pa.schema([("run", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())]))


def _mostly_shared(percent: int):
    def run(key, table):
        import pyarrow as pa

        ids, counts = table.column("ids").to_pylist(), [np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()]
        found = []
        # of runs with the same documents, and so the same name, each row of ids is one
        shared = sum((c for i, c in zip(ids, counts, strict=True) if i is None), np.zeros(RUN_DOCS, np.int64))
        for mine, c in zip(ids, counts, strict=True):
            if mine is not None:
                size, inside = c.reshape(2, -1)
                found.append(np.frombuffer(mine, np.int64)[(size > 0) & (100 * (inside + shared[: len(size)]) >= percent * size)])
        return pa.table({"id": np.concatenate(found) if found else np.zeros(0, np.int64)})

    return run


def with_shared_shingles(docs: DataFrame, k: int, percent: int, total: int) -> DataFrame:
    """Ids of the documents (id, text) of which at least ``percent`` of the shingles occur in another row, and of few others.

    Only 40 bits of a hash are compared, so that a few more may be returned, never fewer.
    """
    parts = max(16, -(-total // PART_SHINGLES))
    pieces = docs.mapInArrow(_pieces(k, parts), _PIECE)
    counts = pieces.groupBy("part").applyInArrow(_count_shared, "run long, ids binary, counts binary")
    return counts.groupBy("run").applyInArrow(_mostly_shared(percent), "id long")


def _whole_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, words, at in document_words(batch.column("text")):
                sets = [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)).view(np.int64) for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])

    return docs.mapInArrow(run, "id long, tokens array<long>")


def _tree_join(percent: int):
    def run(key, table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        parts = table.column("block").to_numpy()
        tokens = table.column("tokens").combine_chunks()
        at = np.asarray(tokens.offsets)
        flat = np.asarray(tokens.flatten()).view(np.uint64)
        sets = [flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]
        group = table.column("group").to_numpy()
        number = {}
        labels = np.array([number.setdefault(x, len(number)) for x in table.column("label").to_numpy()])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            mine = sorted(set(parts[rows]))
            parent = list(range(len(number)))
            split = [rows[parts[rows] == p] for p in mine]
            bits = _bits([sets[i] for i in rows])
            trees = [SignatureTree([sets[i] for i in part], bits) for part in split]
            a, b = (0, 0) if len(trees) == 1 else (0, 1)
            pairs = dual_links(trees[a], trees[b], percent, labels[split[a]], labels[split[b]], parent)
            found.append((ids[split[a]][[i for i, _ in pairs]], ids[split[b]][[j for _, j in pairs]]))
        return pa.table({"a": np.concatenate([x for x, _ in found]).astype(np.int64), "b": np.concatenate([y for _, y in found]).astype(np.int64)})

    return run


def _meetings(grouped: DataFrame, percent: int, pack: int) -> DataFrame:
    """Links found in each meeting (group, i, j); small groups share a task."""
    out = grouped.withColumn("_bin", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("group"), F.lit(pack))).otherwise(F.xxhash64("group", "i", "j")))
    out = out.withColumn("group", F.xxhash64("group", "i", "j"))
    return out.groupBy("_bin").applyInArrow(_tree_join(percent), "a long, b long")


def similar_links(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect just what all links at the threshold connect; ``sets`` are those of the class representatives."""
    spark = docs.sparkSession
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    met = with_shared_shingles(named, k, percent, total).join(sets.select(F.col("doc_id").alias("id")), "id", "left_semi")
    texts = named.join(staged(met.distinct()).hint("shuffle_hash"), "id")
    # ids are unique here: a representative is the smallest of its class; of repeated rows any will do
    whole = staged(_whole_sets(texts, k).dropDuplicates(["id"]))
    rows = whole.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    known = rows.join(often, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    # unshared tokens come first in the order of rarity and can't meet anything
    take = F.size("ranked") - need + 1
    known = known.where(take > 0).select("id", F.explode(F.slice("ranked", F.lit(1), take.cast("int"))).alias("x")).select("id", F.col("x.token").alias("token"))
    known = staged(known)
    lead = known.groupBy("token").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = known.join(lead, "token").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    groups = staged(connected_components(stars))
    members = groups.withColumnRenamed("component", "group").join(whole, "id")
    sizes = groups.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("m"))
    members = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("m") / BLOCK_SETS).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = staged(members.select("id", "tokens", "group", "blocks", "block"))
    pack = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * 4)
    # first every block with itself and the next; a group that this connects is done
    near = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.array(
            F.struct((F.col("block") + 1).alias("i"), F.lit(-1).alias("j")),
            F.struct((F.col("block") + 1).alias("i"), F.pmod(F.col("block") + 1, F.col("blocks")).cast("int").alias("j")),
            F.struct((F.pmod(F.col("block") - 1, F.col("blocks")) + 1).cast("int").alias("i"), F.col("block").alias("j")),
        )
    )
    first = members.withColumn("at", F.explode(near)).select("id", "tokens", "group", "block", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("id").alias("label"))
    links = staged(_meetings(first, percent, pack))
    large = members.where("blocks > 2").select("id", "tokens", "group", "blocks", "block")
    if large.limit(1).count() == 0:
        return links
    parts = connected_components(links)
    large = large.join(parts, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    open_groups = large.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("group")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), (F.greatest("block", j) + 1).alias("j")))
    rest = large.join(open_groups, "group").withColumn("at", F.explode(others)).select("id", "tokens", "group", "block", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "label")
    return links.union(_meetings(rest, percent, pack))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A set holds the distinct shingles of ``k`` lower-cased words; with fewer words, the whole sequence; documents
    without words (null, empty) have no set and stay alone. Two documents link when 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable. Rows that repeat a doc_id are one node each in the same
    component as that id's first row if their sets link; rows with a null doc_id are alone with a null component.
    """
    with scratch(docs.sparkSession) as keep:
        sets = staged(shingle_sets(docs, k))
        named = sets.where("n_shingles > 0 and doc_id is not null")
        classes = named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("first_id"))
        classes = staged(classes)
        ids = classes.select(F.col("first_id").alias("doc_id")).distinct()
        reps = sets.join(ids, "doc_id").dropDuplicates(["doc_id"])
        links = similar_links(docs, reps, k, percent)
        parts = connected_components(links).withColumnRenamed("id", "first_id")
        found = staged(classes.join(parts, "first_id", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "first_id").alias("component_id")))
        keep(sets)
        keep(found)
    out = sets.join(found, ["n_shingles", "f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each component of rows.

    Rows that repeat a doc_id are rows like others: one stays if their sets link, each if not. Rows with a null doc_id
    are in no component and stay, as do rows without words. Columns of any name but ``_row`` stay as they are.
    """
    with scratch(docs.sparkSession) as keep:
        rows = numbered(docs)
        named = rows.where("doc_id is not null")
        parts = ngram_components(named.select(F.col("_row").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("_row"), "component_id")
        first = parts.join(named.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.count(F.lit(1)).alias("n"))
        # only what goes is joined to the texts: few rows, where most documents are alone
        others = parts.join(first.where("n > 1"), "component_id").where("_row <> first._row").select("_row")
        gone = staged(others)
        keep(rows)
        keep(gone)
    return rows.join(gone.hint("shuffle_hash"), "_row", "left_anti").select(*docs.columns)


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)
), ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
