"""Every row of one table beside every row of another, block by block.

Rows are packed into blocks; the blocks of one side are dealt out by salt and those of the other are copied to every salt, so
each task works on its share of the meetings. What a meeting gives back is for its function to bound: a few rows for each row
of a block, never the pairs. Arrow batches of meetings are bounded by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import statistics
from .staging import cut

#: Rows in a block.
BLOCK = 1024


def packed(df: DataFrame, names: list[str], columns: list[str], prefix: str = "", size: int | None = None) -> DataFrame:
    """Blocks of ``df``: a list of each of ``names``, and ``vectors``, the doubles of ``columns`` with nulls as NaN."""
    kinds = {n: df.schema[n].dataType.simpleString() for n in names}
    nan, size = F.lit(float("nan")), size or BLOCK
    rows = df.select(*names, F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in columns]).cast("array<double>").alias("_v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.asarray(part.column("_v").flatten(), np.float64).tobytes()], pa.binary())], names=[*[prefix + n for n in names], prefix + "vectors"])

    return rows.mapInArrow(run, ", ".join(f"`{prefix}{n}` array<{k}>" for n, k in kinds.items()) + f", `{prefix}vectors` binary")


def met(asked: DataFrame, others: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over batches whose rows are a block of ``asked`` beside a block of ``others`` (both of ``packed``)."""
    salts = max(8, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    there = others.withColumn("_salt", F.pmod(F.xxhash64("vectors"), F.lit(salts)).cast("int"))
    here = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return there.join(here, "_salt").drop("_salt").mapInArrow(run, schema)


def vectors(batch, name: str, i: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py()).reshape(-1, width)


def order_of(values) -> np.ndarray:
    """The places of an Arrow array in the order of its values."""
    import pyarrow.compute as pc

    return pc.sort_indices(values, null_placement="at_start").to_numpy()


def same(a, b) -> np.ndarray:
    """For each of ``a`` and each of ``b`` whether they are equal; a null equals none."""
    import pyarrow.compute as pc

    known = pc.unique(b)
    x, y = (pc.fill_null(pc.index_in(v, known), -1).to_numpy() for v in (a, b))
    y = np.where(b.is_null().to_numpy(zero_copy_only=False), -2, y)
    x = np.where(a.is_null().to_numpy(zero_copy_only=False), -1, x)
    return x[:, None] == y[None, :]


#: Where bounds of distances and distances themselves may differ by the order of additions, or by rounding to nine digits.
SLACK = 4e-9
#: Bits of a column in the order of places.
_BITS = 12


def placed(df: DataFrame, names: list[str], columns: list[str], size: int, by: str | None = None, labels: int = 0) -> DataFrame:
    """Blocks of ``size`` rows that lie near each other: (_block, _low, _high, _holes, _kinds, _counts, a list of each of ``names``,
    _vectors), staged, so that the numbers of the blocks stay.

    Rows go in the order of the last ``labels`` columns and then of the interleaved bits of the others. ``_low`` and ``_high``
    bound each column, ``_holes`` says which have unknown values, ``_kinds`` and ``_counts`` tell how many rows of each value of
    ``by`` (as hashes) there are.
    """
    plain = columns[: len(columns) - labels] if labels else columns
    s = statistics(df, plain) if plain else {}
    bits = max(1, min(_BITS, 60 // max(1, len(plain))))
    order = F.lit(0).cast("long")
    for i, c in enumerate(plain):
        low, width = s[c]["min"] or 0.0, float((s[c]["max"] or 0) - (s[c]["min"] or 0)) or 1.0
        cell = F.coalesce(F.least(F.lit((1 << bits) - 1), F.floor((F.col(c).cast("double") - low) / width * (1 << bits))).cast("long"), F.lit(0))
        for b in range(bits):
            order = order.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)), b * len(plain) + i))
    nan = F.lit(float("nan"))
    kind = F.xxhash64(by) if by else F.lit(0).cast("long")
    rows = df.select(*names, F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in columns]).cast("array<double>").alias("_v"), kind.alias("_kind"), order.alias("_order"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(columns[len(plain) :])])
    sort = [*[f"_l{i}" for i in range(labels)], "_order"]
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    types = {n: df.schema[n].dataType.simpleString() for n in names}

    def run(batches):
        import warnings

        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                v = np.asarray(part.column("_v").flatten(), np.float64).reshape(len(part), -1)
                kinds, counts = np.unique(part.column("_kind").to_numpy(), return_counts=True)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # a column without known values has no bounds
                    low, high = np.nanmin(v, 0), np.nanmax(v, 0)
                one = lambda x, t: pa.array([x.tolist()], pa.list_(t))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(n)) for n in names]
                yield pa.RecordBatch.from_arrays([one(low, pa.float64()), one(high, pa.float64()), one(np.isnan(v).any(0), pa.bool_()), one(kinds, pa.int64()), one(counts, pa.int64()), *lists, pa.array([v.tobytes()], pa.binary())], names=["_low", "_high", "_holes", "_kinds", "_counts", *names, "_vectors"])

    fields = "_low array<double>, _high array<double>, _holes array<boolean>, _kinds array<long>, _counts array<long>, " + "".join(f"`{n}` array<{t}>, " for n, t in types.items()) + "_vectors binary"
    return cut(rows.mapInArrow(run, fields).withColumn("_block", F.monotonically_increasing_id()))


def _gaps(low, high, holes, lows, highs, hole, unknown):
    """The least and the greatest difference, column by column, that rows of a box and of each of many boxes can have."""
    some = holes | hole
    with np.errstate(invalid="ignore"):
        least = np.fmax(0.0, np.fmax(lows - high, low - highs))
        most = np.fmax(highs - low, high - lows)
    return np.where(some, 0.0, least), np.where(some, np.fmax(np.where(np.isnan(most), 0.0, most), unknown), most)


def _wanted_pairs(boxes: dict, closeness, relation: str, k: int, unknown: float, least: float = -np.inf):
    """For each block that asks the blocks that can hold some of what its rows want, with the greatest closeness to them.

    ``k`` rows at a closeness of ``least`` or more are surely there, so what cannot come as close isn't wanted.
    """
    low, high, hole, kinds, counts = (boxes[c] for c in ("_low", "_high", "_holes", "_kinds", "_counts"))
    total = counts.sum(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                own = [np.array([np.nan if v is None else v for v in r[c]]) for c in ("_low", "_high")]
                near, far = _gaps(*own, np.array(r["_holes"]), low, high, hole, unknown)
                best, worst = closeness(near, far), closeness(far, near)
                mine = np.searchsorted(kinds, [c for c in r["_kinds"] if c in boxes["known"]])
                if relation == "any":
                    groups = [total]
                elif relation == "enemy":
                    groups = [total - counts[:, c] for c in mine] if len(mine) == len(r["_kinds"]) else [total, *(total - counts[:, c] for c in mine)]
                elif relation == "friend":
                    groups = [counts[:, c] for c in mine]
                else:
                    groups = [counts[:, c] for c in range(len(kinds))]
                order = np.argsort(-worst, kind="stable")
                wanted = np.zeros(len(low), bool)
                for n in groups:
                    at = np.searchsorted(np.cumsum(n[order]), k)
                    reach = worst[order[at]] if at < len(order) else -np.inf
                    wanted |= (n > 0) & (best >= max(reach, least) - SLACK)
                found = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), r["_block"])), pa.array(boxes["_block"][found]), pa.array(best[found])], names=["_a", "_b", "_best"])

    return run


def closest(asked: DataFrame, others: DataFrame, ask: list[str], give: list[str], exact, closeness, k: int = 1, relation: str = "any", key: tuple[str, str] | None = None, by: tuple[str, str] | None = None, unknown: float = 0.0, least: float = -np.inf) -> DataFrame:
    """(ask.., give.., _close): for each row of ``asked`` its ``k`` closest rows of ``others``; both are of ``placed``.

    ``relation`` says among which: ``any``, those of another or of the same value of ``by`` (``enemy``, ``friend``), or those of
    ``each`` value of it. ``key`` names the columns whose equality leaves a row out as the row itself; of ties the smaller key
    comes first. ``exact`` gives the closeness of two lists of vectors, ``closeness`` the greatest that the least and the greatest
    differences by column allow (and, of those the other way round, the least); ``unknown`` is the greatest difference to an unknown value. Rows
    less close than ``least`` aren't sought. Names of ``asked`` and ``others`` have to differ.

    The search is exact. Blocks are compared by their bounds first (the driver holds the bounds of the ``others``, one for
    each block), and only blocks that can hold a closest row meet, best first; rows that a block cannot better stay out. A
    block that asks is in one task, which holds its rows' best so far.
    """
    boxes = _boxes(others)
    ask_types = {n: asked.schema[n].dataType.elementType.simpleString() for n in ask}
    give_types = {n: others.schema[n].dataType.elementType.simpleString() for n in give}
    schema = ", ".join(f"`{n}` {t}" for n, t in {**ask_types, **give_types}.items()) + ", _close double"
    if boxes is None:
        return asked.sparkSession.createDataFrame([], schema)
    parts = max(32, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    pairs = asked.select("_block", "_low", "_high", "_holes", "_kinds").mapInArrow(_wanted_pairs(boxes, closeness, relation, k + (key is not None), unknown, least), "_a long, _b long, _best double")
    there = others.select(F.col("_block").alias("_b"), F.col("_low"), F.col("_high"), F.col("_holes"), *dict.fromkeys([*give, *([key[1]] if key else []), *([by[1]] if by else [])]), "_vectors")
    here = asked.select(F.col("_block").alias("_a"), *dict.fromkeys([*ask, *([key[0]] if key else []), *([by[0]] if by else [])]), F.col("_vectors").alias("_q_vectors"))
    met = pairs.join(there, "_b").join(here, "_a").repartition(parts, "_a").sortWithinPartitions("_a", F.col("_best").desc())
    return met.mapInArrow(_keep_closest(ask, give, exact, closeness, k, relation, key, by, unknown, least), schema)


def _boxes(others: DataFrame) -> dict | None:
    rows = others.select("_block", "_low", "_high", "_holes", "_kinds", "_counts").collect()
    if not rows:
        return None
    known = np.unique(np.concatenate([r["_kinds"] for r in rows]))
    counts = np.zeros((len(rows), len(known)), np.int64)
    for i, r in enumerate(rows):
        counts[i, np.searchsorted(known, r["_kinds"])] = r["_counts"]
    numbers = lambda c: np.array([[np.nan if v is None else v for v in r[c]] for r in rows], float)
    return {"_block": np.array([r["_block"] for r in rows]), "_low": numbers("_low"), "_high": numbers("_high"), "_holes": np.array([r["_holes"] for r in rows], bool), "_kinds": known, "known": set(known.tolist()), "_counts": counts}


def _keep_closest(ask, give, exact, closeness, k, relation, key, by, unknown, least):
    def run(batches):
        import pyarrow as pa

        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column("_a")[i].as_py()
                if state is None or state.a != a:
                    if state is not None:
                        yield from state.out()
                    state = _Best(a, batch, i, ask, give, exact, closeness, k, relation, key, by, unknown, least, pa)
                state.meet(batch, i)
        if state is not None:
            yield from state.out()

    return run


class _Best:
    """What is closest so far to the rows of a block."""

    def __init__(self, a, batch, i, ask, give, exact, closeness, k, relation, key, by, unknown, least, pa):
        self.a, self.exact, self.closeness, self.k, self.relation, self.key, self.by, self.unknown, self.give, self.pa = a, exact, closeness, k, relation, key, by, unknown, give, pa
        self.names, self.raw = [*ask, *give, "_close"], batch.column("_q_vectors")[i].as_py()
        self.asked = {n: batch.column(n)[i].values for n in dict.fromkeys([*ask, *([key[0]] if key else []), *([by[0]] if by else [])])}
        self.ask = ask
        self.rows = len(next(iter(self.asked.values())))
        self.x = np.frombuffer(self.raw).reshape(self.rows, -1)
        self.floor, self.least = least, {}
        self.found: list = []
        self.held = 0

    def meet(self, batch, i):
        low, high = (np.array([np.nan if v is None else v for v in batch.column(c)[i].as_py()], float) for c in ("_low", "_high"))
        holes = np.array(batch.column("_holes")[i].as_py(), bool)
        best = self.closeness(*_gaps(self.x, self.x, np.isnan(self.x), low[None, :], high[None, :], holes[None, :], self.unknown))
        lists = {n: batch.column(n)[i].values for n in dict.fromkeys([*self.give, *([self.key[1]] if self.key else []), *([self.by[1]] if self.by else [])])}
        y = np.frombuffer(batch.column("_vectors")[i].as_py()).reshape(-1, self.x.shape[1])
        if self.relation == "each":
            kinds = lists[self.by[1]]
            for label in kinds.unique():
                at = np.flatnonzero(same(self.pa.array([label.as_py()], kinds.type), kinds)[0])
                self._take(label.as_py(), best, {n: v.take(self.pa.array(at)) for n, v in lists.items()}, y[at])
        else:
            self._take(None, best, lists, y)

    def _take(self, group, best, lists, y):
        least = self.least.setdefault(group, np.full((self.rows, self.k), self.floor))
        rows = np.flatnonzero(best >= least[:, -1] - SLACK)
        if not len(rows):
            return
        if self.key:
            order = order_of(lists[self.key[1]])
            lists, y = {n: v.take(self.pa.array(order)) for n, v in lists.items()}, y[order]
        close = self.exact(self.x[rows], y)
        at = self.pa.array(rows)
        if self.relation in ("enemy", "friend"):
            alike = same(self.asked[self.by[0]].take(at), lists[self.by[1]])
            close[alike if self.relation == "enemy" else ~alike] = -np.inf
        if self.key:
            close[same(self.asked[self.key[0]].take(at), lists[self.key[1]])] = -np.inf
        if self.k == 1:
            first = close.argmax(1)[:, None]
        elif self.k < close.shape[1] // 4:
            # all that reach the k-th closest, ties too, and of them the first
            edge = -np.partition(-close, self.k - 1, axis=1)[:, self.k - 1, None]
            first = np.argsort(np.where(close >= edge, -close, np.inf), axis=1, kind="stable")[:, : self.k]
        else:
            first = np.argsort(-close, axis=1, kind="stable")[:, : self.k]
        value = np.take_along_axis(close, first, 1)
        kept = np.isfinite(value) & (value >= least[rows, -1:])
        least[rows] = -np.sort(-np.concatenate([least[rows], value], 1), 1)[:, : self.k]
        r, c = np.nonzero(kept)
        if len(r):
            self.found.append((group, rows[r], value[r, c], {n: lists[n].take(self.pa.array(first[r, c])) for n in dict.fromkeys([*self.give, *([self.key[1]] if self.key else [])])}))
            self.held += len(r)
            if self.held > 16 * self.rows * self.k * max(1, len(self.least)):
                self._settle()

    def _settle(self):
        """Of all that was found the ``k`` closest of each row and group."""
        kept = []
        for group in self.least:
            mine = [f for f in self.found if f[0] == group]
            if not mine:
                continue
            row, value = np.concatenate([f[1] for f in mine]), np.concatenate([f[2] for f in mine])
            lists = {n: self.pa.concat_arrays([f[3][n] for f in mine]) for n in mine[0][3]}
            place = np.zeros(len(row), np.int64)
            if self.key:
                place[order_of(lists[self.key[1]])] = np.arange(len(row))
            order = np.lexsort((place, -value, row))
            start = np.searchsorted(row[order], np.arange(self.rows))
            rank = np.arange(len(order)) - start[row[order]]
            order = order[rank < self.k]
            kept.append((group, row[order], value[order], {n: v.take(self.pa.array(order)) for n, v in lists.items()}))
        self.found = kept
        self.held = sum(len(f[1]) for f in kept)

    def out(self):
        self._settle()
        pa, parts = self.pa, []
        for _, row, value, lists in self.found:
            parts.append(pa.RecordBatch.from_arrays([*[self.asked[n].take(pa.array(row)) for n in self.ask], *[lists[n] for n in self.give], pa.array(value)], names=self.names))
        return parts
