"""Alignment of two tokenizers' outputs over the same bytes.

Both tokenizers' token ends are bits of packed bitsets over the bytes; their AND has the cuts that both share. The rank
(popcount up to a cut) of a cut in each bitset is the number of its tokens there, which turns byte cuts into token
ranges: the groups. A pair of tokens that end together is a link; as every token has bytes, each cut has one.

A link's tokens end at the same byte, so one's bytes are a suffix of the other's. The pairs of which that holds follow
from the two vocabularies alone (some 10**5 pairs), whatever the corpus: link counts are kept by place in that list, and
the counts of the whole corpus are an array of that length, the one thing that is gathered and broadcast.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, scratch, staged, string_buffers
from .tokens import PATTERN

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at once.
BLOCK = 1 << 20
#: What a piece has for a space (a fixed value of its library).
_SPACE_MARK = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the list of pairs that can be linked.

    The byte-level vocabulary's ids are the order of its merges, so its entries are the encoder's ranks; a test compares
    the encoder with the vocabulary file's own tokenizer.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        alphabet, file = _byte_alphabet(), Tokenizer.from_file(byte_level)
        special = {i for i, t in file.get_added_tokens_decoder().items() if t.special}
        a = {i: bytes(alphabet[c] for c in t) for t, i in file.get_vocab(with_added_tokens=False).items() if i not in special}
        self.a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in a.items()}, special_tokens={})
        self.b, b = sentencepiece.SentencePieceProcessor(model_file=pieces), {}
        for i in range(self.b.get_piece_size()):
            if self.b.is_byte(i):
                b[i] = bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                b[i] = self.b.id_to_piece(i).replace(_SPACE_MARK, " ").encode()
        self.a_table, self.b_table, self.pairs = _Bytes(a), _Bytes(b), _suffix_pairs(a, b)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Token ids of space + text under the first tokenizer and of text under the second, which adds the space."""
        return [self.a.encode_to_numpy(" " + x, disallowed_special=()) for x in texts], [np.array(x, np.uint32) for x in self.b.encode(texts, num_threads=1)]


class _Bytes:
    """The bytes of each token id; ids without any stand for a byte that no UTF-8 text has."""

    def __init__(self, of: dict[int, bytes]):
        all_ = [of.get(i, b"\xff") for i in range(max(of) + 1)]
        self.size = np.array([len(t) for t in all_], np.int64)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(all_), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _suffix_pairs(a: dict[int, bytes], b: dict[int, bytes]) -> np.ndarray:
    """Sorted keys (a << 32 | b) of all tokens of which one's bytes are a suffix of the other's."""

    def by_bytes(of):
        out: dict[bytes, list[int]] = {}
        for i, t in of.items():
            out.setdefault(t, []).append(i)
        return out

    keys, of_a, of_b = [], by_bytes(a), by_bytes(b)
    for t, ids in of_a.items():
        keys += [i << 32 | j for k in range(len(t)) for j in of_b.get(t[k:], ()) for i in ids]
    for t, ids in of_b.items():
        keys += [i << 32 | j for k in range(1, len(t)) for i in of_a.get(t[k:], ()) for j in ids]
    return np.unique(np.array(keys, np.int64))


@lru_cache(maxsize=2)
def tokenizers(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def _bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """A bitset in 64-bit words whose bit i says that a token ends after byte i."""
    bits = np.zeros(-(-n // 64) * 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _ranks(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with bit at - 1: whole words by their running popcount, the last by a mask."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, bit = (at - 1) // 64, ((at - 1) % 64).astype(np.uint64)
    return before[word] + np.bitwise_count(bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)))


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets up to ``n`` where tokens of both end, and at each the number of tokens of either up to there."""
    a, b = _bitset(a_ends, n), _bitset(b_ends, n)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little")) + 1
    return cuts, _ranks(a, cuts), _ranks(b, cuts)


def _same(ids: np.ndarray, table: _Bytes, whole: bytes) -> bool:
    return table.size[ids].sum() == len(whole) and table.joined(ids).tobytes() == whole


def _written(a: np.ndarray, b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` in ASCII, and where each group ends in it. ``up_a`` and ``up_b`` are the tokens up to each group's end.

    A token's place among all is its own number and that of the other tokenizer's tokens that are written before it, so
    all digits go to their places at once.
    """
    n_a, n_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
    place_a = np.arange(len(a)) + np.repeat(up_b - n_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(up_a, n_b)
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[up_a - 1]], mark[place_b[up_b - 1]] = ord("|"), ord(";")
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10) if 10**k <= (ids.max() if len(ids) else 0))
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    for k in range(int(digits.max()) if len(ids) else 0):
        has = digits > k
        out[ends[has] - 2 - k] = ids[has] % 10 + ord("0")
        ids //= 10
    return out, ends[place_b[up_b - 1]]


def _aligned(texts: list[str], t: Tokenizers) -> tuple[list[tuple], np.ndarray]:
    """For each text (tokens of a, tokens of b, groups, groups as text), zeros where joined bytes differ; and the places of all links."""
    ids_a, ids_b = t.encode(texts)
    whole = [b" " + x.encode() for x in texts]
    known = [i for i, w in enumerate(whole) if _same(ids_a[i], t.a_table, w) and _same(ids_b[i], t.b_table, w)]
    out: list[tuple] = [(0, 0, 0, b"")] * len(texts)
    if not known:
        return out, np.zeros(0, np.int32)
    a, b = (np.concatenate([ids[i] for i in known]).astype(np.int64) for ids in (ids_a, ids_b))
    size = np.cumsum([len(whole[i]) for i in known])
    cuts, up_a, up_b = shared_cuts(np.cumsum(t.a_table.size[a]), np.cumsum(t.b_table.size[b]), int(size[-1]))
    links = np.searchsorted(t.pairs, a[up_a - 1] << 32 | b[up_b - 1]).astype(np.int32)
    written, ends = _written(a, b, up_a, up_b)
    # a text's end is a cut
    first, at, view = 0, 0, written.data
    for i, last in zip(known, np.searchsorted(cuts, size, "right").tolist()):
        end = int(ends[last - 1])
        out[i] = (len(ids_a[i]), len(ids_b[i]), last - first, view[at : end - 1])
        first, at = last, end
    return out, links


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) for each row of ``docs`` (doc_id, text), and the ``groups`` themselves if asked.

    ``groups`` are written ``a1,a2|b1;a3|b2,b3`` in ids, and ``links`` are places in the vocabularies' list of pairs.
    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros, '' and no links. Special tokens'
    strings are ordinary text. Repeated rows and null ids each have their row; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = tokenizers(byte_level, pieces)
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            for first, last in chunks(offsets, BLOCK):
                part = batch.slice(first, last - first)
                texts = part.column("text").to_pylist()
                filled = [i for i, x in enumerate(texts) if x]
                found, links = _aligned([texts[i] for i in filled], t)
                rows = [(0, 0, 0, "", "")] * len(texts)
                for i, (n_a, n_b, n, written) in zip(filled, found):
                    rows[i] = (n_a, n_b, n, hashlib.sha256(written).hexdigest() if n else "", bytes(written).decode() if groups else "")
                n_a, n_b, n, digest, written = zip(*rows)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)]
                columns = [part.column("doc_id"), *numbers, pa.array(digest, pa.string()), pa.ListArray.from_arrays(ends, pa.array(links)), pa.array(written, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "groups"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, groups string")
    return out if groups else out.drop("groups")


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, n) of ``aligned`` rows: how many links of all documents are at that place of the list of pairs."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(batch.column("links").flatten().to_numpy(zero_copy_only=False), minlength=len(n)) if batch.num_rows else n[:0]
            more[: len(n)] += n[: len(more)] if len(more) >= len(n) else 0
            n = more if len(more) >= len(n) else n
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(links: DataFrame, counts: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``aligned`` rows with ``n_best`` and ``count_sum`` instead of ``links``.

    ``counts`` is that of ``link_counts``, at most a row for each pair that the vocabularies allow, so it is gathered and
    broadcast. A link is among the best if its count is the highest of any pair with its second token.
    """
    spark = links.sparkSession
    table = counts.select("pair", "n").toArrow()
    t = tokenizers(byte_level, pieces)
    n = np.zeros(len(t.pairs), np.int64)
    n[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    second = t.pairs & 0xFFFFFFFF
    highest = np.zeros(int(second.max()) + 1, np.int64)
    np.maximum.at(highest, second, n)
    known = spark.sparkContext.broadcast((n, n == highest[second]))
    kept = [f for f in links.schema.fields if f.name != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"

    def run(batches):
        import pyarrow as pa

        n, best = known.value
        for batch in batches:
            column = batch.column("links")
            at, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, n)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "n_best", "count_sum"])

    return links.mapInArrow(run, schema)


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Both passes: documents are encoded once into a staged table, counted, and scored against the whole corpus's counts."""
    with scratch(docs.sparkSession) as keep:
        links = staged(aligned(docs, byte_level, pieces))
        keep(links)
        return scored(links, link_counts(links), byte_level, pieces)


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
