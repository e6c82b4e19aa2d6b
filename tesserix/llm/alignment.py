"""Which tokens of two tokenizers mean the same: documents aligned by bytes, linked id pairs counted over the corpus.

Tokenizer A encodes space + text, tokenizer B the text, to which it adds the space. Where tokens of both end at one byte, a group ends;
every A token of a group is linked to every B token of it. A pair's count is the number of documents that hold it linked.

Texts are encoded once; the ids are stored by chunks of documents, compressed. First pass: each chunk is aligned and sends its
distinct pairs with their document counts to the shards of their A ids. A shard's distinct pairs, merged along a tree, get a
minimal perfect hash (levels of bits, about four bits a pair, ranked by set bits) and the table of keys by slot against which every
lookup is verified. Counts become dense vectors over the slots, added along a tree of at most ``FAN`` inputs a task. Second
pass: chunks get the counts of their pairs back from the shards, align their documents again from the stored ids and look each
pair up. Nothing is broadcast; a shard holds at most (A ids / shards) x (B ids) pairs however large the corpus.

Null and empty texts have no tokens, nor has a text whose joined token bytes differ from space + text under either tokenizer;
such rows are all zeros. Repeated rows are documents of their own. A very long text is a chunk alone and is held with its tokens by
one task, about 150 times its bytes. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.llm.backoff import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from tesserix.llm.common import chunks, mix
from tesserix.session import cut_lineage

#: How byte-level BPE cuts texts before merging (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and signs that every Unicode version classes alike; other texts are left to the tokenizer's own library.
SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")
#: Links of a group above which only its different ids are paired.
WIDE_GROUP = 4096
#: A tokens aligned at once (a document is never cut).
BLOCK_TOKENS = 1 << 18
#: Rows of one chunk; texts of more bytes than LONG_TEXT are chunks of their own.
CHUNK_ROWS, LONG_TEXT = 1024, 64 << 10
#: Inputs of one task in a tree of sums.
FAN = 64
_LEVELS = 40


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys. Each level is twice as many bits as keys left; keys alone at their bit stay there, the
    others go to the next level; the few left after the last level are searched."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, spare: np.ndarray):
        self.sizes, self.bits, self.spare = sizes, bits, spare
        self.rank = np.cumsum(bits, dtype=np.int64) - bits
        self.placed = int(bits.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left) and len(sizes) < _LEVELS:
            size = max(8, 2 * len(left))
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *levels]), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Of a key that was not built in, any slot: verify against the keys by slot."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._at(keys[open_], level, size) + base
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
            if not len(open_):
                return out
        if len(self.spare):
            out[open_] = self.placed + np.minimum(np.searchsorted(self.spare, keys[open_]), len(self.spare) - 1)
        return out

    def verified(self, keys: np.ndarray, by_slot: np.ndarray) -> np.ndarray:
        out = self.slots(keys)
        if (out < 0).any() or (by_slot[out] != keys).any():
            raise ValueError("a pair of the second pass was not in the first")
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.spare)], "<i8").tobytes()
        return head + self.sizes.astype("<i8").tobytes() + np.packbits(self.bits).tobytes() + self.spare.astype("<u8").tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> PerfectHash:
        n, bits, spare = np.frombuffer(raw, "<i8", 3).tolist()
        packed = np.frombuffer(raw, np.uint8, -(-bits // 8), 24 + 8 * n)
        return cls(np.frombuffer(raw, "<i8", n, 24), np.unpackbits(packed, count=bits).astype(bool), np.frombuffer(raw, "<u8", spare, 24 + 8 * n + len(packed)))


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: printable Latin-1 as itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return letters


class Encoders:
    """Both tokenizers. A is a byte-level BPE file: where its ids follow its merges, merging by id gives its tokens, which is done
    several times faster outside of its own library. B is a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(pieces)) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.fast = self._by_ids(path_a)

    def _by_ids(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file["normalizer"]
        if not plain or [model["vocab"].get(x + y) for x, y in merges] != list(range(256, 256 + len(merges))):
            return None
        from tiktoken import Encoding

        special = {t["id"] for t in file["added_tokens"]}
        return Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in enumerate(self.bytes_a) if i not in special}, special_tokens={})

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text under A and B; none where bytes are lost."""
        none = (np.zeros(0, "<u2"), np.zeros(0, "<u2"))
        out = []
        for text in texts:
            if not text:
                out.append(none)
                continue
            raw = " " + text
            a = self.fast.encode_ordinary(raw) if self.fast and SETTLED.fullmatch(text) else self.a.encode(raw, add_special_tokens=False).ids
            b = self.b.encode(text, num_threads=1)
            raw = raw.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
            out.append((np.array(a, "<u2"), np.array(b, "<u2")) if same else none)
        return out


class Sizes:
    """Bytes of every token, and how ids are written: followed by a comma or by the end of their side of a group."""

    def __init__(self, encoders: Encoders):
        self.a, self.b = (np.array([len(v) for v in t], np.int64) for t in (encoders.bytes_a, encoders.bytes_b))
        self.written = [f"{i}{e}" for n, ends in ((len(self.a), ",|"), (len(self.b), ",;")) for i in range(n) for e in ends]


class Alignment:
    """Documents of one block: ids of all, and how many of each document."""

    def __init__(self, sizes: Sizes, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.sizes, self.n_a, self.n_b, self.a, self.b = sizes, n_a, n_b, a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(sizes.a[self.a]), np.cumsum(sizes.b[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.from_a, self.from_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.doc = np.repeat(np.arange(len(n_a)), n_a)[self.from_a]  # of each group

    def totals(self) -> np.ndarray:
        """(documents, 4): A tokens, B tokens, groups, links."""
        groups = np.bincount(self.doc, minlength=len(self.n_a))
        links = np.zeros(len(self.n_a), np.int64)
        np.add.at(links, self.doc, self.in_a * self.in_b)
        return np.stack([self.n_a, self.n_b, groups, links], axis=1).astype(np.int64)

    def groups(self) -> list[str]:
        """The groups of each document as text."""
        last_a, last_b = np.diff(self.group_a, append=-1) != 0, np.diff(self.group_b, append=-1) != 0
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + self.from_b[self.group_a]] = 2 * self.a + last_a
        code[np.arange(len(self.b)) + (self.from_a + self.in_a)[self.group_b]] = 2 * (len(self.sizes.a) + self.b) + last_b
        words = [self.sizes.written[c] for c in code.tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[p:q])[:-1] for p, q in zip([0, *ends], ends)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, times linked there), each document's pair once, ascending. A key is A id x 2^16 + B id."""
        links = self.in_a * self.in_b
        few = np.where(links <= WIDE_GROUP, links, 0)
        of = np.repeat(np.arange(len(few)), few)
        t = np.arange(len(of)) - np.repeat(np.cumsum(few) - few, few)
        width = self.in_b[of]
        whole = self.doc[of] << 32 | self.a[self.from_a[of] + t // width] << 16 | self.b[self.from_b[of] + t % width]
        times = np.ones(len(of), np.int64)
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():  # a long group repeats few ids
            (ua, na), (ub, nb) = (np.unique(x[s:s + c], return_counts=True)
                                  for x, s, c in ((self.a, self.from_a[g], self.in_a[g]), (self.b, self.from_b[g], self.in_b[g])))
            whole = np.concatenate([whole, (self.doc[g] << 32 | ua[:, None] << 16 | ub[None, :]).ravel()])
            times = np.concatenate([times, (na[:, None] * nb[None, :]).ravel()])
        order = np.argsort(whole, kind="stable")
        whole, times = whole[order], times[order]
        first = np.flatnonzero(np.diff(whole, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        return whole[first] >> 32, (whole[first] & 0xFFFFFFFF).astype(np.uint32), times


_LOADED: dict[tuple[str, str], tuple[Encoders, Sizes]] = {}


def loaded(path_a: str, path_b: str) -> tuple[Encoders, Sizes]:
    """Once per worker process."""
    if (path_a, path_b) not in _LOADED:
        encoders = Encoders(path_a, path_b)
        _LOADED[path_a, path_b] = encoders, Sizes(encoders)
    return _LOADED[path_a, path_b]


def blocks(table: pa.Table | pa.RecordBatch, sizes: Sizes) -> Iterator[tuple[int, pa.Array, Alignment]]:
    """(chunk, ids of documents, alignment) of stored tokens, some documents at a time."""
    from zstandard import ZstdDecompressor

    for chunk, ids, n_a, n_b, raw in zip(table["chunk"].to_pylist(), table["doc_ids"], table["n_a"], table["n_b"], table["tokens"].to_pylist()):
        n_a, n_b, tokens = n_a.values.to_numpy(), n_b.values.to_numpy(), np.frombuffer(ZstdDecompressor().decompress(raw), "<u2")
        a, b = tokens[:n_a.sum()], tokens[n_a.sum():]
        ends_a, ends_b, at = np.cumsum(n_a), np.cumsum(n_b), 0
        while at < len(n_a):
            skip_a, skip_b = (ends_a[at - 1], ends_b[at - 1]) if at else (0, 0)
            end = max(at + 1, int(np.searchsorted(ends_a, skip_a + BLOCK_TOKENS, side="right")))
            yield chunk, ids.values.slice(at, end - at), Alignment(sizes, n_a[at:end], n_b[at:end], a[skip_a:ends_a[end - 1]], b[skip_b:ends_b[end - 1]])
            at = end


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix((keys >> np.uint32(16)).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _batch(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, names.values())], names=list(names))


def encode_chunks(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(chunk, doc_ids, n_a, n_b, tokens): a chunk's documents, a few rows per chunk. Tokens: 16-bit ids, all of A, then all of B."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        encoders, _ = loaded(*paths)
        for batch in chunks(batches, "text"):
            done = encoders.encoded(batch.column("text").to_pylist())
            chunk = batch.column("chunk").to_numpy()
            rows, ids = [], []
            for c in np.unique(chunk).tolist():
                at = np.flatnonzero(chunk == c)
                mine = [done[i] for i in at.tolist()]
                raw = b"".join([p[0].tobytes() for p in mine] + [p[1].tobytes() for p in mine])
                rows.append((c, [len(p[0]) for p in mine], [len(p[1]) for p in mine], ZstdCompressor(1).compress(raw)))
                ids.append(batch.column("doc_id").take(pa.array(at)))
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            c, n_a, n_b, raw = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(ids)),
                                              pa.array(n_a, pa.list_(pa.int64())), pa.array(n_b, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                                             names=["chunk", "doc_ids", "n_a", "n_b", "tokens"])

    return texts.select("chunk", "doc_id", "text").mapInArrow(
        encode, f"chunk long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, tokens binary")


def chunk_pairs(tokens: DataFrame, paths: tuple[str, str], shards: int) -> DataFrame:
    """(chunk, shard, keys, counts): distinct pairs of a chunk's documents, and how many of these hold each."""
    kinds = {"chunk": pa.int64(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes = loaded(*paths)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, found = 0, []
                for chunk, _, block in blocks(batch.slice(row, 1), sizes):
                    found.append(np.unique(block.pairs()[1], return_counts=True))
                whole, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([f[1] for f in found]), minlength=len(whole)).astype(np.int64)
                shard = _shard_of(whole, shards)
                order = np.argsort(shard, kind="stable")  # keys of a shard stay in order
                whole, counts, shard = whole[order].astype(np.uint64), counts[order], shard[order]
                cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                yield _batch(kinds, [(chunk, int(shard[p]), pack_sorted(whole[p:q]), pack_counts(counts[p:q])) for p, q in zip(cut, [*cut[1:], len(whole)])])

    return tokens.mapInArrow(send, "chunk long, shard int, keys binary, counts binary")


def _keys(table: pa.Table) -> list[np.ndarray]:
    return [unpack_sorted(v).astype(np.uint32) for v in table["keys"].to_pylist()]


def _counts(table: pa.Table, column: str = "counts") -> list[np.ndarray]:
    return [unpack_counts(v) for v in table[column].to_pylist()]


def _tree(rows: DataFrame, nodes: int, merge, schema: str) -> DataFrame:
    """Rows (shard, node, ...) merged until a shard has one, at most ``FAN`` of them in a task."""
    while nodes > 1:
        nodes = -(-nodes // FAN)
        rows = rows.withColumn("node", F.expr(f"CAST(node div {FAN} AS INT)")).groupBy("shard", "node").applyInArrow(merge, schema)
    return rows


def _merged_keys(table: pa.Table) -> pa.Table:
    whole = np.unique(np.concatenate(_keys(table))).astype(np.uint64)
    return pa.table({"shard": table["shard"][:1], "node": table["node"][:1], "keys": pa.array([pack_sorted(whole)], pa.binary())})


def _vector(table: pa.Table, total: np.ndarray) -> pa.Table:
    return pa.table({"shard": table["shard"][:1], "node": table["node"][:1], "counts": pa.array([pack_counts(total)], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    return _vector(table, np.sum(_counts(table), axis=0, dtype=np.int64))


def _hashed(table: pa.Table) -> pa.Table:
    """The hash of a shard's pairs, and the pairs by slot."""
    keys = _keys(table)[0]
    hashed = PerfectHash.build(keys)
    by_slot = np.zeros(len(keys), "<u4")
    by_slot[hashed.slots(keys)] = keys
    return pa.table({"shard": table["shard"][:1], "hash": pa.array([hashed.dumps()], pa.binary()), "by_slot": pa.array([by_slot.tobytes()], pa.binary())})


def _loaded(table: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    return PerfectHash.loads(table["hash"][0].as_py()), np.frombuffer(table["by_slot"][0].as_py(), "<u4")


def _counted(rows: pa.Table, shard: pa.Table) -> pa.Table:
    """The dense vector of one node: counts of its chunks at the slots of their pairs."""
    if not rows.num_rows:  # no chunk of this node has a pair of the shard
        return pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("counts", pa.binary())]).empty_table()
    hashed, by_slot = _loaded(shard)
    total = np.zeros(len(by_slot), np.int64)
    for keys, counts in zip(_keys(rows), _counts(rows)):
        total[hashed.verified(keys, by_slot)] += counts  # keys of one row are distinct
    return _vector(rows, total)


def _answered(rows: pa.Table, shard: pa.Table) -> pa.Table:
    """For each chunk the corpus counts of its pairs, doubled, plus one where no pair of the A id has a higher count."""
    if not rows.num_rows:
        return pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("answers", pa.binary())]).empty_table()
    hashed, by_slot = _loaded(shard)
    counts = _counts(shard)[0]
    a = by_slot >> 16
    highest = np.zeros(int(a.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, a, counts)
    answer = counts * 2 + (counts == highest[a])
    return pa.table({"chunk": rows["chunk"], "keys": rows["keys"],
                     "answers": pa.array([pack_counts(answer[hashed.verified(k, by_slot)]) for k in _keys(rows)], pa.binary())})


def pair_counts(pairs: DataFrame, nodes: int) -> DataFrame:
    """(shard, hash, by_slot, counts): all pairs of a shard behind their perfect hash."""
    keys = _tree(pairs.select("shard", "node", "keys").groupBy("shard", "node").applyInArrow(_merged_keys, "shard int, node int, keys binary"),
                 nodes, _merged_keys, "shard int, node int, keys binary")
    hashes = cut_lineage(keys.groupBy("shard").applyInArrow(_hashed, "shard int, hash binary, by_slot binary"), "hashes")
    vectors = pairs.groupBy("shard", "node").cogroup(_at_nodes(hashes, nodes)).applyInArrow(_counted, "shard int, node int, counts binary")
    return hashes.join(_tree(vectors, nodes, _added, "shard int, node int, counts binary").drop("node"), "shard")


def _at_nodes(shards: DataFrame, nodes: int):
    return shards.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))).groupBy("shard", "node")


def file_chunks(text: str = "text") -> Column:
    """A chunk name for rows read from files: neighbours in a file, long texts apart."""
    long = F.octet_length(F.coalesce(F.col(text), F.lit(""))) > LONG_TEXT
    return F.when(long, F.xxhash64(F.lit(1), "_metadata.file_path", "_metadata.row_index")).otherwise(
        F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {CHUNK_ROWS}")))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, chunk: Column | None = None, text: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    ``chunk`` names the chunk of a row, the same each time it is read; without one the rows are stored under numbers first."""
    t = F.coalesce(F.col(text), F.lit(""))
    if chunk is None:
        texts = docs.select("doc_id", t.alias("text"), F.monotonically_increasing_id().alias("_n"))
        long = F.octet_length("text") > LONG_TEXT
        texts = cut_lineage(texts.select("doc_id", "text", F.when(long, -1 - F.col("_n")).otherwise(F.expr(f"_n div {CHUNK_ROWS}")).alias("chunk")), "texts")
    else:
        texts = docs.select("doc_id", t.alias("text"), chunk.cast("long").alias("chunk"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = (path_a, path_b)
    tokens = cut_lineage(encode_chunks(texts, paths), "tokens")
    pairs = cut_lineage(chunk_pairs(tokens, paths, shards), "pairs")
    n = pairs.agg(F.approx_count_distinct("chunk")).first()[0]
    nodes = max(1, -(-n // FAN))
    pairs = pairs.withColumn("node", F.pmod(F.xxhash64("chunk"), F.lit(nodes)).cast("int"))
    counts = cut_lineage(pair_counts(pairs, nodes), "pair_counts")
    answers = pairs.groupBy("shard", "node").cogroup(_at_nodes(counts, nodes)).applyInArrow(_answered, "chunk long, keys binary, answers binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint32), *_keys(known)])
        answers = np.concatenate([np.zeros(0, np.int64), *_counts(known, "answers")])
        order = np.argsort(keys, kind="stable")
        keys, answers = keys[order], answers[order]
        out = []
        for _, ids, block in blocks(rows, loaded(*paths)[1]):
            doc, key, times = block.pairs()
            at = np.searchsorted(keys, key)
            if len(key) and (keys[np.minimum(at, len(keys) - 1)] != key).any():
                raise ValueError("a pair of the second pass was not in the first")
            best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(best, doc, times * (answers[at] & 1))
            np.add.at(total, doc, times * (answers[at] >> 1))
            sums = block.totals()
            marks = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in block.groups()]
            out.append(pa.table([ids, *(pa.array(sums[:, k]) for k in range(4)), pa.array(best), pa.array(total), pa.array(marks, pa.string())], names=names))
        return pa.concat_tables(out)

    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
