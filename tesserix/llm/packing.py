"""Order-preserving packing of documents into sequences of bounded length.

Documents stay in the order of their id. Where a sequence ends is chosen by dynamic programming over the places where a cut
is allowed: document ends (free), sentence ends and, inside long sentences, every few dozen ids (each at a price). A
sequence costs its padding plus the price of the cut that ends it. The cheapest predecessor within one sequence length comes
from a monotone queue, so the work is linear in the number of places.

Null and empty texts have the end id only. Repeated rows are packed each. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.common import chunks, tidy, utf8, word_starts
from tesserix.session import cut_lineage

LENGTH = 4096
END_ID = 2
SENTENCE_PRICE, FORCED_PRICE = 4, 12
FORCED_STEP = 32
#: Tokens per range partition, at which a sequence is ended early; and tokens held before finished sequences are given out.
PARTITION_TOKENS, BLOCK_TOKENS = 4 << 20, 1 << 20
CACHE_WORDS = 600_000

_SEPARATOR, _SEPARATOR_ID = "<|endoftext|>", 49407
_WORDS: dict[str, dict[bytes, bytes]] = {}
_TOKENIZERS: dict = {}


_SIGNS = b".,!?;:#$%&*)"
#: Trailing signs set apart at once; words with more are taken apart one by one.
_MOST_SIGNS = 8
_IS_SIGN, _ENDS_SENTENCE, _IS_LETTER = (np.isin(np.arange(256), list(some)) for some in (_SIGNS, b".!?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Words that the tokenizer reads as they are: small letters without other forms.
_SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def word_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes as the tokenizer may as well get them, begin and end of each piece there, and pieces per text.

    A piece is a word, or a word and the signs behind it apart, which the tokenizer reads apart after a letter. It lower-cases; a letter
    before what may be a mark keeps its case, as both may be composed first. Texts with what may be a special token stay as they are."""
    begin, end, counts = word_starts(data, starts)
    if b"<|" in data.tobytes():
        return data, begin, end, counts
    after = np.append(data[1:], np.uint8(0))
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90) & ((after < 128) | (after == 0xC3)))
    core, at = end.copy(), np.arange(len(end))
    for _ in range(_MOST_SIGNS):
        at = at[(core[at] > begin[at]) & _IS_SIGN[data[core[at] - 1]]]
        core[at] -= 1
    cut = np.flatnonzero((core < end) & (core > begin))
    last, lead = data[core[cut] - 1], data[np.maximum(core[cut] - 2, begin[cut])]
    cut = cut[_IS_LETTER[last] | ((lead == 0xC3) & (last >= 128) & (last != 0x97) & (last != 0xB7))]
    shift = np.zeros(len(end) + 1, np.int64)
    shift[cut + 1] = 1
    first = np.cumsum(shift)[:-1] + np.arange(len(end))  # place of each word's first piece
    head, tail = (np.empty(len(end) + len(cut), np.int64) for _ in range(2))
    head[first], tail[first] = begin, end
    tail[first[cut]] = head[first[cut] + 1] = core[cut]
    tail[first[cut] + 1] = end[cut]
    text = np.repeat(np.arange(len(counts)), counts)
    return data, head, tail, counts + np.bincount(text[cut], minlength=len(counts))


class WordEncoder:
    """Ids of a text, word by word. The tokenizer drops white space and never joins over it, so the ids of a text are those
    of its words in turn; words seen before come from a table that lives as long as the worker and is emptied when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        if path not in _TOKENIZERS:
            whole, light = Tokenizer.from_file(path), Tokenizer.from_file(path)
            # For small letters between spaces; it need not normalize them or look for other words.
            light.normalizer = None
            light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            _TOKENIZERS[path] = whole, light
        (self.tokenizer, self.light), self.known = _TOKENIZERS[path], _WORDS.setdefault(path, {})
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _read(self, text: str) -> str:
        """The text as the tokenizer reads it. A letter may become a letter and a mark (U+0130 in lower case, U+0958 composed)."""
        return text if text.isascii() else self.tokenizer.normalizer.normalize_str(text)

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        """Pieces of a word that the tokenizer reads apart from each other: it lower-cases, and signs after a letter are their own."""
        core = word.rstrip(_SIGNS)
        lower = core.lower() if word.isascii() else core  # a letter may be composed with a mark before it is lower-cased
        if core and len(core) < len(word) and self._read(core.decode())[-1].isalpha():
            return lower, word[len(core):]
        return (lower + word[len(core):],)

    def learn(self, words: Collection[bytes]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + 2 * len(new) > CACHE_WORDS:
            known.clear()
            new = list(words)
        texts = b"\n".join(new).decode().split("\n") if new else []
        small, other = [], []
        for w, t in zip(new, texts, strict=True):
            t = t.lower()
            if _SMALL.fullmatch(t):
                small.append((w, t))
            else:
                other.append(w)
        for at in range(0, len(small), 2000):
            some = small[at:at + 2000]
            self._keep([w for w, _ in some], self.light, [t for _, t in some], True)
        parts = {w: self._parts(w) for w in other if b"<|" not in w}
        plain = list({p for both in parts.values() for p in both if p not in known})
        for at in range(0, len(plain), 2000):
            self._encode(plain[at:at + 2000])
        for w, both in parts.items():
            known[w] = b"".join([known[p] for p in both])
        for w in other:
            if b"<|" in w:
                known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[bytes]) -> None:
        """Many words in one call. A word that the tokenizer reads as letters only is one to it, and its last id is one that ends words, so spaces
        between such words are enough; others are set apart by a special token."""
        texts = [w.decode() for w in words]
        plain = [self._read(t).isalpha() for t in texts]
        for letters in (True, False):
            some = [(w, t) for w, t, p in zip(words, texts, plain) if p == letters]
            if some:
                self._keep([w for w, _ in some], self.tokenizer, [t for _, t in some], letters)

    def _keep(self, words: list[bytes], tokenizer, texts: list[str], letters: bool) -> None:
        joined = (" " if letters else _SEPARATOR).join(texts)
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        raw = ids.tobytes()
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1) if letters else 4 * np.append(np.flatnonzero(ids == _SEPARATOR_ID), len(ids))
        a, gap = 0, 0 if letters else 4
        for w, b in zip(words, ends.tolist(), strict=True):
            self.known[w] = raw[a:b]
            a = b + gap

    def places(self, words: list[bytes], end_id: int) -> tuple[list[int], list[int], list[int]]:
        """Where one document, given as its words, may be cut: ids before each place, CRC-32 of them, and what kind of place."""
        data = np.frombuffer(b" ".join(words), np.uint8)
        _, cuts, crcs, kinds = self.all_places(data, np.array([0, len(data)]), end_id)
        return cuts.tolist(), crcs.tolist(), kinds.tolist()

    def all_places(self, data: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts may be cut: number of places of each text; and of each place the ids before it in its text, their CRC-32, and its
        kind (2 end, 1 sentence, 0 forced)."""
        data, head, tail, counts = word_pieces(data, starts)
        # Each different piece is looked up once; one more stands for the end of a text.
        size, texts = tail - head, len(counts)
        packed = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
        offsets = np.concatenate([[0], np.cumsum(size)])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        self.learn(words)
        known = [self.known[w] for w in words]
        known.append(end_id.to_bytes(4, "little"))
        n_of = np.array([len(k) for k in known]) >> 2
        at_of = np.cumsum(n_of) - n_of
        code = np.insert(pieces.indices.to_numpy(), np.cumsum(counts), len(words))
        n = n_of[code]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(at_of[code] - (upto - n), n) + np.arange(n.sum())]
        # A sentence ends with its piece; the rest of a text ends before its end id, which is added to it after its forced places.
        closes = np.insert(_ENDS_SENTENCE[data[tail - 1]], np.cumsum(counts), True)
        final = np.cumsum(counts + 1) - 1
        closes[np.setdiff1d(final - 1, np.append(-1, final))] = False
        seg = np.flatnonzero(closes)
        is_final = code[seg] == len(words)
        stop = upto[seg]
        length = np.diff(stop, prepend=0)
        forced = np.maximum(0, -(-(length - is_final - 2 * FORCED_STEP) // FORCED_STEP))
        own = (length > 0).astype(np.int64)  # a sentence without ids is no place
        k = forced + own
        of = np.repeat(np.arange(len(seg)), k)
        step = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + 1
        is_own = step > forced[of]
        place = np.where(is_own, stop[of], stop[of] - length[of] + FORCED_STEP * step)
        kind = np.where(is_own, 1 + is_final[of], 0).astype(np.int8)
        last = np.flatnonzero(kind == 2)
        per_text = np.diff(last, prepend=-1)
        base = np.repeat(np.concatenate([[0], place[last][:-1]]), per_text) if texts else place
        raw, crc, crcs, a = memoryview(ids.tobytes()), 0, [], 0
        for b, done in zip((4 * place).tolist(), (kind == 2).tolist()):
            crc = zlib.crc32(raw[a:b], crc)
            crcs.append(crc)
            a = b
            if done:
                crc = 0
        return per_text, place - base, np.array(crcs, np.int64), kind


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, cuts, crcs, kinds): where each document may be cut. The ids themselves are not kept."""

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in chunks(batches, "_text"):
            many, cuts, crcs, kinds = encoder.all_places(*utf8(batch.column("_text")), end_id)
            offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(cuts[offsets[1:] - 1]), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(c)) for c in (cuts, crcs, kinds))],
                names=["doc_id", "doc_tokens", "cuts", "crcs", "kinds"])

    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(
        encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_tokens long, cuts array<long>, crcs array<long>, kinds array<tinyint>")


def best_cuts(position: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indexes of the places that end a sequence, the last place among them. ``position`` ascends; neighbours (and the first and
    0) lie at most ``length`` apart."""
    at, cost = [0, *position.tolist()], [0, *price.tolist()]
    best, came = [0] * len(at), [0] * len(at)
    queue = deque([0])  # predecessors in reach, their best cost plus position ascending
    key = [0] * len(at)
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        best[j] = key[i] + length - p + cost[j]
        came[j] = i
        k = key[j] = best[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j > 0:
        out.append(j - 1)
        j = came[j]
    return out[::-1]


# Fixed values of CRC-32: its polynomial, bit-reversed.
_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC's, coefficients bit-reversed."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint64)
    b = np.broadcast_to(b, out.shape).copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), _POLY, np.uint64(0))
    return out


def crc_of_rest(whole: np.ndarray, head: np.ndarray, rest_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of what follows a head, from that of the whole and of the head."""
    shift = np.full(len(head), 1 << 31, np.uint64)
    power, left = np.array([1 << 30], np.uint64), rest_bytes.astype(np.uint64)  # x
    for _ in range(3):
        power = _times(power, power)  # x^8
    while left.any():
        shift = np.where(left & np.uint64(1), _times(shift, power), shift)
        left, power = left >> np.uint64(1), _times(power, power)
    return whole.astype(np.uint64) ^ _times(shift, head.astype(np.uint64))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A range partition of ids is packed by one task, block by block; only the last, unfinished sequence is carried on."""
    if length < 2 * FORCED_STEP + 2:
        raise ValueError(f"sequences must hold at least {2 * FORCED_STEP + 2} ids")
    tokens = cut_lineage(tokenized(docs, path, end_id, text), "tokens")
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    ordered = tokens.repartitionByRange(max(1, total // PARTITION_TOKENS), "doc_id").sortWithinPartitions("doc_id", "doc_tokens", "crcs")

    def finish(held: list[tuple], first: int, last: bool) -> tuple[pa.RecordBatch | None, list[tuple], int]:
        ids = [pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4, 5))]
        doc_of, size, local, crc, kind = ids[1], ids[2], ids[3], ids[4], ids[5]
        step = np.diff(local, prepend=0)
        new = np.ones(len(doc_of), bool)
        new[1:] = doc_of[1:] != doc_of[:-1]
        start0 = held[0][6]  # ids of the first document that went out before
        step[new] = local[new]
        step[0] = local[0] - start0
        position = np.cumsum(step)
        ends = np.array(best_cuts(position, np.array([FORCED_PRICE, SENTENCE_PRICE, 0])[kind], length))
        done = ends if last else ends[:-1]
        if not len(done):
            return None, held, first
        upto = done[-1] + 1
        border = kind[:upto] == 2
        border[done] = True
        at = np.flatnonzero(border)
        prev = np.concatenate([[-1], at[:-1]])
        fresh = (prev < 0) | (kind[prev] == 2)
        start = np.where(fresh, 0, local[prev])
        head = np.where(fresh, 0, crc[prev])
        if start0:  # its CRC up to there was carried along
            start[0], head[0] = start0, held[0][7]
        size_of = local[at] - start
        seq = np.searchsorted(done, at)
        before = np.cumsum(size_of) - size_of
        opens = np.flatnonzero(np.diff(seq, prepend=-1))
        out = pa.RecordBatch.from_arrays([
            ids[0].take(pa.array(doc_of[at])), pa.array(start), pa.array(size_of), pa.array(crc_of_rest(crc[at], head, 4 * size_of).astype(np.int64)),
            pa.array(size[at]), pa.array((TaskContext.get().partitionId() << 32) + first + seq), pa.array(before - before[opens][seq])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        if upto == len(doc_of):
            return out, [], first + len(done)
        cut_inside = kind[upto - 1] != 2
        low = int(doc_of[upto])
        rest = (ids[0].slice(low), doc_of[upto:] - low, size[upto:], local[upto:], crc[upto:], kind[upto:],
                int(local[upto - 1]) if cut_inside else 0, int(crc[upto - 1]) if cut_inside else 0)
        return out, [rest], first + len(done)

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs_held = tokens_held = first = 0
        for batch in batches:
            counts = np.diff(batch.column("cuts").offsets.to_numpy())
            doc_of = np.repeat(np.arange(batch.num_rows), counts)
            local, crc, kind = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("cuts", "crcs", "kinds"))
            sizes = batch.column("doc_tokens").to_numpy()
            if not batch.num_rows:
                continue
            held.append((batch.column("doc_id"), doc_of + docs_held, sizes[doc_of], local, crc, kind, 0, 0))
            docs_held, tokens_held = docs_held + batch.num_rows, tokens_held + int(sizes.sum())
            if tokens_held >= BLOCK_TOKENS:
                out, held, first = finish(held, first, False)
                docs_held, tokens_held = sum(len(h[0]) for h in held), 0
                if out is not None:
                    yield out
        if held:
            yield finish(held, first, True)[0]

    return ordered.mapInArrow(fill, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, "
                                    "doc_tokens long, sequence_id long, offset long")
