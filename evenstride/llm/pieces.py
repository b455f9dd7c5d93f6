"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public model lies on the driver; its bytes travel to executors.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped; versions of a word's segmentation in one run (a document's hash chooses).
DROPOUT, VERSIONS = 0.1, 16
PIECE = 1 << 20
#: Words of more characters are encoded one by one with a heap, shorter ones many at a time: the same merges, at a cost of n log n against n * n.
LONG = 96
_MASK = (1 << 64) - 1
_SPACE = "▁"
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def load(path: str = MODEL) -> dict:
    """What encoding needs of a BPE model: pieces, byte pieces, and of each pair of pieces the piece it merges to."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, plain, byte_ids = [], {}, np.full(256, -1, np.int64)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            plain[p] = i
            pieces.append(p.replace(_SPACE, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it can't hold every text")
    order = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
    rank = np.zeros(n, np.int64)
    rank[order] = np.arange(len(order))
    keys, merged = [], []
    for p, i in plain.items():
        if _SPACE in p.lstrip(_SPACE):
            raise ValueError(f"piece {p!r} goes over a word's start")
        for k in range(1, len(p)):
            a, b = plain.get(p[:k]), plain.get(p[k:])
            if a is not None and b is not None:
                keys.append(a * n + b)
                merged.append(i)
    at = np.argsort(keys)
    singles = {ord(p): i for p, i in plain.items() if len(p) == 1 and p != _SPACE}
    return {"n": n, "pieces": pieces, "byte_ids": byte_ids, "space": plain[_SPACE], "singles": singles, "rank": rank, "keys": np.array(keys, np.int64)[at], "merged": np.array(merged, np.int64)[at]}


class Encoder:
    """Encodes many words at once: a row of symbols per word, each step merging the best remaining candidate of every row."""

    def __init__(self, m: dict, seed: int, dropout: float) -> None:
        self.m, self.n, self.dropout = m, m["n"], dropout
        self.seed = _mix(np.array([seed], np.uint64) + _BASE)[0]
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        lut = np.full(0x3000, -1, np.int64)
        for cp, i in m["singles"].items():
            if cp < len(lut):
                lut[cp] = i
        lut[32] = m["space"]
        for cp in range(128):
            if lut[cp] < 0:
                lut[cp] = m["byte_ids"][cp]
        self.lut, self.high = lut, {cp: i for cp, i in m["singles"].items() if cp >= len(lut)}
        # pair table, open addressing
        self.bits = int(3 * len(m["keys"])).bit_length()
        self.slots, self.vals = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, at = np.arange(len(m["keys"])), self._slot(m["keys"])
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = m["keys"][left[free]]
            done = self.slots[at] == m["keys"][left]
            self.vals[at[done]] = m["merged"][left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)
        self.lens = np.array([len(p) for p in m["pieces"]], np.int64)
        self.flat = np.frombuffer(b"".join(m["pieces"]), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).view(np.int64)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b merge to; -1 where there is none."""
        keys = a * self.n + b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.vals[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.vals[at[hit]]
            go = ~hit & (there != -1)
            left, at = left[go], at[go]
        return out

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Piece of each character; for one without a piece, minus its code point and 1 (it becomes its bytes)."""
        out = -codes.astype(np.int64) - 1
        low = codes < len(self.lut)
        out[low] = np.where(self.lut[codes[low]] >= 0, self.lut[codes[low]], out[low])
        for i in np.flatnonzero(~low):
            out[i] = self.high.get(int(codes[i]), out[i])
        return out

    def _dropped(self, key: np.ndarray, left: np.ndarray, mid: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A candidate merge is named by its word and its three character positions; a keyed hash says whether it is skipped."""
        place = (left.astype(np.uint64) << np.uint64(42)) | (mid.astype(np.uint64) << np.uint64(21)) | right.astype(np.uint64)
        return _mix((key ^ self.seed) + place * _BASE) < self.limit

    def words(self, sym: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols [words, length] -> (symbols left over, moved to the front; how many)."""
        n, width = sym.shape
        sym = sym.copy()
        size = np.full(n, width)
        begin = np.tile(np.arange(width + 1), (n, 1))  # first character of each symbol, and the end
        result, result_n = np.empty_like(sym), np.empty(n, np.int64)
        rows = np.arange(n)
        none = np.iinfo(np.int64).max
        rank = self.m["rank"]

        def candidates(s, b, k, i):
            """Rank (best lowest) and piece of the candidates at columns i of all rows."""
            rr = np.arange(len(s))[:, None]
            to = self.merge_of(s[rr, i].ravel(), s[rr, i + 1].ravel())
            r = np.where(to >= 0, rank[to], none)
            if self.dropout > 0:
                live = np.flatnonzero(to >= 0)
                rows_, cols = np.divmod(live, i.shape[1])
                c = i[rows_, cols]
                r[live[self._dropped(k[rows_], b[rows_, c], b[rows_, c + 1], b[rows_, c + 2])]] = none
            return r.reshape(i.shape), to.reshape(i.shape)

        if width == 1:
            return sym, size
        r, to = candidates(sym, begin, key, np.tile(np.arange(width - 1), (n, 1)))
        while len(rows):
            best = r.argmin(1)
            ii = np.arange(len(rows))
            go = r[ii, best] != none
            if not go.all():
                end = rows[~go]
                result[end], result_n[end] = self._pad(sym[~go], width), size[~go]
                rows, sym, size, begin, key, r, to, best = rows[go], sym[go], size[go], begin[go], key[go], r[go], to[go], best[go]
                if not len(rows):
                    break
                ii = np.arange(len(rows))
            sym[ii, best] = to[ii, best]
            w = sym.shape[1]
            cols = np.arange(w - 1)
            move = cols + (cols > best[:, None])
            sym = np.take_along_axis(sym, move, 1)
            cb = np.arange(w)
            begin = np.take_along_axis(begin, cb + (cb > best[:, None]), 1)
            size = size - 1
            if w - 1 < 2:
                result[rows], result_n[rows] = self._pad(sym, width), size
                break
            cr = np.arange(w - 2)
            mr = cr + (cr > best[:, None])
            mr = np.minimum(mr, w - 2)
            r, to = np.take_along_axis(r, mr, 1), np.take_along_axis(to, mr, 1)
            near = np.stack([np.maximum(best - 1, 0), np.minimum(best, w - 3)], 1)
            nr, nt = candidates(sym, begin, key, near)
            # a neighbour outside the row repeats one inside whose pair is unchanged or the same, so writing it again does no harm
            for j in (0, 1):
                r[ii, near[:, j]], to[ii, near[:, j]] = nr[:, j], nt[:, j]
        return result, result_n

    def long_word(self, sym: np.ndarray, key: int) -> np.ndarray:
        """Symbols of one word -> symbols left over: the same agenda as ``words``, kept in a heap over linked symbols.

        A symbol is named by its first character: ``end`` is where it ends (-1 once it is merged into its left neighbour), ``back`` where
        the one before it begins. A candidate in the heap holds only while both of its symbols are still as they were.
        """
        n = len(sym)
        if n < 2:
            return sym
        if not hasattr(self, "merge"):
            self.merge = dict(zip(self.m["keys"].tolist(), self.m["merged"].tolist()))
        rank, merge, limit, mix = self.m["rank"].tolist(), self.merge, int(self.limit), (int(key) ^ int(self.seed)) & _MASK
        at = np.arange(n - 1)
        to = self.merge_of(sym[:-1], sym[1:])
        live = to >= 0
        if self.dropout > 0:
            live &= ~self._dropped(np.full(n - 1, key, np.uint64), at, at + 1, at + 2)
        heap = [(rank[t], i, i + 1, i + 2, t) for i, t in zip(at[live].tolist(), to[live].tolist())]
        heapq.heapify(heap)
        s, end, back = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(left: int, mid: int, right: int) -> None:
            a, b = s[left], s[mid]
            t = merge.get(a * self.n + b) if a >= 0 and b >= 0 else None
            if t is None:
                return
            if limit:
                x = (mix + (left << 42 | mid << 21 | right) * int(_BASE)) & _MASK
                x = ((x ^ x >> 30) * int(_MIX1)) & _MASK
                x = ((x ^ x >> 27) * int(_MIX2)) & _MASK
                if x ^ x >> 31 < limit:
                    return
            heapq.heappush(heap, (rank[t], left, mid, right, t))

        while heap:
            _, left, mid, right, t = heapq.heappop(heap)
            if end[left] != mid or end[mid] != right:
                continue
            s[left], end[left], end[mid] = t, right, -1
            if right < n:
                back[right] = left
                offer(left, right, end[right])
            if back[left] >= 0:
                offer(back[left], left, right)
        return np.array([x for x, e in zip(s, end) if e >= 0], np.int64)

    @staticmethod
    def _pad(s: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(s), width), np.int64)
        out[:, : s.shape[1]] = s
        return out

    def encode(self, texts: list[str], version: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's end. A text is led by a space; words are cut before spaces and around line ends."""
        flat = "".join(" " + t if t else "" for t in texts)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        ends = np.cumsum([len(t) + (len(t) > 0) for t in texts])
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        sym = self.symbols(codes)
        space, line = codes == 32, codes == 10
        first = np.zeros(n, bool)
        first[0] = True
        first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        first[ends[:-1][ends[:-1] < n]] = True
        a = np.flatnonzero(first)
        z = np.append(a[1:], n)
        length = z - a
        text = np.searchsorted(ends, a, side="right")
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + _BASE) * _powers(_BASE, n), out=sums[1:])
        key = (sums[z] - sums[a]) * _powers(_BASE_INV, n)[a]
        key = _mix(key + length.astype(np.uint64) * _MIX1 + version.astype(np.uint64)[text] * _MIX2)
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        ulen, ua = length[one], a[one]
        out_n = np.zeros(len(one), np.int64)
        parts, where = [], []
        for i in np.flatnonzero(ulen > LONG).tolist():
            toks = self.long_word(sym[ua[i] : ua[i] + ulen[i]], key[one[i]])
            cnt = np.array([len(toks)])
            if (toks < 0).any():
                toks, cnt = self._spell(toks, cnt)
            out_n[i] = cnt[0]
            parts.append(toks)
            where.append(np.array([i]))
        for w in np.unique(ulen[ulen <= LONG]):
            for s in range(0, int((ulen == w).sum()), max(1, (1 << 17) // int(w))):
                at = np.flatnonzero(ulen == w)[s : s + max(1, (1 << 17) // int(w))]
                res, cnt = self.words(sym[ua[at][:, None] + np.arange(w)], key[one[at]])
                toks = res[np.arange(w) < cnt[:, None]]
                if (toks < 0).any():
                    toks, cnt = self._spell(toks, cnt)
                out_n[at] = cnt
                parts.append(toks)
                where.append(at)
        toks, order = np.concatenate(parts), np.concatenate(where)
        begin = np.zeros(len(one), np.int64)
        begin[order] = np.cumsum(out_n[order]) - out_n[order]
        size = out_n[same]
        total = np.cumsum(size)
        ids = toks[np.repeat(begin[same] - (total - size), size) + np.arange(total[-1])]
        last = np.searchsorted(a, ends) - 1
        return ids, np.where(ends > 0, total[np.maximum(last, 0)], 0)

    def _spell(self, toks: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.arange(len(cnt)), cnt)
        spelt = [[t] if t >= 0 else [int(self.m["byte_ids"][b]) for b in chr(-t - 1).encode("utf-8", "surrogatepass")] for t in toks.tolist()]
        n = np.array([len(s) for s in spelt])
        return np.array([x for s in spelt for x in s], np.int64), np.bincount(word, n, len(cnt)).astype(np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts (each with its leading space) end to end, and where each ends."""
        size = self.lens[ids]
        total = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
        out = self.flat[np.repeat(self.starts[ids] - (total - size), size) + np.arange(total[-1])]
        return out, np.where(ends > 0, total[np.maximum(ends - 1, 0)], 0)


def _encoder(shared, seed: int, dropout: float) -> Encoder:
    held = shared.value
    if (seed, dropout) not in held["made"]:
        held["made"][seed, dropout] = Encoder(held["model"], seed, dropout)
    return held["made"][seed, dropout]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t)
        if held >= PIECE:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _encode(shared, seed: int, dropout: float):
    def run(batches) -> Iterator:
        import pyarrow as pa

        enc = _encoder(shared, seed, dropout)
        for b in batches:
            texts = b.column(1).to_pylist()
            version = b.column(2).to_numpy(zero_copy_only=False)
            for i, j in _groups(texts):
                ids, ends = enc.encode(texts[i:j], version[i:j])
                raw, at = enc.decode(ids, ends)
                whole, lossless, s = raw.tobytes(), [], 0
                for t, e in zip(texts[i:j], at.tolist()):
                    lossless.append(whole[s + 1 : e] == t.encode("utf-8", "surrogatepass") if t else s == e)
                    s = e
                off = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(np.concatenate([[0], ends]))), lists, pa.array(lossless)], ["doc_id", "n_tokens", "ids", "lossless"])

    return run


def _decode(shared):
    def run(batches) -> Iterator:
        import pyarrow as pa

        enc = _encoder(shared, 0, 0.0)
        for b in batches:
            col = b.column(1)
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in col]).astype(np.int64)
            raw, at = enc.decode(ids, ends)
            whole, out, s = raw.tobytes(), [], 0
            for x, e in zip(col, at.tolist()):
                out.append(whole[s + 1 : e].decode("utf-8", "surrogatepass") if x.is_valid else None)
                s = e
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


_shared: dict = {}


def _share(df: DataFrame, model: str):
    """The vocabulary as a broadcast, one for each application and model however many queries run."""
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, model) not in _shared:
        _shared[sc.applicationId, model] = sc.broadcast({"model": load(model), "made": {}})
    return _shared[sc.applicationId, model]


def encode(docs: DataFrame, model: str = MODEL, seed: int = 11, dropout: float = DROPOUT, versions: int = VERSIONS) -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>, lossless)`` per row of ``docs``: BPE ids with seeded merge-dropout.

    Candidate merges are taken from the best rank on, the leftmost first; each is skipped for good if a hash keyed by ``seed``, the word,
    its version and the candidate's place is below ``dropout``. So one seed always gives the same ids, another seed other ones, and a
    word has up to ``versions`` segmentations within a run, by document. Characters without a piece, and U+2581 itself, are spelt in
    bytes, so every text decodes to itself; ``lossless`` is whether it did. With dropout 0 ids are those of the model.

    The vocabulary (a fixed size) is read on the driver and broadcast. A null or empty text has no ids; repeated rows are encoded alike;
    an empty table gives no rows; other columns are ignored.
    """
    version = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(versions))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), version.alias("version"))
    return d.mapInArrow(_encode(_share(docs, model), seed, dropout), "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``ids(doc_id, ids)``; null ids give a null text."""
    return ids.select("doc_id", "ids").mapInArrow(_decode(_share(ids, model)), "doc_id long, text string")
