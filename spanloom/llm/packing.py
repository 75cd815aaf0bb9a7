"""Packing documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _offsets, chunks, materialize, text_array, tidy, with_fields
from .words import _LOWER

#: Largest count of (task, class) ranks that is sent to every executor (about 24 bytes each); beyond it a shuffle join is used.
BROADCAST_RANKS = 200_000
#: Bytes of text whose distinct chunks are encoded together.
RUN_BYTES = 1 << 20

_TOKENIZERS: dict = {}
_NONE = np.int32(2**31 - 1)
_BREAK = re.compile(r"[ \t\n\r]")

# The rules of the public tokenizer that the array form knows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: What a byte is in a chunk: 1 letter, 2 digit, 3 punctuation but the apostrophe, 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0


class _Ids:
    """Token ids of texts by arrays.

    White space separates the tokenizer's own words, so a text's ids are the ids of its chunks in order; of a run of texts
    only the distinct chunks are encoded. A chunk of ASCII and Latin-1 letters, digits and punctuation falls into the
    pieces that the tokenizer's own split makes, and the distinct pieces are merged together, rank by rank. All other
    chunks (other scripts, apostrophes, added tokens, very long ones) go to the tokenizer itself, as everything does
    where its rules are not the ones known here.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        rules = json.loads(self.tokenizer.to_str())
        model = rules["model"]
        self.known = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
        self.known = self.known and model["type"] == "BPE" and all(model.get(k) == v for k, v in _MODEL.items()) and self._learn(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _learn(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> bool:
        """Tables of first symbols and of merges; false if a merge's result could come before its parts."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        if not all(char[b] in vocab and char[b] + "</w>" in vocab for b in range(256)):
            return False
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[char[b] + "</w>"] for b in range(256)], np.int32)
        made = {a + b: r for r, (a, b) in enumerate(merges)}
        if len(made) != len(merges) or any(made.get(x, -1) >= r for r, m in enumerate(merges) for x in m):
            return False
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.bits = max(1, int(len(keys) * 8 - 1).bit_length())
        table, rank = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, _NONE, np.int32)
        self.probes = 1
        for k, slot, r in zip(keys.tolist(), self._slot(keys).tolist(), range(len(keys))):
            n = 1
            while table[slot] >= 0:
                slot, n = slot + 1, n + 1
            table[slot], rank[slot], self.probes = k, r, max(self.probes, n)
        self.table, self.rank = table, rank
        return self.probes < 60

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, _NONE where there is none."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        out = np.where(self.table[slot] == keys, self.rank[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.table[slot] >= 0))
        for i in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + i
            hit = self.table[at] == keys[open_]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (self.table[at] >= 0)]
        return out

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that tile ``data``, and how many each has. In each round every piece makes its lowest merge."""
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        n = (ends - starts).astype(np.int64)
        piece = np.arange(len(n))
        rank = np.full(len(sym), _NONE, np.int32)
        inside = np.ones(len(sym), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        rank[at] = self._ranks(sym[at], sym[at + 1])
        done_sym, done_piece, done_n = [], [], []
        while len(n):
            first = np.cumsum(n) - n
            low = np.minimum.reduceat(rank, first)
            ready = low == _NONE
            if ready.any():
                of = np.repeat(ready, n)
                done_sym.append(sym[of])
                done_piece.append(piece[ready])
                done_n.append(n[ready])
                sym, rank, n, piece, low = sym[~of], rank[~of], n[~ready], piece[~ready], low[~ready]
                if not len(n):
                    break
                first = np.cumsum(n) - n
            hit = rank == np.repeat(low, n)
            twice = hit[1:] & hit[:-1]
            if twice.any():  # equal symbols in a row: from the left, each symbol once
                i = np.flatnonzero(hit)
                run = np.maximum.accumulate(np.where(np.diff(i, prepend=-2) > 1, np.arange(len(i)), 0))
                hit[i[(np.arange(len(i)) - run) % 2 == 1]] = False
            i = np.flatnonzero(hit)
            sym[i] = self.result[rank[i]]
            last = np.zeros(len(sym), bool)
            last[first + n - 1] = True
            last[i] = last[i + 1]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            changed = hit.copy()
            changed[:-1] |= hit[1:]
            changed[i[i > 0] - 1] = True
            n -= np.add.reduceat(hit, first)
            changed[:-1] |= ~keep[1:]
            sym, rank, last, changed = sym[keep], rank[keep], last[keep], changed[keep]
            rank[last] = _NONE
            at = np.flatnonzero(changed & ~last)
            rank[at] = self._ranks(sym[at], sym[at + 1])
        counts = np.zeros(len(starts), np.int64)
        if not done_n:
            return np.zeros(0, np.int32), counts
        sym, piece, n = np.concatenate(done_sym), np.concatenate(done_piece), np.concatenate(done_n)
        order = np.argsort(piece)
        first = np.cumsum(n) - n
        counts[piece] = n
        return sym[_ranges(first[order], n[order])], counts

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _chunks(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of each of the distinct chunks."""
        offsets = _offsets(values).astype(np.int64)
        raw = values.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = 1
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        length = np.diff(offsets)
        hard = (odd[offsets[1:]] > odd[offsets[:-1]]) | (length > 256)
        opened = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # may start an added token
        hard[np.searchsorted(offsets, opened, "right") - 1] = True
        low = _LOWER[data]
        upper = lead[letter & (second < 0x9F)] + 1
        low[upper] += 32
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[offsets[:-1][length > 0]] = True
        easy = np.repeat(~hard, length)
        low, cut = low[easy], cut[easy]
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(low)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low)]).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary
        at = _offsets(distinct).astype(np.int64)
        ids, counts = self._merge(np.frombuffer(distinct.buffers()[2], np.uint8)[at[0] : at[-1]] if len(distinct) else low, at[:-1] - at[0], at[1:] - at[0]) if len(distinct) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        first = np.cumsum(counts) - counts
        ids = ids[_ranges(first[which], counts[which])]
        total = np.concatenate([[0], np.cumsum(counts[which])])  # ids before each piece in turn
        inside = np.where(hard, 0, length)
        ends = np.cumsum(inside)
        a, z = total[np.searchsorted(starts, ends - inside)], total[np.searchsorted(starts, ends)]
        start, count = a, z - a
        odd_ones = np.flatnonzero(hard)
        found = self._whole(values.take(pa.array(odd_ones)).to_pylist())
        n = np.array([len(x) for x in found], np.int64)
        start[odd_ones], count[odd_ones] = len(ids) + np.cumsum(n) - n, n
        return np.concatenate([ids, *found]), start, count

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.known:
            out = self._whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], np.int64)
        split = pc.ascii_split_whitespace(texts)
        bounds = _offsets(split).astype(np.int64)
        code = split.flatten().dictionary_encode()
        which = code.indices.to_numpy()
        ids, start, count = self._chunks(code.dictionary)
        n = count[which]
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = bounds - bounds[0]
        return ids[_ranges(start[which], n)], total[bounds[1:]] - total[bounds[:-1]]

    def __call__(self, texts: pa.Array):
        """(first text, unsigned 32-bit ids of some texts in a row, ids of each) for all texts; a text over RUN_BYTES is read in parts cut at white space."""
        for at, part in chunks(texts, RUN_BYTES):
            if len(part) > 1 or part.nbytes <= 2 * RUN_BYTES:
                ids, n = self._run(part)
            else:
                some = [self._run(pa.array([x]))[0] for x in _parts(part[0].as_py())]
                ids = np.concatenate(some)
                n = np.array([len(ids)], np.int64)
            yield at, ids.astype("<u4"), n


def _parts(text: str):
    """A long text in parts of about RUN_BYTES characters that end before white space."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + RUN_BYTES) if at + RUN_BYTES < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _ids_of(path: str) -> _Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Ids(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its ids as 16- or 32-bit integers and its ranks within its task.

    A document of n ids has ``n div seq_len`` full pieces and a rest; ``k_full`` and ``k_rest`` number the full pieces
    and the rests of the same length within the task, so that a prefix sum over tasks ranks them globally.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        ids_of = _ids_of(tokenizer_path)
        rests = np.zeros(seq_len, np.int64)
        full = 0
        for b in batches:
            keys = b.column(0)
            for at, ids, n in ids_of(text_array(b.column(1))):
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                k_full = full + np.cumsum(n // seq_len) - n // seq_len
                full += int((n // seq_len).sum())
                rest = n % seq_len
                order = np.argsort(rest, kind="stable")
                new = np.flatnonzero(np.diff(rest[order], prepend=-1))
                k_rest = np.empty(len(n), np.int64)
                k_rest[order] = rests[rest[order]] + np.arange(len(n)) - np.repeat(new, np.diff(np.append(new, len(n))))
                rests += np.bincount(rest, minlength=seq_len)
                width = 2 if ids.max() < 65536 else 4
                bounds = width * np.concatenate([[0], np.cumsum(n)])
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u2") if width == 2 else ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(k_full), pa.array(k_rest), packed],
                    names=["doc_key", "part", "n", "rest", "k_full", "k_rest", "ids"],
                )

    src = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    schema = with_fields(src.schema["doc_key"], "part int, n long, rest int, k_full long, k_rest long, ids binary")
    return src.mapInArrow(tidy(run), schema)


def solve_cutting_stock(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (copies, {size: pieces}) that hold all pieces; sizes and capacity are small integers.

    The linear program min sum(x), A x >= d over patterns is solved by the revised simplex method; a column is priced by
    a knapsack over the sizes with the duals as values. x is rounded down and the pieces left are packed first-fit by
    decreasing size. The size of the problem depends on the number of sizes alone.
    """
    sizes = sorted(counts, reverse=True)
    if not sizes:
        return []
    size = np.array(sizes)
    demand = np.array([counts[s] for s in sizes], float)
    m = len(sizes)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(40 * m + 200):
        duals = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        choice = np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            fits = size <= c
            if not fits.any():
                continue
            value = np.where(fits, best[np.maximum(c - size, 0)] + duals, -1.0)
            k = int(value.argmax())
            if value[k] > best[c - 1] + 1e-12:
                best[c], choice[c] = value[k], k
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= size[choice[c]]
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        inverse[out] /= direction[out]
        rest = direction.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        columns[:, out] = column
    left = demand.astype(np.int64)
    found: dict[tuple, int] = {}
    for j in np.argsort(-x, kind="stable"):
        column = columns[:, j].astype(np.int64)
        used = column > 0
        n = int(min(np.floor(x[j] + 1e-9), (left[used] // column[used]).min())) if used.any() else 0
        if n > 0:
            left -= n * column
            key = tuple((sizes[i], int(column[i])) for i in np.flatnonzero(used))
            found[key] = found.get(key, 0) + n
    bins: list[list] = []
    for i in range(m):
        for _ in range(int(left[i])):
            for b in bins:
                if b[0] >= sizes[i]:
                    break
            else:
                bins.append(b := [capacity, {}])
            b[0] -= sizes[i]
            b[1][sizes[i]] = b[1].get(sizes[i], 0) + 1
    for _, content in bins:
        key = tuple(sorted(content.items(), reverse=True))
        found[key] = found.get(key, 0) + 1
    return [(n, dict(k)) for k, n in sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))]


def make_plan(histogram: dict[int, int], n_full: int, seq_len: int, bins: int = 128) -> dict:
    """Where the i-th rest of each length goes.

    The histogram of rest lengths is binned (rounded up) for the linear program; each pattern slot then takes consecutive
    ranks of its bin, so the exact lengths in a slot are a step function of the copy number and every pattern splits into
    sub-patterns of exact lengths. The sub-patterns with the most room left are dissolved until the remaining sequences
    can be filled: their rests form one stream that is cut to fill the room left elsewhere exactly. What remains of the
    stream becomes sequences whose lengths are powers of two, which need no padding.

    Segments by length: first rank, kind (0 placed, 1 stream), base, offset.
    """
    unit = max(1, seq_len // bins)
    capacity = seq_len // unit
    exact = {length: n for length, n in histogram.items() if n > 0 and length > 0}
    by_bin: dict[int, list[int]] = {}
    for length in sorted(exact):
        by_bin.setdefault(min(-(-length // unit), capacity), []).append(length)
    patterns = solve_cutting_stock({b: sum(exact[x] for x in v) for b, v in by_bin.items()}, capacity) if by_bin else []
    taken = {length: 0 for length in exact}
    position = {b: 0 for b in by_bin}

    def steps(b: int, n: int) -> list[tuple[int, int, int]]:
        """The next n rests of a bin as (count, length, first rank in that length)."""
        out = []
        while n:
            length = by_bin[b][position[b]]
            k = min(n, exact[length] - taken[length])
            if k == 0:
                position[b] += 1
                continue
            out.append((k, length, taken[length]))
            taken[length] += k
            n -= k
        return out

    subs = []  # (copies, [(length, first rank)])
    for copies, content in patterns:
        slots = [steps(b, copies) for b in sorted(content, reverse=True) for _ in range(content[b])]
        cuts = sorted({0, copies} | {int(c) for s in slots for c in np.cumsum([k for k, _, _ in s])})
        for a, z in zip(cuts, cuts[1:]):
            inside = []
            for s in slots:
                at = 0
                for k, length, rank in s:
                    if at <= a < at + k:
                        inside.append((length, rank + a - at))
                        break
                    at += k
            subs.append([z - a, inside])
    total = sum(length * n for length, n in exact.items())
    drop = sum(n for n, _ in subs) - total // seq_len
    subs.sort(key=lambda s: (sum(length for length, _ in s[1]), s[0]))
    segments: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in exact}
    stream = 0
    kept = []
    for n, inside in subs:
        k = min(n, drop) if drop > 0 else 0
        drop -= k
        if k:
            for length, rank in inside:
                segments[length].append((rank, 1, stream, 0))
                stream += k * length
        if n > k:
            kept.append((n - k, [(length, rank + k) for length, rank in inside]))
    sequence, filled, holes = n_full, 0, []  # holes: first stream position, room per copy, first sequence, offset in it
    for n, inside in kept:
        offset = 0
        for length, rank in inside:
            segments[length].append((rank, 0, sequence, offset))
            offset += length
        room = min(seq_len - offset, max(0, stream - filled))
        if seq_len - offset > 0 and room > 0:
            holes.append((filled, seq_len - offset, sequence, offset))
            filled += n * (seq_len - offset)
        sequence += n
    tail, at = [], filled
    left, bit = stream - filled, seq_len
    while left > 0:
        while bit > left:
            bit //= 2
        tail.append((at, bit, sequence, 0))
        at, left, sequence = at + bit, left - bit, sequence + 1
    return {"segments": {k: sorted(v) for k, v in segments.items()}, "holes": holes + tail, "filled": filled, "sequences": sequence}


def _place(plan: dict):
    """A function from (length, rank) to the pieces (start in the rest, length, sequence, offset) of that rest."""
    seg = {k: (np.array([s[0] for s in v]), v) for k, v in plan["segments"].items()}
    holes = plan["holes"]
    first = np.array([h[0] for h in holes], np.int64)

    def pieces(length: int, rank: int):
        ranks, rows = seg[length]
        r0, kind, base, offset = rows[int(np.searchsorted(ranks, rank, "right")) - 1]
        if kind == 0:
            return [(0, length, base + rank - r0, offset)]
        out, p, done = [], base + (rank - r0) * length, 0
        while done < length:
            f, room, sequence, off = holes[int(np.searchsorted(first, p, "right")) - 1]
            inside = (p - f) % room
            k = min(length - done, room - inside)
            out.append((done, k, sequence + (p - f) // room, off + inside))
            done, p = done + k, p + k
        return out

    return pieces


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``seq_len`` ids.

    Returns a row per piece: ``id_col``, start (the document's ids before the piece), length, ids (binary, little-endian
    unsigned 32 bit), doc_tokens, sequence_id and offset (place in the sequence). Every id lies in exactly one piece and
    sequences have no gaps. A null or empty text is the single id ``end_id``; repeated rows are packed as often as they
    occur and a null id is carried; columns other than the two named are not read; an empty table gives no pieces.

    Ids are written once to the shared folder, since both the histogram and the pieces need them. The driver sees the
    histogram alone (at most ``seq_len`` numbers).
    """
    tokens = materialize(tokenize(docs, tokenizer_path, seq_len, end_id, id_col, text_col), "tokens")
    counts = (
        tokens.select("part", F.explode(F.array(F.struct(F.lit(seq_len).alias("cls"), F.col("n").alias("ids_n")), F.struct(F.col("rest").alias("cls"), F.lit(0).cast("long").alias("ids_n")))).alias("c"))
        .select("part", "c.cls", F.when(F.col("c.cls") == seq_len, F.floor(F.col("c.ids_n") / seq_len)).otherwise(1).cast("long").alias("k"))
        .where("k > 0 and cls > 0")
        .groupBy("part", "cls")
        .agg(F.sum("k").alias("k"))
    )
    counts = materialize(counts, "ranks")
    histogram = {r["cls"]: r["k"] for r in counts.groupBy("cls").agg(F.sum("k").alias("k")).collect()}
    n_full = histogram.pop(seq_len, 0)
    plan = make_plan(histogram, n_full, seq_len)
    from pyspark.sql import Window

    before = F.sum("k").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.withColumn("r0", F.coalesce(before, F.lit(0)))
    full = ranks.where(F.col("cls") == seq_len).select("part", F.col("r0").alias("f0"))
    rest = ranks.where(F.col("cls") < seq_len).select("part", F.col("cls").alias("rest"), F.col("r0").alias("r0"))
    if counts.count() <= BROADCAST_RANKS:
        full, rest = F.broadcast(full), F.broadcast(rest)
    ranked = tokens.join(rest, ["part", "rest"], "left").join(full, "part", "left").select(
        "doc_key", "n", "rest", (F.col("k_rest") + F.coalesce("r0", F.lit(0))).alias("rank"), (F.col("k_full") + F.coalesce("f0", F.lit(0))).alias("full"), "ids"
    )

    def run(batches):
        pieces = _place(plan)
        for b in batches:
            keys = b.column(0)
            rows: list[tuple] = []
            n, rests, rank, full_at = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            size = 0
            for i, raw in enumerate(b.column(5)):
                raw = raw.as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[i] else "<u4").astype("<u4").tobytes()
                m = int(n[i]) // seq_len
                for k in range(m):
                    rows.append((i, k * seq_len, seq_len, int(full_at[i]) + k, 0, int(n[i]), ids[4 * k * seq_len : 4 * (k + 1) * seq_len]))
                if rests[i]:
                    for s, length, sequence, offset in pieces(int(rests[i]), int(rank[i])):
                        s += m * seq_len
                        rows.append((i, s, length, sequence, offset, int(n[i]), ids[4 * s : 4 * (s + length)]))
                size += len(ids)
                if size > 1 << 23:
                    yield _batch(keys, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(keys, rows)

    def _batch(keys, rows):
        i, start, length, sequence, offset, n, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(i)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    schema = with_fields(tokens.schema["doc_key"], "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return ranked.mapInArrow(tidy(run), schema).withColumnRenamed("doc_key", id_col)
