"""Near-duplicate passages by compact windows.

A passage is PASSAGE consecutive five-word shingles, 50 words. Under each of HASHES random orders of shingles, the
passages that start side by side share their smallest shingle until it leaves them or a smaller one comes: the nodes of
the order's Cartesian tree that passages of this length meet. Such a run is a compact window: one value stands
for all its passages. An interval join of the windows of a band's orders, within a text, gives windows whose passages share a signature of BAND
values. Two passages with similarity 0.8 share an order's value with probability 0.8, and a band's signature with 0.64.

1. Signatures meet by value; those of one text alone can't match and leave. Windows that are left are kept
   with the shingles of the pieces of text that they cover.
2. These shingles meet by value. A passage with less than SHARED shingles that other texts hold too has no near-duplicate, so its start leaves.
3. Windows with equal shingles are a class: all but those of its smallest doc_id are exact repeats of that one, and are settled.
4. What is left meets by signature. First a window is paired with the one of its group with the smallest doc_id, which settles most.
   Windows with starts that are still unsettled are compared with all of their group, in blocks of BLOCK_WINDOWS that are dealt to tasks. A pair leaves only by a
   bound that loses none: of the shingles that all passages of one window hold, at most PASSAGE - SHARED may be missing in the other window. What is left is verified.
   So pairs of rows grow with the windows; comparisons of what no smaller doc_id settles grow with the square of a group, in arrays.
5. Pairs of windows become pairs of pieces, each once with all its alignments, and are verified on their shingles: a start is settled
   where at least SHARED of the passage's shingles stand in an equally long passage of the other piece, and SHARED of that one's in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, staged, text_bytes
from .near_duplicates import _PLACES, _SPACE, WORDS, _mix, word_hashes
from .substring_parse import CODE_BITS, PART_BYTES, _batches, _by_bucket, _five_bytes, _unpack

PASSAGE = 46
HASHES, BAND = 8, 2
#: Of PASSAGE shingles, those that have to be shared for a similarity of 0.8: m / (2 * PASSAGE - m) >= 0.8.
SHARED = -(-8 * PASSAGE // 9)
#: Shingles between windows that are kept in one piece.
PIECE_GAP = 64
#: Windows of a group that are compared with as many others, hash buckets of their shingles, partners that a whole window is tested with, windows whose starts
#: are laid out at a time, and starts that are looked at more closely at a time.
BLOCK_WINDOWS, BUCKETS, WHOLE, CHUNK, PAIRS = 1 << 10, 1 << 10, 3, 1 << 6, 1 << 9
#: Shingles of a window at most: all of its passages hold one of them.
WIDE = 2 * PASSAGE - 1
#: Starts whose smallest shingles are sought at a time; a multiple of 64.
BLOCK = 1 << 14

_ORDERS = np.random.default_rng(20240502).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def batch_shingles(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: shingle hashes at every word, the text of each, where each text's words begin, their numbers, and doc_ids."""
    data, ends, ids, known = _unpack(row)
    texts = [data[a:b].tobytes().lower() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
    words, stops = word_hashes(texts)
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    n = max(0, len(words) - WORDS + 1)
    mixed = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        mixed[at : at + size] = _mix(sum(words[at + k : at + k + size] * _PLACES[k] for k in range(WORDS)))
    owner = np.searchsorted(stops, np.arange(n), side="right")
    return mixed, owner, begins, np.where(known, stops - begins, 0), ids


def smallest(mixed: np.ndarray) -> list[np.ndarray]:
    """For each order and start, the place of the smallest of PASSAGE shingles; ties go to places in a fixed order. Works in blocks that a processor's cache holds."""
    n = len(mixed) - PASSAGE + 1
    found = [np.empty(n, np.int32) for _ in range(HASHES)]
    for at in range(0, n, BLOCK):
        block = mixed[at : at + BLOCK + PASSAGE - 1]
        place = np.arange(len(block), dtype=np.uint64) & np.uint64(63)
        start = np.arange(len(block) - PASSAGE + 1)
        for order, out in zip(_ORDERS, found, strict=True):
            key = block * order
            key ^= key >> np.uint64(31)
            key *= np.uint64(0x9E3779B97F4A7C15)
            key &= ~np.uint64(63)
            key |= place
            width = 1
            while width * 2 <= PASSAGE:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            key = np.minimum(key[: len(key) - (PASSAGE - width)], key[PASSAGE - width :])
            out[at : at + len(start)] = at + start + (((key & np.uint64(63)).astype(np.int64) - (start & 63)) & 63)
    return found


def passage_minima(row: dict) -> tuple:
    """Shingles and texts of a batch, where texts' words begin, their numbers, doc_ids, which starts have a whole passage, and each order's smallest shingles."""
    mixed, owner, begins, counts, ids = batch_shingles(row)
    n = len(mixed) - PASSAGE + 1
    if n <= 0:
        return mixed, owner, begins, counts, ids, np.zeros(0, bool), []
    last = (begins + counts)[owner[:n]] - (PASSAGE + WORDS - 1)
    whole = np.arange(n) <= last
    return mixed, owner, begins, counts, ids, whole, smallest(mixed)


def signature_windows(mixed: np.ndarray, owner: np.ndarray, whole: np.ndarray, minima: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each band, the windows whose passages have one smallest shingle in each of its orders: first and last start, signature, and the place of one such shingle."""
    for first in range(0, HASHES if minima else 0, BAND):
        at = minima[first : first + BAND]
        begin = whole.copy()
        begin[1:] &= ~whole[:-1] | (owner[1 : len(whole)] != owner[: len(whole) - 1]) | np.any([x[1:] != x[:-1] for x in at], axis=0)
        stop = whole.copy()
        stop[:-1] &= begin[1:] | ~whole[1:]
        s0, s1 = np.flatnonzero(begin), np.flatnonzero(stop)
        value = np.full(len(s0), first, np.uint64)
        for x in at:
            value = _mix(value + mixed[x[s0]])
        yield s0, s1, value, at[0][s0]


def _codes(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values % np.uint64(buckets) << np.uint64(CODE_BITS)) | (values // np.uint64(buckets) & np.uint64((1 << CODE_BITS) - 1))


def _shared(x: np.ndarray, y: np.ndarray, shift: int) -> np.ndarray:
    """For each start s of a passage in x, how many of its shingles stand in y's passage from s + shift on."""
    keys = np.sort((y.astype(np.uint64) << np.uint64(32)) | np.arange(len(y), dtype=np.uint64))
    i = np.arange(len(x))
    use = (i + shift > -PASSAGE) & (i + shift < len(y) + PASSAGE)
    i = i[use]
    query = (x[i].astype(np.uint64) << np.uint64(32)) | np.clip(i + shift, 0, (1 << 32) - 1).astype(np.uint64)
    after = np.searchsorted(keys, query, side="right")
    padded = np.concatenate([[np.uint64(0)], keys, [np.uint64(0)]])
    far = 2 * PASSAGE

    def offset(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        same = known & (key >> np.uint64(32) == x[i])
        return np.where(same, (key & np.uint64(0xFFFFFFFF)).astype(np.int64) - (i + shift), far)

    before, later = offset(padded[after], after > 0), offset(padded[after + 1], after < len(keys))
    before = np.where(before > 0, far, before)  # a start before y's first shingle was clipped
    change = np.zeros(len(x) + PASSAGE + 2, np.int32)

    def cover(lo: np.ndarray, hi: np.ndarray) -> None:
        """One more for the starts from lo to hi."""
        some = hi >= lo
        np.add.at(change, np.clip(lo[some], 0, len(x)), 1)
        np.add.at(change, np.clip(hi[some] + 1, 0, len(x)), -1)

    near = before > -PASSAGE
    near &= before != far
    cover((i - PASSAGE + 1)[near], (i + before)[near])
    near_later = (later > 0) & (later < PASSAGE)
    floor = np.where(near, i + before, i - PASSAGE)
    cover(np.maximum(i + later - PASSAGE, floor)[near_later] + 1, i[near_later])
    return np.cumsum(change)[: max(0, len(x) - PASSAGE + 1)]


def _rolled(flags: np.ndarray) -> np.ndarray:
    """Sums of PASSAGE flags in a row, along the last axis."""
    sums = np.cumsum(flags, axis=-1, dtype=np.int32)
    out = sums[..., PASSAGE - 1 :].copy()
    out[..., 1:] -= sums[..., :-PASSAGE]
    return out


def similar_starts(x: np.ndarray, y: np.ndarray, shifts: list[int]) -> np.ndarray:
    """Starts of passages in x that are near-duplicates of a passage in y that begins at one of the shifts from them.

    Of the shingles that two such passages share, at least half stand in equal places of both, at one of the shifts.
    """
    n = len(x) - PASSAGE + 1
    good = np.zeros(max(0, n), bool)
    if n <= 0:
        return good
    held = None
    step = max(1, (1 << 20) // len(x))
    for at in range(0, len(shifts), step):
        moved = np.array(shifts[at : at + step])[:, None]
        to = np.arange(len(x)) + moved
        equal = (y[np.clip(to, 0, len(y) - 1)] == x) & (to >= 0) & (to < len(y))
        count = _rolled(equal)
        count[(to[:, :n] < 0) | (to[:, :n] + PASSAGE > len(y))] = 0
        good |= (count >= SHARED).any(axis=0)
        if good.all():
            break
        maybe = (count >= SHARED // 2) & ~good
        if maybe.any():  # shingles may stand in other places of the passages
            held = _rolled(np.isin(x, y)) >= SHARED if held is None else held
            maybe &= held
            for k in np.flatnonzero(maybe.any(axis=1)).tolist():
                here, shift = np.flatnonzero(maybe[k] & ~good), int(moved[k, 0])
                if len(here):
                    lo, hi = int(here[0]), int(here[-1]) + PASSAGE
                    there = max(0, lo + shift)
                    xs, ys, off = x[lo:hi], y[there : hi + shift], lo + shift - there
                    here = here - lo
                    here = here[_shared(xs, ys, off)[here] >= SHARED]
                    good[lo + here[_shared(ys, xs, -off)[here + off] >= SHARED]] = True
    return good


_SENT = "bucket int, batch long, codes binary, twice binary"


def _send(batch: int, code: np.ndarray, docs_of: np.ndarray, parts: int) -> pa.RecordBatch:
    """A batch's distinct codes by bucket, and which of them stand in two of its texts."""
    order = np.lexsort((docs_of, code))
    code, docs_of = code[order], docs_of[order]
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    group = np.cumsum(first) - 1
    twice = np.zeros(int(first.sum()), bool)
    twice[group[1:][(docs_of[1:] != docs_of[:-1]) & ~first[1:]]] = True
    code = code[first]
    found = _by_bucket(code, parts)
    columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([batch] * len(found), pa.int64()), pa.array([_five_bytes(code[a:b]) for _, a, b in found], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "codes", "twice"])


def _find_shared(table: pa.Table) -> pa.Table:
    """Of each batch's codes in a bucket, those that stand in more than one text of the corpus."""
    values = table["codes"].to_pylist()
    sizes = [len(x) // (CODE_BITS // 8) for x in values]
    codes = np.zeros((sum(sizes), 8), np.uint8)
    codes[:, : CODE_BITS // 8] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, CODE_BITS // 8)
    _, inverse, counts = np.unique(codes.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    often = counts > 1
    often[inverse[np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes, strict=True)]).astype(bool)]] = True
    flags = np.split(often[inverse], np.cumsum(sizes)[:-1])
    bodies = [(np.frombuffer(v, np.uint8).reshape(-1, CODE_BITS // 8)[f]).tobytes() for v, f in zip(values, flags, strict=True)]
    return pa.table([table["batch"], table["bucket"], pa.array(bodies, pa.binary())], names=["batch", "bucket", "codes"])


def _shared_codes(sent: DataFrame) -> DataFrame:
    """batch and shared: its codes that stand in more than one text, by bucket."""
    found = sent.groupBy("bucket").applyInArrow(_find_shared, "batch long, bucket int, codes binary")
    return found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "codes")).alias("shared"))


def _received(shared: list[dict]) -> np.ndarray:
    known = [np.zeros(0, np.uint64)]
    for x in shared:
        codes = np.zeros((len(x["codes"]) // (CODE_BITS // 8), 8), np.uint8)
        codes[:, : CODE_BITS // 8] = np.frombuffer(x["codes"], np.uint8).reshape(-1, CODE_BITS // 8)
        known.append(codes.view(np.uint64).ravel() | np.uint64(x["bucket"]) << np.uint64(CODE_BITS))
    return np.concatenate(known)


def _laid_out(windows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window, its shingles as a row (then 0), the last start of a passage, and its doc."""
    n = np.array([len(w["shingles"]) // 4 for w in windows])
    rows = np.zeros((len(n), WIDE), np.uint32)
    rows[np.arange(WIDE) < n[:, None]] = np.frombuffer(b"".join(w["shingles"] for w in windows), np.uint32)
    return rows, n - PASSAGE, np.array([w["doc"] for w in windows])


def _held(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets the passages from a first to a last start fall in, and how many of the shingles that all of them hold fall in each."""
    buckets, place = shingles % BUCKETS, np.arange(WIDE)
    held, core = np.zeros((len(buckets), BUCKETS), np.float32), np.zeros((len(buckets), BUCKETS), np.float32)
    rows, at = np.nonzero((place >= first[:, None]) & (place < last[:, None] + PASSAGE))
    held[rows, buckets[rows, at]] = 1
    rows, at = np.nonzero((place >= last[:, None]) & (place < first[:, None] + PASSAGE))
    np.add.at(core, (rows, buckets[rows, at]), 1)
    return held, core


def settled_by(x: list[dict], y: list[dict]) -> Iterator[tuple[int, np.ndarray, int]]:
    """Windows of x with the starts, from the window's first, of passages that are near-duplicates of one in a window of y with a smaller doc, and that doc.

    Every start is compared with every window until one settles it: first whole windows with the WHOLE nearest ones, then what is left start by start.
    """
    (xs, ends, docs), (ys, y_ends, y_docs) = _laid_out(x), _laid_out(y)
    y_held, y_core = _held(ys, np.zeros(len(y), np.int64), y_ends)
    good = np.arange(PASSAGE) > ends[:, None]  # what is no start counts as settled
    tried = docs[:, None] <= y_docs

    def bound(of: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For windows' starts from a first to a last one and each window of y, at most so many shingles are missing in the other where two passages are near; more where none are."""
        held, core = _held(xs[of], first, last)
        return np.where(tried[of], PASSAGE, np.maximum(core @ (1 - y_held).T, (1 - held) @ y_core.T))

    def test(p: int, q: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """All open starts of a window with all of another."""
        if tried[p, q] or good[p].all():
            return
        tried[p, q] = True
        some = np.flatnonzero(~good[p])
        lo, hi = int(some[0]), int(some[-1])
        one, other = xs[p, lo : hi + PASSAGE], ys[q, : y_ends[q] + PASSAGE]
        new = lo + np.flatnonzero(similar_starts(one, other, list(range(PASSAGE - len(one), len(other) - PASSAGE + 1))) & ~good[p, lo : hi + 1])
        if len(new):
            good[p, new] = True
            yield p, new, int(y_docs[q])

    whole = bound(np.arange(len(x)), np.zeros(len(x), np.int64), ends)
    for p, row in enumerate(np.argsort(whole, axis=1, kind="stable")[:, :WHOLE].tolist()):
        for q in row:
            if whole[p, q] <= PASSAGE - SHARED:
                yield from test(p, q)
    for at in range(0, len(x), CHUNK):
        of, starts = np.nonzero(~good[at : at + CHUNK])
        of, take = of + at, 1
        missing = bound(of, starts, starts)
        while len(of):
            nearest = np.argpartition(missing, min(take, len(y)) - 1, axis=1)[:, :take]
            row = np.repeat(np.arange(len(of)), nearest.shape[1])
            q = nearest.ravel()
            may = missing[row, q] <= PASSAGE - SHARED
            row, q = row[may], q[may]
            missing[row, q] = PASSAGE
            for k in range(0, len(row), PAIRS):
                # A start with fewer shingles in the other window than are to be shared, or that no passage there has enough of, is not settled by it.
                r, w = row[k : k + PAIRS], q[k : k + PAIRS]
                r, w = (v[~good[of[r], starts[r]]] for v in (r, w))
                same = xs[of[r][:, None], starts[r][:, None] + np.arange(PASSAGE)][:, :, None] == ys[w][:, None, :]
                near = (same.any(axis=2).sum(axis=1) >= SHARED) & (_rolled(same.any(axis=1)) >= SHARED).any(axis=1)
                for p, other in zip(of[r[near]].tolist(), w[near].tolist(), strict=True):
                    yield from test(p, other)
            left = ~good[of, starts] & (missing <= PASSAGE - SHARED).any(axis=1)
            of, starts, missing, take = of[left], starts[left], missing[left], min(4 * take, len(y))


def near_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_dup_words, spans: words in passages that are near-duplicates of a passage in a document with a smaller doc_id.

    ``spans`` are (first word, end, doc_id of the other text), by first word; they may overlap. Texts of fewer than 50 words have no passage.
    A null text has no words; a null doc_id has no spans and is no source. Rows with equal doc_id do not match each other. Each row gives a row;
    other columns are ignored; an empty table gives no rows. doc_id has to be an integer.
    """
    with scratch(docs.sparkSession):
        return staged(_near_passages(docs, doc_id, text, part_bytes), "near_passages", outlives=True)


def _near_passages(docs: DataFrame, doc_id: str, text: str, part_bytes: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    parts = max(1, -(-text_bytes(docs, text) // part_bytes))
    batches = _batches(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "doc_id", "text", parts)
    blobs = ("batch", "ids", "known", "ends", "data")

    def send_values(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                mixed, owner, _, _, ids, whole, minima = passage_minima(row)
                found = list(signature_windows(mixed, owner, whole, minima))
                if found:
                    yield _send(row["batch"], np.concatenate([_codes(x[2], parts) for x in found]), np.concatenate([ids[owner[x[0]]] for x in found]), parts)

    of_window = {"doc": np.int64, "ord": np.int32, "base": np.int64, "slot": np.int32, "s0": np.int64, "s1": np.int64, "c": np.int64, "value": np.uint64}
    of_piece = {"p_doc": np.int64, "p_ord": np.int32, "p_base": np.int64, "p_lo": np.int64, "p_n": np.int64, "low": np.uint32}

    def keep_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each batch: its windows with shared signatures, and the pieces that they cover, as packed arrays."""
        for batch in rows:
            for row in batch.to_pylist():
                mixed, owner, begins, _, ids, whole, minima = passage_minima(row)
                known = _received(row["shared"])
                found = [[y[keep] for y in x] for x in signature_windows(mixed, owner, whole, minima) for keep in [np.isin(_codes(x[2], parts), known)]]
                if not sum(len(x[0]) for x in found):
                    continue
                s0, s1, value, c = (np.concatenate([x[k] for x in found]) for k in range(4))
                order = np.argsort(s0, kind="stable")
                s0, s1, value, c = s0[order], s1[order], value[order], c[order]
                ords, ends = owner[s0], np.maximum.accumulate(s1) + PASSAGE
                new = np.ones(len(s0), bool)
                new[1:] = (ords[1:] != ords[:-1]) | (s0[1:] > ends[:-1] + PIECE_GAP)
                lo, hi, low = s0[new], ends[np.append(new[1:], True)], (mixed >> np.uint64(32)).astype(np.uint32)
                packed = [ids[ords], ords, begins[ords], np.cumsum(new) - 1, s0, s1, c, value]
                packed += [ids[ords[new]], ords[new], begins[ords[new]], lo, hi - lo, np.concatenate([low[p:q] for p, q in zip(lo.tolist(), hi.tolist(), strict=True)])]
                kinds = {**of_window, **of_piece}
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(packed, kinds.values(), strict=True)]], names=["batch", *kinds])

    packed_schema = "batch long, " + ", ".join(f"{c} binary" for c in (*of_window, *of_piece))

    def unpacked(row: dict, kinds: dict) -> list[np.ndarray]:
        return [np.frombuffer(row[c], kind) for c, kind in kinds.items()]

    def send_shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                doc, _, _, _, n, low = unpacked(row, of_piece)
                yield _send(row["batch"], _codes(_mix(low.astype(np.uint64)), parts), np.repeat(doc, n), parts)

    def send_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["code", "cls", "doc", "batch", "ord", "slot", "s0", "s1", "c", "lo", "shingles"]
        for batch in rows:
            for row in batch.to_pylist():
                doc, ords, base, slot, s0, s1, c, value = unpacked(row, of_window)
                _, p_ord, p_base, p_lo, p_n, low = unpacked(row, of_piece)
                hashed = _mix(low.astype(np.uint64))
                held = np.concatenate([_rolled(np.isin(_codes(hashed, parts), _received(row["shared"] or ()))) >= SHARED, np.zeros(PASSAGE, bool)])
                runs = np.flatnonzero(held & ~np.append(False, held[:-1]))
                stops = np.flatnonzero(held[:-1] & ~held[1:])
                off = (np.cumsum(p_n) - p_n - p_lo)[slot]
                # Windows are cut to stretches of starts whose passages may have a near-duplicate.
                begin, end = np.searchsorted(stops, s0 + off), np.searchsorted(runs, s1 + off, side="right")
                count = np.maximum(end - begin, 0)
                of = np.repeat(np.arange(len(s0)), count)
                run = np.repeat(begin, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                a, b = np.maximum(s0[of] + off[of], runs[run]), np.minimum(s1[of] + off[of], stops[run])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed)])
                body = sums[b + PASSAGE] - sums[a]
                n, here = len(of), off[of]
                cls = _mix(_mix(value[of] + body) + ((a - here - c[of]) * 4096 + (b - a)).astype(np.uint64))
                texts = [x - base[of] for x in (a - here, b - here, c[of])]
                columns = [pa.array(value[of].view(np.int64)), pa.array(cls.view(np.int64)), pa.array(doc[of]), pa.array(np.full(n, row["batch"])), pa.array(ords[of]), pa.array(slot[of]), *[pa.array(x.astype(np.int32)) for x in texts], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                n, empty = len(p_n), lambda kind: pa.nulls(len(p_n), kind)  # noqa: B023
                columns = [*[empty(pa.int64())] * 3, pa.array(np.full(n, row["batch"])), pa.array(p_ord), pa.array(np.arange(n, dtype=np.int32)), *[empty(pa.int32())] * 3, pa.array((p_lo - p_base).astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, np.cumsum(p_n)[:-1])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    window_schema = "code long, cls long, doc long, batch long, ord int, slot int, s0 int, s1 int, c int, lo int, shingles binary"
    with scratch(docs.sparkSession):  # what leads to the windows goes once they are written
        with scratch(docs.sparkSession):
            shared = staged(_shared_codes(batches.select(*blobs).mapInArrow(send_values, _SENT)), "shared")
            kept = staged(batches.select(*blobs).join(shared.hint("shuffle_hash"), "batch").mapInArrow(keep_windows, packed_schema), "kept", outlives=True, compression="zstd")
        # By batch already, so the join moves the windows only.
        often = _shared_codes(kept.select("batch", *of_piece).mapInArrow(send_shingles, _SENT))
        both = staged(kept.join(often.hint("shuffle_hash"), "batch", "left").mapInArrow(send_windows, window_schema), "windows", outlives=True, compression="zstd")
    pieces = both.filter("shingles IS NOT NULL").select("batch", "slot", "ord", "lo", "shingles")
    every = both.filter("shingles IS NULL").drop("lo", "shingles")
    classes = every.groupBy("cls").agg(F.min("doc").alias("least"))
    ranked = staged(every.join(classes.hint("merge"), "cls").drop("cls"), "ranked")
    repeats = ranked.filter("doc > least").select("batch", "slot", "ord", F.col("s0").alias("first"), F.col("s1").alias("last"), F.col("least").alias("source"))
    windows = ranked.filter("doc = least").drop("least", "ord")

    near_schema = "batch long, slot int, ord int, first int, last int, source long"

    def starts_of(out: list[tuple[int, ...]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["batch", "slot", "ord", "first", "last", "source"])

    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple[int, ...]] = []
            for at, slot, ord_, source, shifts, lo, x, lo2, y in zip(*[batch.column(k).to_pylist() for k in range(9)], strict=True):
                good = np.flatnonzero(similar_starts(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), [d + lo - lo2 for d in shifts]))
                if len(good):
                    cuts = np.flatnonzero(np.diff(good) > 1)
                    for p, q in zip(good[np.concatenate([[0], cuts + 1])].tolist(), good[np.concatenate([cuts, [len(good) - 1]])].tolist(), strict=True):
                        out.append((at, slot, ord_, lo + p, lo + q, source))
            yield starts_of(out)

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple[int, ...]] = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for k, good, source in settled_by(x, y):
                    w, cuts = x[k], np.flatnonzero(np.diff(good) > 1)
                    for p, q in zip(good[np.concatenate([[0], cuts + 1])].tolist(), good[np.concatenate([cuts, [len(good) - 1]])].tolist(), strict=True):
                        out.append((w["batch"], w["slot"], w["ord"], w["s0"] + p, w["s0"] + q, source))
            yield starts_of(out)

    def verified(found: DataFrame) -> DataFrame:
        """batch, slot, ord, first, last, source: starts of windows with a partner ``o`` that are near-duplicates of passages in its piece."""
        shift = F.col("o.c") - F.col("c")
        pairs = found.groupBy("batch", "slot", F.col("o.batch").alias("batch2"), F.col("o.slot").alias("slot2")).agg(F.first("o.doc").alias("source"), F.collect_set(shift).alias("shifts"), F.min("s0").alias("a"), F.max("s1").alias("b"), F.min(shift).alias("down"), F.max(shift).alias("up"))
        x = pieces.hint("merge")
        y = pieces.select(F.col("batch").alias("batch2"), F.col("slot").alias("slot2"), F.col("lo").alias("lo2"), F.col("shingles").alias("y")).hint("merge")
        # Of each piece, only the shingles of passages that the windows hold.
        left = pairs.join(x, ["batch", "slot"]).withColumn("shingles", F.expr(f"substring(shingles, 4 * (a - lo) + 1, 4 * (b - a + {PASSAGE}))"))
        both = left.join(y, ["batch2", "slot2"]).withColumn("from2", F.greatest(F.col("a") + F.col("down"), F.col("lo2")))
        joined = both.select("batch", "slot", "ord", "source", "shifts", F.col("a").alias("lo"), "shingles", F.col("from2").alias("lo2"), F.expr(f"substring(y, 4 * (from2 - lo2) + 1, 4 * (b + up + {PASSAGE} - from2))").alias("y"))
        return staged(joined.mapInArrow(verify, near_schema), "verified")

    def unsettled(windows: DataFrame, near: DataFrame) -> DataFrame:
        """Windows with a start that nothing settles."""
        settled = near.groupBy("batch", "slot").agg(F.collect_set(F.struct("first", "last")).alias("settled"))
        joined = windows.join(settled.hint("merge"), ["batch", "slot"], "left")
        return staged(joined.filter("settled IS NULL OR NOT exists(settled, x -> x.first <= s0 AND s1 <= x.last)").drop("settled"), "unsettled")

    here = F.struct("doc", "batch", "slot", "c")
    smallest_of = windows.groupBy("code").agg(F.min(here).alias("o")).hint("merge")

    # Round 1: the smallest doc_id of each group.
    others = unsettled(windows.join(smallest_of, "code").filter("o.doc < doc"), repeats)
    near = repeats.unionByName(verified(others))
    # Round 2: what is unsettled with all of its group, block by block. Hashes deal a group's windows to blocks, and its blocks to tasks.
    left = unsettled(others.drop("o"), near)

    def blocks(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
        """code, part and a block of its windows, each with its own shingles."""
        own = F.expr(f"substring(shingles, 4 * (s0 - lo) + 1, 4 * (s1 - s0 + {PASSAGE}))").alias("shingles")
        held = rows.select("code", "doc", "batch", "slot", "s0", "s1").join(pieces.hint("merge"), ["batch", "slot"]).select("code", "doc", "batch", "slot", "ord", "s0", own)
        part = F.pmod(F.xxhash64("doc", "batch", "slot", "s0"), F.col("more") + 1).alias("part")
        return held.join(sizes.hint("merge"), "code").groupBy("code", part).agg(F.collect_list(F.struct("doc", "batch", "slot", "ord", "s0", "shingles")).alias(name))

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("code").agg((F.count("*") / BLOCK_WINDOWS).cast("long").alias("more"))

    last = left.groupBy("code").agg(F.max("doc").alias("most")).hint("merge")
    group = staged(windows.join(last, "code").filter("doc < most").drop("most"), "group")
    dealt = blocks(left, sizes(left), "x").drop("part").join(sizes(group).hint("merge"), "code").select("code", "x", F.explode(F.sequence(F.lit(0).cast("long"), "more")).alias("part"))
    pairs = dealt.join(blocks(group, sizes(group), "y").hint("merge"), ["code", "part"])
    near = near.unionByName(staged(pairs.select("x", "y").mapInArrow(compare, near_schema), "compared"))
    spans = near.select("batch", "ord", F.col("first").alias("start"), (F.col("last") + PASSAGE + WORDS - 1).alias("end"), "source")
    found = staged(spans.groupBy("batch").agg(F.collect_list(F.struct("ord", "start", "end", "source")).alias("found")), "found")

    def report(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row, found in zip(batch.select(list(blobs)).to_pylist(), batch.column("found"), strict=True):
                data, ends, ids, known = _unpack(row)
                inside = ~_SPACE[data]
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                opens = inside.copy()
                opens[1:] &= ~inside[:-1]
                filled = begins[begins < ends]
                opens[filled] = inside[filled]
                at = np.flatnonzero(opens)
                n_words = np.searchsorted(at, ends) - np.searchsorted(at, begins)
                ords, start, end, source = (found.values.field(k).to_numpy() for k in range(4)) if found.is_valid else (np.zeros(0, np.int64),) * 4
                order = np.lexsort((source, end, start, ords))
                ords, start, end, source = ords[order].astype(np.int64), start[order], end[order], source[order]
                new = np.ones(len(ords), bool)
                new[1:] = (ords[1:] != ords[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (source[1:] != source[:-1])
                ords, start, end, source = ords[new], start[new], end[new], source[new]
                # Each text's spans, by where they start, cover what lies beyond the furthest end of those before.
                furthest = np.concatenate([[-1], np.maximum.accumulate((ords << 32) + end)[:-1]])[: len(ords)]
                covered = np.maximum(0, end - np.maximum(start, np.where(furthest >> 32 == ords, furthest & 0xFFFFFFFF, 0)))
                n_dup = np.bincount(ords, covered, len(ids)).astype(np.int64)
                span_columns = [pa.array(x.astype(kind)) for x, kind in ((start, np.int32), (end, np.int32), (source, np.int64))]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(ords, np.arange(len(ids) + 1)).astype(np.int32)), pa.StructArray.from_arrays(span_columns, ["start", "end", "source"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n_words.astype(np.int64)), pa.array(n_dup), spans], names=["doc_id", "n_words", "n_dup_words", "spans"])

    return batches.select(*blobs).join(found.hint("shuffle_hash"), "batch", "left").mapInArrow(report, "doc_id long, n_words long, n_dup_words long, spans array<struct<start:int,end:int,source:long>>")


def near_passages_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_dup_words, n_spans, source_ids (sorted) of every document."""
    found = near_passages(docs)
    return found.select("doc_id", "n_words", "n_dup_words", F.size("spans").cast("long").alias("n_spans"), F.sort_array(F.array_distinct(F.col("spans.source"))).alias("source_ids"))
