"""Substring dedup: passages of ``window`` words that also start in an earlier document, found behind a count-min prefilter.

First pass. Every window has an anchor, the least hash among the k-grams of half its length inside it, so equal windows have
equal anchors and neighbouring windows mostly share one. The count-min table of all anchors has DEPTH rows of a width that is
fixed by the size of the input, cut into slices. Each task counts its anchors, chunk by chunk, in such a table and sends of each
slice the cells it met, not the anchors; slices add these sketches up, and the merged table estimates the places that came
along with the cells. Counters stop at 2 for a chunk, as only that is asked for. An estimate is never below the number of
windows' occurrences, so a window that occurs twice always has an anchor estimated at 2 or more. An anchor that repeats within a
chunk is known to repeat: its windows go on at once, and the slice gets the cells only. So a slice holds at most one place of an
anchor per chunk, however common it is.

Second pass. Only windows with such an anchor are hashed (96 bits, within the slice of their anchor) and grouped exactly. A
chunk keeps the smallest document of each window, which flags its own larger documents, and sends that on; the slice flags the
rest. Flagged windows come back to their document as runs, and the words they cover are removed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import query, short_batches, table, text_bytes

#: Rows of the count-min table; its cells per entry; entries (anchors, windows) in a chunk; the same in a slice, on average;
#: bits of a cell's number, so that the cells of an entry fit in 64.
DEPTH, SPARE, CHUNK, PER_SLICE, CELL_BITS = 2, 4, 1 << 18, 1 << 18, 20
#: Slices at least, so that small inputs are dealt out as well, and bytes that a word takes at least on average.
LEAST_SLICES, WORD_BYTES = 1024, 5
_MIX = 0x9E3779B97F4A7C15
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mixed(x: np.ndarray, turn: int = 1) -> np.ndarray:
    """The hash finaliser x -> (x ^ x >> 32) * odd, twice."""
    odd = np.uint64(_MIX * (2 * turn + 1) % 2**64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * odd
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of odd numbers and of their inverses modulo 2**64, grown as texts need them."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in _STEP]
        self.down = [np.ones(1, np.uint64) for _ in _STEP]

    def grow(self, n: int) -> None:
        if n > len(self.up[0]):
            n = max(n, 2 * len(self.up[0]))
            for k, m in enumerate(_STEP):
                for store, base in ((self.up, int(m)), (self.down, pow(int(m), -1, 1 << 64))):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    store[k] = np.multiply.accumulate(steps)


_powers = _Powers()


def _rolled(words: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by a polynomial over their hashes modulo 2**64."""
    _powers.grow(len(words) + 1)
    up, down = _powers.up[which], _powers.down[which]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)))
    return _mixed((sums[length:] - sums[:-length]) * down[:len(words) - length + 1], which + 1)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _anchor_runs(hashes: np.ndarray, window: int):
    """(anchor, first window, windows) for each run of neighbouring windows with one anchor."""
    k = window // 2
    grams = _rolled(hashes, k, 0)
    span = window - k + 1
    at = np.arange(len(hashes) - window + 1)
    at += np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return grams[at[starts]], starts, np.diff(np.concatenate((starts, [len(at)])))


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each anchor; anchors are least hashes, most of them small, so they are mixed again."""
    return ((_mixed(keys, 0) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _runs_bytes(first, count) -> bytes:
    return np.stack((first, count), 1).astype("<u4").tobytes()


def _by_document(uid, doc, first, count):
    """Rows (uid, doc, runs) of equal documents put together, as three lists; runs that repeat count once."""
    if not len(uid):
        return [], [], []
    order = np.lexsort((count, first, doc, uid))
    uid, doc, first, count = uid[order], doc[order], first[order], count[order]
    same = (uid[1:] == uid[:-1]) & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]) & (count[1:] == count[:-1])
    new = np.concatenate(([True], ~same))
    uid, doc, first, count = uid[new], doc[new], first[new], count[new]
    cuts = np.flatnonzero((np.diff(uid) != 0) | (np.diff(doc) != 0)) + 1
    edges = [0, *cuts.tolist(), len(uid)]
    return (uid[edges[:-1]].tolist(), doc[edges[:-1]].tolist(),
            [_runs_bytes(first[a:b], count[a:b]) for a, b in zip(edges, edges[1:])])


def _per_slice(batches, close):
    """Calls close(rows of a slice as a table) for each slice of a sorted partition and passes on what it yields."""
    held, now = [], None
    for batch in batches:
        slices = batch.column("slice").to_numpy()
        cuts = np.flatnonzero(np.diff(slices)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slices)]):
            if b > a:
                if held and slices[a] != now:
                    yield from close(pa.Table.from_batches(held))
                    held = []
                now = slices[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield from close(pa.Table.from_batches(held))


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as first bytes of all, second bytes of all and so on, whose zeros a shuffle's compression takes away."""
    return x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def _from_planes(column, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
             for x in column.to_pylist() if x]
    return np.concatenate([np.empty(0, kind), *parts])


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """Cells of anchors in the DEPTH rows of a table, as one number each."""
    packed = np.zeros(len(keys), np.uint64)
    for d in range(DEPTH):
        packed |= (_mixed(keys, 3 + d) & np.uint64(width - 1)) << np.uint64(CELL_BITS * d)
    return packed


def _estimates(packed: np.ndarray, counts: np.ndarray, asked: np.ndarray, width: int) -> np.ndarray:
    """Merges sketches, given as the cells met and their counts, and reads the table at the cells that are asked for."""
    least = None
    for d in range(DEPTH):
        cell = lambda x: (x >> np.uint64(CELL_BITS * d) & np.uint64(width - 1)).astype(np.int64)  # noqa: B023, E731
        found = np.bincount(cell(packed), weights=counts, minlength=width)[cell(asked)]
        least = found if least is None else np.minimum(least, found)
    return least


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


_RUNS = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("runs", pa.binary())])
_SKETCH = pa.schema([("slice", pa.int64()), ("cells", pa.binary()), ("uids", pa.binary()), ("firsts", pa.binary()),
                     ("counts", pa.binary())])
_EXACT = pa.schema([("slice", pa.int64()), ("marks", pa.binary()), ("tails", pa.binary()), ("uids", pa.binary()),
                    ("docs", pa.binary()), ("places", pa.binary())])


def _empty(schema):
    return {f.name: [] for f in schema}


def _sketch(window: int, slices: int, width: int):
    """First pass: sketch rows for the slices, and rows of slice -1 - n with runs known to repeat within the chunk."""

    def close(parts):
        key, uid, first, count = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, uid, first, count = key[order], uid[order], first[order], count[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(key)])))
        alone = np.repeat(sizes == 1, sizes)
        out = _empty(_SKETCH)
        for u, _, runs in zip(*_by_document(uid[~alone], uid[~alone], first[~alone], count[~alone])):
            runs = np.frombuffer(runs, "<u4").reshape(-1, 2)
            for name, x in zip(_SKETCH.names, (-1 - (u & 0xFFFF), None, np.array([u], np.int64).tobytes(),
                                               _planes(runs[:, 0], "<u4"), _planes(runs[:, 1], "<u4"))):
                out[name].append(x)
        at = _slice_of(key[heads], slices)
        order = np.lexsort((sizes > 1, at))  # of a slice first the cells of places, then those of anchors that repeat here
        heads, at, once = heads[order], at[order], sizes[order] == 1
        packed = _cells(key[heads], width)
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:]):
            one = heads[a:b][once[a:b]]
            for name, x in zip(_SKETCH.names, (int(at[a]), _planes(packed[a:b], "<u8"), _planes(uid[one], "<i8"),
                                               _planes(first[one], "<u4"), _planes(count[one], "<u4"))):
                out[name].append(x)
        table = pa.Table.from_pydict(out, _SKETCH)
        yield from table.to_batches(max_chunksize=4096)

    def run(batches):
        parts, held, seen = [], 0, set()
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                words = text.split()
                if len(words) < window or (uid, len(text)) in seen:  # a row that repeats id and text adds nothing
                    continue
                seen.add((uid, len(text)))
                key, first, count = _anchor_runs(_word_hashes(words), window)
                parts.append((key, np.full(len(key), uid, np.int64), first, count))
                held += len(key)
                if held >= CHUNK:
                    yield from close(parts)
                    parts, held = [], 0
        if parts:
            yield from close(parts)

    return run


def _estimate(width: int):
    """Merges the sketches of a slice; passes on the runs whose anchor is estimated at 2 or more."""

    def close(rows):
        first, count = (_from_planes(rows[c], "<u4") for c in ("firsts", "counts"))
        if rows["slice"][0].as_py() < 0:
            uid = np.repeat(_joined(rows["uids"], "<i8"), [len(x) // 4 for x in rows["firsts"].to_pylist()])
            chosen = slice(None)
        else:
            uid, packed = _from_planes(rows["uids"], "<i8"), _from_planes(rows["cells"], "<u8")
            places = np.array([len(x) // 8 for x in rows["uids"].to_pylist()], np.int64)
            cells = np.array([len(x) // 8 for x in rows["cells"].to_pylist()], np.int64)
            row = np.repeat(np.arange(len(cells)), cells)
            alone = np.arange(len(packed)) - (np.cumsum(cells) - cells)[row] < places[row]
            chosen = _estimates(packed, np.where(alone, 1, 2), packed[alone], width) >= 2
        u, _, runs = _by_document(uid[chosen], uid[chosen], first[chosen], count[chosen])
        if u:
            table = pa.Table.from_pydict({"uid": u, "runs": runs}, pa.schema([("uid", pa.int64()), ("runs", pa.binary())]))
            yield from table.to_batches(max_chunksize=4096)

    return lambda batches: _per_slice(batches, close)


def _flag(marks, tails, docs):
    """For windows: whether a smaller document has the same one."""
    order = np.lexsort((docs, tails, marks))
    m, t, d = marks[order], tails[order], docs[order]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (t[1:] != t[:-1])))
    least = d[new][np.cumsum(new) - 1]
    out = np.empty(len(d), bool)
    out[order] = d > least
    return out


def _spans(chosen: np.ndarray, run: np.ndarray):
    """Starts and lengths of the stretches of chosen windows, cut where the run of a window changes."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return at, at
    cut = np.concatenate(([True], (np.diff(at) != 1) | (run[at[1:]] != run[at[:-1]])))
    starts = np.flatnonzero(cut)
    return at[starts], np.diff(np.concatenate((starts, [len(at)])))


def _windows(window: int, slices: int):
    """Second pass: exact hashes of the chosen windows for the slices of their anchors, and runs flagged in the chunk."""

    def close(parts):
        key, uid, doc, first, count, marks, tails = (np.concatenate(x) for x in zip(*parts))
        run = np.repeat(np.arange(len(key)), count)
        place = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(run))
        flagged = _flag(marks, tails, doc[run])
        out = _empty(_EXACT)
        at, n = _spans(flagged, run)
        for u, d, runs in zip(*_by_document(uid[run[at]], doc[run[at]], place[at], n)):
            out["slice"].append(-1 - (u & 0xFFFF))
            out["marks"].append(None), out["tails"].append(None)
            out["uids"].append(np.array([u], np.int64).tobytes()), out["docs"].append(np.array([d], np.int64).tobytes())
            out["places"].append(runs)
        at, n = _spans(~flagged, run)
        where = _slice_of(key[run[at]], slices)
        order = np.argsort(where, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(where[order])) + 1).tolist(), len(order)]
        for a, b in zip(edges, edges[1:]):
            some = order[a:b]
            if len(some):
                rows = np.repeat(at[some] - np.concatenate(([0], np.cumsum(n[some])[:-1])), n[some]) \
                    + np.arange(n[some].sum())
                out["slice"].append(int(where[some[0]]))
                out["marks"].append(marks[rows].astype("<u8").tobytes())
                out["tails"].append(tails[rows].astype("<u4").tobytes())
                out["uids"].append(uid[run[at[some]]].astype("<i8").tobytes())
                out["docs"].append(doc[run[at[some]]].astype("<i8").tobytes())
                out["places"].append(_runs_bytes(place[at[some]], n[some]))
        table = pa.Table.from_pydict(out, _EXACT)
        yield from table.to_batches(max_chunksize=4096)

    def run(batches):
        parts, held, seen = [], 0, set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("uid", "doc", "text", "runs")]
            for uid, doc, text, runs in zip(*columns):
                words = text.split()
                if len(words) < window or (uid, len(text)) in seen:
                    continue
                seen.add((uid, len(text)))
                hashes = _word_hashes(words)
                wanted = np.zeros(len(words) + 1, np.int64)
                for a, n in np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).tolist():
                    if a + n <= len(words) - window + 1:  # else it is of another document under the same uid
                        wanted[a] += 1
                        wanted[a + n] -= 1
                wanted = np.cumsum(wanted)[:len(words) - window + 1] > 0
                key, first, count = _anchor_runs(hashes, window)
                chosen = wanted[first]  # a run is wanted whole or not at all
                if not chosen.any():
                    continue
                key, first, count = key[chosen], first[chosen], count[chosen]
                rows = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                marks, tails = _rolled(hashes, window, 0)[rows], _rolled(hashes, window, 1)[rows]
                n = len(key)
                parts.append((key, np.full(n, uid, np.int64), np.full(n, doc, np.int64), first, count, marks,
                              (tails >> np.uint64(32)).astype(np.uint32)))
                held += len(rows)
                if held >= CHUNK:
                    yield from close(parts)
                    parts, held = [], 0
        if parts:
            yield from close(parts)

    return run


def _group(batches):
    """Flags the windows of a slice that a smaller document has too; passes on runs by document."""

    def close(rows):
        if rows["slice"][0].as_py() < 0:
            found = (_joined(rows["uids"], "<i8").tolist(), _joined(rows["docs"], "<i8").tolist(),
                     rows["places"].to_pylist())
        else:
            places = _joined(rows["places"], "<u4").reshape(-1, 2).astype(np.int64)
            uid, doc = _joined(rows["uids"], "<i8"), _joined(rows["docs"], "<i8")
            first, count = places[:, 0], places[:, 1]
            run = np.repeat(np.arange(len(first)), count)
            place = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(run))
            at, n = _spans(_flag(_joined(rows["marks"], "<u8"), _joined(rows["tails"], "<u4"), doc[run]), run)
            found = _by_document(uid[run[at]], doc[run[at]], place[at], n)
        if found[0]:
            table = pa.Table.from_pydict(dict(zip(_RUNS.names, found)), _RUNS)
            yield from table.to_batches(max_chunksize=4096)

    yield from _per_slice(batches, close)


def _remove(window: int):
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
                        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))])

    def run(batches):
        for batch in batches:
            out = _empty(schema)
            columns = [batch.column(c).to_pylist() for c in ("doc", "text", "runs")]
            for doc, text, runs in zip(*columns):
                words, spans = text.split(), []
                kept = words
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    for other, data in ((r["doc"], r["runs"]) for r in runs):
                        if other == doc:
                            for a, n in np.frombuffer(data, "<u4").reshape(-1, 2).tolist():
                                change[a] += 1
                                change[a + n - 1 + window] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    kept = list(compress(words, ~gone))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                    spans = [{"start": a, "words": b - a} for a, b in zip(edges[::2], edges[1::2])]
                for name, x in zip(schema.names, (doc, len(words), len(words) - len(kept), b" ".join(kept), spans)):
                    out[name].append(x)
            yield from pa.Table.from_pydict(out, schema).to_batches()

    return run


def remove_repeats(df: DataFrame, text: str = "text", id: str = "doc_id", window: int = 50) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_text (kept words, joined by a space), removed (start and words of
    each stretch).

    A word goes if a window of ``window`` words over it, taken from the input, also starts in a document with a smaller id.
    Null texts have no words. A null id is larger than all others and null ids are not compared with each other; rows with
    one id are one document for this comparison, so copies under one id stay. Rows that repeat id and text are searched once a
    task and cost no more than others. An empty table gives an empty result.
    """
    spark = df.sparkSession
    short_batches(spark)
    largest = F.lit(2**63 - 1)
    docs = df.select(F.coalesce(F.col(f"`{id}`").cast("long"), largest).alias("doc"),
                     text_bytes(F.col(f"`{text}`")).alias("text"))
    docs = docs.select(F.xxhash64("doc", "text").alias("uid"), "doc", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size // WORD_BYTES
    anchors = max(LEAST_SLICES, -(-words // (PER_SLICE * max(1, window // 4))))
    exact = max(LEAST_SLICES, -(-words // PER_SLICE))

    def dealt(frame):
        return frame.repartition("slice").sortWithinPartitions("slice")

    entries = SPARE * words // (max(1, window // 4) * anchors)
    width = 1 << min(CELL_BITS, max(8, entries.bit_length()))  # of a slice
    sketch = docs.select("uid", "text").mapInArrow(
        _sketch(window, anchors, width), "slice long, cells binary, uids binary, firsts binary, counts binary")
    chosen = dealt(sketch).mapInArrow(_estimate(width), "uid long, runs binary") \
        .groupBy("uid").agg(F.collect_list("runs").alias("runs"))  # no more than the windows of a document
    windows = docs.join(chosen, "uid").select("uid", "doc", "text", "runs").mapInArrow(
        _windows(window, exact), "slice long, marks binary, tails binary, uids binary, docs binary, places binary")
    flagged = dealt(windows).mapInArrow(_group, "uid long, doc long, runs binary") \
        .groupBy("uid").agg(F.collect_list(F.struct("doc", "runs")).alias("runs"))
    found = docs.join(flagged, "uid", "left").select("doc", "text", "runs").mapInArrow(
        _remove(window), "doc long, n_words long, n_removed long, kept binary, "
                         "removed array<struct<start: long, words: long>>")
    return found.select(F.nullif("doc", largest).alias(id), "n_words", "n_removed",
                        F.col("kept").cast("string").alias("kept_text"), "removed")


@query("op7_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
        FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (k) WHERE m < doc_id),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
""")
def op7(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
