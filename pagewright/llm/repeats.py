"""Removal of byte strings of threshold length that occur twice or more, by a depth-limited radix sort of suffixes.

Only suffixes that can matter are sorted. The first, most significant digit of
a suffix is the gram in it with the least hash among those that start in its
first half: any two equal windows pick the same gram at the same place. Grams that
occur once are dropped with all their suffixes. The windows that hold a gram differ in their offset
from it, and further digits are the bytes that follow on either side of the gram. A pass halves a range of
offsets and orders each half by the bytes that all its windows have beyond the last pass; a group of
one is finished, as are contexts that are equal throughout the range. At one offset and full depth,
no deeper than the threshold, groups of two or more are exactly the repeated windows. The bytes
they cover go; matches never cross texts, and all is judged on the input.

No group is held whole. A map task sees which of its own grams and contexts repeat: these are known, and
of each only one goes on to meet those of other tasks, so a key has at most one row for each flush of a task.
Groups of contexts up to a bound are ordered within a task; of larger ones both halves of the range become
keys of their own and are dealt again, until they are small or at full depth.

Equal texts are folded first, by an aggregate: a text that occurs twice is covered wholly if it
reaches the threshold, and one copy stands for all against the others. Rows of a digest are told apart
by its 128 bits; grams and digits are compared byte by byte after their hashes, but
for groups that are still large at full depth, whose windows are told apart by 64 bits. Null texts count as empty;
texts below the threshold lose nothing but count nowhere either. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mix, powers, prefix
from .runtime import buffers, join_small, materialise, slices, small_batches

#: Bytes of a window, of a gram, around a gram, and of a context.
WIDTH = 200
GRAM = 100
SIDE = WIDTH - GRAM
SPAN = GRAM + 2 * SIDE
#: Bytes of text handled at once, bits of a place in them, grams and contexts of a flush, texts with copies that are broadcast at most.
CHUNK, PLACE, FLUSH, ROWS, BROADCAST = 1 << 20, 23, 1 << 20, 20_000, 500_000
#: Rows of a group that a task orders at least, and the part of all rows beyond which a group is dealt again, so that as many keys are broadcast at most.
GROUP, PART = 8192, 100_000
CONTEXT = "key long, low int, high int, rid binary, at int, before int, after int, around binary, start int, end int"


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that some window within one row picks; fewer than 2**PLACE bytes."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    sums = prefix(data)
    _, inv = powers(n + 1)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1])
    low = U((1 << PLACE) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=U)
    # The least of SIDE + 1 values that follow each other, by doubling.
    size, want = 1, SIDE + 1
    while 2 * size <= want:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    if size < want:
        v = np.minimum(v[: len(v) - (want - size)], v[want - size :])
    inside = np.ones(len(v), bool)
    for b in at[1:-1].tolist():
        inside[max(0, b - WIDTH + 1) : b] = False
    v = v[inside]
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, U)
    place = (v[np.append(True, v[1:] != v[:-1])] & low).astype(np.int64)
    return place, h[place]


def find_anchors(rows: DataFrame) -> DataFrame:
    """(hash, part, rid, at, known) of the picked grams of each text; rows has rid and text, in an order that does not change.

    Grams that occur twice or more in a flush are known to repeat; each of their rows is a part of its own, and a
    row without rid stands for all in part 0, where the others wait to be counted.
    """
    names = ["hash", "part", "rid", "at", "known"]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        at = np.concatenate([x[2] for x in held])
        rid = pa.concat_arrays([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = np.append(False, same) | np.append(same, False)
        known = np.zeros(len(h), bool)
        known[order[many]] = True
        told = h[order[many & ~np.append(False, same)]]
        part = np.where(known, np.cumsum(known), 0).astype(np.int32)
        m = len(told)
        columns = [
            pa.array(np.concatenate([h, told]).view(np.int64)), pa.array(np.concatenate([part, np.zeros(m, np.int32)])),
            pa.concat_arrays([rid, pa.nulls(m, pa.binary())]), pa.array(np.concatenate([at, np.zeros(m, np.int32)])),
            pa.array(np.concatenate([known, np.ones(m, bool)])),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            rid = b.column(0).cast(pa.binary())
            data, at = buffers(b.column(1))
            for i, j in slices(at, CHUNK):
                # A text too long for the place bits is read in parts that overlap by a window.
                step = (1 << PLACE) - WIDTH
                for s in range(int(at[i]), max(int(at[i]) + 1, int(at[j]) - WIDTH + 1), step):
                    e = min(int(at[j]), s + step + WIDTH - 1)
                    own = at[i : j + 1] - s if s == at[i] and e == at[j] else np.array([0, e - s])
                    place, h = anchors(data[s:e], own)
                    if len(place):
                        row = np.searchsorted(at, place + s, side="right") - 1
                        held.append((h, rid.take(pa.array(row)), (place + s - at[row]).astype(np.int32)))
                        n += len(place)
                    if n >= FLUSH:
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)

    return rows.select("rid", "text").mapInArrow(run, "hash long, part int, rid binary, at int, known boolean")


def binaries(data: np.ndarray, width: int) -> pa.Array:
    """A binary column of rows of one width."""
    n = len(data) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def digest(digits: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    n, width = digits.shape
    words = -(-width // 8)
    padded = np.zeros((n, words * 8), np.uint8)
    padded[:, :width] = digits
    out = np.zeros(n, U) + np.asarray(seed).astype(U) * U(0x9FB21C651E98DF25) + U(width + 1)
    for k, word in enumerate(padded.view(U).T):
        out = mix(out * U(0xD6E8FEB86659FD93) + word + U(k))
    return out


def refined(group: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the rows' groups after a pass over more digits: equal where group and digits are."""
    h = digest(digits, group)
    order = np.argsort(h, kind="stable")
    a, b = order[1:], order[:-1]
    near = h[a] == h[b]
    same = near.copy()
    same[near] = (group[a[near]] == group[b[near]]) & (digits[a[near]] == digits[b[near]]).all(axis=1)
    out = np.empty(len(group), np.int64)
    if (same != near).any():
        # Different digits with one hash: order the bytes themselves.
        whole = np.ascontiguousarray(np.concatenate([group.astype(np.int64)[:, None].view(np.uint8), digits], axis=1))
        out[:] = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_inverse=True)[1]
    else:
        out[order] = np.cumsum(np.append(0, ~same))[: len(out)] if len(out) else out
    return out


def within(around: np.ndarray, before: np.ndarray, after: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes that windows at offsets low to high can have, zero beyond the text, and how many there are on each side."""
    left, right = np.minimum(before, high), np.minimum(after, SIDE - low)
    wide = around[:, SIDE - high : SPAN - low].copy()
    place = np.arange(SIDE - high, SPAN - low)
    outside = (place < SIDE - left[:, None]) | (place >= SIDE + GRAM + right[:, None])
    wide[outside] = 0
    return wide, left, right


def folded(group: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, low: int, high: int) -> np.ndarray:
    """Numbers of the groups of contexts that are equal throughout a range of offsets."""
    wide, left, right = within(around, before, after, low, high)
    return refined(group, np.concatenate([wide, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1))


def reached(group: np.ndarray, before: np.ndarray, after: np.ndarray, around: np.ndarray, low: int = 0, high: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """For each context of whole groups, bytes before and after its gram that repeated windows cover; -1 before where there are none."""
    n = len(group)
    most, least = np.full(n, -1), np.full(n, SIDE + 1)
    start = np.flatnonzero((before >= low) & (after >= SIDE - high))
    first = refined(group[start], around[start, SIDE - low : SPAN - high])
    passes = [(low, high, start, first, np.ones(len(start), bool))]
    while passes:
        low, high, row, own, wanted = passes.pop()
        # Groups of one are finished.
        some = np.bincount(own, minlength=1)[own] > 1
        row, own, wanted = row[some], own[some], wanted[some]
        if not len(row):
            continue
        # Contexts equal throughout the range are repeated throughout; the first stands for them from here on.
        alike = folded(own, around[row], before[row], after[row], low, high)
        many = np.bincount(alike)[alike] > 1
        hit = row[many & wanted]
        most[hit] = np.maximum(most[hit], np.minimum(before[hit], high))
        least[hit] = np.minimum(least[hit], np.maximum(SIDE - after[hit], low))
        if low == high:
            continue
        _, first = np.unique(alike, return_index=True)
        row, own, wanted = row[first], own[first], (wanted & ~many)[first]
        middle = (low + high) // 2
        for a, b, digits in ((low, middle, slice(SPAN - high, SPAN - middle)), (middle + 1, high, slice(SIDE - middle - 1, SIDE - low))):
            fits = (before[row] >= a) & (after[row] >= SIDE - b)
            live = np.zeros(int(own.max()) + 1, bool)
            live[own[fits & wanted]] = True
            fits &= live[own]
            if fits.any():
                passes.append((a, b, row[fits], refined(own[fits], around[row[fits], digits]), wanted[fits]))
    return most, SIDE - least


def batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """n rows of CONTEXT, null in columns that are not given."""
    kind = {"key": pa.int64(), "rid": pa.binary(), "around": pa.binary()}
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(kind.get(c, pa.int32())) if c in columns else pa.nulls(n, kind.get(c, pa.int32())) for c in names], names)


def runs(rid: pa.Array, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of CONTEXT that only tell of repeated bytes; a row without rid stands for contexts that are told elsewhere."""
    asked = np.flatnonzero(rid.is_valid().to_numpy(zero_copy_only=False))
    return batch(len(asked), {"rid": rid.take(pa.array(asked)), "start": pa.array(start[asked]), "end": pa.array(end[asked])})


def sent(key: np.ndarray, low: int, high: int, rid: pa.Array, at: np.ndarray, before: np.ndarray, after: np.ndarray, around: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of contexts that a flush knows to repeat throughout the range, and one context of each kind.

    A context that stands for several has no rid, as nothing is asked about it any more.
    """
    wide, left, right = within(around, before, after, low, high)
    kind = refined(np.zeros(len(at), np.int64), np.concatenate([wide, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1))
    known = np.bincount(kind)[kind] > 1
    _, first = np.unique(kind, return_index=True)
    whole = np.zeros((len(first), SPAN), np.uint8)
    whole[:, SIDE - high : SPAN - low] = wide[first]
    ends = {"low": np.full(len(first), low), "high": np.full(len(first), high), "at": at[first], "before": left[first], "after": right[first], "key": key[first].view(np.int64)}
    owner = pc.if_else(pa.array(known[first]), pa.scalar(None, pa.binary()), rid.take(pa.array(first)))
    yield batch(len(first), {c: pa.array(x) for c, x in ends.items()} | {"rid": owner, "around": binaries(whole.ravel(), SPAN)})
    told = np.flatnonzero(known)
    yield runs(rid.take(pa.array(told)), at[told] - left[told], at[told] + GRAM + right[told])


def contexts(rows: DataFrame) -> DataFrame:
    """Rows of CONTEXT for each repeated gram; rows has rid, text and the array `grams`, in an order that does not change."""
    names = rows.columns
    rid_at, text_at, grams_at = (names.index(c) for c in ("rid", "text", "grams"))
    reach = np.arange(-SIDE, GRAM + SIDE)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, at, before, after, around = (np.concatenate([x[k] for x in held]) for k in range(5))
        return sent(key.view(U), 0, SIDE, pa.concat_arrays([x[5] for x in held]), at, before, after, around)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            rid = b.column(rid_at).cast(pa.binary())
            data, at = buffers(b.column(text_at))
            grams = b.column(grams_at)
            ends = grams.offsets.to_numpy().astype(np.int64)
            flat = grams.values
            place, h = flat.field("at").to_numpy().astype(np.int64), flat.field("hash").to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            place, h = place[ends[0] : ends[-1]], h[ends[0] : ends[-1]]
            for s in range(0, len(place), ROWS):
                p, r = place[s : s + ROWS], row[s : s + ROWS]
                before = np.minimum(p, SIDE)
                after = np.minimum(at[r + 1] - at[r] - p - GRAM, SIDE)
                where = np.clip((p + at[r])[:, None] + reach, 0, len(data) - 1)
                held.append((h[s : s + ROWS], p, before, after, data[where], rid.take(pa.array(r))))
                n += len(p)
                if n >= ROWS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, CONTEXT)


def taken(b: pa.RecordBatch | pa.Table) -> tuple:
    """low, high, rid, at, before, after and around of rows of CONTEXT."""
    if isinstance(b, pa.Table):
        b = b.combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in b.columns]
    else:
        columns = b.columns
    own = dict(zip(b.schema.names, columns, strict=True))
    data, _ = buffers(own["around"])
    low, high, at, before, after = (own[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high", "at", "before", "after"))
    return low, high, own["rid"].cast(pa.binary()), at, before, after, data.reshape(-1, SPAN)


def deeper(rows: DataFrame) -> DataFrame:
    """Rows of CONTEXT for both halves of each row's range of offsets, or spans where the range is one offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high, rid, at, before, after, around = taken(b)
            for a, z in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
                own = np.flatnonzero((low == a) & (high == z))
                if a == z:
                    yield runs(rid.take(pa.array(own)), at[own] - a, at[own] + WIDTH - a)
                    continue
                middle = (a + z) // 2
                for i, j in ((a, middle), (middle + 1, z)):
                    k = own[(before[own] >= i) & (after[own] >= SIDE - j)]
                    if len(k):
                        key = digest(around[k, SIDE - i : SPAN - j], 1 + i * WIDTH + j)
                        yield from sent(key, i, j, rid.take(pa.array(k)), at[k], before[k], after[k], around[k])

    return rows.select(*(x.split()[0] for x in CONTEXT.split(", "))).mapInArrow(run, CONTEXT)


def solved(rows: DataFrame) -> DataFrame:
    """(rid, start, end) of the runs of bytes that repeated windows around each gram cover; rows are contexts whose groups are not large."""

    def work(t: pa.Table) -> pa.RecordBatch:
        low, high, rid, at, before, after, around = taken(t)
        key = t.column("key").to_numpy()
        most, rest = np.full(len(at), -1), np.zeros(len(at), np.int64)
        for a, z in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
            own = np.flatnonzero((low == a) & (high == z))
            most[own], rest[own] = reached(key[own], before[own], after[own], around[own], a, z)
        hit = np.flatnonzero((most >= 0) & ~rid.is_null().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([rid.take(pa.array(hit)), pa.array((at[hit] - most[hit]).astype(np.int32)), pa.array((at[hit] + GRAM + rest[hit]).astype(np.int32))], ["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("key").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield work(t.slice(0, cut))
            held, n = t.slice(cut).to_batches(), (t.num_rows - cut if cut else 0)
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid binary, start int, end int")


def repeated(found: DataFrame, least: int = GROUP) -> DataFrame:
    """(rid, start, end) of all runs; found has rows of CONTEXT. A group beyond the bound goes on to further digits."""
    spans = []
    while True:
        found = materialise(found)
        spans.append(found.where("start is not null").select("rid", "start", "end"))
        rows = found.where("around is not null")
        bound = max(least, rows.count() // PART)
        # At most PART keys, as each has more than a PART-th of the rows.
        large = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("key"))
        if large.isEmpty():
            spans.append(solved(rows))
            break
        spans.append(solved(rows.join(F.broadcast(large), "key", "left_anti")))
        found = deeper(rows.join(F.broadcast(large), "key", "left_semi"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    return out


def _rest(docs: DataFrame, key: str, text: str, keep: list[str], with_text: bool) -> DataFrame:
    """Columns k, c0, c1, ... of the columns to keep, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for."""
    small_batches(docs.sparkSession)
    own = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("rid", F.unhex(F.md5("text")))
    copies = materialise(rows.groupBy("rid").agg(F.count("*").alias("n"), F.min("k").alias("least")).where("n > 1").select("rid", "least", F.lit(True).alias("copied")))
    rows = join_small(rows, copies, "rid", "left", BROADCAST).withColumn("copied", F.coalesce("copied", F.lit(False)))
    long = F.octet_length("text") >= WIDTH
    # One row for each long text, however often it occurs; the order within a task must not change when it runs again.
    single = rows.where(~F.col("copied") & long).drop("least")
    stand = rows.where(F.col("copied") & long & F.col("k").eqNullSafe(F.col("least"))).drop("least").dropDuplicates(["rid"]).sortWithinPartitions("rid")
    base = single.unionByName(stand)
    # Each gram's rows are counted where they are sorted, in memory that can spill.
    counted = find_anchors(base).withColumn("n", F.expr("count(*) over (partition by hash, part)"))
    grams = counted.where("rid is not null and (known or n > 1)").groupBy("rid").agg(F.collect_list(F.struct("at", "hash")).alias("grams"))
    found = contexts(base.join(grams, "rid").withColumn("grams", F.array_sort("grams")).sortWithinPartitions("rid"))
    spans = repeated(found).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = base.join(spans, "rid", "left").select("k", *own, "text", "copied", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[: 1 + len(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([not x for x in b.column("copied").to_pylist()], pa.bool_()))
            data, at = buffers(b.column("text"))
            lists = b.column("spans")
            ends = lists.offsets.to_numpy()
            start, end = (lists.values.field(c).to_numpy() for c in ("start", "end"))
            out: list[tuple] = []
            for i in range(b.num_rows):
                whole = data[at[i] : at[i + 1]]
                n = len(whole)
                s, e = start[ends[i] : ends[i + 1]], end[ends[i] : ends[i + 1]]
                if not len(s):
                    rest, removed, runs = whole.tobytes(), 0, 0
                else:
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > e[:-1])
                    first = s[new]
                    last = e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    cuts = np.concatenate([[0], np.stack([first, last], 1).ravel(), [n]])
                    parts = [whole[cuts[k] : cuts[k + 1]].tobytes() for k in range(0, len(cuts), 2)]
                    rest, removed, runs = b"".join(parts), int((last - first).sum()), len(first)
                out.append((n, removed, runs, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "ignore")] if with_text else [])))
            columns = list(zip(*out, strict=True)) or [()] * (4 + with_text)
            kind = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(own)], *(pa.array(c, t) for c, t in zip(columns, kind, strict=False))], [*b.schema.names[: 1 + len(own)], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])])

    done = joined.mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    # Copies and short texts need no span.
    size = F.octet_length("text").cast("long")
    left = F.when(long, F.lit("")).otherwise(F.col("text"))
    others = rows.where(F.col("copied") | ~long).select("k", *own, size.alias("n_bytes"), F.when(long, size).otherwise(0).alias("n_removed"), long.cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), *([left.alias("kept_text")] if with_text else []))
    return done.unionByName(others)


def stripped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes, n_removed, n_spans and kept_sha256 of each row. Other columns are not read."""
    rest = _rest(docs, key, text, [], False)
    return rest.select(F.col("k").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def passed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with all its columns, the repeats gone from the text and the column of its size set anew.

    What remains of a character that a removed run has cut goes too. Null texts become empty.
    """
    keep = [c for c in docs.columns if c not in (key, text)]
    rest = _rest(docs, key, text, keep, True)
    place = {key: F.col("k"), text: F.col("kept_text")} | {c: F.col(f"c{i}") for i, c in enumerate(keep)}
    if size in keep:
        place[size] = F.length("kept_text").cast(docs.schema[size].dataType)
    return rest.select(*(place[c].alias(c) for c in docs.columns))
