"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Texts become sets of five-word shingles; a text of one to four words is
one shingle. Every distinct shingle weighs the same, as in the verified similarity. Each element is a Poisson
process with its weight as rate, whose arrivals fall on random signature places;
a place keeps its first arrival. All arrivals of a document up to a time bound are
made, and the bound doubles only for documents with an empty place left, so later
arrivals, which cannot win, are never made. Two signatures agree at a place with
the probability Jaccard similarity of their sets, which for equal weights is the Jaccard similarity.

1. Equal texts are folded into one node each, by an aggregate on a digest.
2. Bands of the signature that several nodes share give groups, split into chunks
   of bounded size. In a chunk, nodes are held against leaders only, and the links
   kept are a spanning forest, never all pairs.
3. Components of these links are dealt to tasks, with whole shingle sets, and any pair not
   yet connected whose signatures agree enough is verified: the set Jaccard similarity must reach the
   threshold. Components beyond the bound are split, and their most linked nodes go to each part.
4. What that leaves uncompared, pairs of a band in different chunks or parts and not in one class yet,
   is asked for: in a band the nodes outside its largest class are held against all its nodes, block by block,
   and pairs that agree enough get both shingle sets by a join and are verified alike. First each asks one block
   for its nearest, then all blocks, and at last, if any of them has more, for all: so what connects soon is not compared
   pair by pair, and no pair is left out.
5. Components of the verified links are the classes.

The class id is the least key in the class. Keys are whole numbers. Null and empty texts have no shingles and
count as copies of each other. Rows that share a key share a class. A row without a key has the class of the rows with the
same text, and none (null) if no row with that text has a key. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.graph import components

from .hashing import U, grams, mix, words
from .runtime import buffers, join_hot, join_small, materialise, slices, small_batches

#: Words of a shingle, similarity, and signature places as bands of rows.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
PLACES = BANDS * ROWS
#: Agreement of signatures that links a node to leaders, and that lets a pair be verified.
LINK, VERIFY = 0.4, 0.58
#: A follower so near to its leader that whatever agrees with it by VERIFY agrees with the leader by LINK.
NEAR = LINK + 1 - VERIFY
#: Nodes of a chunk, nodes whose ids are broadcast at most, hubs of a split component, bytes of text handled at once.
CHUNK, BROADCAST, HUBS, BYTES = 4096, 500_000, 16, 1 << 20
#: Shingles that a task holds for one part of a component, as expected.
ELEMENTS = 1 << 22
#: Rounds of asking: whether a node asks one block or all, and for how many pairs in each.
ASK = ((True, 4), (False, 32), (False, None))


def shingles(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct shingle, in order; fewer than 65,536 rows at once."""
    _, _, h, row = words(data, at)
    g, r = grams(h, row, n)
    size = np.bincount(row, minlength=len(at) - 1)[row] if len(row) else row
    parts = [(g, r)] + [grams(h[size == k], row[size == k], k) for k in range(1, n)]
    keys = np.concatenate([(r.astype(U) << U(48)) | (g >> U(16)) for g, r in parts])
    found = np.unique(keys)
    return (found >> U(48)).astype(np.int64), found & U((1 << 48) - 1)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """ProbMinHash signatures (n x places) of 32-bit values; rows without elements are zero."""
    first = np.full(n * places, np.inf)
    owner = np.zeros(n * places, np.uint32)
    total = np.bincount(row, weight, minlength=n)
    bound = np.where(total > 0, places * (np.log(places) + 1.5) / np.maximum(total, 1e-300), 0.0)
    seed = mix(element * U(0x9FB21C651E98DF25) + U(1))
    mark = (mix(seed) >> U(32)).astype(np.uint32)

    def gap(k: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(seed[k] + step * U(0xA0761D6478BD642F))
        # 44 bits make the exponential gap, 20 others the place.
        return -np.log(((x >> U(20)).astype(np.float64) + 0.5) * 2.0**-44) / weight[k], ((x & U((1 << 20) - 1)) * U(places) >> U(20)).astype(np.int64)

    left = np.arange(len(element))
    step = np.ones(len(element), U)
    time, place = gap(left, step)
    while len(left):
        now = time[left] < bound[row[left]]
        act = left[now]
        while len(act):
            slot = row[act] * places + place[act]
            t = time[act]
            np.minimum.at(first, slot, t)
            win = first[slot] == t
            owner[slot[win]] = mark[act[win]]
            step[act] += U(1)
            dt, place[act] = gap(act, step[act])
            time[act] = t + dt
            act = act[time[act] < bound[row[act]]]
        short = np.isinf(first).reshape(n, places).any(axis=1) & (total > 0)
        bound[short] *= 2
        left = left[short[row[left]]]
    return owner.reshape(n, places)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15), (len(signature), BANDS)).copy()
    s = signature.reshape(-1, BANDS, ROWS).astype(U)
    for k in range(ROWS):
        x = mix(x * U(0xD6E8FEB86659FD93) + s[:, :, k])
    return x.view(np.int64)


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, digest of the text, keys of the bands (none without words), signature and number of shingles of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            bands: list = [[]] * b.num_rows
            signed = [b""] * b.num_rows
            size = np.zeros(b.num_rows, np.int64)
            for i, j in slices(at, BYTES):
                row, element = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])
                s = signatures(row, element, np.ones(len(row)), j - i)
                size[i:j] = np.bincount(row, minlength=j - i)
                keys = band_keys(s)
                for k in np.unique(row):
                    bands[i + k], signed[i + k] = keys[k], s[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(signed, pa.binary()), pa.array(size)], ["key", "digest", "bands", "signature", "size"])

    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", F.md5("text")).mapInArrow(run, "key long, digest string, bands array<long>, signature binary, size long")


def grouped(rows: Iterator[pa.RecordBatch], by: list[str], work: Callable[[pa.Table], list[tuple]], names: pa.Schema, many: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Call work on whole groups of rows sorted by `by`, several groups at a time; the last group waits for the next batch."""
    rest: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        out = work(t)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), names, strict=True)], schema=names)

    def last(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b.column(b.schema.get_field_index(c))[k].as_py() for c in by)

    held = 0
    for b in rows:
        if not b.num_rows:
            continue
        rest.append(b)
        held += b.num_rows
        if held < many:
            continue
        end = last(b, b.num_rows - 1)
        t = pa.Table.from_batches(rest).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for c, v in zip(by, end, strict=True):
            same &= t.column(c).to_numpy() == v
        cut = int(np.argmax(same))
        if cut:
            yield from flush(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks().to_batches()
        held = t.num_rows - cut if cut else 0
    if rest:
        yield from flush(pa.Table.from_batches(rest).combine_chunks())


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    data, _ = buffers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return data.view(np.uint32).reshape(-1, PLACES)


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def lead(node: np.ndarray, signature: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over a group that joins all that agree by VERIFY."""
    forest = Forest(len(node))
    links, leaders = [], []
    for i in range(len(node)):
        if leaders:
            alike = (signature[leaders] == signature[i]).mean(axis=1)
            for k in np.flatnonzero(alike >= LINK):
                if node[leaders[k]] != node[i] and forest.join(leaders[k], i):
                    links.append((leaders[k], i))
            if alike.max() >= NEAR:
                continue
        leaders.append(i)
    return links


def candidates(bands: DataFrame) -> DataFrame:
    """Links (a, b) that keep connected what shares a chunk of a band and agrees; bands has band, chunk, node, signature."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(t: pa.Table) -> list[tuple]:
        band, chunk, node = (t.column(c).to_numpy() for c in ("band", "chunk", "node"))
        signature = matrix(t.column("signature"))
        new = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1])))
        ends = np.append(new[1:], len(band))
        pair = ends - new == 2
        i = new[pair]
        near = ((signature[i] == signature[i + 1]).mean(axis=1) >= LINK) & (node[i] != node[i + 1])
        out = [(int(a), int(b)) for a, b in zip(node[i[near]], node[i[near] + 1], strict=True)]
        for s, e in zip(new[~pair], ends[~pair], strict=True):
            out += [(int(node[s + a]), int(node[s + b])) for a, b in lead(node[s:e], signature[s:e])]
        return out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(rows, ["band", "chunk"], work, names)

    return bands.repartition("band", "chunk").sortWithinPartitions("band", "chunk", "node").mapInArrow(run, "a long, b long").distinct()


def near(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether the Jaccard similarity of two sets of distinct values reaches the threshold."""
    if min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similar * (len(a) + len(b) - both) - 1e-9


def verified_part(node: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links of verified pairs that span the classes of some nodes."""
    n = len(node)
    sizes = np.array([len(x) for x in sets])
    ends = np.append(0, np.cumsum(sizes))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), bool)
    own, out = np.arange(n), []
    for i in range(1, n):
        other = np.flatnonzero((own[:i] != own[i]) & (node[:i] != node[i]))
        # Pairs whose sizes alone keep them below the threshold are none.
        other = other[np.minimum(sizes[other], sizes[i]) >= similar * np.maximum(sizes[other], sizes[i])]
        other = other[(signature[other] == signature[i]).mean(axis=1) >= VERIFY]
        if not len(other):
            continue
        mine[place[ends[i] : ends[i + 1]]] = True
        hits = mine[np.concatenate([place[ends[k] : ends[k + 1]] for k in other])]
        mine[place[ends[i] : ends[i + 1]]] = False
        both = np.add.reduceat(hits, np.append(0, np.cumsum(sizes[other])[:-1]), dtype=np.int64)
        for k in other[both >= similar * (sizes[other] + sizes[i] - both) - 1e-9].tolist():
            if own[k] != own[i]:
                out.append((int(node[k]), int(node[i])))
                own[own == own[i]] = own[k]
    return out


def verified(parts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of verified pairs that span each part's classes; parts has root, part, node, elements, signature."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(t: pa.Table) -> list[tuple]:
        root, part, node = (t.column(c).to_numpy() for c in ("root", "part", "node"))
        signature = matrix(t.column("signature"))
        data, at = buffers(t.column("elements").combine_chunks())
        sets = [data[at[k] : at[k + 1]].view(np.uint64) for k in range(len(node))]
        new = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (part[1:] != part[:-1])))
        ends = np.append(new[1:], len(root))
        out: list[tuple] = []
        for s, e in zip(new, ends, strict=True):
            out += verified_part(node[s:e], signature[s:e], sets[s:e], similar)
        return out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(rows, ["root", "part"], work, names, 1000)

    return parts.repartition("root", "part").sortWithinPartitions("root", "part", "node").mapInArrow(run, "a long, b long")


def across(told: DataFrame, one: bool, most: int | None) -> DataFrame:
    """(a, b, more): pairs that share a band, agree enough to be verified, and are neither in one class nor in one part.

    told has band, node, signature, root and part of the component, and class. In each band the nodes outside its largest
    class ask all others, `most` pairs in a block at most; more says that a node has others, or has not asked all blocks.
    """
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def work(t: pa.Table) -> list[tuple]:
        band, of, by, asks, blocks, node, root, part, own = (t.column(c).to_numpy() for c in ("band", "of", "by", "asks", "blocks", "node", "root", "part", "class"))
        signature = matrix(t.column("signature"))
        new = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (of[1:] != of[:-1]) | (by[1:] != by[:-1])))
        out: list[tuple] = []
        for s, e in zip(new, np.append(new[1:], len(band)), strict=True):
            # Rows that are asked stand before those that ask.
            cut = s + int(np.searchsorted(asks[s:e], 1))
            for i in range(cut, e):
                j = s + np.flatnonzero((own[s:cut] != own[i]) & ((root[s:cut] != root[i]) | (part[s:cut] != part[i])))
                alike = (signature[j] == signature[i]).mean(axis=1)
                j, alike = j[alike >= VERIFY], alike[alike >= VERIFY]
                more = one and blocks[i] > 1
                if most is not None and len(j) > most:
                    j, more = j[np.argsort(-alike, kind="stable")[:most]], True
                out += [(min(int(node[i]), x), max(int(node[i]), x), bool(more)) for x in node[j].tolist()]
        return out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(rows, ["band", "of", "by"], work, names)

    sizes = told.groupBy("band", "class").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    blocks = [F.ceil(n / CHUNK).cast("int") for n in (F.col("n"), F.col("n") - F.col("most.n"))]
    rows = told.join(sizes.select("band", F.col("most.class").alias("largest"), blocks[0].alias("blocks"), blocks[1].alias("others")), "band")
    place = F.xxhash64("node", "band")
    asked = rows.withColumns({"of": F.pmod(place, "blocks").cast("int"), "by": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "asks": F.lit(0)})
    asking = rows.where("class <> largest").withColumns({"by": F.pmod(place, "others").cast("int"), "of": F.pmod(F.xxhash64("band", "node"), "blocks").cast("int") if one else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(1)})
    every = asked.unionByName(asking).select("band", "of", "by", "asks", "blocks", "node", "signature", "root", "part", "class")
    found = every.repartition("band", "of", "by").sortWithinPartitions("band", "of", "by", "asks", "node").mapInArrow(run, "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def proved_pairs(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar; sets has node and elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, at), (y, to) = buffers(b.column(2)), buffers(b.column(3))
            ok = [near(x[at[k] : at[k + 1]].view(U), y[to[k] : to[k + 1]].view(U), similar) for k in range(b.num_rows)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sets = sets.select("node", "elements")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Node, sorted shingle hashes and signature of each row that has a word."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            sets, signed = [b""] * b.num_rows, [b""] * b.num_rows
            for i, j in slices(at, BYTES):
                row, element = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])
                s = signatures(row, element, np.ones(len(row)), j - i)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    sets[i + k], signed[i + k] = element[cut[k] : cut[k + 1]].tobytes(), s[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(signed, pa.binary())], ["node", "elements", "signature"])

    return docs.select(F.col(key).cast("long").alias("node"), text).mapInArrow(run, "node long, elements binary, signature binary")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The key and class_id of each row: the least key of those its text is a copy or, through links, a near copy of."""
    signed = materialise(sign(docs, key, text))
    copies = materialise(signed.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("n")))
    # By key too, so that a large group of copies is not one key of the join.
    nodes = signed.dropDuplicates(["digest", "key"]).join(copies.select("digest", F.col("node").alias("key")), ["digest", "key"])
    nodes = materialise(nodes.select(F.col("key").alias("node"), "bands", "signature", "size"))
    keys = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialise(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = keys.join(shared, "band").select("band", "node", chunks.alias("chunks"), F.pmod(F.xxhash64("node", "band"), chunks).cast("int").alias("chunk"))
    links = materialise(candidates(members.join(nodes.select("node", "signature"), "node")))
    coarse = components(links)
    coarse = materialise(coarse.unionAll(coarse.select(F.col("root").alias("node"), "root")).distinct())
    sizes = coarse.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    split = F.ceil(F.greatest(F.col("n") / (2 * CHUNK), F.col("size") / ELEMENTS)).cast("int")
    place = materialise(coarse.join(sizes, "root").select("node", "root", F.pmod(F.xxhash64("node"), split).cast("int").alias("part"), split.alias("parts")))
    # The most linked nodes of a component in several parts go to each of them.
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    large = place.where("parts > 1")
    # One hub for each hash class of nodes: a maximum, so nothing is gathered by component.
    hubs = large.join(degree, "node").groupBy("root", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("salt")).agg(F.max("parts").alias("parts"), F.max_by("node", "degree").alias("node"))
    dealt = place.select("node", "root", "part").unionAll(hubs.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))).distinct()

    def sets(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("node").alias(key)).distinct()
        return elements(join_small(docs.select(key, text), wanted, key, "left_semi", BROADCAST), key, text)

    final = components(verified(sets(coarse).join(dealt, "node"), similar))
    if not (large.isEmpty() and shared.where(F.col("n") > CHUNK).isEmpty()):
        # A node of no component is one of its own.
        told = members.join(place, "node", "left").where("chunks > 1 or parts > 1").join(nodes.select("node", "signature"), "node")
        told = materialise(told.select("band", "node", "signature", F.coalesce("root", "node").alias("root"), F.coalesce("part", F.lit(0)).alias("part")))
        tried = None
        for one, most in ASK:
            now = told.join(final.select("node", F.col("root").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
            found = across(now, one, most)
            found = materialise(found if tried is None else found.join(tried, ["a", "b"], "left_anti"))
            more = materialise(proved_pairs(found.select("a", "b"), materialise(sets(found.select(F.explode(F.array("a", "b")).alias("node")))), similar))
            if not more.isEmpty():
                final = components(final.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
            if found.where("more").isEmpty():
                break
            tried = found.select("a", "b") if tried is None else tried.unionAll(found.select("a", "b"))
    least = copies.where("n > 1").select("digest", "n", F.coalesce("node", F.lit(None).cast("long")).alias("node"))
    member = join_hot(signed.select("key", "digest"), least, "digest").select("key", F.when(F.col("n") > 1, F.col("node")).otherwise(F.col("key")).alias("node"))
    return member.join(final, "node", "left").select(F.col("key").cast(docs.schema[key].dataType).alias(key), F.coalesce("root", "node").cast(docs.schema[key].dataType).alias("class_id"))
