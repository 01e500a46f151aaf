"""Groups of records that are the same but for small edits.

Records are compared by their distinct triples of consecutive words. A
record's signature is a row of minima over hashed triples, one per hash
function: two records differ in each component with probability one minus
their similarity. The signature is cut into segments, fewer than the
components that similar records may differ in, so that some segment differs in
at most one component. Of every segment its one-wildcard variants are indexed
(the segment with one component deleted), variants are joined on equality, and
candidates are verified on the triples themselves.

Candidates are first judged by a short sketch of independent minima, which
lets pairs of the required similarity pass but for less than one in a million;
shingles are then made again only for sets that a remaining pair names, found
among all texts by a Bloom filter sized by their number.

Exact copies (equal sets of triples) are one representative from the start.
Variants that many representatives share don't produce all their pairs. Their
members are compared with the first member. Members of a variant that then
still lie in different groups may differ a lot and share only a part that is
common (the chrome of a site): they meet where two of them share one of their
rarest triples, so few that two sets of the required similarity can't do
without (``rare``), an exact filter under which sets that share only what is
common don't meet at all. Only where each record's links are counted do all
members of a group that share a hot variant meet, in blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import cut
from . import slices as S

#: Segments of a signature, and components of a segment.
SEGMENTS, WIDTH = 8, 4
#: Words of a shingle.
WORDS = 3
#: From so many members a variant's members meet their first member before each other.
HOT = 32
#: A variant is looked up as very hot, and kept out of any window, if so many of the sampled sets (one in SAMPLED) have it.
SAMPLED, VERY_HOT = 16, 64


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's words, a hash of each word): runs of letters and digits after NFKC and lower-casing."""
    texts = [unicodedata.normalize("NFKC", t).lower() for t in texts]
    points, offsets = S.code_points(texts)
    kind = S.class_table()[points]
    word = (kind == S.LETTER) | (kind == S.NUMBER)
    head = np.zeros(len(points) + 1, bool)
    head[offsets] = True
    start = np.flatnonzero(word & (head[:-1] | np.concatenate([[True], ~word[:-1]])[: len(word)]))
    end = np.flatnonzero(word & (head[1:] | np.concatenate([~word[1:], [True]])[: len(word)])) + 1
    return np.searchsorted(start, offsets), S.slice_hashes(points, start, end)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's shingles, its distinct hashed shingles in order)."""
    at, hashes = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = S.mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k] + np.uint64(k + 1))
    text = np.searchsorted(at, np.arange(n), side="right") - 1
    whole = np.arange(n) + words <= at[text + 1] if n else np.zeros(0, bool)
    text, mixed = text[whole], mixed[whole]
    order = np.lexsort((mixed, text))
    text, mixed = text[order], mixed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (mixed[1:] != mixed[:-1])
    text, mixed = text[new], mixed[new]
    return np.searchsorted(text, np.arange(len(texts) + 1)), mixed


#: Minima of a sketch, four bits of each, and how many must agree per required similarity (five standard deviations below the mean).
SKETCH = 64


def _hashers(n: int, seed: int = 20250101) -> list[tuple[np.uint64, np.uint64]]:
    r = np.random.default_rng(seed)
    return [(np.uint64(int(a) | 1), np.uint64(int(b))) for a, b in r.integers(1, 2**63, (n, 2))]


def signatures(offsets: np.ndarray, hashed: np.ndarray, segments: int, width: int) -> np.ndarray:
    """A row of minima for each text with at least one shingle."""
    first = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(first), segments * width), np.uint64)
    for k, (a, b) in enumerate(_hashers(segments * width)):
        x = hashed * a + b
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first) if len(first) else 0
    return out


def variants(signature: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The keys of all one-wildcard variants of each signature: segment, place of the wildcard, the other components."""
    rows = len(signature)
    out = np.empty((rows, segments * width), np.uint64)
    mixed = S.mix64(signature + np.arange(segments * width, dtype=np.uint64))
    for s in range(segments):
        part = mixed[:, s * width : (s + 1) * width]
        total = part.sum(axis=1, dtype=np.uint64)
        for k in range(width):
            out[:, s * width + k] = S.mix64(total - part[:, k] + np.uint64((s * width + k + 1) * 0x9E3779B1))
    return out


def sketches(offsets: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A row of SKETCH / 2 bytes for each text with at least one shingle: four bits of each of independent minima."""
    first = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(first), SKETCH // 2), np.uint8)
    for k, (a, b) in enumerate(_hashers(SKETCH, 20250202) if len(first) else ()):
        x = hashed * a + b
        low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first)
        out[:, k // 2] |= ((S.mix64(low) & np.uint64(15)) << np.uint64(4 * (k % 2))).astype(np.uint8)
    return out


def agreeing(least: float) -> int:
    """How many minima of the sketches of two sets agree at least, at the similarity ``least``."""
    p = least + (1 - least) / 16
    return int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5)


def set_ids(offsets: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each text's set of shingles, whether it has any)."""
    full = np.diff(offsets) > 0
    out = np.zeros(len(full), np.uint64)
    if full.any():
        first = offsets[:-1][full]
        out[full] = S.mix64(np.add.reduceat(S.mix64(hashed), first) + np.diff(offsets)[full].astype(np.uint64))
    return out.view(np.int64), full


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in S.portions(batch, "text", 1 << 18):
            yield part, *shingles(["" if t is None else t for t in part.column("text").to_pylist()], words)


#: Most sets that a task remembers, to index copies within its rows once.
SEEN = 1 << 18


def members(df: DataFrame, words: int = WORDS, segments: int = SEGMENTS, width: int = WIDTH) -> DataFrame:
    """(record_id, set_id, n, sketch, text_key, keys) of every row (record_id, text), in one pass over the texts.

    set_id stands for the set of n shingles; it is null for texts of fewer
    words, empty and null texts, which share nothing with any other. keys are
    the one-wildcard variants of the set's signature; of copies in one
    partition the first has them. text_key is Spark's xxhash64 of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, at, hashed in _texts(batches, words):
            ids, full = set_ids(at, hashed)
            new = full.copy()
            for i in np.flatnonzero(full).tolist():
                if (k := int(ids[i])) in seen:
                    new[i] = False
                else:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
            short = iter(sketches(at, hashed))
            drawn = pa.array([next(short).tobytes() if f else None for f in full.tolist()], pa.binary())
            keys = variants(signatures(at, hashed, segments, width)[new[full]], segments, width).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(new)]).astype(np.int32) * (segments * width)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array(ids, mask=~full), pa.array(np.diff(at).astype(np.int32)), drawn, part.column("text_key"), lists], names=["record_id", "set_id", "n", "sketch", "text_key", "keys"])

    return df.select("record_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "record_id string, set_id bigint, n int, sketch binary, text_key bigint, keys array<bigint>")


#: Bits of the filter per wanted text (three are set: one text in a hundred passes unwanted), and most bits of it: 16 MB, for 11 million texts.
#: Beyond it the filter lets more through; what passes unwanted is dropped by a join.
BITS, MOST_BITS = 12, 27


def bloom(wanted: DataFrame) -> np.ndarray:
    """The Bloom filter of the wanted text_keys, sized by their number: words of 64 bits, a power of two of them."""
    n = wanted.count()
    m = min(MOST_BITS, max(10, int(n * BITS).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned("text_key", k).bitwiseAND((1 << m) - 1) for k in (0, 18, 36))))
    word = F.shiftright("at", 6).cast("int").alias("w")
    rows = wanted.select(at.alias("at")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (m - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    x, words = keys.view(np.uint64), bits.view(np.uint64)
    out = np.ones(len(x), bool)
    for k in (0, 18, 36):
        at = (x >> np.uint64(k)) & np.uint64(64 * len(words) - 1)
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def shingle_sets(df: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the wanted (set_id, text_key), each set once.

    Texts don't move for it: where they are read, those whose hash a filter
    knows are cut into shingles again.
    """
    bits = df.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(maybe(bits.value, batch.column("text_key").to_numpy())))
            for _, at, hashed in _texts(iter([some]), words):
                ids, full = set_ids(at, hashed)
                rows = np.flatnonzero(full)
                if len(rows):
                    size = np.diff(at)[rows]
                    flat = hashed[S.flat_ranges(at[rows], size)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), lists], names=["set_id", "shingles"])

    some = df.filter("text is not null").select("text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "set_id bigint, shingles array<bigint>")
    return some.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def drawn_of(sets: DataFrame) -> DataFrame:
    """(set_id, n, sketch, text_key), each set once."""
    return sets.filter("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("text_key").alias("text_key"))


def verified(pairs: DataFrame, drawn: DataFrame, least: float, shingles: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of set_ids whose shared shingles are at least ``least`` of all shingles of either; ``shingles`` gives those of wanted sets."""
    near = pairs.join(drawn.select(F.col("set_id").alias("a"), F.col("n").alias("_na"), F.col("sketch").alias("_ka")), "a")
    near = near.join(drawn.select(F.col("set_id").alias("b"), F.col("n").alias("_nb"), F.col("sketch").alias("_kb")), "b")
    near = near.filter(F.least("_na", "_nb") >= F.lit(least) * F.greatest("_na", "_nb") - 1e-9).select("a", "b", "_ka", "_kb")
    enough = agreeing(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_ka", "_kb"))
                z = x ^ y
                same = ((z & 15) == 0).sum(axis=1) + ((z >> 4) == 0).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= enough))

    near = cut(near.mapInArrow(run, "a bigint, b bigint"))
    own = shingles(cut(near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(drawn.select("set_id", "text_key"), "set_id")))
    ends = near.select("a", "b", F.explode(F.array("a", "b")).alias("set_id"))
    both = ends.join(own, "set_id").groupBy("a", "b").agg(F.collect_list("shingles").alias("_s")).filter(F.size("_s") == 2)
    na, nb = F.size(F.col("_s")[0]), F.size(F.col("_s")[1])
    shared = F.size(F.array_intersect(F.col("_s")[0], F.col("_s")[1]))
    return both.filter(shared >= F.lit(least) * (na + nb - shared) - 1e-9).select("a", "b")


def rare(own: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the sets (set_id, g, shingles) of different groups g that share one of their rarest shingles.

    Two sets of similarity ``least`` share at least ``least`` of the longer
    one's shingles and 2 least / (1 + least) of the shorter one's. So, in any
    one order of all shingles, the first of the longer and the first of the
    shorter, by as many as may be missing and one more, have a shingle in
    common. The order is rarest first, by how many of these sets have a
    shingle: what all sets share comes last and makes no candidates.
    """
    # Half of a hash stands for a shingle: what collides makes a candidate more, and one place more covers a set that it shortens.
    one = own.select("set_id", F.explode(F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")))).alias("shingle"))
    often = one.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    # Shingles of one set come first and meet nothing; they only take up places.
    known = one.join(often, "shingle").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    known = known.join(own.select("set_id", "g", F.size("shingles").alias("n")), "set_id")
    first = lambda share: F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 2 - (F.col("n") - F.size("s"))).cast("int")
    part = lambda share: F.explode(F.slice("s", F.lit(1), first(share))["shingle"])
    known = cut(known)
    short = known.select(F.col("set_id").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"), part(2 * least / (1 + least)).alias("shingle"))
    long = known.select(F.col("set_id").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"), part(least).alias("shingle"))
    met = short.join(long, "shingle").filter((F.col("ga") != F.col("gb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.lit(least) * F.col("nb") - 1e-9))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, group): the least node of each connected component of links (a, b); nodes without links are absent.

    Alternating large and small stars until nothing is left to do: every node's larger neighbours, then
    its smaller ones, are linked to the least node known. The edges are written
    to the shared checkpoint folder each round, and only a count comes to the
    driver.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        new = cut(small.filter("u <> v").distinct())
        # Done when every node has one edge, to a node that has none.
        many = new.groupBy("u").count().filter("count > 1").select("u")
        chained = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        edges = new
        if many.unionByName(chained).isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    return stars.unionByName(stars.select(F.col("group").alias("node"), "group").distinct())


#: Most members of a block, and most shingles on average, of a group whose members all meet.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Shingles or variants that are multiplied at once.
WIDE = 1 << 12


def _shared(values: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each set of ``a`` shares with each of ``b``; the sets have no value twice."""
    size = np.array([len(v) for v in values])
    kind, code, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(values)), size)
    kept = times[code] > 1
    row, code = row[kept], (np.cumsum(times > 1) - 1)[code[kept]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int((times > 1).sum()), WIDE):
        x, y = np.searchsorted(code, [at, at + WIDE])
        has = np.zeros((len(values), WIDE), np.float32)
        has[row[x:y], code[x:y] - at] = 1
        out += has[a] @ has[b].T
    return np.rint(out).astype(np.int64)


def linked(block: np.ndarray, i: int, j: int, keys: list[np.ndarray], drawn: np.ndarray, hashed: list[np.ndarray], least: float) -> np.ndarray:
    """How many rows of the other of blocks i and j (of its own, if i = j) each row shares a variant and at least ``least`` of all shingles with."""
    out = np.zeros(len(block), np.int64)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(a) or not len(b):
        return out
    met = _shared(keys, a, b) > 0
    if i == j:
        met = np.triu(met, 1)
    x, y = np.nonzero(met)
    enough, near = agreeing(least), np.zeros(len(x), bool)
    for k in range(0, len(x), 1 << 15):
        z = drawn[a[x[k : k + (1 << 15)]]] ^ drawn[b[y[k : k + (1 << 15)]]]
        near[k : k + (1 << 15)] = ((z & 15) == 0).sum(axis=1) + ((z >> 4) == 0).sum(axis=1) >= enough
    x, y = x[near], y[near]
    if len(x):
        size = np.array([len(h) for h in hashed])
        both = _shared(hashed, a, b)[x, y]
        sure = both >= least * (size[a[x]] + size[b[y]] - both) - 1e-9
        out += np.bincount(a[x[sure]], minlength=len(out)) + np.bincount(b[y[sure]], minlength=len(out))
    return out


def degrees(links: DataFrame, hot: DataFrame, groups: DataFrame, df: DataFrame, drawn: DataFrame, least: float, words: int) -> DataFrame:
    """(node, n_links): the number of links of every set that has one.

    Links between members of one hot variant (``hot``: key, set_id) are counted
    where blocks of their group meet, each pair once whatever variants it
    shares; only the counts leave a block. All other links are in ``links``.
    """
    keys = hot.join(groups, hot.set_id == groups.node).groupBy("group", "set_id").agg(F.collect_set("key").alias("keys"))
    keys = cut(keys.join(drawn, "set_id"))
    size = keys.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("_n")).filter("m > 1")
    size = size.select("group", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("_n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    meeting = keys.join(size, "group")
    own = shingle_sets(df, words, cut(meeting.select("set_id", "text_key")))
    meeting = meeting.join(own, "set_id").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(3)), "blocks").cast("int"))
    meeting = meeting.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = meeting.select("group", F.least("block", "_x").alias("i"), F.greatest("block", "_x").alias("j"), "block", "set_id", "keys", "sketch", "shingles")

    def run(t: pa.Table) -> pa.Table:
        keys, hashed = ([x.values.to_numpy() for x in t.column(c)] for c in ("keys", "shingles"))
        drawn = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        n = linked(t.column("block").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py(), keys, drawn, hashed, least)
        return pa.table({"node": t.column("set_id"), "n": pa.array(n)})

    inside = meeting.groupBy("group", "i", "j").applyInArrow(run, "node bigint, n bigint")
    ka, kb = (keys.select(F.col("set_id").alias(c), F.col("keys").alias(f"_{c}")) for c in "ab")
    beside = links.join(ka, "a", "left").join(kb, "b", "left").filter(~F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    beside = beside.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("n"))
    return inside.unionByName(beside).groupBy("node").agg(F.sum("n").alias("n_links"))


def group(df: DataFrame, least: float = 0.7, words: int = WORDS, segments: int = SEGMENTS, width: int = WIDTH, count_links: bool = True) -> DataFrame:
    """(record_id, group_id, n_links) of every row (record_id, text): the group it belongs to.

    Two texts are linked if they share at least ``least`` of the distinct
    ``words``-word shingles of either; groups are records connected by links.
    n_links is the number of different other texts that the record's text is
    linked to, hot variants or not; it is left out if not ``count_links``,
    since in a hot variant all members of a group must meet for it. Rows delivered twice count once. A text of fewer words has
    no shingles and a group of its own (group_id null). A record_id with
    several texts has a row for each. Extra columns are ignored. Two different
    sets of shingles are taken for one only if their 64-bit hashes agree.
    """
    rows = cut(members(df, words, segments, width))
    sets = rows.select("record_id", "set_id").distinct()
    drawn = cut(drawn_of(rows))
    index = rows.select(F.explode("keys").alias("key"), "set_id")
    # Variants of very many sets stay out of the window below; which way a variant goes changes no result.
    very = index.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLED)) == 0).groupBy("key").count().filter(F.col("count") >= VERY_HOT).select("key")
    very = cut(very)
    same = W.Window.partitionBy("key")
    shared = index.join(very, "key", "left_anti").withColumn("n", F.count("*").over(same)).filter("n > 1").withColumn("first", F.min("set_id").over(same))
    few = shared.filter(F.col("n") <= HOT).groupBy("key").agg(F.array_sort(F.collect_set("set_id")).alias("ids"))
    few = few.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("i") + 2, F.lit(HOT))).alias("b"), F.lit(None).cast("bigint").alias("key"))
    hot = shared.filter(F.col("n") > HOT).select(F.col("first").alias("a"), F.col("set_id").alias("b"), "key")
    if not very.isEmpty():
        there = index.join(very, "key", "left_semi")
        hot = hot.unionByName(there.join(there.groupBy("key").agg(F.min("set_id").alias("a")), "key").select("a", F.col("set_id").alias("b"), "key"))
    # Members of hot variants are kept (with their key) beside the candidates, so that they needn't be indexed again.
    both = cut(few.unionByName(hot).distinct())
    links = cut(verified(both.filter("a <> b").select("a", "b").distinct(), drawn, least, lambda wanted: shingle_sets(df, words, wanted)))
    groups = components(links)
    hot = both.filter("key is not null").select("key", F.col("b").alias("set_id"))
    heated = not hot.isEmpty()
    if heated:
        groups = cut(groups)
        # Members of hot variants that still lie in different groups meet by their rarest shingles.
        own = hot.join(groups, hot.set_id == groups.node, "left").select("key", "set_id", F.coalesce("group", "set_id").alias("g"))
        mixed = own.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("key")
        own = own.join(mixed, "key", "left_semi").groupBy("set_id").agg(F.first("g").alias("g")).join(drawn.select("set_id", "text_key"), "set_id")
        own = cut(own)
        if not own.isEmpty():
            apart = cut(own.join(shingle_sets(df, words, own.select("set_id", "text_key")), "set_id"))
            links = cut(links.unionByName(verified(rare(apart, least), drawn, least, lambda _: apart.select("set_id", "shingles"))).distinct())
            groups = components(links)
    out = sets.select("record_id", F.col("set_id").alias("node")).join(groups, "node", "left")
    if not count_links:
        return out.select("record_id", F.coalesce("group", "node").alias("group_id"))
    if heated:
        degree = degrees(links, hot, groups, df, drawn, least, words)
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return out.join(degree, "node", "left").select("record_id", F.coalesce("group", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def pairs(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different records of one group."""
    many = grouped.filter("group_id is not null").select("record_id", "group_id").distinct()
    size = many.groupBy("group_id").count().filter("count > 1").select("group_id")
    many = many.join(size, "group_id", "left_semi")
    a = many.select("group_id", F.col("record_id").alias("id_a"))
    b = many.select("group_id", F.col("record_id").alias("id_b"))
    return a.join(b, "group_id").filter("id_a < id_b").select("id_a", "id_b").distinct()
