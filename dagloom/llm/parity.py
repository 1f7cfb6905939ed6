"""N-gram Jaccard self-join by parity sketches.

Two sets of a and b shingles with Jaccard similarity p/q or more differ in at most
d = (a + b)(q - p) / (q + p) shingles. A set's shingles toggle bits of a sketch, so the Hamming
distance of two sketches is at most the size of the sets' difference. Sets are put into geometric
size bands; for a band (and the one below) the sketch is cut into d + 3 + L blocks, so by the
pigeonhole principle L + 3 blocks at least agree in a linked pair. A block's key is the XOR of
hashes of its set bits. Light blocks, those without a bit besides those of passages that very many
documents share, say next to nothing and are not sent by a set that has at most L of them: three of
its L + 3 agreeing blocks are then heavier ones. Sets of so few shingles that most blocks would be
empty send their first shingles in hash order instead, as many as a linked set must meet.

Sets that share a key are candidates: the pairs of a small group that share three keys, and of each
set in large ones the pair with one centre. Before any text moves, candidates are held against whole
sketches of the sets (a few bits for each shingle that linked sets may differ in), whose Hamming
distance is never above the difference; only pairs within the bound are verified, on the shingles
themselves. Equal sets are collapsed first. What is linked so far makes components. In large groups
that hold several of them, the members that are not of the centre's are then held against all those
of other components, sketch by sketch, in tiles of bounded numbers of members; of the pairs within
the bound those closest to each component are verified first, and more of them, in growing portions,
only while the components stay apart. So no group is gathered whole in one task, nor are its pairs
emitted, and every link between different sets that joins two components is found.

Defined results: a set without shingles (null, empty or blank text) links with nothing; a text of
fewer words than a shingle is one shingle; a very long text has as many keys and sketch bits as its
size asks for and is compared whole; ties between members for a star's centre go to the smaller hash;
repeated rows and equal sets are one class; a null doc_id counts as the largest id; an empty table
gives an empty result; extra columns are ignored. Sets are identified by 64-bit hashes, texts by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.blocks import NULL_ID, pack_keys, split, unpack_keys
from dagloom.llm.tokens import U64, Texts, batches_of, fold, free_memory, list_array, mix, windows, word_hashes
from dagloom.session import Scratch, arrow_rows, cut

#: bits of a sketch's block
BLOCK_BITS = 16
#: a group of candidates up to this size sends all its pairs, a larger one a star
SMALL = 6
#: keys that linked sets share at least
SUPPORT = 3
#: members of a star in one task: those not linked to its centre, and those they are held against
CHUNK, TILE = 1024, 4096
#: pairs that a member sends for each other component in the first round, and the growth by round
PORTION, GROWTH = 16, 8
#: sketch bits for each shingle in which linked sets may differ, and the least
BITS_EACH, LEAST_BITS = 8, 64
#: rows of an Arrow batch: with texts of a few KB these are a few MB
BATCH = 2000
#: texts to verify are picked by a broadcast of up to so many hashes (16 bytes each)
BROADCAST_TEXTS = 1 << 20
#: a key that so many sets of one batch hold goes to one of SPREAD buckets beside the others
HOT, SPREAD, PROXY = 32, 1 << 10, np.iinfo(np.int64).min
KEYS_PER_BUCKET = 1 << 20
#: sample in which common shingles are looked for, and in how many of its sets they are common;
#: the share of a set's shingles that the light allowance expects not to be common
SAMPLE, COMMON, RARE_SHARE = 8192, 6, 0.85


def shingle_sets(texts: Texts, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ascending distinct shingle hashes of each text, and a hash of each set."""
    starts, ends, counts = texts.words()
    h = word_hashes(texts.buf, starts, ends, lower=True)
    all_h, _ = windows(h, counts, n)
    sizes = np.maximum(counts - n + 1, 0)
    end = np.cumsum(sizes)
    sets = [np.unique(all_h[e - s : e]) for e, s in zip(end.tolist(), sizes.tolist(), strict=True)]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = (np.cumsum(counts) - counts)[short]
        for i, x in zip(short.tolist(), fold(h, begin, counts[short]), strict=True):
            sets[i] = np.array([x], U64)
    code = np.zeros(len(sets), U64)
    for i, s in enumerate(sets):
        code[i] = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return sets, mix(code)


class Bands:
    """Blocks and light allowance of each space of size bands for similarity p/q."""

    def __init__(self, p: int, q: int, common: np.ndarray | None = None):
        """common: shingles that many documents share. Bits that they toggle do not make a block
        heavy; any list gives the same links, a good one fewer candidates."""
        self.p, self.q = p, q
        self._common = np.empty(0, U64) if common is None else common
        self._step = np.log(q / p)
        self._made: dict[int, tuple[int, int]] = {}
        self._common_bits: dict[int, np.ndarray] = {}

    def most_apart(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.q * both >= self.p * (a + b - both)

    def sketch(self, s: np.ndarray) -> bytes:
        """The parities of a set in as many bits as its size asks for, a power of two."""
        bits = LEAST_BITS
        while bits < BITS_EACH * self.most_apart(len(s), len(s)):
            bits *= 2
        odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(bool), bitorder="little").tobytes()

    def band(self, a: int) -> int:
        return int(np.log(a) / self._step + 1e-9)

    def space(self, k: int) -> tuple[int, int]:
        """(blocks, light allowance) for pairs of bands k and k or k - 1; no blocks: sets too small."""
        if k not in self._made:
            top = int(np.exp(self._step * (k + 1)) + 1)  # sizes in band k are at most this
            blocks = d1 = int(self.most_apart(top, top)) + SUPPORT
            light = 0
            while True:
                expected = blocks * np.exp(-RARE_SHARE * 0.9 * top / blocks)
                need = int(np.ceil(expected + 3 * np.sqrt(expected)))
                if need <= light:
                    break
                light += max(1, (need - light) // 2)
                blocks = d1 + light
                if light > d1:  # so few shingles that most blocks would be empty
                    blocks = light = 0
                    break
            self._made[k] = (blocks, light)
        return self._made[k]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set in its own band's space and in the next."""
        if not len(s):
            return np.empty(0, U64)
        k = self.band(len(s))
        return np.concatenate([self._keys(s, k), self._keys(s, k + 1)])

    def _keys(self, s: np.ndarray, space: int) -> np.ndarray:
        blocks, light = self.space(space)
        if not blocks:  # one of the first |s| - p/q |s| + 1 shingles is in a linked set's first ones
            first = s[: len(s) - -(-self.p * len(s) // self.q) + 1]
            return np.concatenate([mix(first ^ mix(np.array([space + (i << 20)], U64))) for i in range(SUPPORT)])
        width = min(BLOCK_BITS, 31 - blocks.bit_length())
        bit = self._bits(s, blocks << width)  # ascends with s
        if (bit[1:] == bit[:-1]).any():  # a bit that is toggled twice is not set
            bit, times = np.unique(bit, return_counts=True)
            bit = bit[times % 2 == 1]
        if space not in self._common_bits:
            self._common_bits[space] = np.unique(self._bits(self._common, blocks << width))
        common = self._common_bits[space]
        rare = np.ones(len(bit), bool) if not len(common) else common[np.minimum(np.searchsorted(common, bit), len(common) - 1)] != bit
        rares = np.concatenate([[0], np.cumsum(rare)])
        off = np.searchsorted(bit >> U64(width), np.arange(blocks + 1, dtype=U64))
        toggled = np.zeros(len(bit) + 1, U64)
        np.bitwise_xor.accumulate(mix(bit + U64(space << 48)), out=toggled[1:])
        content = toggled[off[1:]] ^ toggled[off[:-1]]
        heavy = rares[off[1:]] > rares[off[:-1]]
        keys = mix(content + mix(np.arange(blocks, dtype=U64) + U64(space << 32)))
        return keys[heavy] if np.count_nonzero(~heavy) <= light else keys

    @staticmethod
    def _bits(s: np.ndarray, m: int) -> np.ndarray:
        return ((s >> U64(32)) * U64(m)) >> U64(32)


def fold_sketches(blobs: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, folded to `width` bytes: bits whose index
    agrees in the low bits are one bit of the shorter sketch."""
    rows = np.frombuffer(b"".join(blobs), U64).reshape(len(blobs), -1)
    while rows.shape[1] * 8 > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Hamming distances of x[i] and y[i]."""
    out = np.zeros(len(x), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        kinds.setdefault((len(a), len(b)), []).append(i)
    for (a, b), rows in kinds.items():
        one, two = (fold_sketches([side[i] for i in rows], min(a, b)) for side in (x, y))
        out[rows] = np.bitwise_count(one ^ two).sum(1)
    return out


def common_shingles(docs: DataFrame, n: int, rows: int, sample: int = SAMPLE, least: int = COMMON) -> np.ndarray:
    """Shingles of `least` or more different sets of a sample of about `sample` documents. Both
    numbers bound what the driver gets; they steer cost, not results."""
    share = min(1.0, sample / max(1, rows))

    def run(it):
        for _, texts in batches_of(it):
            sets, code = shingle_sets(texts, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), list_array(np.concatenate(sets).view(np.int64), sizes, pa.int64())], names=["code", "s"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sets = chosen.mapInArrow(run, "code long, s array<long>").dropDuplicates(["code"])
    found = sets.select(F.explode("s").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("g").toArrow()
    return np.sort(found["g"].to_numpy().view(U64))


TEXT = ("t1", "t2")
ROWS = "doc_id long, t1 long, t2 long, n_shingles long, h long, sketch binary"


def text_hash(text: Column) -> list[Column]:
    """128 bits of two independent hashes of a text."""
    return [F.xxhash64(F.lit(i), text.cast("string")).alias(c) for i, c in enumerate(TEXT)]


def _classes(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """ROWS of every row."""

    def run(it):
        for batch, texts in batches_of(it):
            sets, code = shingle_sets(texts, n)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *TEXT)]
            sketches = pa.array([bands.sketch(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(code.view(np.int64)), sketches], names=[x.split(" ")[0] for x in ROWS.split(", ")])
        free_memory()

    return docs.select("doc_id", "text", *text_hash(F.col("text"))).mapInArrow(run, ROWS)


def _key_rows(docs: DataFrame, n: int, bands: Bands, shingles: int) -> DataFrame:
    """(key, h) of the keys that two sets or more hold. A batch of documents sends its keys sorted
    and delta-coded, split by their top bits into buckets; a bucket keeps what is held twice. A
    key that very many sets of one batch hold is sent there once, as a proxy, and its sets in
    spread-out buckets of their own, so that a group of near copies does not pile up in one
    bucket. A row may come twice."""
    bits = max(1, int(np.ceil(np.log2(max(1, shingles / 2 / KEYS_PER_BUCKET)))))

    def coded(bucket: int, keys: np.ndarray, own: np.ndarray, h: np.ndarray) -> tuple:
        used, own = np.unique(own, return_inverse=True)  # the last of h stands for proxies
        return bucket, len(keys), pack_keys(keys), own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), h[used].tobytes()

    def run(it):
        sent: set[int] = set()
        for _, texts in batches_of(it):
            sets, code = shingle_sets(texts, n)
            out, held = [], []
            for s, h in zip(sets, code.view(np.int64).tolist(), strict=True):
                if h not in sent:  # a set met again in one task is not sent again
                    sent.add(h)
                    out.append(bands.keys(s))
                    held.append(h)
            if len(sent) > 1 << 17:
                sent.clear()
            if not out:
                continue
            h = np.array([*held, PROXY], np.int64)
            keys = np.concatenate(out)
            order = np.argsort(keys, kind="stable")
            own, keys = np.repeat(np.arange(len(out)), [len(k) for k in out])[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([first, [len(keys)]]))
            hot = np.repeat(times >= HOT, times)
            stay = ~hot
            stay[first] = True
            sent_own = np.where(hot, len(held), own)
            rows = [coded(bucket, keys[stay][a:b], sent_own[stay][a:b], h) for bucket, a, b in split(keys[stay], bits)]
            if hot.any():
                rows.append(coded(-1 - int(h[0] % SPREAD), keys[hot], own[hot], h))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["bucket", "n", "keys", "own", "sets"])
        free_memory()

    def shared(table: pa.Table) -> pa.Table:
        ns = table["n"].to_pylist()
        keys = np.concatenate([unpack_keys(k, c) for k, c in zip(table["keys"].to_pylist(), ns, strict=True)])
        h = np.concatenate(
            [np.frombuffer(s, np.int64)[np.frombuffer(o, np.uint16 if len(o) == 2 * c else np.uint32)] for o, s, c in zip(table["own"].to_pylist(), table["sets"].to_pylist(), ns, strict=True)]
        )
        order = np.lexsort((h, keys))
        keys, h = keys[order], h[order]
        # proxies of two batches stand for different sets
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (h[1:] != h[:-1]) | (h[1:] == PROXY)])
        keys, h = keys[new], h[new]
        if table["bucket"][0].as_py() >= 0:
            same = keys[1:] == keys[:-1]
            on = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            on &= h != PROXY
            keys, h = keys[on], h[on]
        free_memory()
        return pa.table({"key": pa.array(keys.view(np.int64)), "h": pa.array(h)})

    sent = docs.mapInArrow(run, "bucket int, n int, keys binary, own binary, sets binary")
    return sent.groupBy("bucket").applyInArrow(shared, "key long, h long")


def _groups(rows: DataFrame) -> DataFrame:
    """(key, h, k, x): how many sets hold the key, and its centre, as the struct (-keys, h): the member
    that shares the most keys. In a group of near copies that is one of the least edited, and the
    same one for most of the group's keys."""
    degree = rows.groupBy("h").agg((-F.count(F.lit(1))).alias("d"))
    ranked = rows.join(degree, "h").select("key", "h", F.struct("d", "h").alias("rank"))
    # counts and centres are aggregated and joined back: no task holds a key's sets together
    groups = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("rank").alias("x")).where("k > 1")
    return ranked.select("key", "h").join(groups, "key")


def _candidates(sized: DataFrame) -> DataFrame:
    """(x, y): the pairs of small groups, and of each set in large ones the first of its centres."""
    star = sized.where(F.col("k") > SMALL).groupBy(F.col("h").alias("y")).agg(F.min("x")["h"].alias("x")).where("x <> y").select("x", "y")
    few = sized.where(F.col("k") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("h")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = few.select(F.explode(pairs).alias("p")).select("p.x", "p.y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    # linked sets that share fewer small groups than SUPPORT share a large one, and meet in its star
    return star.unionByName(each.where(F.col("n") >= SUPPORT).select("x", "y")).distinct()


def _near(edges: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """(x, y): the edges whose sketches are within the bound of linked sets."""
    x, y = (classes.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "xy")

    def run(it):
        for batch in it:
            n_x, n_y = (batch.column(k).to_numpy() for k in (2, 3))
            near = pa.array(_apart(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= bands.most_apart(n_x, n_y))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in range(2)], names=["x", "y"])
        free_memory()

    both = edges.join(x, "x").join(y, "y").select("x", "y", "n_x", "n_y", "s_x", "s_y")
    return both.mapInArrow(run, "x long, y long")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(t1, t2, z): the needed texts, once each, compressed before they travel."""

    def run(it):
        z = zstandard.ZstdCompressor(level=3)
        for batch, texts in batches_of(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(texts.bytes_of(i)) for i in range(len(texts))], pa.binary())], names=[*TEXT, "z"])

    hashed = docs.select(*text_hash(F.col("text")), "text")
    few = needed.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    if few:  # else all texts are shuffled, compressed
        hashed = hashed.join(F.broadcast(needed), [*TEXT], "left_semi")
    packed = hashed.mapInArrow(run, "t1 long, t2 long, z binary")
    return (packed if few else packed.join(needed, [*TEXT], "left_semi")).groupBy(*TEXT).agg(F.first("z").alias("z"))


def _verify(edges: DataFrame, docs: DataFrame, classes: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(x, y, linked): edges held against one text of each class."""
    named = edges.select("x", "y")
    for c in "xy":
        named = named.join(classes.select(F.col("h").alias(c), F.col("first.t1").alias(f"t1_{c}"), F.col("first.t2").alias(f"t2_{c}")), c)
    needed = named.select(F.col("t1_x").alias("t1"), F.col("t2_x").alias("t2")).union(named.select("t1_y", "t2_y")).distinct()
    texts = _texts(docs, needed)
    for c in "xy":
        named = named.join(texts.select(F.col("t1").alias(f"t1_{c}"), F.col("t2").alias(f"t2_{c}"), F.col("z").alias(f"z_{c}")), [f"t1_{c}", f"t2_{c}"])

    def run(it):
        un = zstandard.ZstdDecompressor()
        for whole in it:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                zs = batch.column(2).to_pylist() + batch.column(3).to_pylist()
                distinct = list(dict.fromkeys(zs))
                sets = dict(zip(distinct, shingle_sets(Texts.of_list([un.decompress(z) for z in distinct]), n)[0], strict=True))
                linked = []
                for zx, zy in zip(zs[: batch.num_rows], zs[batch.num_rows :], strict=True):
                    a, b = sets[zx], sets[zy]
                    linked.append(bands.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["x", "y", "linked"])
        free_memory()

    return named.select("x", "y", "z_x", "z_y").mapInArrow(run, "x long, y long, linked boolean")


def _star_members(sized: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, m, label, loose, loose_n, members_n, n, sketch) of the large groups that hold sets of
    several components, by centre c; loose: m is of another component than c."""
    named = sized.where(F.col("k") > SMALL).select("key", "h", F.col("x")["h"].alias("c")).join(labels.select("h", "label"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    stars = named.join(mixed, "key").groupBy("c", F.col("h").alias("m")).agg(F.first("label").alias("label"))
    centre = labels.select(F.col("h").alias("c"), F.col("label").alias("of"))
    stars = stars.join(centre, "c", "left").withColumn("loose", F.col("label") != F.coalesce("of", "c"))
    some = stars.groupBy("c").agg(F.count_if("loose").alias("loose_n"), F.count(F.lit(1)).alias("members_n"))
    sets = classes.select(F.col("h").alias("m"), "n", "sketch")
    return stars.join(some, "c").join(sets, "m").select("c", "m", "label", "loose", "loose_n", "members_n", "n", "sketch")


def _inside_stars(members: DataFrame, labels: DataFrame, bands: Bands, low: int, high: int) -> DataFrame:
    """(x, y, rank): pairs of members of one star, x loose, which `labels` (h, label) says are of
    different components, and whose sketches are within the bound. Of a loose member's pairs with each
    component of the first round those that rank from `low` to `high` by distance are returned; one
    of rank `high` says that there are more."""
    named = members.withColumnRenamed("label", "was").join(labels.select(F.col("h").alias("m"), "label"), "m", "left")
    named = named.select("c", "m", "loose", "n", "sketch", "was", F.coalesce("label", "m").alias("label"), F.ceil(F.col("loose_n") / CHUNK).cast("int").alias("rows"), F.ceil(F.col("members_n") / TILE).cast("int").alias("columns"))
    place = F.xxhash64("m")
    left = named.where("loose").withColumns({"i": F.pmod(place, "rows").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("columns") - 1)), "left": F.lit(True)})
    right = named.withColumns({"j": F.pmod(place, "columns").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), "left": F.lit(False)})

    def run(table: pa.Table) -> pa.Table:
        is_left, m, n, was, label, loose = (table[c].to_numpy() for c in ("left", "m", "n", "was", "label", "loose"))
        sketch = table["sketch"].to_pylist()
        width = np.array([len(s) for s in sketch])
        out: list[tuple[np.ndarray, ...]] = []
        for a in np.unique(width[is_left]).tolist():
            for b in np.unique(width[~is_left]).tolist():
                xs, ys = np.flatnonzero(is_left & (width == a)), np.flatnonzero(~is_left & (width == b))
                one, two = (fold_sketches([sketch[i] for i in side.tolist()], min(a, b)) for side in (xs, ys))
                for x, own in zip(xs.tolist(), one, strict=True):
                    ok = (was[ys] != was[x]) & (~loose[ys] | (m[ys] > m[x])) & (bands.q * np.minimum(n[ys], n[x]) >= bands.p * np.maximum(n[ys], n[x]))
                    at = np.flatnonzero(ok)
                    apart = np.bitwise_count(two[at] ^ own).sum(1, dtype=np.int64)
                    near = apart <= bands.most_apart(n[ys[at]], n[x])
                    out.append((np.full(int(near.sum()), x), ys[at[near]], apart[near]))
        x, y, apart = (np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3))
        x, y = x.astype(np.int64), y.astype(np.int64)
        order = np.lexsort((m[y], apart, was[y], x))
        x, y = x[order], y[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (was[y[1:]] != was[y[:-1]])])) if len(x) else np.empty(0, np.int64)
        rank = np.arange(len(x)) - np.repeat(new, np.diff(np.concatenate([new, [len(x)]])))
        on = (rank >= low) & (rank <= high) & (label[x] != label[y])
        free_memory()
        return pa.table({"x": pa.array(m[x[on]], pa.int64()), "y": pa.array(m[y[on]], pa.int64()), "rank": pa.array(rank[on], pa.int64())})

    return left.unionByName(right).groupBy("c", "i", "j").applyInArrow(run, "x long, y long, rank long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of edges (x, y) can reach. Labels move to
    neighbours and then to their label's label, until nothing changes."""
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.col("v")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels, F.col("y") == F.col("v")).groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        # hook: the label of v, as a vertex, takes the smallest label that v sees
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("least"))
        hooks = step.groupBy(F.col("label").alias("r")).agg(F.min("least").alias("to"))
        moved = step.join(hooks, F.col("least") == F.col("r"), "left").select("v", F.least("least", F.coalesce("to", "least")).alias("new"), "label")
        moved = cut(moved)
        changed = moved.where(F.col("new") < F.col("label")).limit(1).count()
        labels = moved.select("v", F.col("new").alias("label"))
        if not changed:
            return labels


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, label, rep): of every linked set the component, named by its smallest set, and that set's
    doc_id. A vertex is a set, since different sets may share a doc_id; the smallest has the smallest doc_id."""
    named = links.select("x", "y")
    for c in "xy":
        named = named.join(classes.select(F.col("h").alias(c), F.struct("first.doc_id", "h").alias(f"v_{c}")), c)
    found = components(named.select(F.col("v_x").alias("x"), F.col("v_y").alias("y")))
    return found.select(F.col("v.h").alias("h"), F.col("label.h").alias("label"), F.col("label.doc_id").alias("rep"))


def _links(docs: DataFrame, classes: DataFrame, keys: DataFrame, n: int, bands: Bands, scratch: Scratch) -> DataFrame:
    """Labels of all sets that are linked with any."""
    sized = scratch.keep(_groups(keys))
    near = scratch.keep(_near(_candidates(sized), classes, bands))
    links = scratch.keep(_verify(near, docs, classes, n, bands).where("linked").select("x", "y"))
    labels = scratch.keep(_labels(links, classes))
    members = scratch.keep(_star_members(sized, labels, classes))
    low, high = 0, PORTION
    while not members.isEmpty():
        pairs = scratch.keep(_inside_stars(members, labels, bands, low, high))
        new = pairs.where(F.col("rank") < high).select("x", "y").distinct()
        if new.isEmpty():
            break
        found = scratch.keep(_verify(new, docs, classes, n, bands).where("linked").select("x", "y"))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = scratch.keep(_labels(links, classes))
        if pairs.where(F.col("rank") >= high).isEmpty():
            break
        low, high = high, high * GROWTH
    return labels


def near_duplicates(docs: DataFrame, n: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, t1, t2, first) of every row. class_id: the
    smallest doc_id with an equal set; component_id: the smallest doc_id reachable over pairs of
    Jaccard p/q or more; t1, t2: hashes of the text; first: the row is of that doc_id and of the
    component's smallest set with it, or has no shingles."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, BATCH):
        rows = cut(_classes(docs, n, Bands(p, q)))
    sets = rows.where("n_shingles > 0").groupBy("h").agg(F.min(F.struct("doc_id", *TEXT)).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    count, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    with arrow_rows(docs.sparkSession, BATCH), Scratch(docs.sparkSession) as scratch:
        classes = scratch.keep(sets)
        bands = Bands(p, q, common_shingles(docs, n, count))
        keys = scratch.keep(_key_rows(docs, n, bands, shingles))
        labels = _links(docs, classes, keys, n, bands, scratch)
        own = F.struct(F.col("first.doc_id").alias("rep"), "h")
        by_set = cut(classes.join(labels.select("h", F.struct("rep", F.col("label").alias("h")).alias("label")), "h", "left").select("h", F.col("first.doc_id").alias("rep"), F.coalesce("label", own).alias("label")))

    def known(c: str):
        return F.nullif(F.col(c), F.lit(int(NULL_ID)))

    first = (F.col("doc_id") == F.col("label")["rep"]) & (F.col("h") == F.col("label")["h"])
    labelled = rows.where("n_shingles > 0").join(by_set, "h").select("doc_id", "n_shingles", "rep", F.col("label")["rep"].alias("label"), *TEXT, first.alias("first"))
    blank = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"), *TEXT, F.lit(True).alias("first"))
    return labelled.unionByName(blank).select(known("doc_id").alias("doc_id"), "n_shingles", known("rep").alias("class_id"), known("label").alias("component_id"), *TEXT, "first")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: links by value over distinct sets; closure by recursion from each set to smaller ones
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2])))) END AS g FROM d
), c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s GROUP BY g),
e AS (SELECT rep, n, unnest(g) AS x FROM c WHERE n > 0),
r AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY hash(x), x) AS k FROM e),
cand AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM r a JOIN r b ON a.x = b.x AND a.rep < b.rep
  WHERE a.k <= a.n - ceil(a.n * 0.9) + 1 AND b.k <= b.n - ceil(b.n * 0.9) + 1 AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (SELECT cand.a, cand.b, ca.n AS na, cb.n AS nb, len(list_intersect(ca.g, cb.g)) AS i
    FROM cand JOIN c ca ON ca.rep = cand.a JOIN c cb ON cb.rep = cand.b WHERE ca.n > 0 AND cb.n > 0) t
  WHERE 100 * i >= 90 * (na + nb - i)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS u FROM both_ways UNION SELECT reach.v, b FROM reach JOIN both_ways ON reach.u = both_ways.a),
comp AS (SELECT v, min(u) AS m FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE coalesce(comp.m, c.rep) END AS component_id
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN comp ON comp.v = c.rep
"""
