"""Exact Jaccard self-join on word shingles (operator 2) by universe partitioning.

Sets are filed in size bands. Within a band the universe of shingles is hashed into segments. Two sets of
similarity t or more differ in at most H shingles, so among H+1 segments one at least is the same in both;
with one-deletion neighbourhoods a segment also answers for a difference of one, and half as many do.

Allocation. A band takes whichever costs less: whole segments (one key each; z further segments are spent
so that a set may leave out up to z empty ones, which would match everything, and SPARE more so that it may
leave out up to SPARE keys that many classes share, as those of a common passage), or fewer segments with all
one-deletion keys. A set of n shingles needs only the first H(n)+1 (+z) segments of its band, as does any
partner at least as large, so small sets of a band write fewer keys.

Keys of a batch are packed by hash slice and sorted out slice by slice; equal sets are one class and write
equal entries, which merge in the batch, so a group of copies of any size costs a batch one entry a key.
Groups of a key are then linked in rounds: first every class with the group's hub, the class that shares most
keys and so stands amid near copies, then with another centre in groups that are not yet one component. What
groups are still open are searched across components by their rarest shingles with bounds on places and
sizes, so no link between components is lost and a group of near copies is not expanded into all pairs.
A candidate is first held against bucket counts of the two sets, whose distance is never more than that of
the sets, and if it passes, verified on the whole sets.

Shingles are compared by 64-bit hash and classes by a 64-bit hash of the set.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; a
text of fewer words than a shingle is one shingle. Rows that repeat a doc_id are rows of one document. Rows
with a null doc_id link with nothing and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.graph import components
from gazette.llm.shared import SPACE_WORDS, byte_rows, drop_saved, mix, save, shingle_hashes, tidy, word_hashes, words

#: Entries that a slice of the key space holds on average, and reps whose ids are sent to the workers at most.
SLICE_ENTRIES, SENT_IDS = 400_000, 1_000_000
#: Keys that a set may leave out if more than COMMON classes share them.
SPARE, COMMON = 8, 8
#: Classes of a group whose pairs are all tried.
SMALL = 24
#: Least and most cells, powers of two, of the array that the order of shingles by frequency is taken from; four a shingle between them.
FREQUENCIES = (1 << 20, 1 << 23)
_BAND, _SEGMENT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)

_TOP = np.uint64(1 << 63)


class Allocation:
    """Bands of set sizes and how many segments, of which kind, each has. num / den is the threshold."""

    def __init__(self, num: int = 80, den: int = 100, largest: int = 1 << 26) -> None:
        self.num, self.den = num, den
        edges, low = [], 1
        while low <= largest:
            high = max(low, math.ceil(low * 1.5) - 1)
            edges.append((low, high))
            low = high + 1
        self.lows = np.array([a for a, _ in edges])
        self.bands = []
        for low, high in edges:
            h = self.apart(high)
            void = math.exp(-4 * (low / high) * 0.95)  # of a whole segment, for the smallest sets of the band
            mean = void * (self.apart(low) + 1)
            z = math.ceil(mean + 4 * math.sqrt(mean)) + 1
            z += SPARE
            whole = h + 1 + z
            halves = math.ceil((h + 1) / 2)
            deletions = high + halves + 400 * halves * (1 - 1 / max(halves, 1)) ** low  # an empty segment costs candidates
            if h == 0:
                self.bands.append((0, 0, 0))  # only equal sets can link
            elif deletions < 2.5 * whole + 12:
                self.bands.append((1, halves, 0))
            else:
                self.bands.append((0, whole, z))

    def apart(self, n: int) -> int:
        """The most shingles in which a set of n and a partner at least as large can differ."""
        m = n * self.den // self.num
        return (n + m) - 2 * -(-(n + m) * self.num // (self.num + self.den))

    def count(self, n: int) -> int:
        """About how many keys a set of n has."""
        return 2 * (n + 1) if n < 27 else n // 2 + 32

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """All keys of a set (distinct shingle hashes); the highest bit is set on those of deletion bands."""
        n = len(shingles)
        if n == 0:
            return np.zeros(0, np.uint64)
        home = int(np.searchsorted(self.lows, n, "right")) - 1
        out = []
        for band in (home, home - 1):
            if band < 0 or (band < home and -(-n * self.num // self.den) >= self.lows[home]):
                continue
            kind, segments, z = self.bands[band]
            if segments == 0:
                continue
            top = int(self.lows[band + 1]) - 1 if band + 1 < len(self.lows) else n
            h = self.apart(min(n, top))
            used = min(segments, math.ceil((h + 1) / 2) if kind else h + 1 + z)
            salt = np.uint64((band + 1) * int(_BAND) & 0xFFFFFFFFFFFFFFFF)
            place = (mix(shingles ^ salt) % np.uint64(segments)).astype(np.int64)
            value = mix(shingles + salt)
            sums, count = np.zeros(segments, np.uint64), np.bincount(place, minlength=segments)
            np.add.at(sums, place, value)
            base = sums + np.arange(1, segments + 1, dtype=np.uint64) * _SEGMENT + salt
            if kind:
                own = place < used
                out += [mix(base[:used]) | _TOP, mix(base[place[own]] - value[own]) | _TOP]
            else:
                empty = count[:used] == 0
                out.append(mix(base[:used] if empty.sum() > z - SPARE else base[:used][~empty]) & ~_TOP)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _class(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for data in byte_rows(column):
        yield np.zeros(0, np.uint64) if data is None else shingle_hashes(word_hashes(*words(data, SPACE_WORDS)), k)


def _base(docs: DataFrame, k: int, plan: Allocation) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, class and number of keys of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), _class(s), plan.count(len(s))) for s in _sets(batch.column(1), k)]
            n, c, m = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.int64())], names=["doc_id", "text_key", "n_shingles", "class", "n_keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, class long, n_keys long")


def _packed_keys(docs: DataFrame, k: int, plan: Allocation, slices: int) -> DataFrame:
    """Keys by slice of the key space. A blob holds 48 bits of each key (the kind, and 47 of its hash), and which class of a list it is of."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                known = batch.column(0).is_valid().to_pylist()
                found: dict[int, np.ndarray] = {}
                for ok, s in zip(known, _sets(batch.column(1), k), strict=True):
                    if ok and len(s) and (c := _class(s)) not in found:
                        found[c] = plan.keys(s)
                keys = np.concatenate([np.zeros(0, np.uint64), *found.values()])
                if not len(keys):  # none, or sets so small that only equal ones link
                    continue
                owner = np.repeat(np.arange(len(found), dtype=np.uint16), [len(x) for x in found.values()])
                kind, keys = keys & _TOP, keys & ~_TOP
                part = (keys % np.uint64(slices)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keys, owner, part = (keys // np.uint64(slices) & np.uint64((1 << 47) - 1) | kind >> np.uint64(16))[order], owner[order], part[order]
                ids = np.array(list(found), np.int64)
                at = np.flatnonzero(np.diff(part, prepend=-1))
                rows = []
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    x = keys[a:b]
                    rows.append((int(part[a]), b"".join([np.int32(b - a).tobytes(), (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes(), local.astype("<u2").tobytes(), ids[used].tobytes()])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "blob"])

    return docs.mapInArrow(run, "slice int, blob binary")


def _shared_keys(slice_rows: pa.Table) -> pa.Table:
    """(key, class) of the keys of a slice that more than one class has."""
    keys, classes = [], []
    part = slice_rows.column("slice")[0].as_py() if slice_rows.num_rows else 0
    for blob in slice_rows.column("blob").to_pylist():
        n = int(np.frombuffer(blob, "<i4", 1)[0])
        low = np.frombuffer(blob, "<u4", n, 4).astype(np.uint64)
        high = np.frombuffer(blob, "<u2", n, 4 + 4 * n).astype(np.uint64)
        local = np.frombuffer(blob, "<u2", n, 4 + 6 * n)
        keys.append(low | (high << np.uint64(32)))
        classes.append(np.frombuffer(blob, "<i8", -1, 4 + 8 * n)[local])
    key, cls = np.concatenate(keys), np.concatenate(classes)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    key, cls = key[keep], cls[keep]
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]) if len(key) else np.zeros(0, bool)
    key, cls = key[new], cls[new]
    _, at, many = np.unique(key, return_inverse=True, return_counts=True)
    shared = many[at] if len(key) else np.zeros(0, np.int64)
    more = shared > 1
    named = mix(key[more] ^ np.uint64((part + 1) << 48)).view(np.int64)
    common = (shared[more] > COMMON) & (key[more] >> np.uint64(47) == 0)
    return pa.table({"key": pa.array(named, pa.int64()), "class": pa.array(cls[more], pa.int64()), "common": pa.array(common, pa.bool_())})


def _without_common(members: DataFrame) -> DataFrame:
    """Leave out the common keys of classes that have SPARE of them at most; n_keys are those that a class then shares."""
    few = members.where("common").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPARE).select("class")
    kept = members.where("not common").unionByName(members.where("common").join(few, "class", "left_semi")).select("key", "class")
    return kept.join(kept.groupBy("class").agg(F.count(F.lit(1)).alias("n_keys")), "class").select("key", "class", "n_keys")


def _buckets(shingles: np.ndarray) -> bytes:
    """Counts of the set by bucket, up to 255; about four shingles a bucket, a power of two of buckets."""
    size = 1 << max(4, int(max(len(shingles), 1) // 4).bit_length())
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % size, minlength=size), 255).astype(np.uint8).tobytes()


def _whole_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """class and sorted shingle hashes of the documents that stand for the classes in reps (class, rep)."""
    few = reps.limit(SENT_IDS + 1).count() <= SENT_IDS
    if few:
        ids = np.sort(reps.select("rep").toPandas()["rep"].to_numpy(np.int64))
        sent = docs.sparkSession.sparkContext.broadcast(ids)
        rows = docs
    else:
        sent = None
        rows = docs.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if sent is not None and batch.num_rows:
                mine = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(sent.value, mine), max(len(sent.value) - 1, 0))
                batch = batch.filter(pa.array(sent.value[at] == mine if len(sent.value) else np.zeros(len(mine), bool)))
            sets = list(_sets(batch.column(1), k))
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_buckets(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "buckets", "shingles"])

    return rows.select("doc_id", "text").mapInArrow(run, "class long, n long, buckets binary, shingles binary")


def _near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bucket counts leave open: a lower bound of the distance, so no link is lost."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("buckets").alias(f"k{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column(2).to_pylist(), byte_rows(batch.column(3)), byte_rows(batch.column(4)), strict=True):
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                apart = np.abs(y.reshape(-1, len(x)).sum(0, dtype=np.int64) - x) if len(y) == len(x) or y.max(initial=0) < 255 else np.zeros(1, np.int64)
                keep.append((num + den) * (n - int(apart.sum())) >= 2 * num * n)  # at most (n - apart) / 2 are common
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ka", "kb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. b, the side with fewer repeats, meets its sets first."""
    met = pairs.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(byte_rows(batch.column(2)), byte_rows(batch.column(3)), strict=True):
                x, y = np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _candidates(members: DataFrame, labels: DataFrame | None, how: str) -> DataFrame:
    """Pairs (a, b) of a group's centre and its other classes; only from groups of a key that are not one component yet."""
    mine = _with_component(members, labels)
    centre = F.struct(-F.col("n_keys"), F.col("class")) if how == "hub" else F.struct(F.xxhash64("class", F.lit(how)), F.col("class"))
    groups = mine.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct(centre.alias("o"), F.col("class").alias("class"), F.col("comp").alias("comp"))).alias("m"))
    groups = groups.where("c0 <> c1").select("key", F.col("m.class").alias("a"), F.col("m.comp").alias("ca"))
    return groups.join(mine.select("key", F.col("class").alias("b"), F.col("comp").alias("cb")), "key").where("ca <> cb").select("a", "b").distinct()


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("class"))
    return members.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select(*members.columns, F.coalesce("component", "class").alias("comp"))


def _frequencies(sets: DataFrame, shingles: int) -> np.ndarray:
    """How many of the sets have a shingle of each cell, in steps of a twelfth (of a logarithm): a byte a cell, FREQUENCIES[1] bytes at most.

    The order need only be the same for all sets; where cells are shared by several shingles it is less sharp, and no link is lost.
    """
    cells = min(FREQUENCIES[1], max(FREQUENCIES[0], 1 << (4 * shingles).bit_length()))
    part = 1 << 14

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch in batches:
            for x in byte_rows(batch.column(0)):
                np.add.at(total, (np.frombuffer(x.tobytes(), np.uint64) % np.uint64(cells)).astype(np.int64), 1)
        parts = total.astype("<i4").reshape(-1, part)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i4").astype(np.float64) for x in rows.column("counts").to_pylist())
        steps = np.minimum(np.round(12 * np.log1p(total)), 255).astype(np.uint8)
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([steps.tobytes()], pa.binary())})

    out = np.zeros((cells // part, part), np.uint8)
    for row in sets.select("shingles").mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").toLocalIterator():  # a byte a cell in all
        out[row["part"]] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def _open_pairs(members: DataFrame, labels: DataFrame | None, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of groups that are not one component, a and b being of different components.

    A group of SMALL classes at most gives its pairs, a bounded number for each class. Larger ones are searched by
    their shingles. Two similar sets share a shingle among the first few of each in any one order of all shingles. Here rare ones
    come first. A match at places p and q leaves at most min(n - p, m - q) common shingles, which bounds the sizes
    of partners for each place, so the join's key holds the partner's size band too. Of a group of a shingle all
    but the commonest component meet the rest, so a large group that is one component but for a few costs little.
    """
    mine = _with_component(members, labels)
    open_keys = mine.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 <> c1").select("key", F.col("many") <= SMALL)
    open_keys = open_keys.toDF("key", "small")
    open_rows = save(mine.join(open_keys, "key").select("key", "class", "comp", "small"), "open-groups")
    few = open_rows.where("small")
    direct = few.select("key", F.col("class").alias("a"), F.col("comp").alias("ca")).join(few.select("key", F.col("class").alias("b"), F.col("comp").alias("cb")), "key").where("a < b and ca <> cb").select("a", "b")
    classes = open_rows.where("not small").select("class", "comp").distinct()
    rows = save(sets.join(classes, "class").select("class", "comp", "n", "shingles"), "open-sets")
    held = rows.sparkSession.sparkContext.broadcast(_frequencies(rows, rows.agg(F.sum("n")).first()[0] or 0))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for c, comp, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch.column(3)), strict=True):
                x = np.frombuffer(x.tobytes(), np.uint64)
                n = len(x)
                x = x[np.lexsort((x, often[(x % np.uint64(len(often))).astype(np.int64)]))]
                first = x[: n - -(-n * num // den) + 1].view(np.int64)
                out.append((first, np.full(len(first), c), np.full(len(first), comp), np.full(len(first), n), np.arange(len(first))))
            shingle, c, comp, n, place = (np.concatenate(z) for z in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (shingle, c, comp, n, place)], names=["shingle", "class", "comp", "n", "place"])

    places = save(rows.mapInArrow(run, "shingle long, class long, comp long, n long, place long"), "first-shingles")
    by_comp = places.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("many"))
    major = by_comp.groupBy("shingle").agg(F.max_by("comp", F.struct("many", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("shingle", "major")
    places = places.join(major, "shingle")
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(1.02)))
    least = F.ceil(F.col("n") * num / den)
    index = places.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den))).withColumn("band", band(F.col("n")))
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("place")) * (num + den) / num - F.col("n")))
    probe = places.where(most >= least).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    small = lambda df: df.select("shingle", "band", F.col("class").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("major").alias("ma"))
    large = lambda df: df.select("shingle", "band", F.col("class").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    fits = f"a <> b and ca <> cb and na <= nb and {num + den} * least(na - pa, nb - pb) >= {num} * (na + nb)"
    outer = small(index.where("comp <> major")).join(large(probe), ["shingle", "band"]).where(fits)
    inner = small(index.where("comp = major")).join(large(probe.where("comp <> major")), ["shingle", "band"]).where(fits)
    found = outer.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(direct).distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the least doc_id that links of similarity num / den or more reach."""
    return jaccard_groups(docs, id_col, text_col, k, num, den).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """As jaccard_classes, with text_key (xxhash64 of the text) and group_key (of the component; null without shingles or doc_id).

    Rows that repeat a doc_id with different texts have the group_key of their own text each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plan = Allocation(num, den)
    base = save(_base(docs, k, plan), "shingle-sets")
    entries = base.agg(F.sum("n_keys")).first()[0] or 0
    classes = base.where("doc_id is not null and n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))

    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SLICE_ENTRIES))
    keys = _packed_keys(docs, k, plan, slices)
    shared = save(keys.groupBy("slice").applyInArrow(_shared_keys, "key long, class long, common boolean"), "shared-keys")
    members = save(_without_common(shared), "shared-keys")
    involved = save(members.select("class").distinct().join(classes, "class"), "involved")
    sets = save(_whole_sets(docs, involved, k), "whole-sets")
    drop_saved(shared, involved)

    links, tested, labels = None, None, None
    for how in ("hub", "1", "all"):
        pairs = _open_pairs(members, labels, sets, num, den) if how == "all" else _candidates(members, labels, how)
        if how == "all" and tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = save(pairs, "candidates")
        if pairs.isEmpty():
            continue
        near = save(_near(pairs, sets, num, den), "near")
        good = save(_verified(near, sets, num, den), "links")
        drop_saved(near)
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = ordered if tested is None else tested.unionByName(ordered)
        links = good if links is None else links.unionByName(good)
        labels = components(links)
    drop_saved(members, sets, *([tested] if tested is not None else []))
    if labels is None:
        placed = classes.select("class", F.col("class").alias("group_key"), F.col("rep").alias("component_id"))
    else:
        known = classes.join(labels, classes["class"] == labels["node"], "left").select("class", "rep", F.coalesce("component", "class").alias("group_key"))
        least = known.groupBy("group_key").agg(F.min("rep").alias("component_id"))
        placed = known.join(least, "group_key").select("class", "group_key", "component_id")
    placed = placed.withColumnRenamed("class", "_c")
    alone = base["n_shingles"] == 0
    met = base.join(placed, (base["class"] == placed["_c"]) & base["doc_id"].isNotNull() & ~alone, "left")
    return met.select("doc_id", "text_key", "n_shingles", "group_key", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
