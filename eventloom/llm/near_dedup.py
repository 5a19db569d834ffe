"""Near-duplicate detection by b-bit MinHash.

1. Every text becomes its set of distinct word shingles and 128 minima of it. Four minima make a band
   key; the low four bits of all minima are packed into eight 64-bit words, one bit plane after another.
2. Texts with equal sets are one class from here on, so copies cost nothing further.
3. Classes that share a band key are candidates. Similarity is estimated from the packed words: places
   where no plane differs agree, and agreement is corrected for minima that collide in their low bits.
   Only pairs within six standard deviations of the threshold go on, so that none is lost to chance.
4. Pairs are confirmed on the full shingle sets, and links are joined into components.

Groups are not paired out. Buckets of `SMALL` members or fewer are paired in full. In a larger bucket,
cut into ranges of similar set sizes, all members meet one hub, the member that stands in the most and largest
buckets, so that buckets agree on their hubs. From then on a member x is what it lacks and adds against
its hub, D(x). As |x sym y| = |D(x)| + |D(y)| - 2 |D(x) and D(y)|, two members that are linked, one of them
not with the hub, share a known number of elements of their differences. These are put in one order, the
frequent ones last, and two members of different components are looked at only if they share one so early
that the rest can still reach that number. What copies have in common never comes up, and members that
merely come near the threshold share nothing early. No candidate is capped. What lies in one component needs
no further pair.

The sets of members are written once, and every comparison reads these, never texts.

Nulls and ties: a text that is null or has no words has an empty set and is linked with nothing. A
component is named by its smallest id, a null id counting only where there is no other. Rows with the
same id and text are all reported; `drop_near_duplicates` lets one of them stay. An empty table gives
an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import cut
from .components import components
from .shingles import mix64, random64, shingle_sets

MINIMA, BAND_MINIMA, BITS = 128, 4, 4
BANDS = MINIMA // BAND_MINIMA
PLANES = [f"s{i}" for i in range(BITS * MINIMA // 64)]
#: Members of a bucket that are paired in full.
SMALL = 8
DEVIATIONS = 6
#: Members of a hub from which on the frequent elements of differences are looked for, among as many members
#: and the elements of least hash of each.
SAMPLE, SAMPLE_ELEMENTS = 64, 1024
#: Frequent elements that are kept for a hub; all others count as rare, which costs time only.
FREQUENT = 256
#: Keys for which a table of bits, `BITS_PER_KEY` for each, is broadcast; with more keys all rows are joined.
BIT_TABLE_KEYS, BITS_PER_KEY = 500_000, 16

_FLIP = random64(MINIMA, 11)
_TIMES = random64(MINIMA, 12) | np.uint64(1)
_BAND = random64(BAND_MINIMA, 13) | np.uint64(1)
_HALF = np.uint64(32)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (n, 2), band keys (n, BANDS) and packed planes (n, PLANES) of sets that are not empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    digests = np.stack([np.add.reduceat(every, starts), np.add.reduceat(mix64(every ^ _FLIP[0]), starts)], 1)
    minima = np.empty((len(sets), MINIMA), np.uint64)
    work = np.empty_like(every)
    for i in range(MINIMA):
        np.bitwise_xor(every, _FLIP[i], out=work)
        np.multiply(work, _TIMES[i], out=work)
        np.right_shift(work, _HALF, out=work)
        minima[:, i] = np.minimum.reduceat(work, starts)
    bands = mix64((minima.reshape(len(sets), BANDS, BAND_MINIMA) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    planes = [np.packbits((minima >> np.uint64(bit) & np.uint64(1)).astype(bool), axis=1, bitorder="little").view(np.uint64) for bit in range(BITS)]
    return digests, bands, np.concatenate(planes, 1)


def _signer(width: int, schema: pa.Schema):
    def sign(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(3), width):
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests = np.zeros((len(sets), 2), np.uint64)
                bands = np.zeros((0, BANDS), np.uint64)
                planes = np.zeros((len(sets), len(PLANES)), np.uint64)
                if len(full):
                    digests[full], bands, planes[full] = _signatures([sets[i] for i in full])
                ends = np.cumsum(np.concatenate([[0], np.where(sizes > 0, BANDS, 0)])).astype(np.int32)
                arrays = [
                    *(batch.column(i).slice(first, len(sets)) for i in range(3)), pa.array(sizes),
                    *(pa.array(np.ascontiguousarray(digests[:, i]).view(np.int64)) for i in range(2)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64))),
                    *(pa.array(np.ascontiguousarray(planes[:, i]).view(np.int64)) for i in range(len(PLANES))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema)

    return sign


def agreeing(left: str, right: str) -> Column:
    """How many of the minima agree in all low bits, by bit counts over the packed planes."""
    words = MINIMA // 64
    out = F.lit(MINIMA)
    for w in range(words):
        differ = None
        for bit in range(BITS):
            name = PLANES[bit * words + w]
            x = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
            differ = x if differ is None else differ.bitwiseOR(x)
        out = out - F.bit_count(differ)
    return out


def least_similarity(percent: int) -> float:
    """The estimate below which a pair of at least `percent` similarity is ruled out."""
    similar = percent / 100
    return max(0.0, similar - DEVIATIONS * math.sqrt(similar * (1 - similar) / MINIMA))


def similarity(agree: Column) -> Column:
    """The estimate of similarity, corrected for minima that collide in their low bits."""
    chance = 2.0**-BITS
    return (agree / MINIMA - chance) / (1 - chance)


def _sized(percent: int) -> Column:
    return F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent


def _small_pairs(members: DataFrame, planes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small buckets that may reach the threshold."""
    members = cut(members.join(planes, "class"))
    near = similarity(agreeing("x", "y")) >= least_similarity(percent)
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & _sized(percent) & near
    pairs = members.alias("x").join(members.alias("y"), on)
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _hubs(members: DataFrame, percent: int) -> DataFrame:
    """(class, hub): the hubs of the large buckets that a class stands in.

    Ranges of set sizes overlap, so that two sets of similar sizes are in one; within a range sizes differ
    by a bounded factor, so a set is never compared with one that is much larger.
    """
    weight = F.sum("m").over(Window.partitionBy("class"))
    step = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * 1.001)) if percent < 100 else F.col("n")
    ranged = members.withColumn("weight", weight).withColumn("size", F.explode(F.array(step - 1, step)))
    hub = F.max(F.struct("weight", (-F.col("class")).alias("class"))).alias("hub")
    hubs = ranged.groupBy("key", "size").agg(hub).select("key", "size", (-F.col("hub.class")).alias("hub"))
    return ranged.join(hubs, ["key", "size"]).filter("class <> hub").select("class", "hub").distinct()


class _Links:
    """Sets of classes, and the components that confirmed links make."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.labels = None

    def component(self, df: DataFrame, node: str = "class", name: str = "component") -> DataFrame:
        """`df` with the component of a class; a class without links is one by itself."""
        if self.labels is None:
            return df.withColumn(name, F.col(node))
        label = self.labels.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(label, node, "left").withColumn(name, F.coalesce(name, node))

    def both(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs with the full sets of their ends, `_a` and `_b`."""
        sets = self.sets
        return pairs.join(sets.select(F.col("class").alias(a), F.col("shingles").alias("_a")), a).join(
            sets.select(F.col("class").alias(b), F.col("shingles").alias("_b")), b)

    def similar(self, common: Column, first: Column, second: Column) -> Column:
        return common * (100 + self.percent) >= (first + second) * self.percent

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        common = F.size(F.array_intersect("_a", "_b"))
        return self.both(pairs.select("a", "b"), "a", "b").filter(self.similar(common, F.size("_a"), F.size("_b"))).select("a", "b")

    def add(self, links: DataFrame) -> None:
        """Join what is linked."""
        links = cut(links.distinct())
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = components(links)
            return
        # Only components and classes without one are joined anew.
        ends = self.component(self.component(links, "a", "_a"), "b", "_b")
        merged = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).toDF("component", "_into")
        before = self.labels.join(merged, "component", "left").select("node", F.coalesce("_into", "component").alias("component"))
        fresh = merged.join(self.labels, F.col("node") == merged["component"], "left_anti").toDF("node", "component")
        self.labels = cut(before.union(fresh))

    def against_hubs(self, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(class, hub, n, adds, lacks) for (class, hub), and the links (a, b) of classes with their hubs."""
        # Dealt out anew: the members of one hub were made side by side.
        differ = cut(self.both(hubs, "class", "hub").select(
            "class", "hub", F.size("_a").cast("long").alias("n"), F.size("_b").alias("_of_hub"),
            F.array_except("_a", "_b").alias("adds"), F.array_except("_b", "_a").alias("lacks")).repartition("class", "hub"))
        linked = differ.filter(self.similar(F.col("n") - F.size("adds"), F.col("n"), F.col("_of_hub")))
        return differ.drop("_of_hub"), linked.select(F.col("class").alias("a"), F.col("hub").alias("b"))

    def sharing_early(self, differ: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of one hub, in different components, that may be linked."""
        members = cut(self.component(self.component(differ), "hub", "main"))
        several = members.groupBy("hub").agg(
            F.count(F.lit(1)).alias("members"), F.max("n").alias("largest"),
            F.max(F.col("component") != F.col("main")).alias("_open")).filter("_open")
        members = members.join(cut(several.select("hub", "members", "largest")), "hub")
        elements = members.filter(
            (F.col("members") > SAMPLE) & (F.pmod(F.xxhash64("class", "hub"), F.lit(1 << 30)) * F.col("members") < SAMPLE * (1 << 30)))
        some = F.slice(F.array_sort(F.concat("adds", "lacks")), 1, SAMPLE_ELEMENTS)
        most = elements.groupBy("hub").agg(F.flatten(F.collect_list(some)).alias("elements")).mapInArrow(
            _frequent, "hub long, frequent array<long>, often array<long>")
        given = members.join(most, "hub", "left").select(
            "hub", "class", "component", "main", "n", "adds", "lacks", "frequent", "often", "largest")
        early = cut(given.mapInArrow(
            _early(self.percent), "hub long, element long, class long, component long, main long, n long, d long, at long"))
        # The hub's component doesn't meet itself; what lies outside meets it, and the rest once.
        whole = F.col("x.n") + F.col("y.n")
        least = F.expr(f"((x.n + y.n) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        room = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
        reach = room * 2 >= F.col("x.d") + F.col("y.d") - whole + least * 2
        once = (F.col("y.component") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))
        on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & once & _sized(self.percent)
        pairs = early.filter("component <> main").alias("x").join(
            early.alias("y"), on & (F.col("x.component") != F.col("y.component")) & reach)
        return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _frequent(batches):
    """The most frequent elements of each hub's sample, in ascending order, and how often they come up."""
    for batch in batches:
        hubs, found = batch.column(0), []
        for row in range(batch.num_rows):
            elements, often = np.unique(batch.column(1)[row].values.to_numpy(), return_counts=True)
            first = np.sort(np.argsort(-often, kind="stable")[:min(FREQUENT, int((often > 1).sum()))])
            found.append((elements[first], often[first]))
        yield pa.RecordBatch.from_arrays(
            [hubs, *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(2))], names=["hub", "frequent", "often"])


def _early(percent: int):
    """The elements of each difference by which a link that its hub doesn't make has to show."""

    def emit(batches):
        for batch in batches:
            parts, size = [], 0
            for row in range(batch.num_rows):
                hub, node, component, main, n = (batch.column(i)[row].as_py() for i in range(5))
                adds, lacks = (batch.column(i)[row].values.to_numpy() for i in (5, 6))
                elements = np.concatenate([adds, lacks])
                seldom = np.zeros(len(elements), np.int64)
                if batch.column(7)[row].is_valid and len(batch.column(7)[row]):
                    frequent, often = (batch.column(i)[row].values.to_numpy() for i in (7, 8))
                    place = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
                    seldom = np.where(frequent[place] == elements, often[place], 0)
                order = np.lexsort((elements, np.arange(len(elements)) >= len(adds), seldom))
                # Of d elements at least max(1, d - h) are shared, h the most that two linked sets of such sizes differ by.
                partner = min(batch.column(9)[row].as_py(), n * 100 // percent)
                most = (n + partner) * (100 - percent) // (100 + percent)
                first = elements[order][:len(elements) - max(1, len(elements) - most) + 1]
                fixed = [np.full(len(first), v, np.int64) for v in (node, component, main, n, len(elements))]
                parts.append([np.full(len(first), hub, np.int64), first, *fixed, np.arange(len(first))])
                size += len(first)
                if size > 100_000 or row == batch.num_rows - 1:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["hub", "element", "class", "component", "main", "n", "d", "at"])
                    parts, size = [], 0

    return emit


def _shingler(width: int):
    def explode(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), shingles], names=["class", "shingles"])

    return explode


def _bits(keys: DataFrame) -> tuple[DataFrame, Column, Column] | None:
    """A table of bits for (text_key, text_hash), with the word and the bit of a row; None if there are too many keys."""
    n = keys.count()
    if n > BIT_TABLE_KEYS:
        return None
    word = F.pmod(F.col("text_hash"), F.lit(max(1, n * BITS_PER_KEY // 64)))
    bit = F.shiftrightunsigned("text_key", 58).cast("int")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_mask")
    return keys.groupBy(word.alias("_word")).agg(mask), word, bit


def _maybe_in(rows: DataFrame, bits: tuple[DataFrame, Column, Column]) -> DataFrame:
    """Rows with `_maybe`: false if their key is surely none of the table's."""
    masks, word, bit = bits
    hit = F.call_function("shiftrightunsigned", F.coalesce("_mask", F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.withColumn("_word", word).join(F.broadcast(masks), "_word", "left").withColumn("_maybe", hit).drop("_word", "_mask")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with `text_key`, of id and text, and `text_hash`, by which they are found again."""
    return docs.withColumns({"text_key": F.xxhash64(F.lit("key"), F.col(id_col), F.col(text_col)), "text_hash": F.xxhash64(F.col(text_col))})


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, shingles) for (class, text_key, text_hash), each from one of its documents."""
    keyed = _keyed(docs, "_id", "_text").drop("_id")
    bits = _bits(wanted)
    if bits:
        keyed = _maybe_in(keyed, bits).filter("_maybe").drop("_maybe")
    one = keyed.join(wanted, ["text_key", "text_hash"]).dropDuplicates(["text_key", "text_hash"])
    return cut(one.select("class", "_text").mapInArrow(_shingler(width), "class long, shingles array<long>"))


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(_id, n, component, text_key, text_hash) for every row of (_id, _text)."""
    kind = docs.schema["_id"].dataType
    fields = [("_id", kind), ("text_key", T.LongType()), ("text_hash", T.LongType()), ("n", T.LongType()), ("_one", T.LongType()),
              ("_two", T.LongType()), ("bands", T.ArrayType(T.LongType())), *((p, T.LongType()) for p in PLANES)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    signed = _keyed(docs, "_id", "_text").select("_id", "text_key", "text_hash", "_text").mapInArrow(_signer(width, schema.names), schema)
    rows = cut(signed.withColumn("row", F.monotonically_increasing_id()))
    set_key = ["n", "_one", "_two"]
    first = F.min(F.struct("row", "text_key", "text_hash", "bands", *PLANES)).alias("first")
    classes = cut(rows.filter("n > 0").groupBy(*set_key).agg(first).select(
        *set_key, F.col("first.row").alias("class"), "first.text_key", "first.text_hash", "first.bands",
        *(F.col(f"first.{p}") for p in PLANES)))
    keys = classes.select("class", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut(keys.join(shared, "key"))
    wanted = cut(classes.select("class", "text_key", "text_hash").join(members.select("class"), "class", "left_semi"))
    found = _Links(_sets(docs, wanted, width), percent)
    planes = classes.select("class", *PLANES)
    pairs = _small_pairs(members.filter(f"m <= {SMALL}"), planes, percent)
    differ, with_hubs = found.against_hubs(_hubs(members.filter(f"m > {SMALL}"), percent))
    found.add(found.confirmed(pairs).unionAll(with_hubs))
    near = found.sharing_early(differ)
    near = near.join(planes.alias("x"), F.col("a") == F.col("x.class")).join(planes.alias("y"), F.col("b") == F.col("y.class"))
    found.add(found.confirmed(near.filter(similarity(agreeing("x", "y")) >= least_similarity(percent))))
    own = found.component(rows.join(classes.select(*set_key, "class"), set_key, "left"))
    return own.select("_id", "n", F.coalesce("component", "row").alias("component"), "text_key", "text_hash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of `docs`: id, `n_shingles`, `component_id`, `kept`."""
    own = _components(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), width, percent)
    names = own.groupBy("component").agg(F.min("_id").alias("component_id"))
    return own.join(names, "component").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one for each component, with all their columns.

    Rows that stand alone, as a table of bits of the others tells, pass without a shuffle.
    """
    key = ["text_key", "text_hash"]
    own = _components(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), width, percent)
    # Rows without words are one if they have the same id and text.
    bare = F.col("n") == 0
    own = cut(own.select("_id", *key, F.when(bare, F.col("text_key")).otherwise(F.col("component")).alias("_group"),
                         F.when(bare, F.col("text_hash")).otherwise(0).alias("_bare")))
    # Of several rows with a component's id (an id given to different texts) the least hash stays.
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "text_hash", "text_key")).alias("_stays")
    groups = cut(own.groupBy("_group", "_bare").agg(F.count(F.lit(1)).alias("_rows"), first).filter("_rows > 1"))
    doubtful = cut(own.join(groups.select("_group", "_bare"), ["_group", "_bare"], "left_semi").select(*key).distinct())
    staying = groups.select("_stays.text_key", "_stays.text_hash")
    marked = _keyed(docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    marked = marked.select("_doc", *key)
    bits = _bits(doubtful)
    if bits is not None:
        marked = _maybe_in(marked, bits)
        alone, marked = marked.filter("NOT _maybe").select("_doc.*"), marked.filter("_maybe")
    # A row with a bit that is in no group stands alone as well.
    looked = marked.join(doubtful.withColumn("_doubtful", F.lit(True)), key, "left").join(
        staying.withColumn("_staying", F.lit(True)), key, "left")
    chosen = looked.filter("_doubtful IS NULL OR _staying").dropDuplicates(key).select("_doc.*")
    return chosen if bits is None else alone.unionAll(chosen)
