"""Near duplicates by SimHash with multi-index hashing, each candidate verified by the Jaccard similarity of shingles.

Two texts are linked if the sets of their 5-word shingles have similarity 0.8 or more; a group is all that is linked,
over any number of links. A set's fingerprint has 1,024 bits, each the majority of that bit over its shingles. Two sets of
0.8 differ in 15 % of the bits (arccos(8/9) / pi), so 64 bits with a small radius, as `simhash` has them, miss most such
pairs. Here segments of a fingerprint are looked up whole, so many of them that a pair of 0.8 agrees in none with a chance
of 1 in 100,000; a segment has the more bits the more texts there are, so that a bucket of unlike ones holds 512 or fewer
on average. In a bucket the first 192 bits, which are in no segment, are compared, and those within 58 are candidates: 5
standard deviations above a pair of 0.8, and 5 below unlike texts. Sets of four and of five shingles differ in more bits,
as four make many ties, so a set of five is looked up by each four of its shingles too.

Texts with one set of shingles become one row first. Of a bucket only candidates go on, those that are joined by close
fingerprints; what buckets join, over any number of them, is a crowd, and only within it are sets held against each other.
A crowd may be large and have few links, so its members don't all meet: in the order of how many sets of the crowd have a
shingle, rarest first, two sets of 0.8 share one of the first fifth of their shingles, or else they couldn't share enough of
the rest, and the smaller one has it in its first ninth. Those who have a shingle among their first ones make a list, if one
has it in its first ninth, and only a list's members meet. Of a small crowd all meet. So no link of a crowd is lost, and the
rows of lists are first shingles, in proportion to the texts.

In a list, pairs of one group need no look. Where many pairs are left, the members are held against a few leaders, those
that share most with others, more of them in each round, and what that links is grouped before the next, by a search of two
links only; when few are left, each is verified. Sets of one dense group lie together, and another's set goes by them once,
not once a pair; there, pairs of groups that have been linked already need no look. So a list of very many near copies costs
little more than its rows, and no pair of a list is left out unless both are in one group already. All links together are
joined to whole groups at the end. `linked` calls lists buckets, as any will do for it.

Defined results: texts without words are one group; a text of fewer than five words is one shingle; case counts for
nothing in A to Z; rows with one id and one text stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import checkpointed, require, small_parts
from scanloom.llm.components import components
from scanloom.llm.simhash import keep_least_of_each
from scanloom.sources.tables import LoopTables

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Bits of a fingerprint, how many of them, the first, are compared, and at how many that differ two sets are candidates.
BITS, COMPARED, MAX_DISTANCE = 1024, 192, 58
#: The share of bits in which two sets of SIMILARITY differ, and the chance that such sets agree in no segment.
DIFFERENT, MISSED = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi, 1e-5
#: Texts that share a segment by chance, at most, as a power of two; and the bits of a segment at least.
BUCKET_BITS, LEAST_BITS = 9, 4
#: Different sets of SIMILARITY share so many shingles at least.
LEAST_SHARED = 4
#: Shingles whose bits are counted at once, in a byte; segments that are made at once; fingerprints compared at once.
COUNTED, SEGMENTS_AT_ONCE, SOME, OTHERS = 255, 1 << 15, 256, 1 << 12
#: Pairs in buckets for each distinct text, at most, that are verified without another round of leaders.
PAIRS_A_TEXT = 60
#: Leaders of a bucket in the first round, and how many times as many in each next one: a round reads all open buckets.
LEADERS, MORE_LEADERS = 16, 16
#: Sets that lie together while others are held against them.
HOME_SETS = 2048
#: Members of a crowd, at most, that all meet: their pairs are few.
SMALL_CROWD = 16
LINKS = "a long, b long, a_root long, b_root long"

#: A shingle's hash times each of these gives 32 bits.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    n, hash_of, join = max(1, len(words) - shingle_words + 1) if words else 0, xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((hash_of(join(words[i : i + shingle_words]), SEED) for i in range(n)), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Of a set of shingles: each bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, COUNTED):
        words = ((hashes[at : at + COUNTED, None] * _FACTORS) >> np.uint64(32)).astype(np.uint32)
        counts += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > hashes.size).tobytes()


def fingerprints(hashes: np.ndarray) -> bytes | None:
    """All fingerprints under which a set is looked up, end to end: its own; and, as a set of four makes many ties, that of
    each four of a set of five. None if it is too small for a different one of SIMILARITY."""
    if hashes.size < LEAST_SHARED:
        return None
    fours = [np.delete(hashes, i) for i in range(hashes.size)] if hashes.size == LEAST_SHARED + 1 else []
    return b"".join(map(fingerprint, [hashes, *fours]))


def segment_places(texts: int) -> np.ndarray:
    """The bits of each segment for so many different sets, one row a segment. All bits beyond those that are compared are
    used before one is used again, then with other ones."""
    width = max(LEAST_BITS, (texts - 1).bit_length() - BUCKET_BITS)
    count = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFERENT) ** width)))
    generator, a_turn = np.random.default_rng(SEED), (BITS - COMPARED) // width
    turns = [generator.permutation(np.arange(COMPARED, BITS))[: a_turn * width] for _ in range(-(-count // a_turn))]
    return np.concatenate(turns).reshape(-1, width)[:count]


def parts(prints: np.ndarray) -> np.ndarray:
    """prints: the compared bits as unsigned numbers, one row a set. A number for each row, the same for those that are
    joined by prints within MAX_DISTANCE, over any number of them. Rows of one part aren't held against each other again
    and small parts come first, so very many close prints cost little more than their rows."""
    part, todo = np.arange(len(prints)), np.arange(len(prints))
    while todo.size > 1 and (part[todo] != part[todo[0]]).any():
        some = todo[:SOME]
        for at in range(0, todo.size, OTHERS):
            others = todo[at : at + OTHERS]
            near = sum(np.bitwise_count(x[some, None] ^ x[others]) for x in prints.T) <= MAX_DISTANCE
            near &= part[some, None] != part[others]
            for nth in np.flatnonzero(near.any(axis=1)).tolist():
                joined = np.unique(part[np.append(others[near[nth]], some[nth])])
                if joined.size > 1:
                    part[np.isin(part, joined)] = joined[0]
        todo = todo[SOME:]
        todo = todo[np.argsort(np.bincount(part)[part[todo]], kind="stable")]
    return part


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _node(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def _sketches(rows: DataFrame, shingle_words: int) -> DataFrame:
    """rows: id, h and text. id, h, node (of the set of shingles) and print, its fingerprints."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 2):
            nodes, prints = [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), shingle_words)
                nodes.append(_node(own))
                prints.append(fingerprints(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], ["id", "h", "node", "print"])

    return rows.mapInArrow(sketch, f"id {dict(rows.dtypes)['id']}, h long, node long, print binary")


def _buckets(nodes: DataFrame, texts: int) -> DataFrame:
    """nodes: node and print, each once, texts in number. key and node of all candidates: those of one segment whose compared
    bits are close, or joined by close ones, have one key."""
    places = segment_places(texts)
    weights, words = 1 << np.arange(places.shape[1]), COMPARED // 64

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SEGMENTS_AT_ONCE // len(places))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                of_each = own.column(1).to_pylist()
                node = np.repeat(own.column(0).to_numpy(), [len(p) * 8 // BITS for p in of_each])
                prints = np.frombuffer(b"".join(of_each), np.uint8).reshape(-1, BITS // 8)
                bits = np.unpackbits(prints, axis=1)
                keys = np.concatenate([bits[:, p] @ weights + (nth << p.size) for nth, p in enumerate(places)])
                compared = np.ascontiguousarray(prints[:, : COMPARED // 8]).view(np.int64)
                columns = [keys, *(np.tile(x, len(places)) for x in (node, *compared.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def candidates(keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        found_keys, found_nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), keys.size], strict=True):
            part = parts(np.stack([c[low:high] for c in columns[1:]], axis=1).view(np.uint64))
            if np.unique(part).size == part.size:
                continue
            order = np.lexsort((columns[0][low:high], part))
            part, node = part[order], columns[0][low:high][order]
            once = np.append(True, (np.diff(part) > 0) | (np.diff(node) != 0))
            part, node = part[once], node[once]
            begins = np.flatnonzero(np.diff(part, prepend=-1))
            sizes = np.diff(np.append(begins, part.size))
            own = [_signed(xxhash.xxh64_intdigest(np.array([keys[low], x]).tobytes(), SEED)) for x in node[begins].tolist()]
            several = np.repeat(sizes > 1, sizes)
            found_keys.append(np.repeat(np.array(own, np.int64), sizes)[several])
            found_nodes.append(node[several])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_keys)), pa.array(np.concatenate(found_nodes))], ["key", "node"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            first, last = held[0][0][0], held[-1][0][-1]
            if first != last:  # all but the last key are whole
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(columns[0], last))
                held = [[c[cut:] for c in columns]]
                yield candidates(columns[0][:cut], [c[:cut] for c in columns[1:]])
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield candidates(columns[0], columns[1:])

    names = ["key", "node", *(f"bits{i}" for i in range(words))]
    rows = nodes.filter("print IS NOT NULL").select("node", "print").mapInArrow(segments, ", ".join(f"{n} long" for n in names))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(close, "key long, node long")


def _sets(rows: DataFrame, shingle_words: int) -> DataFrame:
    """rows: node and text. node and hashes, the set of its shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1):
            found = [np.sort(shingles(text.as_py(), shingle_words).view(np.int64)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    return rows.mapInArrow(sets, "node long, hashes array<long>")


def _crowds(buckets: DataFrame) -> DataFrame:
    """buckets: key and node, each once. node, crowd, the least node that buckets join it to, and members, how many it has,
    of all nodes that share a bucket."""
    least = buckets.groupBy("key").agg(F.min("node").alias("least"))
    # a node is linked to the least of the least ones of its buckets, and so are those: in a dense crowd they are few
    of = buckets.join(least, "key").groupBy("node").agg(F.collect_set("least").alias("ends"), F.min("least").alias("least"))
    found = components(of.select(F.explode(F.array_union("ends", F.array("node"))).alias("end"), "least")).withColumnRenamed("root", "crowd")
    return checkpointed(found.join(found.groupBy("crowd").agg(F.count(F.lit(1)).alias("members")), "crowd").select("node", "crowd", "members"))


def _lists(crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """crowds: node, crowd and members; sets: node and hashes. key and node, each once: any two of a crowd that are similar
    enough have a key in common, that of a shingle which is among the rarest of both, or, if it is small, that of the crowd."""
    small = crowds.filter(F.col("members") <= SMALL_CROWD).select(F.col("crowd").alias("key"), "node")
    large = crowds.filter(F.col("members") > SMALL_CROWD).select("node", "crowd")
    each = sets.join(large, "node").select("node", "crowd", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    shared = each.groupBy("crowd", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = each.join(shared, ["crowd", "h"]).groupBy("node", "crowd", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("rarest"))
    # two similar sets share one of the first shingles of each, in the smaller set one of the fewer that are meant by short;
    # those that no other set has come before the rarest
    own = own.withColumn("alone", F.col("size") - F.size("rarest"))
    long, short = (F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1 - F.col("alone") for share in (similarity, 2 * similarity / (1 + similarity)))
    own = own.withColumn("long", long.cast("int")).withColumn("short", short).filter("long > 0")
    own = own.select("node", "crowd", "short", F.posexplode(F.slice("rarest", F.lit(1), F.col("long"))).alias("nth", "x"))
    own = checkpointed(own.select(F.xxhash64("crowd", "x.h").alias("key"), "node", (F.col("nth") < F.col("short")).alias("short")))
    of_smaller = own.groupBy("key").agg(F.max("short").alias("short"), F.count(F.lit(1)).alias("n")).filter("short AND n > 1")
    return small.unionByName(own.join(of_smaller.select("key"), "key").select("key", "node"))


def _alike(few: DataFrame, rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """few: key, a and root, of some members of the buckets; rows: key, node, root and home of all. The pairs (a, b) of one
    bucket and two roots whose sets are similar enough, with a_root and b_root. Sets lie at home, with those of their largest
    bucket; that of an a goes to each home of a member of its buckets once, and streams by. Which members it meets is seen
    there: pairs are never rows."""
    root = F.first("root").alias("root")
    members = rows.groupBy("node").agg(F.first("home").alias("home"), F.lit(False).alias("asks"), root, F.collect_list("key").alias("keys"))  # a key a segment at most
    visits = few.join(rows.select("key", "home").distinct(), "key").groupBy("home", F.col("a").alias("node")).agg(root, F.collect_list("key").alias("keys"))
    met = members.unionByName(visits.withColumn("asks", F.lit(True))).join(sets, "node").select("home", "asks", "node", "root", "keys", "hashes")
    met = met.repartition("home").sortWithinPartitions("home", "asks", "node")  # in every home the same leader comes first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, here = None, _Home(similarity)
        for batch in batches:
            for part in small_parts(iter([batch]), 5):
                found = []
                for own, asks, node, root, keys, hashes in zip(*(part.column(i).to_pylist() for i in range(5)), part.column(5), strict=True):
                    if own != home:
                        home, here = own, _Home(similarity)
                    if asks:
                        found += [(node, other, root, its_root) for other, its_root in here.links_of(root, keys, hashes.values.to_numpy())]
                    else:
                        here.add(node, root, keys, hashes.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["a", "b", "a_root", "b_root"])

    return met.mapInArrow(compare, LINKS)


class _Home:
    """Sets that lie together, and which of their groups have been linked here so far. A set that goes by is held against
    those of its buckets that are in another group, so of a dense group few comparisons are left after the first links."""

    def __init__(self, similarity: float):
        self.similarity, self.nodes, self.sets, self.of_root, self.in_bucket = similarity, [], [], {}, {}
        self.group = self.sizes = None

    def add(self, node: int, root: int, keys: list[int], hashes: np.ndarray) -> None:
        for key in keys:
            self.in_bucket.setdefault(key, []).append(len(self.nodes))
        self.nodes.append(node)
        self.sets.append((root, hashes.copy()))

    def _group(self, root: int) -> int:
        while (above := self.of_root.get(root, root)) != root:
            root = above
        return root

    def links_of(self, root: int, keys: list[int], hashes: np.ndarray) -> list[tuple[int, int]]:
        """The nodes here that the set links to, one of each group that is new to it, with their roots; all adds come before."""
        if self.group is None:
            self.group = np.array([r for r, _ in self.sets], np.int64)
            self.sizes = np.array([x.size for _, x in self.sets], np.int64)
            self.in_bucket = {key: np.array(places) for key, places in self.in_bucket.items()}
        own, found = self._group(root), []
        others = [places[self.group[places] != own] for key in keys if (places := self.in_bucket.get(key)) is not None]
        others = np.unique(np.concatenate(others)) if others else np.empty(0, np.int64)
        sizes = self.sizes[others]
        others = others[np.minimum(sizes, hashes.size) >= self.similarity * np.maximum(sizes, hashes.size)]
        for other in others.tolist():
            if (linked := int(self.group[other])) == own:
                continue
            its_root, y = self.sets[other]
            if _shared(hashes, y) >= self.similarity * (hashes.size + y.size) / (1 + self.similarity) - 1e-9:
                found.append((self.nodes[other], its_root))
                self.of_root[linked] = own
                self.group[self.group == linked] = own
        return found


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # of two sorted runs: a merge
    return int((both[1:] == both[:-1]).sum())


def _members(buckets: DataFrame) -> DataFrame:
    """buckets: key and node, each once. Of each node that shares a bucket: home, which is its largest bucket, or a part of it
    if that has more than HOME_SETS nodes; weight, the size of all its buckets; and those, with key, n (nodes) and top."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("top")).filter("n > 1")
    of = buckets.join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct("key", "n", "top")).alias("buckets"), F.max(F.struct("n", "key")).alias("x"), F.sum("n").alias("weight"))
    return of.select("node", F.xxhash64("x.key", F.pmod(F.xxhash64("node"), F.ceil(F.col("x.n") / HOME_SETS))).alias("home"), "weight", "buckets")


def _open(rows: DataFrame) -> DataFrame:
    """rows, without top and pairs: those of buckets with several groups, with top, the root of the largest group, and pairs,
    a row's part of the pairs of two groups."""
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    sizes = sizes.filter(F.col("top.n") < F.col("all")).select("key", F.col("top.root").alias("top"), ((F.col("all") - F.col("squares") / F.col("all")) / 2).alias("pairs"))
    return rows.join(sizes, "key")


def _nearby(links: DataFrame) -> DataFrame:
    """(old, new) of each end of links: new is the least end within two links, so ends with one new are of one component."""
    a, b = links.columns
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).unionAll(links.select(F.col(b).alias("a"), F.col(a).alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return both.join(least, "b").groupBy(F.col("a").alias("old")).agg(F.min("m").alias("new"))


def linked(buckets: DataFrame, sets: DataFrame, texts: int, similarity: float = SIMILARITY) -> DataFrame:
    """buckets: key and node, each once; sets: node and hashes. Gives (node, root) of all nodes with a link: no pair of
    a bucket that is similar enough is in two groups."""
    members, leaders = checkpointed(_members(buckets)), LEADERS
    with LoopTables(members.sparkSession) as kept:
        rows = members.select("node", F.col("node").alias("root"), "home", "weight", F.inline("buckets"))
        rows = kept.put("rows", rows.select("key", "node", "root", "home", "weight", "top", ((F.col("n") - 1) / 2).alias("pairs")))
        while True:
            pairs_left = rows.agg(F.sum("pairs")).first()[0]
            if not pairs_left:
                return components(kept.all("links", LINKS).select("a", "b"))
            # of each pair of two groups, one isn't of the bucket's largest
            few = rows.filter("root != top").select("key", F.col("node").alias("a"), "root", "weight")
            last = pairs_left <= PAIRS_A_TEXT * texts
            if not last:
                # leaders are those that share the most with others
                few = few.groupBy("key", F.pmod(F.xxhash64("a"), F.lit(leaders)).alias("share")).agg(F.max(F.struct("weight", "a", "root")).alias("x")).select("key", "x.a", "x.root")
                few = kept.put("few", few)
            links = kept.add("links", _alike(few, rows, sets, similarity))
            if last:
                return components(kept.all("links", LINKS).select("a", "b"))
            # linked roots with one new root are of one group, if not all of it; more isn't needed between rounds
            nearby = kept.put("nearby", _nearby(links.select("a_root", "b_root")))
            rows = rows.drop("top", "pairs").join(few.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
            rows = rows.join(nearby, F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")
            rows = kept.put("rows", _open(kept.put("merged", rows)))
            leaders *= MORE_LEADERS


def keep_one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the least id; all columns stay."""
    require(docs, id_column, text_column)
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the segments are made for a similarity of {SIMILARITY} or more")
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("h"), F.col(text_column).alias("text"))
    rows = checkpointed(_sketches(texts, shingle_words))
    nodes = rows.groupBy("node").agg(F.first("print").alias("print"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("of"))
    nodes = checkpointed(nodes)
    different = nodes.count()
    crowds = _crowds(checkpointed(_buckets(nodes, different)))
    wanted = nodes.join(crowds.select("node"), "node").select("node", F.col("of.id").alias("of_id"), F.col("of.h").alias("of_h"))
    sets = texts.join(wanted, (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of_id"))).select("node", "text")
    sets = checkpointed(_sets(sets, shingle_words).dropDuplicates(["node"]))
    roots = linked(_lists(crowds, sets, similarity), sets, different, similarity)
    found = rows.drop("print").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return keep_least_of_each(docs, found, id_column, text_column)
