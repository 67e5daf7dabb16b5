"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.common import file_system, forget_tables, new_folder, runtime_filter, small_batches
from textwarden.llm.components import components
from textwarden.sources.checkpoints import cut_lineage, delete_folder, let_go

#: Two documents link when PERCENT of the union of their shingles are in both.
SHINGLE, PERCENT = 3, 90
#: A region that is joined as it is has at most so many shingles, over all members, and at most so many
#: shingles times members, which is what joining it may cost; larger ones are divided by pivots.
LEAF, WORK = 4_000_000, 1_000_000
#: What two blocks of a region that pivots do not divide may cost to join, by the same measure.
BLOCK_WORK = 64_000_000
#: Regions of more than so many times the shingles that are joined as they are get formed anew by whole sets before they are
#: divided. This takes some twenty short jobs; smaller regions cost less than that in blocks, in proportion to their number.
LOOSE = 16
#: Divisions after which what is still large is joined in blocks.
DEPTH = 4
#: Cells of a region are gone into if they have at most this share of its pairs, and this many copies of its members.
USEFUL, WIDEST = 0.5, 16
#: Pivots keep this distance from each other; members this near to one are at home in its cell.
APART, NEAR = 0.3, 0.5
#: Windows of all documents, and the wider ones of those that remain: shingles that partners share in them,
#: as a share of those that may be missing.
FIRST, SECOND = 1 / 3, 1.0
#: Rounds in which documents without enough shared shingles leave before regions are formed.
PEELS = 2
_SLACK = 1e-9
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; of a shorter text the one of all its words."""
    # Bytes fold and split by ASCII alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed + hashed[k : len(words) - width + 1 + k]) * _M[k % 3]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def at_least(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any set that it links to."""
    return -(-percent * n // 100)


def shared_in_window(n: int, percent: int, width: float = FIRST) -> int:
    """How many of its first shingles, at least, a set of n shares with the window of one that it links to."""
    least = at_least(n, percent)
    return max(1, min(least, int((n - least) * width) + 1))


def window(n: int, percent: int, width: float = FIRST) -> int:
    """How many of the smallest shingles of a set stand for it.

    Of n shingles at most n - at_least(n) are missing in a partner, so among the first of
    that number plus l are the first l common ones.
    """
    return n - at_least(n, percent) + shared_in_window(n, percent, width)


def _fewest(n: Column, percent: int, width: float) -> Column:
    """shared_in_window() of the smallest set that a set of n can link to: it holds for every partner."""
    least = F.ceil(percent * n / 100)
    inner = F.ceil(percent * least / 100)
    return F.greatest(F.lit(1), F.least(inner, F.floor((least - inner) * F.lit(width)) + 1))


def _profiles(docs: DataFrame, size: int, percent: int, width: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = [shingles(t, size) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "first": [s[: window(len(s), percent, width)] for s in sets],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, digest binary, first array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                yield pd.DataFrame(
                    {
                        "region": part["region"].to_numpy(), "doc_id": part["doc_id"].to_numpy(),
                        "shingles": [shingles(t, size).tobytes() for t in part["text"]],
                    }
                )

    return docs.select("region", "doc_id", "text").mapInPandas(run, "region long, doc_id long, shingles binary")


class Space:
    """Sets with an index from each shingle to the sets that hold it; costs follow what is shared."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        self.values, self.code, self.df = np.unique(whole, return_inverse=True, return_counts=True)
        self.code = self.code.astype(np.int32)
        del whole
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        self.owners = owners[np.argsort(self.code, kind="stable")]
        self.first = np.cumsum(self.df) - self.df
        self.ends = np.cumsum(self.sizes)

    def codes(self, i: int) -> np.ndarray:
        return self.code[self.ends[i] - self.sizes[i] : self.ends[i]]

    def lookup(self, other: np.ndarray) -> np.ndarray:
        """Codes of those shingles of a foreign set that are known here."""
        at = np.minimum(np.searchsorted(self.values, other), max(0, len(self.values) - 1))
        return at[self.values[at] == other] if len(self.values) else at[:0]

    def holders(self, codes: np.ndarray) -> np.ndarray:
        """For each of the given shingles all sets that hold it, one after the other."""
        counts = self.df[codes]
        before = np.cumsum(counts) - counts
        return self.owners[np.arange(counts.sum()) + np.repeat(self.first[codes] - before, counts)]

    def common(self, codes: np.ndarray) -> np.ndarray:
        """How many of the given shingles each set holds."""
        return np.bincount(self.holders(codes), minlength=len(self.sizes))

    def some(self, codes: np.ndarray, number: int) -> np.ndarray:
        """The sets that hold at least one of so many of the shingles, the rarest of them."""
        if number < len(codes):
            codes = codes[np.argpartition(self.df[codes], number - 1)[:number]]
        return np.unique(self.holders(codes))


def join_region(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the place of another of its group of linked sets, or its own; exact.

    Every set is a pivot in turn. Its ball can only hold sets of like size with at least
    one of any missing + 1 of its shingles, of which the rarest are taken. A set at
    distance d from an earlier pivot is farther than r from all that lie more than r nearer
    or farther; one such pivot is known of each set. Sets of one group are not compared.
    """
    space, n, radius = Space(sets), len(sets), 1 - percent / 100
    group = np.arange(n)
    done = np.zeros(n, dtype=bool)
    anchor, reach = np.full(n, -1), np.zeros(n)
    for pivot in np.argsort(-space.sizes, kind="stable"):
        done[pivot] = True
        size = int(space.sizes[pivot])
        codes = space.codes(pivot)
        at = space.some(codes, size - at_least(size, percent) + 1)
        at = at[~done[at] & (group[at] != group[pivot])]
        at = at[100 * np.minimum(space.sizes[at], size) >= percent * np.maximum(space.sizes[at], size)]
        same = (anchor[at] >= 0) & (anchor[at] == anchor[pivot])
        at = at[~(same & (np.abs(reach[at] - reach[pivot]) > radius + _SLACK))]
        if len(at) == 0:
            continue
        common = space.common(codes)[at]
        union = space.sizes[at] + size - common
        new = anchor[at] < 0
        anchor[at[new]], reach[at[new]] = pivot, 1 - common[new] / union[new]
        for g in np.unique(group[at[100 * common >= percent * union]]):
            group[group == g] = group[pivot]
    return group.tolist()


def _join_groups(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """u, v for links that connect the documents of each group; rows: keys, doc_id, shingles."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["doc_id"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.int64) for s in part["shingles"]]
        return pd.DataFrame({"u": ids, "v": ids[join_region(sets, percent)]})

    # Said outright: rows that lie together by region alone would do for Spark, all in one task.
    return rows.repartition(*keys).groupBy(*keys).applyInPandas(run, "u long, v long").where("u <> v")


def _net(space: Space) -> list[int]:
    """Places of sets, in order, that keep their distance from the earlier ones."""
    kept: list[int] = []
    covered = np.zeros(len(space.sizes), dtype=bool)
    for i in range(len(space.sizes)):
        if not covered[i]:
            kept.append(i)
            common = space.common(space.codes(i))
            covered |= 1 - common / (space.sizes + space.sizes[i] - common) <= APART
    return kept


def _capacities(members: DataFrame, weight: Column, leaf: int) -> DataFrame:
    """region, weight, count, cap, block of regions with several members.

    As many shingles of such members as `cap` are joined as they are, and so many as `block` in a pair of blocks.
    """
    totals = members.groupBy("region").agg(F.sum(weight).alias("weight"), F.count("*").alias("count")).where("count > 1")
    most = lambda work: F.least(F.lit(float(leaf)), F.sqrt(F.lit(float(work)) * F.col("weight") / F.col("count")))
    return totals.withColumns({"cap": most(WORK), "block": most(BLOCK_WORK)})


def _divide(rows: DataFrame, large: DataFrame, percent: int, level: int) -> DataFrame:
    """parent, region, doc_id: members of the Voronoi cells of large regions; with region null and pivot, links to pivots.

    Each region's pivots are drawn from its members by a hash, as many as half a task
    holds, and thinned to a net. A member is at home in the cell of its nearest pivot if
    that is NEAR. If x is at home with p, whoever is within r of x is no farther from p
    than NEAR + r, and than 2r more than from its own nearest pivot: members are guests of
    all such cells. Members that are near no pivot can otherwise link only to each other
    and form one more cell. Distances come from an index of the pivots' shingles, so
    pivots that share nothing with a member cost nothing. Members are dealt into slices
    that each get the pivots, so a region takes many tasks.
    """
    radius = 1 - percent / 100
    slices = F.ceil(F.col("weight") / F.col("cap")).cast("int")
    # By sets, not ids: an id may have very many texts.
    known = rows.join(large, "region").withColumn("h", F.xxhash64("shingles", F.lit(level)))
    members = known.withColumn("slice", F.pmod(F.xxhash64("shingles"), slices).cast("int")).select("region", "slice", "doc_id", "shingles")
    drawn = F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("cap") / 2 / F.col("weight")
    pivots = cut_lineage(
        known.where(drawn).select(
            "region", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "h", F.col("doc_id").alias("pivot"), F.col("shingles").alias("set")
        )
    )

    def run(key, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        region = int(key[0])
        pivots = pivots.sort_values(["h", "pivot"])
        space = Space([np.frombuffer(s, dtype=np.int64) for s in pivots["set"]])
        net = np.array(_net(space), dtype=np.int64)
        ids = pivots["pivot"].to_numpy()[net]
        name = lambda k: int.from_bytes(hashlib.blake2b(f"{region} {level} {k}".encode(), digest_size=8).digest(), "little", signed=True)
        cells, rest = [name(k) for k in ids.tolist()], name("far")
        out = []
        for doc_id, raw in zip(members["doc_id"].tolist(), members["shingles"]):
            own = np.frombuffer(raw, dtype=np.int64)
            common = space.common(space.lookup(own))[net]
            union = space.sizes[net] + len(own) - common
            distance = 1 - common / union
            least = distance.min(initial=1.0)
            out += [(region, None, doc_id, ids[k]) for k in np.flatnonzero(100 * common >= percent * union)]
            if least > NEAR:
                out.append((region, rest, doc_id, None))
            out += [(region, cells[k], doc_id, None) for k in np.flatnonzero(distance <= min(least + 2 * radius, NEAR + radius) + _SLACK)]
        # Column by column: next to None, pandas would make the ids floating-point numbers.
        columns = zip(*out) if out else ([], [], [], [])
        return pd.DataFrame({k: pd.array(list(v), dtype="Int64") for k, v in zip(("parent", "region", "doc_id", "pivot"), columns)})

    key = ["region", "slice"]
    members, pivots = members.repartition(*key), pivots.repartition(*key)
    return members.groupBy(key).cogroup(pivots.groupBy(key)).applyInPandas(run, "parent long, region long, doc_id long, pivot long")


def _read_block(folder: str, region: int, inner: int, own: int) -> tuple[list[int], list[np.ndarray]]:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileType

    system, place = file_system(f"{folder}/region={region}/inner={inner}/own={own}")
    if system.get_file_info(place).type == FileType.NotFound:
        return [], []
    found = pq.read_table(place, filesystem=system, columns=["doc_id", "shingles"], partitioning=None, use_threads=False)
    return found["doc_id"].to_pylist(), [np.frombuffer(x.as_py(), dtype=np.int64) for x in found["shingles"]]


def _join_blocks(rows: DataFrame, labels: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """A written table of links across the groups of large regions, in blocks; labels: region, doc_id, label.

    Members of a region's largest group need not meet each other. They are dealt into
    blocks, and so are the others; each block of the others meets each block of either
    kind. Blocks are written once, a file each, in the shared folder; a task is told a pair and
    reads both. So what is moved and kept grows with the members, not with the pairs.
    """
    spark = rows.sparkSession
    counted = labels.groupBy("region", "label").agg(F.count("*").alias("c"))
    largest = counted.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count("*").alias("labels"))
    known = rows.join(labels, ["region", "doc_id"]).join(largest.where("labels > 1"), "region")
    known = cut_lineage(known.select("region", "doc_id", "shingles", (F.col("label") == F.col("largest")).cast("int").alias("inner")))
    weight = F.octet_length("shingles") / 8
    blocks = lambda inner: F.ceil(F.sum(F.when(F.col("inner") == inner, weight).otherwise(0)) * 2 / F.max("block")).cast("int")
    sizes = known.join(large.select("region", "block"), "region").groupBy("region").agg(blocks(1).alias("inners"), blocks(0).alias("outers"))
    sizes = cut_lineage(sizes)
    own = F.pmod(F.xxhash64("shingles", F.lit(-1)), F.when(F.col("inner") == 1, F.col("inners")).otherwise(F.col("outers"))).cast("int")
    dealt = known.join(sizes, "region").select("region", "inner", own.alias("own"), "doc_id", "shingles")
    where, folder = ["region", "inner", "own"], new_folder(spark, "blocks")
    dealt.repartition(*where).write.partitionBy(*where).parquet(folder)
    let_go(known)
    first = sizes.where("outers > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("i"))
    across = first.where("inners > 0").select("region", F.lit(1).alias("inner"), "i", F.explode(F.sequence(F.lit(0), F.col("inners") - 1)).alias("j"))
    among = first.select("region", F.lit(0).alias("inner"), "i", F.explode(F.sequence(F.col("i"), F.col("outers") - 1)).alias("j"))
    pairs = cut_lineage(across.unionByName(among))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for region, inner, i, j in batch[["region", "inner", "i", "j"]].itertuples(index=False):
                ids, sets = _read_block(folder, region, 0, i)
                if inner or i != j:
                    more = _read_block(folder, region, inner, j)
                    ids, sets = ids + more[0], sets + more[1]
                ids = np.array(ids, dtype=np.int64)
                group = join_region(sets, percent)
                linked = pd.DataFrame({"u": ids, "v": ids[group]})
                yield linked[linked["u"] != linked["v"]]
        pa.default_memory_pool().release_unused()

    # Two pairs a task, about; Spark would put all of these short rows into one.
    tasks = max(1, min(pairs.count() // 2, 10_000))
    links = cut_lineage(pairs.repartition(tasks, "region", "inner", "i", "j").mapInPandas(run, "u long, v long"))
    let_go(sizes, pairs)
    delete_folder(spark, folder)
    return links


def _tighter(rows: DataFrame, percent: int) -> DataFrame:
    """region, doc_id of those members of large regions that may link, by whole sets; rows: doc_id, shingles.

    Regions are formed by windows, whose rarest shared shingles may be those of a passage that very many
    documents hold. Of a whole set nearly all shingles are in any partner, so a document with fewer shared
    ones leaves, and the rarest that it needs are seldom common. Documents that hold the same one are connected
    only along sizes that come near enough to each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.frombuffer(s, dtype=np.int64) for s in batch["shingles"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n": [len(s) for s in sets], "first": sets})

    whole = cut_lineage(rows.select("doc_id", "shingles").mapInPandas(run, "doc_id long, n long, first array<long>"))
    shared = _shared(whole, F.ceil(percent * F.col("n") / 100), 0)
    by_size = Window.partitionBy("s").orderBy("n")
    gap = (100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int")
    held = shared.select("doc_id", "n", F.explode("rare").alias("s")).withColumn("gap", F.coalesce(gap, F.lit(0)))
    held = held.withColumn("run", F.sum("gap").over(by_size)).withColumn("v", F.min("doc_id").over(Window.partitionBy("s", "run")))
    found = components(held.select(F.col("doc_id").alias("u"), "v").where("u <> v").distinct())
    out = cut_lineage(found.select(F.col("component").alias("region"), F.col("node").alias("doc_id")))
    let_go(shared)
    return out


def join_regions(sets: DataFrame, members: DataFrame, percent: int = PERCENT, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """u, v: links that connect all documents of each region that are linked; exact.

    members: region, doc_id, n, an id once; sets: region, doc_id, shingles of their texts. Regions that
    one task can join (see LEAF, WORK) are joined each in one task. Very large ones (see LOOSE) are formed
    anew by whole sets. What is still large is divided by pivots into Voronoi cells, which are
    regions of the next level; cells whose members the links to pivots have made one group are
    done. Where cells hold nearly as many pairs as their region, as among near copies of one text, and
    after `depth` levels, the region is joined in blocks instead. What is small or large
    is told from members alone, so that whole sets are moved only to be joined.
    """
    sizes = cut_lineage(_capacities(members, F.col("n"), leaf))
    is_large = F.col("weight") > F.col("cap")
    large = sizes.where(is_large)
    is_loose = F.col("weight") > LOOSE * F.col("cap")
    known = cut_lineage(sets.join(sizes.select("region", is_large.alias("large"), is_loose.alias("loose")), "region"))
    links = cut_lineage(_join_groups(known.where("NOT large"), ["region"], percent))
    if large.isEmpty():
        let_go(known)
        return links
    columns = ["region", "doc_id", "shingles"]
    rows = cut_lineage(known.where("large AND NOT loose").select(columns))
    loose = cut_lineage(known.where("loose").select(columns))
    let_go(known)
    if not sizes.where(is_loose).isEmpty():
        tight = _tighter(loose, percent)
        below = cut_lineage(loose.drop("region").join(tight, "doc_id").select(columns))
        let_go(tight)
        formed = cut_lineage(_capacities(below, F.octet_length("shingles") / 8, leaf))
        leaves = cut_lineage(_join_groups(below.join(formed.where(~is_large).select("region"), "region"), ["region"], percent))
        more = cut_lineage(links.unionByName(leaves))
        old, rows = rows, cut_lineage(rows.unionByName(below.join(formed.where(is_large).select("region"), "region").select(columns)))
        let_go(links, leaves, below, old)
        links, large = more, large.where(~is_loose).unionByName(formed.where(is_large))
    let_go(loose)
    if large.isEmpty():
        let_go(rows)
        return links
    for level in range(depth):
        divided = cut_lineage(_divide(rows, large, percent, level))
        to_pivots = divided.where("region IS NULL").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"))
        groups = cut_lineage(components(to_pivots).select(F.col("node").alias("doc_id"), "component"))
        label = F.coalesce("component", "doc_id")
        cells = divided.where("region IS NOT NULL").select("parent", "region", "doc_id").distinct()
        held = cells.groupBy("parent", "region").agg(F.count("*").alias("held"))
        pairs = lambda c: c.cast("double") * c
        widths = held.groupBy("parent").agg(F.sum("held").alias("held"), F.sum(pairs(F.col("held"))).alias("pairs"))
        widths = widths.join(large.withColumnRenamed("region", "parent"), "parent")
        too_wide = (F.col("pairs") > USEFUL * pairs(F.col("count"))) | (F.col("held") > WIDEST * F.col("count"))
        widths = cut_lineage(widths.select("parent", (F.lit(True) if level == depth - 1 else too_wide).alias("wide")))
        whole = rows.join(widths.where("wide").select(F.col("parent").alias("region")), "region")
        labels = whole.select("region", "doc_id").join(groups, "doc_id", "left").select("region", "doc_id", label.alias("label")).distinct()
        blocks = _join_blocks(whole, labels, large, percent)
        narrow = cells.join(widths.where("NOT wide").select("parent"), "parent")
        open_cells = (
            narrow.select("region", "doc_id").join(groups, "doc_id", "left")
            .groupBy("region").agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select("region")
        )
        old = rows.select(F.col("region").alias("parent"), "doc_id", "shingles")
        below = cut_lineage(narrow.join(open_cells, "region").join(old, ["parent", "doc_id"]).select("region", "doc_id", "shingles"))
        sizes = cut_lineage(_capacities(below, F.octet_length("shingles") / 8, leaf))
        leaves = cut_lineage(_join_groups(below.join(sizes.where(~is_large).select("region"), "region"), ["region"], percent))
        more = cut_lineage(links.unionByName(to_pivots).unionByName(blocks).unionByName(leaves))
        let_go(links, divided, groups, widths, blocks, leaves, rows)
        links, large = more, sizes.where(is_large)
        if large.isEmpty():
            let_go(below)
            break
        rows = cut_lineage(below.join(large.select("region"), "region"))
        let_go(below)
    return links


def _may_link(windows: DataFrame, percent: int, width: float) -> DataFrame:
    """doc_id, once, of those that _shared() would keep without peeling; only counts are moved for it."""
    shared = windows.select("doc_id", "n", F.explode("first").alias("s"))
    counts = shared.groupBy("s").agg(F.count("*").alias("df")).where("df > 1").select("s")
    found = shared.join(counts, "s").groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    return found.where(F.col("c") >= _fewest(F.col("n"), percent, width)).select("doc_id").distinct()


def _shared(windows: DataFrame, needed: Column, peels: int) -> DataFrame:
    """doc_id, n, rare of those that may link; windows, which are let go: doc_id, n, first.

    Windows are joined shingle by shingle, as counts first: a shingle of one window only
    cannot link anything. A document of whose window fewer than `needed` shingles are
    shared is farther than r from all others; where it leaves, counts fall, so this is
    done again. Of its shared shingles each document that stays needs only so many, the rarest,
    that one of them is in every partner's.
    """
    needed = needed.cast("int")
    shared, kept = windows.select("doc_id", "n", F.explode("first").alias("s")), None
    for k in range(peels + 1):
        counts = shared.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
        grouped = shared.join(counts, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("own"))
        some = F.size("own") if k < peels else F.size("own") - needed + 1
        before, kept = kept, cut_lineage(grouped.where(F.size("own") >= needed).select("doc_id", "n", F.slice("own.s", F.lit(1), some).alias("rare")))
        let_go(windows if before is None else before)
        shared = kept.select("doc_id", "n", F.explode("rare").alias("s"))
    return kept


def _regions(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """region, doc_id, n of the documents that may link; texts: doc_id, text.

    Documents that share one of the shingles that they need are in one region.
    """
    with small_batches(texts.sparkSession):
        windows = cut_lineage(_profiles(texts, size, percent, SECOND).drop("digest"))
    shared = _shared(windows, _fewest(F.col("n"), percent, SECOND), PEELS)
    members = shared.select("doc_id", F.explode("rare").alias("s"))
    centre = members.groupBy("s").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).where("c > 1")
    edges = members.join(centre, "s").select(F.col("doc_id").alias("u"), "v").distinct()
    found = components(edges).select(F.col("component").alias("region"), F.col("node").alias("doc_id"))
    # An id with several texts is one member, with all of their shingles.
    weights = shared.groupBy("doc_id").agg(F.sum("n").alias("n"))
    out = cut_lineage(found.join(weights, "doc_id"))
    let_go(shared)
    return out


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document with an id.

    Words are runs of anything but ASCII white space, A-Z in lower case. Null and blank
    texts have no shingles and are their own components. Equal sets are one class, which
    its smallest id stands for; a class goes on as one document. Rows with a null id
    take no part and are not returned; rows that repeat an id are one node of the
    components and each keep their own n_shingles. Other columns do not come along.
    Shingles are compared by 64-bit hashes, classes by 128-bit ones.

    Whole sets are only made for members of regions. What the narrow windows of all
    documents leave over has its texts set aside and is seen again with wider ones. Each table is
    deleted once those made of it are written.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(spark):
        wide = cut_lineage(_profiles(rows, size, percent, FIRST))
    profiles = cut_lineage(wide.drop("first"))
    classes = cut_lineage(
        profiles.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("c")).select("digest", "c.*")
    )
    windows = cut_lineage(
        wide.where("n > 0").join(classes.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "n", "first")
    )
    let_go(wide)
    # A narrow table of ids, once each: small enough to filter texts by before they move.
    left = cut_lineage(_may_link(windows, percent, FIRST))
    let_go(windows)
    with runtime_filter(spark):
        texts = rows.join(left.where(F.col("doc_id") > -(1 << 63)), "doc_id", "left_semi")
        # Rows that repeat both id and text; seldom there, so the texts are seldom shuffled for it.
        if not profiles.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
            texts = texts.dropDuplicates(["doc_id", "text"])
        texts = cut_lineage(texts)
    let_go(left)
    regions = _regions(texts, size, percent)
    with runtime_filter(spark), small_batches(spark):
        sets = _sets(texts.join(regions, "doc_id"), size)
        links = join_regions(sets, regions, percent, leaf)
    let_go(texts, regions)
    found = cut_lineage(components(links)).withColumnRenamed("node", "least")
    let_go(links)
    lonely = profiles.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = (
        profiles.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest")
        .join(classes.select("digest", F.col("doc_id").alias("least")), "digest")
        .join(found, "least", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "least").alias("component_id"))
    )
    return linked.unionByName(lonely)


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
