"""N-gram Jaccard join on sets of word shingles.

1. Every text becomes the sorted array of its distinct shingle hashes; equal sets are one class. A set's bitmap has the
   parities of its hashes' slots, at least one slot for each of its elements.
2. Signatures. In a size band, two sets within the threshold differ in at most k elements. The hash space is cut into
   more than k ranges, so some range has the same elements in both: each set shows a hash of every range that isn't
   thin, for its own band and the next larger. Sets that share none can't link. (There are spare ranges against thin
   ones, and a set with too many of those shows the ranges of a second hash as well, and so on.)
3. The sets that show a signature are its bucket; of buckets with the same members one stays. In a bucket, bitmaps are
   compared: the bits in which two differ bound the overlap from above. The pairs that could reach the threshold join
   sets to groups. Texts don't travel in this step.
4. The texts of each group are fetched once. In its tiles, pairs that pass the bound are settled by exact intersection of
   the sorted arrays. A pair already joined through others needs no look, so a tile returns a spanning forest of its
   links, never all pairs.
5. Components of the links, over classes.

Buckets and groups larger than a tile are cut by size band and salt. At first a tile has one salt and its band's pivot;
then only sets outside the largest component so far meet the others of their own and the neighbouring bands, for pairs
within it are joined already. So a large group of near copies moves each member a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cutweave.llm.text import SPACE, Words, as_bytes, mix, slices
from cutweave.operators.components import star_components
from cutweave.session import discard, materialise

SHINGLE, PERCENT = 3, 90
#: Shingles that a tile of texts holds, about: 8 bytes each.
TILE_SHINGLES = 2_000_000
#: Sets that a tile of bitmaps holds.
TILE_SETS = 4096
SHARES = 4


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; under ``n`` words, the whole sequence as one."""
    at, h = w.windows(n)
    bounds = np.searchsorted(at, np.append(w.first, len(w.starts)))
    out = []
    for i, (first, count) in enumerate(zip(w.first.tolist(), w.count.tolist())):
        if count >= n:
            out.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif count:
            x = np.array([count], np.uint64)
            for j in range(first, first + count):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_edges(percent: int, most: int) -> list[int]:
    """Largest size of each band, so that sets within the threshold lie in one band or two neighbouring ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges


def most_differences(percent: int, size: int) -> int:
    """Elements in which two sets of at most ``size`` elements each, within the threshold, can differ."""
    return (100 - percent) * 2 * size // (100 + percent)


LEVELS = 6
_plans: dict[tuple, tuple] = {}


def _plan(percent: int, band: int, edges: list[int]) -> tuple[np.ndarray, int, int]:
    """A band's range borders, the fewest elements of a range that is shown, and how many thinner ranges a set may have.

    With k differences at most and k + 1 + c ranges, c + 1 ranges agree; they are all thin in both sets only if each set
    has more than c thin ones. c is a little over what the least sets of the band will have. Fuller ranges are shared by
    chance less often: the fewest is the greatest of 4 to 1 that takes no more than half as many ranges again.
    """
    key = (percent, band)
    if key not in _plans:
        size = lambda i: edges[i] if i < len(edges) else -(-size(i - 1) * 100 // percent)
        k, least = most_differences(percent, size(band)), edges[band - 2] + 1 if band > 1 else 1
        for fewest in (4, 3, 2, 1) if k else (1,):
            spare = 0
            for _ in range(8 if k else 0):
                m = k + 1 + spare
                mean = least / m
                term, share = np.exp(-mean), 0.0
                for i in range(fewest):
                    share += term
                    term *= mean / (i + 1)
                spare = int(np.ceil(m * share + 2 * np.sqrt(m * share)))
                if spare > (k + 1) // 2 and fewest > 1:
                    break
            else:
                break
        m = k + 1 + spare
        if len(_plans) > 256:
            _plans.clear()
        _plans[key] = np.array([(j << 64) // m for j in range(1, m)], np.uint64), fewest, spare
    return _plans[key]


def signatures(h: np.ndarray, percent: int, edges: list[int]) -> np.ndarray:
    """Signatures of a sorted set for its band and the next: a hash of each range that isn't thin. A set with too many
    thin ranges shows those of a further hash as well, up to LEVELS, and then one that says no more than this."""
    b = int(np.searchsorted(edges, len(h)))
    out: list[np.ndarray] = []
    for band in (b, b + 1):
        borders, fewest, spare = _plan(percent, band, edges)
        for level in range(LEVELS):
            seed = mix(np.array([band * LEVELS + level + 1], np.uint64))
            x = h if level == 0 else np.sort(mix(h ^ seed))
            at = np.concatenate([[0], np.searchsorted(x, borders), [len(x)]])
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x + seed), dtype=np.uint64)])
            full = at[1:] >= at[:-1] + fewest
            tags = mix(total[at[1:]] - total[at[:-1]] + mix(np.arange(len(full), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + seed))
            out.append(tags[full])
            if len(full) - int(full.sum()) <= spare:
                break
        else:
            out.append(mix(seed + np.uint64(1)))
    return np.unique(np.concatenate(out))


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the slots of a set's hashes. Two sets' bitmaps differ in no more bits than the sets in elements, also
    once the longer is folded onto the shorter."""
    slots = max(64, 1 << int(len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(bool)).tobytes()


class Forest:
    """Disjoint sets; ``root`` names each element's at any time. The smaller of two is renamed."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members: list[list[int]] = [[i] for i in range(n)]

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.root[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


def near(size: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int, settle=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, but those of two of side 1, that could link by size and bitmaps and that
    ``settle(i, j)`` confirms. Bitmaps are compared at the width of the smaller set's, which the other's is folded to."""
    n = len(size)
    if n == 2 and len(maps[0]) == len(maps[1]) and settle is None:  # most buckets
        both, differ = int(size[0] + size[1]), (int.from_bytes(maps[0]) ^ int.from_bytes(maps[1])).bit_count()
        ok = 100 * int(size.min()) >= percent * int(size.max()) and 100 * (both - differ) >= percent * (both + differ) and side.min() == 0
        return [(0, 1)] if ok else []
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    widths = np.array([len(maps[i]) for i in order])
    cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), n]
    own = {int(widths[a]): (a, b, np.frombuffer(b"".join(maps[i] for i in order[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(cuts, cuts[1:])}
    fold = {w // 2: (a, b, m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]) for w, (a, b, m) in own.items() if w > 8}
    forest, links = Forest(n), []
    hi = np.searchsorted(size, size * 100 // percent, "right")
    for i in range(n):
        w = int(widths[i])
        mine = own[w][2][i - own[w][0]]
        for first, last, table in (t for t in (own[w], fold.get(w)) if t):
            a, b = max(i + 1, first), min(int(hi[i]), last)
            for lo in range(a, b, 8192):
                todo = np.arange(lo, min(lo + 8192, b))
                todo = todo[(forest.root[todo] != forest.root[i]) & (side[todo] + side[i] < 2)]
                if not len(todo):
                    continue
                differ = np.bitwise_count(table[todo - first] ^ mine).sum(1, dtype=np.int64)
                both = size[todo] + size[i]
                for j in todo[100 * (both - differ) >= percent * (both + differ)].tolist():  # overlap <= (both - differ) / 2, union >= (both + differ) / 2
                    if forest.root[i] != forest.root[j] and (settle is None or settle(int(order[i]), int(order[j]))):
                        links.append((int(order[i]), int(order[j])))
                        forest.join(i, j)
    return links


def link(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``, but those of two of side 1."""

    def settle(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        inter = int(np.count_nonzero(b[at] == a))
        return 100 * inter >= percent * (len(a) + len(b) - inter)

    return near(np.array([len(x) for x in sets], np.int64), [bitmap(x) for x in sets], side, percent, settle)


NO_ID = -(1 << 63)


def row_key(docs: DataFrame, within: str | None = None) -> list:
    """What tells rows apart: doc_id, and a hash of the text; of the columns of a struct, ``within``, if that is named."""
    at = f"{within}." if within else ""
    return [F.coalesce(F.col(f"{at}doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(f"{at}text").alias("th")]


def _sketch(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, hi, lo (the set's 128-bit hash), map, signs."""
    edges = band_edges(percent, 1 << 26)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(as_bytes(part), SPACE, lower=True), shingle)
                whole = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets], np.int64).reshape(-1, 2)
                use = [ok and len(s) > 0 for s, ok in zip(sets, part["doc_id"].is_valid().to_pylist())]
                signs = [signatures(s, percent, edges).view(np.int64) if u else None for s, u in zip(sets, use)]
                maps = [bitmap(s) if u else None for s, u in zip(sets, use)]
                cols = [part["doc_id"].cast(pa.int64()), part["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(maps, pa.binary()), pa.array(signs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "hi", "lo", "map", "signs"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, hi long, lo long, map binary, signs array<long>")


def _buckets(signed: DataFrame) -> DataFrame:
    """sign, lo, m: the members of each bucket of two or more, and their number; one bucket of those with the same members.

    Signatures are taken in SHARES disjoint shares, one after the other, so that only one share's shuffles stand at a
    time. Sets go by 64 bits of their hash here; should two share them, a bucket is larger than it need be.
    """
    members = None
    for i in range(SHARES):
        shown = signed.select("lo", F.explode("signs").alias("sign")).where(F.pmod("sign", F.lit(SHARES)) == i)
        shared = shown.groupBy("sign").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("sign")
        some = materialise(shown.join(shared, "sign").distinct(), "shown")
        members = some if members is None else members.union(some)
    told = members.groupBy("sign").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("lo")).alias("mark"), F.min("lo").alias("least"), F.max("lo").alias("most"))
    one = told.groupBy("m", "mark", "least", "most").agg(F.min("sign").alias("sign")).select("sign", "m")
    return members.join(one, "sign")


def _solve(rows: DataFrame, percent: int, shingle: int | None) -> DataFrame:
    """src, dst: a spanning forest of each tile's pairs. ``rows``: tile, side, node, n, load (a bitmap; with ``shingle``,
    a text). Tiles come sorted, so a task holds one tile and one batch."""

    def solve(node: np.ndarray, side: np.ndarray, n: np.ndarray, loads: list) -> list[tuple[int, int]]:
        order = np.lexsort((side, node))
        some = order[np.append(True, np.diff(node[order]) != 0)]  # a set may come on both sides, or twice
        if len(some) < 2:
            return []
        node, side, loads = node[some], side[some], [loads[i] for i in some.tolist()]
        if shingle is None:
            got = near(n[some], loads, side, percent)
        else:
            sets = []
            for part in slices(pa.record_batch([pa.array(loads, pa.large_string())], names=["text"])):
                sets += shingle_sets(Words(as_bytes(part), SPACE, lower=True), shingle)
            got = link(sets, side, percent)
        return [(int(node[a]), int(node[b])) for a, b in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(pairs):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["src", "dst"])

        held: list[list] = [[], [], [], []]  # rows of the tile that isn't complete yet
        last = None
        for batch in batches:
            tile = batch["tile"].to_numpy()
            cols = [batch["node"].to_numpy(), batch["side"].to_numpy(), batch["n"].to_numpy(), batch["load"].to_pylist()]
            ends = [*(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            pairs, at = [], 0
            for end in ends:
                if last is not None and tile[at] != last:
                    pairs += solve(*(np.concatenate(x) for x in held[:3]), sum(held[3], []))
                    held = [[], [], [], []]
                last = tile[at]
                for h, c in zip(held, cols):
                    h.append(c[at:end])
                at = end
            yield tell(pairs)
        if last is not None:
            yield tell(solve(*(np.concatenate(x) for x in held[:3]), sum(held[3], [])))

    rows = rows.select("tile", F.col("side").cast("int").alias("side"), "node", "n", "load")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "src long, dst long")


def _forest(members: DataFrame, percent: int, cap: int, shingle: int | None = None) -> DataFrame:
    """src, dst: a spanning forest of the pairs within each ``grp`` that could link or, with ``shingle``, that do.

    ``members``, a written table: grp, node, n, w (what it takes of ``cap``, a tile's size), total (of w in its grp), load.
    """
    whole = members.where(F.col("total") <= cap).select(F.col("grp").alias("tile"), F.lit(0).alias("side"), "node", "n", "load")
    links = materialise(_solve(whole, percent, shingle), "links")
    large = members.where(F.col("total") > cap)
    if large.isEmpty():
        return links
    large = large.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("long"))
    sized = lambda t, name: t.groupBy("grp", "band").agg(F.ceil(F.sum("w") / cap).alias(name))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda x: x < n)
    salt = lambda n: F.pmod(F.xxhash64("node"), n)
    rows = lambda side, *tile: [F.xxhash64("grp", *tile).alias("tile"), F.lit(side).alias("side"), "node", "n", "load"]
    cuts = materialise(sized(large, "salts"), "cuts")
    dealt = large.join(cuts, ["grp", "band"]).select(*rows(0, "band", salt(F.col("salts"))))
    pivots = large.groupBy("grp", "band").agg(F.min("node").alias("node")).withColumn("to", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
    pivots = pivots.join(cuts.withColumnRenamed("band", "to"), ["grp", "to"]).join(large.select("grp", "node", "n", "load"), ["grp", "node"])
    first = materialise(_solve(dealt.union(pivots.withColumn("x", F.explode(upto(F.col("salts")))).select(*rows(0, "to", "x"))), percent, shingle), "links")
    comps = materialise(star_components(first), "comps")
    placed = large.select("grp", "band", "node", "w").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    most = placed.groupBy("grp", "comp").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("most"))
    out = materialise(placed.join(most, "grp").where("comp <> most.comp").select("grp", "band", "node", "w"), "outside")
    if not out.isEmpty():
        mine = materialise(sized(out, "mine"), "cuts")
        near_bands = lambda t, name: t.select("grp", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), F.col("band").alias("of"), name)
        outside = large.join(out.select("grp", "node"), ["grp", "node"], "left_semi").join(mine, ["grp", "band"]).join(near_bands(cuts, "salts"), ["grp", "band"])
        outside = outside.withColumn("x", F.explode(upto(F.col("salts")))).select(*rows(0, "band", salt(F.col("mine")), "of", "x"))
        others = large.join(cuts, ["grp", "band"]).join(near_bands(mine, "mine"), ["grp", "band"]).withColumn("x", F.explode(upto(F.col("mine"))))
        first = first.union(materialise(_solve(outside.union(others.select(*rows(1, "of", "x", "band", salt(F.col("salts"))))), percent, shingle), "links"))
    return links.union(first)


def _classes(sets: DataFrame) -> DataFrame:
    """hi, lo, rep (least doc_id), th (of rep's text; the least, if it has several), n, map and node of each distinct set.
    A node is its rep, or a negative hash where sets share one."""
    least = sets.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("map").alias("map"))
    least = least.select("hi", "lo", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "n", "map")
    shared = least.groupBy("rep").agg(F.count("*").alias("sharing"))
    node = F.when(F.col("sharing") > 1, -1 - F.pmod(F.xxhash64("hi", "lo"), F.lit((1 << 63) - 1))).otherwise(F.col("rep"))
    return least.join(shared, "rep").select("hi", "lo", "rep", "th", "n", "map", node.alias("node"))


def _linked(docs: DataFrame, shingle: int, percent: int, tile_shingles: int, tile_sets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (a row for each of ``docs``), classes, and a spanning forest of the links between their nodes."""
    signed = materialise(_sketch(docs, shingle, percent), "sketch")
    sets = materialise(signed.drop("signs"), "sets")
    buckets = materialise(_buckets(signed.where("signs is not null")), "buckets")
    discard(signed)
    classes = materialise(_classes(sets.where("map is not null")), "classes")
    members = materialise(buckets.join(classes, "lo").select(F.col("sign").alias("grp"), "node", "n", F.lit(1).cast("long").alias("w"), F.col("m").alias("total"), F.col("map").alias("load")), "members")
    discard(buckets)
    groups = materialise(star_components(_forest(members, percent, tile_sets)), "groups")
    discard(members)
    sized = groups.join(classes.select("node", "rep", "th", "n"), "node")
    totals = sized.groupBy("comp").agg(F.sum("n").alias("total"))
    own = sized.join(totals, "comp").select(F.col("comp").alias("grp"), "node", F.col("rep").alias("id"), "th", "n", "total")
    texts = docs.select(*row_key(docs), "text").where("text is not null").join(own, ["id", "th"])
    texts = texts.groupBy("grp", "node", "n", "total").agg(F.first("text").alias("load")).withColumn("w", F.col("n"))
    dealt = materialise(texts, "texts")
    links = materialise(_forest(dealt, percent, tile_shingles, shingle), "links")
    discard(dealt)
    return sets, classes, links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set), component_id (least doc_id reachable by links).

    Words are white-space separated, A-Z lower-cased; sets link when 100 * overlap >= percent * union. Empty sets link
    with nothing. Documents are their ids: rows that repeat one share its links, and keep their own n_shingles; a row
    with a null id links with nothing and has null class and component. An empty table gives no rows; other columns are
    ignored. Shingles are 64-bit hashes. Hot groups: equal sets are one class, and large buckets and groups are cut into
    tiles of bounded size.
    """
    sets, classes, links = _linked(docs, shingle, percent, tile_shingles, tile_sets)
    rows = sets.join(classes.select("hi", "lo", "rep", "node"), ["hi", "lo"], "left")
    named = rows.where("doc_id is not null and node is not null").select("doc_id", "node")
    several = named.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("most")).where("src < most").join(named, "doc_id").select("src", F.col("node").alias("dst"))
    comps = materialise(star_components(links.union(several)), "comps")
    least = comps.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    out = rows.join(comps, "node", "left").join(least, "comp", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("rep")))
    return out.select("doc_id", "n_shingles", class_id.alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", class_id)).alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """id, th (see ``row_key``) of the rows that stay if each group of links keeps one: the least id, then the least hash.

    Here a document is an id and a text: different texts of one id are different documents, and link by their texts
    alone. Empty sets link with nothing, so all stay. Rows with a null id are not in the result.
    """
    sets, classes, links = _linked(docs, shingle, percent, tile_shingles, tile_sets)
    rows = sets.where("doc_id is not null").join(classes.select("hi", "lo", "node"), ["hi", "lo"], "left")
    grouped = rows.where("node is not null").join(star_components(links), "node", "left").groupBy(F.coalesce("comp", "node").alias("g")).agg(F.min(F.struct("doc_id", "th")).alias("k"))
    empty = rows.where("node is null").select(F.col("doc_id").alias("id"), "th").distinct()
    return grouped.select(F.col("k.doc_id").alias("id"), F.col("k.th").alias("th")).union(empty)
