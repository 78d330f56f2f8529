"""Exact similarity join of shingle sets by skipping: what relations between sets already tell is not computed again.

Notation: n is a set's size. Two sets at a similarity of at least 3/4 share at least ceil(3n/4) shingles of either.

1. Sets and nodes. Documents with equal sets are one node.
2. Regions. A node's region is its floor(n/4) + 1 + e lowest shingle hashes, e = (n - 1) // 8; the regions of two
   linked sets share more than e shingles of either. A node with at most e shingles that other regions have as well
   links with nothing. Most nodes end here, on a third of their shingles.
3. Probes. Of the rest, whole sets are counted. A node with fewer than ceil(3n/4) shingles that others have ends here.
   Each other one may leave out its ceil(3n/4) - 1 most frequent shingles and still meet every linked set in a shingle
   that both kept: the least frequent one they share. What stays are its probes, in order of frequency.
4. Index lists by position. A list holds the nodes of one probe in blocks by set size, each block 1.4 times the size
   of the one before; only equal and adjacent blocks can hold linked sets, all others are skipped unread. Two nodes
   are compared only if what comes after the probe's positions in both is still enough for a link.
5. Answers from similar sets. Each list first compares its members with one leader only, the one with the fewest
   shingles of its own. The distance 1 - similarity is a metric: members whose distances to the leader differ by more
   than 1/4 cannot link, so only the others are compared.
6. Homes. A node linked with leaders has the leader of its longest such list as home. A member that lacks r of the
   home's L shingles and has e others costs 4r + 3e; two members whose costs add up to at most L are linked, whatever
   they are. These answers are counted from the costs alone. Only members whose costs add up to more are compared, in
   blocks by cost; pairs of blocks whose highest costs add up to at most L are skipped.
7. Verification is exact, on whole sets. Links merge into components. (Where only components are asked for, members
   that lie in one component are not compared at all.)
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .arrow import in_slices, over_batches
from .components import components
from .shingles import shingle_sets

BUCKET_TOKENS = 1 << 20
BATCH_NODES = 1 << 14
BROADCAST_IDS = 2_000_000  # 8 bytes each: at most 16 MB of ids are broadcast
PARTNERS = 256
SIZE_STEP = 1.4
HOME_BLOCK = 512  # members of a home compared at once, fewer of large sets
HOME_TOKENS = 1 << 21
COST_LEVELS = 16


def _node(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """128 bits that stand for a set."""
    digests = (hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return [(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) for d in digests]


def _sets(batch, text_col: str) -> Iterator[tuple]:
    for part in in_slices(batch, text_col, 1 << 20):
        yield part, shingle_sets([(t or "").encode() for t in part.column(text_col).to_pylist()])


def region_size(n: int) -> int:
    return n // 4 + 1 + (n - 1) // 8 if n else 0


def document_key(id_col: str, text_col: str) -> Column:
    """64 bits that stand for id and text of a row; never null, so rows without id have one too."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)


def membership(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every document's id, key, set size and node (s1, s2); stored."""
    def run(source) -> Iterator[dict]:
        for batch in source:
            for part, sets in _sets(batch, text_col):
                nodes = _node(sets)
                yield {"id": part.column(id_col), "key": part.column("_key"), "n": [len(s) for s in sets], "s1": [a for a, _ in nodes], "s2": [b for _, b in nodes]}

    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(id_col, text_col, document_key(id_col, text_col).alias("_key"))
    return stage(over_batches(keyed, [id_col, text_col, "_key"], run, f"id {kind}, key long, n long, s1 long, s2 long"), "sets")


def _shorten(h: np.ndarray) -> bytes:
    """48 of a hash's 64 bits; equal hashes stay equal, and others that become equal are only compared in vain."""
    return (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _lengthen(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _blocks(df: DataFrame, text_col: str, buckets: int, whole: bool) -> DataFrame:
    """Regions (or ``whole`` sets) of distinct nodes as arrays by bucket of hashes, and for each batch of nodes their names and sizes.

    Equal sets meet by name and are written once; a task sends each set that it has seen lately once only.
    """
    def regions(source) -> Iterator[dict]:
        for batch in source:
            seen, rows = set(), []
            for _, sets in _sets(batch, text_col):
                for s, (s1, s2) in zip(sets, _node(sets), strict=True):
                    if len(s) and (s1, s2) not in seen:
                        seen.add((s1, s2))
                        rows.append((s1, s2, len(s), _shorten(s if whole else s[:region_size(len(s))])))
            if rows:
                yield dict(zip(("s1", "s2", "n", "region"), map(list, zip(*rows)), strict=True))

    def split(source) -> Iterator[dict]:
        from pyspark import TaskContext

        number, last, held, size = TaskContext.get().partitionId() << 32, None, [], 0

        def flush() -> dict:
            tokens = _lengthen(b"".join(r for _, _, r in held))
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(r) // 6 for _, _, r in held])
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            parts = [order[cuts[k]:cuts[k + 1]] for k in full]
            return {
                "batch": [number] * (1 + len(full)), "bucket": [-1, *full],
                "a": [np.array([s for s, _, _ in held], np.int64).tobytes(), *(_shorten(tokens[p] << np.uint64(16)) for p in parts)],
                "b": [np.array([n for _, n, _ in held], np.int64).tobytes(), *(owner[p].tobytes() for p in parts)]}

        for batch in source:
            for s1, s2, n, region in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "n", "region")), strict=True):
                if (s1, s2) == last:
                    continue
                last = s1, s2
                held.append((s1, n, region))
                size += len(region)
                if len(held) == BATCH_NODES or size > 6 * BUCKET_TOKENS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    sent = over_batches(df, [text_col], regions, "s1 long, s2 long, n long, region binary")
    dealt = sent.repartition("s1").sortWithinPartitions("s1", "s2")
    return stage(over_batches(dealt, ["s1", "s2", "n", "region"], split, "batch long, bucket int, a binary, b binary"), "regions")


def _shared(blocks: DataFrame) -> DataFrame:
    """For each batch the entries whose shingle occurs in more than one region, with how many it occurs in."""
    def count(source) -> Iterator[dict]:
        bucket, held = None, []
        for batch in source:
            for k, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "a", "b")), strict=True):
                if k != bucket and held:
                    yield tell(held)
                    held = []
                bucket = k
                held.append(rest)
        if held:
            yield tell(held)

    def tell(held: list) -> dict:
        tokens = _lengthen(b"".join(a for _, a, _ in held))
        owner = np.frombuffer(b"".join(b for _, _, b in held), np.uint16)
        source = np.repeat(np.arange(len(held)), [len(b) // 2 for _, _, b in held])
        order = np.argsort(tokens, kind="stable")
        run = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order][:1] + np.uint64(1)))
        sizes = np.diff(np.append(run, len(order)))
        df = np.empty(len(order), np.uint32)
        df[order] = np.repeat(np.minimum(sizes, 0xFFFFFFFF), sizes)
        hit = np.flatnonzero(df > 1)
        cuts = np.searchsorted(source[hit], np.arange(len(held) + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [hit[cuts[k]:cuts[k + 1]] for k in full]
        return {"batch": [held[k][0] for k in full], "owner": [owner[p].tobytes() for p in parts],
                "tokens": [_shorten(tokens[p] << np.uint64(16)) for p in parts], "df": [df[p].tobytes() for p in parts]}

    dealt = blocks.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
    return over_batches(dealt, ["bucket", "batch", "a", "b"], count, "batch long, owner binary, tokens binary, df binary")


def _probes(blocks: DataFrame, whole: bool) -> DataFrame:
    """s1, n, the probes that some other node has, and the first one's position, of nodes with such probes; stored."""
    names = blocks.filter("bucket < 0").select("batch", F.col("a").alias("s1"), F.col("b").alias("n"))
    nothing = F.lit(None).cast("binary")
    rows = _shared(blocks).select("*", nothing.alias("s1"), nothing.alias("n")).unionByName(
        names.select("batch", *(nothing.alias(c) for c in ("owner", "tokens", "df")), "s1", "n"))
    columns = ["batch", "owner", "tokens", "df", "s1", "n"]

    def run(source) -> Iterator[dict]:
        number, held = None, []
        for batch in source:
            for k, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if k != number and held:
                    yield choose(held)
                    held = []
                number = k
                held.append(rest)
        if held:
            yield choose(held)

    def choose(held: list) -> dict:
        s1, n = (np.frombuffer(next(r[k] for r in held if r[k] is not None), np.int64) for k in (3, 4))
        owner = np.frombuffer(b"".join(r[0] or b"" for r in held), np.uint16).astype(np.int64)
        tokens = _lengthen(b"".join(r[1] or b"" for r in held))
        df = np.frombuffer(b"".join(r[2] or b"" for r in held), np.uint32)
        order = np.lexsort((tokens, df, owner))
        owner, tokens = owner[order], tokens[order]
        shared = np.bincount(owner, minlength=len(n))
        first = np.cumsum(shared) - shared
        left_out = -(-3 * n // 4) - 1 if whole else (n - 1) // 8
        # single shingles come first in the order of frequency; the most frequent e are left out
        keep = np.arange(len(owner)) - first[owner] < shared[owner] - left_out[owner]
        owner, tokens = owner[keep], tokens[keep]
        count = np.bincount(owner, minlength=len(n))
        alive = np.flatnonzero(count).tolist()
        ends = np.cumsum(count)
        single = (n if whole else n // 4 + 1 + (n - 1) // 8) - shared
        return {"s1": s1[alive], "n": n[alive], "single": single[alive], "tokens": [tokens[ends[k] - count[k]:ends[k]].view(np.int64) for k in alive]}

    dealt = rows.repartition("batch").sortWithinPartitions("batch")
    return stage(over_batches(dealt, columns, run, "s1 long, n long, single long, tokens array<long>"), "probes")


def _verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """a, b, the sizes and the shingles they share, of every pair, and the group of a's partners it was in; stored.

    A leader's partners are dealt over as many groups of about ``PARTNERS`` as it needs; each group gets the leader's
    set once and streams the partners' sets past it.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("_n")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / PARTNERS)).alias("block"))
    partners = sized.join(arrays.select(F.col("s1").alias("b"), "tokens"), "b").select("a", "block", "b", "tokens")
    leaders = sized.select("a", "block").distinct().join(arrays.select(F.col("s1").alias("a"), "tokens"), "a").select(
        "a", "block", F.lit(None).cast("long").alias("b"), "tokens")
    dealt = leaders.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(source) -> Iterator[dict]:
        own = np.empty(0, np.uint64)
        for batch in source:
            rows = []
            for a, block, b, tokens in zip(*(batch.column(c) for c in ("a", "block", "b", "tokens")), strict=True):
                values = np.frombuffer(tokens.as_buffer(), np.uint64)
                if not b.is_valid:
                    own = values
                    continue
                less, more = (own, values) if len(own) < len(values) else (values, own)
                at = np.searchsorted(more, less)
                both = int((more[np.minimum(at, len(more) - 1)] == less).sum())
                rows.append((a.as_py(), block.as_py(), b.as_py(), len(own), len(values), both))
            own = own.copy()  # the buffer of the batch goes with it
            if rows:
                yield dict(zip(("a", "block", "b", "n_a", "n_b", "both"), map(list, zip(*rows)), strict=True))

    return stage(over_batches(dealt, ["a", "block", "b", "tokens"], run, "a long, block long, b long, n_a long, n_b long, both long"), "verified")


def _linked(verified: DataFrame) -> DataFrame:
    return verified.filter("100 * both >= 75 * (n_a + n_b - both)")


def _links(verified: DataFrame) -> DataFrame:
    return _linked(verified).select("a", "b")


def _documents(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """s1 and text of the wanted nodes' documents (key of one document of each, s1)."""
    wanted = stage(wanted, "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return df.select(document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(side, "key")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """s1 and the whole set of every node of ``texts``; stored."""
    def run(source) -> Iterator[dict]:
        for batch in source:
            for part, sets in _sets(batch, "text"):
                same = [k for k, ((s1, _), wants) in enumerate(zip(_node(sets), part.column("s1").to_pylist(), strict=True)) if s1 == wants]
                if same:
                    yield {"s1": part.column("s1").take(same), "tokens": [sets[k].tobytes() for k in same]}

    found = over_batches(texts, ["text", "s1"], run, "s1 long, tokens binary")
    return stage(found.dropDuplicates(["s1"]), "whole-sets")


def _buckets(sizes: DataFrame, share: float) -> int:
    tokens = sizes.agg(F.sum(F.floor(F.col("n") * share) + 1)).first()[0] or 0
    return max(1, math.ceil(tokens / BUCKET_TOKENS))


def _led_lists(df: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index lists with their leaders, the pairs of leaders and members, these verified, and the whole sets."""
    keys = sets.filter("n > 0").groupBy("s1").agg(F.min("key").alias("key"))
    near = _probes(_blocks(df, text_col, _buckets(sets, 0.375), whole=False), whole=False)
    texts = _documents(df, keys.join(near.select("s1"), "s1"), id_col, text_col)
    probes = _probes(_blocks(texts, "text", _buckets(near, 1.0), whole=True), whole=True)
    lists = probes.select("s1", "n", "single", F.posexplode("tokens").alias("at", "token")).withColumn("at", F.col("single") + F.col("at"))
    # the member with the fewest shingles of its own leads: an original rather than one of its edited copies
    led = lists.groupBy("token").agg(F.min(F.struct("single", "s1")).alias("leader"), F.min("n").alias("least_n"), F.count("*").alias("_n")).filter("_n > 1").select("token", F.col("leader.s1").alias("leader"), "least_n", "_n")
    lists = stage(lists.drop("single").join(led, "token").withColumnRenamed("_n", "length"), "lists")
    first = stage(lists.filter("s1 <> leader").select(F.col("leader").alias("a"), F.col("s1").alias("b")).distinct(), "pairs")
    arrays = _whole_sets(_documents(df, keys.join(lists.select("s1").distinct(), "s1"), id_col, text_col))
    return lists, first, _verify(first, arrays), arrays


def find_links(df: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between nodes that connect all that is connected: not every link, but no component lacks one."""
    lists, first, verified, arrays = _led_lists(df, sets, id_col, text_col)
    links = _links(verified)
    labels = components(links)

    # the rest: members of one list in different components, in adjacent blocks, at distances that allow a link
    distance = 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    known = verified.select(F.col("a").alias("leader"), F.col("b").alias("s1"), distance.alias("far"))
    # (a member from whose position on not even the list's smallest set could link stays out)
    reachable = lists.filter("7 * (n - at) >= 3 * (n + greatest(least_n, ceil(0.75 * n)))")
    placed = reachable.join(labels.withColumnRenamed("node", "s1"), "s1", "left").join(known, ["leader", "s1"], "left").select(
        "token", "s1", "n", "at", F.coalesce("label", "s1").alias("label"), F.coalesce("far", F.lit(0.0)).alias("far"),
        F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).alias("block"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("token")
    open_lists = stage(placed.join(mixed, "token"), "open-lists")
    x = open_lists.select("token", *(F.col(c).alias(f"x_{c}") for c in ("s1", "n", "at", "label", "far")), F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"))
    y = open_lists.select("token", "block", *(F.col(c).alias(f"y_{c}") for c in ("s1", "n", "at", "label", "far")))
    rest = x.join(y, ["token", "block"]).filter(
        "x_s1 < y_s1 and x_label <> y_label and 4 * least(x_n, y_n) >= 3 * greatest(x_n, y_n) and abs(x_far - y_far) <= 0.250001 "
        "and 7 * least(x_n - x_at, y_n - y_at) >= 3 * (x_n + y_n)").select(F.col("x_s1").alias("a"), F.col("y_s1").alias("b")).distinct()
    rest = stage(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(_links(_verify(rest, arrays)))


def _homes(lists: DataFrame, verified: DataFrame) -> DataFrame:
    """s1, n, home, the home's size ``leads`` and the cost from it, of every listed node; stored.

    A node without a linked leader is its own home. A leader may have another home than the nodes that it leads.
    """
    told = _linked(verified).select(F.col("a").alias("leader"), F.col("b").alias("s1"), F.col("n_a").alias("leads"),
                                    (4 * (F.col("n_a") - F.col("both")) + 3 * (F.col("n_b") - F.col("both"))).alias("cost"))
    led = lists.groupBy("leader", "s1").agg(F.max("length").alias("length"), F.first("n").alias("n")).join(told, ["leader", "s1"], "left")
    itself = F.col("leader") == F.col("s1")
    fits = F.when(itself | F.col("leads").isNotNull(), F.struct(
        "length", "leader", F.when(itself, F.col("n")).otherwise(F.col("leads")).alias("leads"), F.when(itself, 0).otherwise(F.col("cost")).alias("cost")))
    best = led.groupBy("s1").agg(F.first("n").alias("n"), F.max(fits).alias("best"))
    return stage(best.select("s1", "n", F.coalesce("best.leader", "s1").alias("home"), F.coalesce("best.leads", "n").alias("leads"),
                             F.coalesce("best.cost", F.lit(0)).cast("long").alias("cost")), "homes")


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``xs`` shares with each of ``ys``; a few thousand values at a time."""
    both = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
    total = np.zeros((len(xs), len(ys)), np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.concatenate(sets)
        at = np.searchsorted(both, tokens)
        hit = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == tokens)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    def matrix(rows: int, owner: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
        here = (at >= first) & (at < first + 4096)
        full = np.zeros((rows, 4096), np.float32)
        full[owner[here], at[here] - first] = 1
        return full

    if len(both):
        left, right = places(xs), places(ys)
        for first in range(0, len(both), 4096):  # sums of at most 4096 ones are exact
            total += (matrix(len(xs), *left, first) @ matrix(len(ys), *right, first).T).astype(np.int64)
    return total


def _compare_blocks(dealt: DataFrame) -> DataFrame:
    """s1 and how many documents of a facing block it links with, of those pairs that the costs leave open."""
    columns = ["home", "low", "high", "upper", "s1", "cost", "leads", "copies", "tokens"]

    def answer(low: int, high: int, held: list) -> dict | None:
        x = [r for r in held if not r[0]]
        y = x if low == high else [r for r in held if r[0]]
        if not x or not y:
            return None
        sets_x, sets_y = ([np.frombuffer(r[5], np.uint64) for r in rows] for rows in (x, y))
        both = _overlaps(sets_x, sets_y)
        (n_x, cost_x, copies_x), (n_y, cost_y, copies_y) = (
            (np.array([len(s) for s in sets]), np.array([r[2] for r in rows]), np.array([r[4] for r in rows])) for rows, sets in ((x, sets_x), (y, sets_y)))
        linked = (cost_x[:, None] + cost_y > x[0][3]) & (100 * both >= 75 * (n_x[:, None] + n_y - both))
        if low == high:
            np.fill_diagonal(linked, False)
            return {"s1": [r[1] for r in x], "others": linked @ copies_x}
        return {"s1": [r[1] for r in x + y], "others": np.concatenate([linked @ copies_y, copies_x @ linked])}

    def run(source) -> Iterator[dict]:
        group, held = None, []
        for batch in source:
            for home, low, high, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (home, low, high) != group:
                    told = answer(*group[1:], held) if held else None
                    if told:
                        yield told
                    group, held = (home, low, high), []
                held.append(rest)
        told = answer(*group[1:], held) if held else None
        if told:
            yield told

    sorted_groups = dealt.repartition("home", "low", "high").sortWithinPartitions("home", "low", "high")
    return over_batches(sorted_groups, columns, run, "s1 long, others long")


def _inside_homes(homes: DataFrame, copies: DataFrame, arrays: DataFrame) -> DataFrame:
    """s1 and ``others``, numbers that add up to the documents of linked other sets of the same home.

    A home's costs are at most its size, so tables by home and cost stay narrow however many members there are.
    """
    members = homes.join(copies, "s1")
    whole = Window.partitionBy("home")
    fit = F.greatest(F.lit(8), F.least(F.lit(HOME_BLOCK), F.floor(HOME_TOKENS / F.col("leads"))))
    level = F.when(F.col("size") <= fit, 0).otherwise(F.floor(COST_LEVELS * F.col("cost") / F.col("leads"))).cast("long")
    costs = members.groupBy("home", "leads", "cost").agg(F.sum("copies").alias("weight"), F.count("*").alias("m")).withColumn(
        "size", F.sum("m").over(whole)).filter("size > 1").withColumn("level", level)
    costs = stage(costs, "costs")
    events = costs.select("home", F.col("cost").alias("at"), F.lit(0).alias("asks"), "weight", "cost").unionByName(
        costs.select("home", (F.col("leads") - F.col("cost")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("weight"), "cost"))
    upto = F.sum("weight").over(whole.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = events.withColumn("sure", upto).filter("asks = 1").select("home", "cost", "sure")
    shelf = F.struct("level", F.ceil(F.col("m") / fit).alias("parts"), "top")
    shelves = costs.groupBy("home", "leads", "level").agg(F.sum("m").alias("m"), F.max("cost").alias("top")).groupBy("home").agg(
        F.collect_list(shelf).alias("shelves"))
    plan = stage(costs.select("home", "cost", "level").join(sure, ["home", "cost"]).join(shelves, "home"), "plan")

    placed = members.join(plan, ["home", "cost"])
    certain = placed.select("s1", (F.col("sure") - F.when(2 * F.col("cost") <= F.col("leads"), F.col("copies")).otherwise(0)).alias("others"))
    facing = F.filter("shelves", lambda s: s["top"] + F.col("cost") > F.col("leads"))
    parts = F.get(F.filter("shelves", lambda s: s["level"] == F.col("level")), F.lit(0))["parts"]
    block = F.col("level") * (1 << 32) + F.pmod(F.xxhash64("s1"), parts)
    others = F.flatten(F.transform(facing, lambda s: F.transform(
        F.sequence(F.lit(0).cast("long"), s["parts"] - 1), lambda k: s["level"] * (1 << 32) + k)))
    asking = placed.filter(F.size(facing) > 0).select("s1", "home", "cost", "leads", "copies", block.alias("block"), others.alias("facing"))
    dealt = asking.join(arrays, "s1").withColumn("other", F.explode("facing")).select(
        "home", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("upper"),
        "s1", "cost", "leads", "copies", "tokens")
    return certain.unionByName(_compare_blocks(dealt))


def _links_across(lists: DataFrame, homes: DataFrame, first: DataFrame, verified: DataFrame, arrays: DataFrame) -> DataFrame:
    """Every link (a < b) between nodes of different ``homes`` (s1, home); stored.

    Two members of a list share at least what both share with its leader beyond the leader's size. Where that is enough
    the link is told by the leader's answers; the other pairs that bounds do not rule out are verified.
    """
    known = verified.select(F.col("a").alias("leader"), F.col("b").alias("s1"), F.col("n_a").alias("leads"), "both")
    # (a member from whose position on not even the list's smallest set could link stays out)
    placed = lists.filter("7 * (n - at) >= 3 * (n + greatest(least_n, ceil(0.75 * n)))").join(homes, "s1").join(known, ["leader", "s1"], "left").select(
        "token", "s1", "n", "at", "home", F.coalesce("leads", "n").alias("leads"), F.coalesce("both", "n").alias("both"),
        F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).alias("block"))
    mixed = placed.groupBy("token").agg(F.min("home").alias("_low"), F.max("home").alias("_high")).filter("_low < _high").select("token")
    placed = stage(placed.withColumn("far", 1 - F.col("both") / (F.col("leads") + F.col("n") - F.col("both"))).join(mixed, "token"), "placed")
    x = placed.select("token", "leads", *(F.col(c).alias(f"x_{c}") for c in ("s1", "n", "at", "home", "both", "far")), F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"))
    y = placed.select("token", "block", *(F.col(c).alias(f"y_{c}") for c in ("s1", "n", "at", "home", "both", "far")))
    pairs = x.join(y, ["token", "block"]).filter(
        "x_s1 < y_s1 and x_home <> y_home and 4 * least(x_n, y_n) >= 3 * greatest(x_n, y_n) and abs(x_far - y_far) <= 0.250001 "
        "and 7 * least(x_n - x_at, y_n - y_at) >= 3 * (x_n + y_n)").select(
        F.col("x_s1").alias("a"), F.col("y_s1").alias("b"), (F.col("x_n") + F.col("y_n")).alias("_sum"), (F.col("x_both") + F.col("y_both") - F.col("leads")).alias("_least"))
    pairs = pairs.groupBy("a", "b").agg(F.max(F.expr("100 * _least >= 75 * (_sum - _least)")).alias("sure"))
    led = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stage(pairs.join(led, ["a", "b"], "left_anti"), "pairs")
    # a leader's home comes once for each group of its partners
    leaders = verified.select("a", "block").distinct().join(homes.select(F.col("s1").alias("a"), F.col("home").alias("_x")), "a")
    told = _linked(verified).join(leaders, ["a", "block"]).join(homes.select(F.col("s1").alias("b"), F.col("home").alias("_y")), "b").filter("_x <> _y").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stage(told.unionByName(pairs.filter("sure").select("a", "b")).unionByName(_links(_verify(pairs.filter("not sure").select("a", "b"), arrays))), "links")


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a and b, the smallest ids of two distinct sets at a similarity of at least 3/4, for every such pair of sets.

    All pairs are given, also those inside a component: as many rows as there are links. Sets without an id have null.
    """
    sets = membership(df, id_col, text_col)
    least = stage(sets.filter("n > 0").groupBy("s1").agg(F.min("id").alias("id")), "least")
    lists, *rest = _led_lists(df, sets, id_col, text_col)
    links = _links_across(lists, lists.select("s1", F.col("s1").alias("home")).distinct(), *rest)
    named = links.join(least.select(F.col("s1").alias("a"), F.col("id").alias("_x")), "a").join(least.select(F.col("s1").alias("b"), F.col("id").alias("_y")), "b")
    return named.select(F.least("_x", "_y").alias("a"), F.when(F.col("_x").isNull() | F.col("_y").isNull(), F.lit(None)).otherwise(F.greatest("_x", "_y")).alias("b"))


def _answers(df: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links that connect all that is connected, and s1 and n_links of every node with a shingle; both stored."""
    lists, first, verified, arrays = _led_lists(df, sets, id_col, text_col)
    homes = _homes(lists, verified)
    across = _links_across(lists, homes.select("s1", "home"), first, verified, arrays)
    copies = stage(sets.filter("n > 0").groupBy("s1").agg(F.count("*").alias("copies")), "copies")
    ends = across.union(across.select("b", "a")).join(copies.withColumnRenamed("s1", "b"), "b").select(F.col("a").alias("s1"), F.col("copies").alias("others"))
    others = ends.unionByName(_inside_homes(homes, copies, arrays)).groupBy("s1").agg(F.sum("others").alias("others"))
    counted = copies.join(others, "s1", "left").select("s1", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return across.unionByName(_links(verified)), stage(counted, "counted")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and n_links of every document: :func:`jaccard_components` and the number of links.

    ``n_links`` counts the other documents at a similarity of at least 3/4, equal texts and repeated rows among them; 0
    for null and blank texts. Links inside a home are counted, never listed; comparisons inside it grow with the square
    of the members far from the home only.
    """
    sets = membership(df, id_col, text_col)
    links, counted = _answers(df, sets, id_col, text_col)
    named = _named(sets, links).join(counted, "s1", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def count_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_links, the number of other documents at a similarity of at least 3/4 (equal texts too), of every row."""
    return jaccard_join(df, id_col, text_col).select(id_col, "n_links")


def _named(sets: DataFrame, links: DataFrame) -> DataFrame:
    """id, key, set size and node (null without words) of every row, and the first document of its component.

    The first is that with the smallest id, then key, nulls last.
    """
    labels = components(links)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min(own).alias("least"))
    labelled = classes.join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("label", F.coalesce("label", "s1"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("first"))
    named = stage(labelled.join(smallest, "label").select("s1", "s2", "first"), "components")
    empty = sets.filter("n = 0").select("id", "key", "n", F.lit(None).cast("long").alias("s1"), own.alias("first"))
    return sets.filter("n > 0").join(named, ["s1", "s2"]).select("id", "key", "n", "s1", "first").unionByName(empty)


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sets = membership(df, id_col, text_col)
    return _named(sets, find_links(df, sets, id_col, text_col))


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``document_key`` of every row, and whether it is the first document of its component.

    Rows that share an id, or have none, are told apart by their texts; equal rows share a key and a verdict.
    """
    return _grouped(df, id_col, text_col).select("key", (F.col("key") == F.col("first.key")).alias("is_first"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) of every document.

    Exact at a similarity of 3/4 over distinct shingles of five words, up to collisions of 64-bit hashes. Null and
    blank texts have no shingle, link with nothing and are their own component. Repeated rows and equal texts share a
    component; rows keep their number. A null id is never a component unless all ids of it are null. An empty table
    gives no row. Other columns are not read. Ids must be numbers.
    """
    return _grouped(df, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))
