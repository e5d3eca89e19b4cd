"""N-gram Jaccard join by set relations: near-duplicate documents and their groups.

A document's set has its distinct word shingles. Two sets link at Jaccard similarity 0.75 or more.

1. Equal sets are one vertex, represented by the smallest id.
2. Shingles are ordered by how common they are (by a count sketch of fixed size, then the hash), rare ones
   first. A set posts its first ``prefix(n) = n // 4 + 1 + n // EXTRA`` shingles. Two sets that link share at
   least ``1 + n // EXTRA`` of them, for either size n: of the set whose prefix ends first, every shared
   shingle is posted by both, and only ``n - prefix(n)`` can follow. So a posting without another set of
   fitting size in its list is dropped, and then a set with too few postings. A set cannot share more than
   the postings left to it and its shingles beyond the prefix (``cap``), nor, from a posting on, more than
   those that follow (``rest``); a link's first shared posting leaves both sets enough.
3. Answer skipping. In a hub round, posting lists (a sample of them, by size class) name a few hubs, and
   each set is compared with the hub of most of its lists. Sets whose components have met by then need no
   more comparison: the hub's answers hold for them. Rounds only save work; any choice of hubs will do.
4. Block skipping. What is left of a list is cut into blocks by set size and by position. Pairs of
   blocks that cannot hold a link (sizes too far apart, too little left from the position on, or all in
   one component) are skipped as a whole; the sets of the others are paired. If the lists would pair many
   more sets than there are postings, another hub round comes first, as long as rounds help: from the
   second on, the last one must have saved ``FEW`` of the pairs, counted on the same lists before and after.
5. A pair (y, z) left is derived from y's hub x, if (x, z) has been compared: the overlap of y and z lies
   between |x & z| - |x - y| and |x & z| + |y - x|. Only what that leaves open is compared itself.

No step lists all pairs of a group of copies: a group that its hub joins has no pair left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, chunks, mix64, span_hashes, windows, word_spans

WORDS = 5
SKETCH = 1 << 19
OCTAVE = 1600  # steps of a shingle's rank for each doubling of its slot's count
EXTRA = 10  # a set posts n // EXTRA more shingles than a prefix filter needs, so that it can count them
LONG = 1 << 16  # lists that may be longer are spread over tasks
_SHORT = np.uint64(0x5DEECE66D1F2A3B7)
SMALL = 1 << 16  # edges that one task joins by itself
FEW = 0.2  # a hub round that saves less of the work than this is the last one
_SEEN = 1 << 16  # sets remembered by a task to leave out its repeats; forgetting costs time only


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS):
    """Each text's sorted distinct shingle hashes; with fewer words, the whole sequence as one."""
    starts, ends, first = word_spans(data, offs)
    h = span_hashes(LOWER[data], starts, ends)
    w = windows(h, words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(w[a : b - words + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix64((h[a:b] * (np.uint64(2) * np.arange(b - a, dtype=np.uint64) + _SHORT)).sum(keepdims=True) + _SHORT * np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit digest of a set; together with the set's size it names the set."""
    with np.errstate(over="ignore"):
        x = mix64(mix64(s).sum(keepdims=True) + np.bitwise_xor.reduce(s, keepdims=True) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))
    return int(x.view(np.int64)[0])


def prefix(n):
    """How many of its n shingles a set posts."""
    return n // 4 + 1 + n // EXTRA


def slots(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SKETCH - 1)).astype(np.int64)


def _scan(batches):
    """Rows (0, id, set, size, key) for texts; (1, slot, count, 0, 0) for slots that stand out; (2, 0, all, 0, 0)."""
    counts = np.zeros(SKETCH, np.int64)
    names = ["kind", "a", "b", "c", "d"]
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(2)):
            keys, sizes = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            found = []
            for i, s in enumerate(shingle_sets(data, offs)):
                if len(s):
                    keys[i], sizes[i] = set_id(s), len(s)
                    found.append(s)
            if found:
                counts += np.bincount(slots(np.concatenate(found)), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int8)), batch.column(0).slice(lo, hi - lo), pa.array(keys), pa.array(sizes), batch.column(1).slice(lo, hi - lo)], names)
    mean = counts.mean()
    at = np.flatnonzero(counts > mean + np.sqrt(mean))
    zero = np.zeros(len(at) + 1, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(at), 1), 2).astype(np.int8)), pa.array(np.append(at, 0)), pa.array(np.append(counts[at], counts.sum())), pa.array(zero), pa.array(zero)], names)


def _post(rank: np.ndarray, heavy: int):
    """Rows (token, set, place, salt) of each set's first shingles, rare ones first; place has size and position."""

    def run(batches):
        seen = set()
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                tokens, sets, sizes, ranks = [], [], [], []
                for s in shingle_sets(data, offs):
                    key = set_id(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    r = rank[slots(s)]
                    first = np.argsort((r.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)))[: prefix(len(s))]
                    tokens.append(s[first])
                    ranks.append(r[first])
                    sets.append(key)
                    sizes.append(len(s))
                if len(seen) > _SEEN:
                    seen.clear()
                if not tokens:
                    continue
                k = [len(t) for t in tokens]
                which = np.repeat(np.array(sets, np.int64), k)
                place = (np.repeat(np.array(sizes, np.int64), k) << 32) | np.concatenate([np.arange(x) for x in k])
                # A list that may be long is spread; its shingles are common, so they need not meet to be kept.
                salt = np.where(np.concatenate(ranks) >= heavy, 1 + (which & 255), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(which), pa.array(place), pa.array(salt)], ["token", "set", "place", "salt"])

    return run


def _shared(batches):
    """Of rows sorted by token, place and set: those with a salt or a neighbour of fitting size, once per set.

    In a list sorted by size, a set's nearest neighbours fit if any other set does, so a row is judged by the
    rows before and after it. One row is kept back between batches.
    """
    names = ["token", "set", "place"]
    rest, fits_last = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)], False
    for batch in batches:
        rows = [np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(rest)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([rows[i][1:] != rows[i][:-1] for i in range(3)], axis=0)
        token, sets, place, salt = (x[new] for x in rows)
        n = place >> 32
        near = (token[1:] == token[:-1]) & (4 * n[:-1] >= 3 * n[1:])
        keep = np.concatenate(([fits_last], near)) | np.append(near, False) | (salt > 0)
        rest, fits_last = [token[-1:], sets[-1:], place[-1:], salt[-1:]], bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, sets, place)], names)
    if fits_last:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest[:3]], names)


def _overlaps(batches):
    """Rows (hub, salt, role, id, text) sorted so that a hub's own text comes first -> (hub, id, hub_n, n, overlap)."""
    key, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        hubs, salts, roles, ids = (batch.column(i).to_numpy() for i in range(4))
        overlap = np.full(len(ids), -1, np.int64)
        size, hub_size = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for lo, _, data, offs in chunks(batch.column(4)):
            for i, s in enumerate(shingle_sets(data, offs), lo):
                if roles[i] == 0:
                    key, own = (hubs[i], salts[i]), s
                elif key == (hubs[i], salts[i]):
                    overlap[i], size[i], hub_size[i] = _common(own, s), len(s), len(own)
        at = overlap >= 0
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (hubs, ids, hub_size, size, overlap)], ["hub", "id", "hub_n", "n", "overlap"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _among(rows: DataFrame, col: str, ids: DataFrame, bits: int = 21) -> DataFrame:
    """Rows whose id may be in ids: a bit table of fixed size is broadcast. It only saves later work."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    table = ids.select(slot(F.col("id")).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    joined = rows.join(F.broadcast(table), F.shiftright(slot(F.col(col)), 6) == F.col("_word"))
    return joined.where(F.expr(f"(shiftright(_bits, cast(pmod(xxhash64({col}), {1 << bits}) & 63 as int)) & 1) = 1")).drop("_word", "_bits")


def compare(pairs: DataFrame, texts: DataFrame, per_task: int = 256) -> DataFrame:
    """(hub, id, hub_n, n, overlap) of the written pairs (hub, id), from (id, text). A hub with many partners is spread."""
    count = F.count(F.lit(1)).over(Window.partitionBy("hub"))
    pairs = pairs.select("hub", "id", count.alias("_n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.floor(F.col("_n") / per_task) + 1).cast("int"))
    pairs = pairs.withColumn("_first", F.row_number().over(Window.partitionBy("hub", "salt").orderBy("id")) == 1)
    own, other = F.struct(F.lit(0).alias("role"), F.col("hub").alias("id")), F.struct(F.lit(1).alias("role"), F.col("id"))
    asked = pairs.select("hub", "salt", F.explode(F.when(F.col("_first"), F.array(own, other)).otherwise(F.array(other))).alias("_e")).select("hub", "salt", "_e.*")
    rows = asked.join(texts, "id").select("hub", "salt", "role", "id", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return rows.mapInArrow(_overlaps, "hub long, id long, hub_n long, n long, overlap long")


def linked(overlap, n1, n2):
    """Jaccard similarity of at least 0.75, in whole numbers: 4 * common >= 3 * union."""
    return F.lit(7) * overlap >= F.lit(3) * (n1 + n2)


def needed(n1: str, n2: str) -> str:
    """SQL for the least number that two sets of these sizes share of their first n // 4 + 1 shingles if they link."""
    return "least(" + ", ".join(f"ceil(3 * ({n1} + {n2}) / 7) - {n} + {n} div 4 + 1" for n in (n1, n2)) + ")"


def _joined(batches, most: int = 1 << 20):
    """(a, b): each vertex of the edges (a, b), with the smallest that it reaches; by itself for every ``most`` edges or so."""
    held, n = [], 0

    def forest():
        ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        low = np.arange(len(ids))
        while (low[a] != low[b]).any():
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, low[a], least)
            np.minimum.at(low, low[b], least)
            while (low[low] != low).any():
                low = low[low]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in range(2)]))
        n += batch.num_rows
        if n >= most:
            yield forest()
            n = 0
    if n:
        yield forest()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) of each vertex of the written edges (a, b): the smallest id it reaches.

    Each task joins its own edges first. What is left is joined by one task, if it is at most ``SMALL`` edges;
    otherwise by neighbours' minima, then a jump, until nothing changes.
    """
    edges = scratch.put(edges.mapInArrow(_joined, "a long, b long").where("a <> b"), "edges")
    if edges.count() <= SMALL:
        labels = scratch.put(edges.coalesce(1).mapInArrow(_joined, "a long, b long").toDF("id", "comp"), "labels")
        scratch.drop(edges)
        return labels
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct()
    both = scratch.put(both, "ends")
    scratch.drop(edges)
    labels = scratch.put(both.groupBy("id").agg(F.min("other").alias("comp")).select("id", F.least("id", "comp").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "comp"), "other").groupBy("id").agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("jump"))
        new = scratch.put(step.join(jump, "mid", "left").select("id", "old", F.least("mid", F.coalesce("jump", "mid")).alias("comp")), "labels")
        scratch.drop(labels)
        labels = new
        if new.where("old <> comp").isEmpty():
            scratch.drop(both)
            return labels.select("id", "comp")


def _merged(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp, was): comps (id, comp), with the components that links (a, b) join as one, and the component before."""
    edges = links.unionByName(comps.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
    labels = components(edges, scratch).select("id", F.col("comp").alias("_new"))
    return scratch.put(comps.select("id", F.col("comp").alias("was")).join(labels, "id", "left").select("id", F.coalesce("_new", "id").alias("comp"), "was"), "comps")


def _sample(lists: DataFrame, turn: int) -> DataFrame:
    """A quarter of the lists, and the postings of short sets."""
    return lists.where(F.expr(f"n < 64 or pmod(xxhash64(token, {turn}), 4) = 0"))


def _work(lists: DataFrame) -> tuple[int, int, int]:
    """How many pairs of sets of different components the lists hold, how many before the last round, and how many postings there are."""
    of = lists.select("token", "comp", "was").repartition("token", "comp").groupBy("token", "comp", "was").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("token", "comp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("was"))
    of = of.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("was").alias("was"))
    found = of.agg(F.sum(F.expr("(n * n - same) div 2")), F.sum(F.expr("(n * n - was) div 2")), F.sum("n")).first()
    return found[0] or 0, found[1] or 0, found[2] or 0


def _hub_pairs(lists: DataFrame, compared: DataFrame | None, turn: int, hubs: int = 4) -> DataFrame:
    """(hub, id): for each set, of the hubs of its lists and of other components, the one of most lists.

    A list names up to ``hubs`` hubs for each class of sizes, at first those of which the largest part may
    be shared; the classes' bounds shift by turns. Pairs of very few lists are left to the blocks, as are
    all others that this leaves out.
    """
    lists = lists.withColumn("size_class", F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)) + F.lit(turn % 2 / 2)).cast("int"))
    first = F.xxhash64(F.col("id"), F.lit(turn))
    hub = lists.groupBy("token", "size_class", F.pmod(first, F.lit(hubs))).agg(F.max(F.struct((F.col("cap") / F.col("n") if turn == 0 else F.lit(0.0)).alias("_cap"), first.alias("_first"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))).alias("_h")).select("token", "size_class", "_h.*")
    met = lists.join(hub, ["token", "size_class"]).where("comp <> hub_comp").groupBy("id", "hub", "n", "hub_n").agg(F.count(F.lit(1)).alias("lists"))
    met = met.where(f"8 * lists >= {needed('n', 'hub_n')}")
    if compared is not None:
        met = met.join(_both(compared).select(F.col("a").alias("id"), F.col("b").alias("hub")), ["id", "hub"], "left_anti")
    return met.groupBy("id").agg(F.max_by("hub", F.struct("lists", "hub")).alias("hub")).select("hub", "id")


def _both(compared: DataFrame) -> DataFrame:
    """(a, b, overlap) of the compared pairs, either way."""
    ends = F.array(F.struct(F.col("hub").alias("a"), F.col("id").alias("b"), "overlap"), F.struct(F.col("id").alias("a"), F.col("hub").alias("b"), "overlap"))
    return compared.select(F.explode(ends).alias("e")).select("e.*")


BLOCK = ["token", "size_block", "place_block"]


def _blocks(lists: DataFrame) -> DataFrame:
    return lists.withColumns({"size_block": F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))).cast("int"), "place_block": F.floor(F.col("rest") * 32 / F.col("n")).cast("int")})


def _block_skips(lists: DataFrame) -> DataFrame:
    """Pairs of blocks that may hold a link of different components.

    The first shingle that two linked sets share leaves each as many shingles from there on as they share.
    """
    blocks = _blocks(lists).groupBy(*BLOCK).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max("rest").alias("rest_max"), F.min("comp").alias("c_min"), F.max("comp").alias("c_max"))
    a, b = blocks.alias("a"), blocks.alias("b")
    fits = F.expr(
        "(a.size_block < b.size_block or (a.size_block = b.size_block and a.place_block <= b.place_block))"
        " and 4 * a.n_max >= 3 * b.n_min and 4 * b.n_max >= 3 * a.n_min"
        " and 7 * least(a.rest_max, b.rest_max) >= 3 * (a.n_min + b.n_min)"
        " and not (a.c_min = a.c_max and b.c_min = b.c_max and a.c_min = b.c_min)"
    )
    near = a.join(b, F.col("a.token") == F.col("b.token")).where(fits)
    return near.select(*[F.col(f"a.{k}").alias(k) for k in BLOCK], F.col("b.size_block").alias("size_block2"), F.col("b.place_block").alias("place_block2"))


def _block_pairs(lists: DataFrame, near: DataFrame) -> DataFrame:
    """(y, z, sizes): pairs of sets of different components, from the pairs of blocks."""
    lists = _blocks(lists)
    left = lists.select(*BLOCK, F.col("id").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), F.col("comp").alias("cy"))
    right = lists.select("token", F.col("size_block").alias("size_block2"), F.col("place_block").alias("place_block2"), F.col("id").alias("z"), F.col("n").alias("nz"), F.col("rest").alias("rz"), F.col("comp").alias("cz"))
    pairs = left.join(near, BLOCK).join(right, ["token", "size_block2", "place_block2"])
    pairs = pairs.where("cy <> cz and 7 * least(ry, rz) >= 3 * (ny + nz)")
    swap = F.col("y") > F.col("z")
    return pairs.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("y", "z"), ("z", "y"), ("ny", "nz"), ("nz", "ny"))]).distinct()


def _derive(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """(y, z, sure, never) of the pairs (y, z) not yet compared: whether a hub's answers show that they link, or never do."""
    known = _both(compared)
    near = compared.groupBy(F.col("id").alias("y")).agg(F.max_by(F.struct("hub", "hub_n", "overlap"), F.struct(F.col("overlap") / F.col("hub_n"), "hub")).alias("h")).select("y", F.col("h.hub").alias("x"), F.col("h.hub_n").alias("nx"), F.col("h.overlap").alias("xy"))
    pairs = pairs.join(known.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"], "left_anti")
    pairs = pairs.join(near, "y", "left").join(known.groupBy(F.col("a").alias("x"), F.col("b").alias("z")).agg(F.max("overlap").alias("xz")), ["x", "z"], "left")
    least, most = F.col("xz") - (F.col("nx") - F.col("xy")), F.col("xz") + (F.col("ny") - F.col("xy"))
    return pairs.select("y", "z", F.coalesce(linked(least, F.col("ny"), F.col("nz")), F.lit(False)).alias("sure"), F.coalesce(~linked(most, F.col("ny"), F.col("nz")), F.lit(False)).alias("never"))


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(linked(F.col("overlap"), F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _ranks(scanned: DataFrame) -> tuple[np.ndarray, int]:
    """Each slot's rank, from its count, and the rank from which lists are spread."""
    counts = np.zeros(SKETCH, np.int64)
    got = scanned.where("kind > 0").groupBy("kind", "a").agg(F.sum("b").alias("n")).toArrow()  # at most SKETCH + 1 rows
    kind, slot, n = (got.column(k).to_numpy() for k in ("kind", "a", "n"))
    counts[slot[kind == 1]] = n[kind == 1]
    rank = lambda x: np.minimum(65535, np.floor(OCTAVE * np.log2(x + 1)))
    return rank(counts).astype(np.uint16), int(rank(max(LONG, 16 * int(n[kind == 2].sum()) // SKETCH)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_key (a hash of the text).

    component_id is the smallest id that links reach, the row's own if there is none. A null or empty
    text, or one without words, has no shingles and no link. A text of fewer than five words links with
    equal word sequences only. Rows that repeat an id are texts of their own. A row without an id has
    no component and joins nothing. An empty table gives an empty result; other columns are not read.
    ``rounds`` (1 or more) bounds the hub rounds; the result is the same for any number.
    """
    scratch = Scratch(docs.sparkSession, "join")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    scanned = scratch.put(source.mapInArrow(_scan, "kind tinyint, a long, b long, c long, d long"), "scan")
    rows = scanned.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("set"), F.col("c").alias("n"), F.col("d").alias("key"))
    rank, heavy = _ranks(scanned)

    posts = source.select("text").mapInArrow(_post(rank, heavy), "token long, set long, place long, salt int")
    met = posts.repartition("token", "salt").sortWithinPartitions("token", "place", "set").mapInArrow(_shared, "token long, set long, place long")
    met = met.select("token", "set", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"))
    # What a set may share in all, and from each posting on.
    left = F.count(F.lit(1)).over(Window.partitionBy("set", "n").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    beyond = F.expr(f"n - (n div 4 + 1 + n div {EXTRA})")
    met = met.withColumns({"rest": (left + beyond).cast("int"), "cap": (F.count(F.lit(1)).over(Window.partitionBy("set", "n")) + beyond).cast("int")})
    kept = scratch.put(met.where(f"cap - n + n div 4 >= 0 and 4 * rest >= 3 * n").drop("pos"), "posts")
    # A class is a set that some row with an id has; its number stands for it from here on.
    classes = rows.where("n > 0 and id is not null").groupBy("set", "n").agg(F.min(F.struct("id", "key")).alias("least"))
    used = kept.select("set", "n").distinct().join(classes, ["set", "n"])
    used = scratch.put(used.select(F.monotonically_increasing_id().alias("id"), "set", "n", F.col("least.id").alias("least"), F.col("least.key").alias("key")), "used")
    lists = scratch.put(kept.join(used, ["set", "n"]).select("token", "id", "n", "rest", "cap"), "lists")
    scratch.drop(kept)
    asked = _among(source.select(F.col("id").alias("least"), "key", "text"), "least", used.select(F.col("least").alias("id"))).groupBy("least", "key").agg(F.first("text").alias("text"))
    texts = scratch.put(asked.join(used, ["least", "key"]).select("id", "text"), "texts")

    comps, compared = used.select("id", F.col("id").alias("comp")), None
    now = lists.withColumns({"comp": F.col("id"), "was": F.col("id")})
    for turn in range(rounds):
        sample = _sample(now, turn)
        if turn:
            work, before, postings = _work(sample)
            if work <= 4 * postings or turn > 1 and work > (1 - FEW) * before:
                break
        pairs = scratch.put(_hub_pairs(sample, compared, turn), "hubs")
        more = scratch.put(compare(pairs, texts), "overlaps")
        compared = more if compared is None else compared.unionByName(more)
        comps = _merged(comps, _links(more), scratch)
        scratch.drop(now)
        now = scratch.put(lists.join(comps, "id"), "lists")
    near = _block_skips(now)
    pairs = scratch.put(_derive(_block_pairs(now, near), compared), "pairs")
    open_pairs = pairs.where("not sure and not never").select(F.col("y").alias("hub"), F.col("z").alias("id"))
    more = scratch.put(compare(open_pairs, texts), "overlaps")
    sure = pairs.where("sure").select(F.col("y").alias("a"), F.col("z").alias("b"))
    comps = _merged(comps, _links(more).unionByName(sure), scratch)

    # A component's name is the smallest id of its classes; a class that shares too little is one by itself.
    members = comps.join(used, "id").select("comp", "set", "n", "least")
    named = members.join(members.groupBy("comp").agg(F.min("least").alias("name")), "comp").select("set", "n", "name")
    of_class = scratch.put(classes.join(named, ["set", "n"], "left").select("set", "n", F.coalesce("name", F.col("least.id")).alias("name")), "names")
    scratch.keep(scanned, of_class)
    out = rows.join(of_class, ["set", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("name")), F.col("id"))).alias("component_id"), F.col("key").alias("text_key"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' rows, all columns, one document of each component.

    That is the smallest id; if that id has several texts in the component, the one of the smallest
    hash. Rows that repeat an id and a text are one document. Rows without an id or without words stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options).where("doc_id is not null and n_shingles > 0")
    own = found.where("doc_id = component_id")
    first = own.groupBy("doc_id").agg(F.min("text_key").alias("_first"))
    other = found.where("doc_id <> component_id").select("doc_id", "text_key").unionByName(own.join(first, "doc_id").where("text_key <> _first").select("doc_id", "text_key"))
    gone = other.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_gone_key")), "left_anti")
