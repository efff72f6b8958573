"""Similar documents: wide SimHash fingerprints, joined segment by segment over binary tries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import SPACE, Forest, arrow_rows, components, lower_ascii, row_hashes, split_words, table_copy, whole_rows
from recollect.llm.simhash import BLOCK, CHUNK_SHINGLES, levels, shingle_hashes, trie_pairs

#: 64-bit words of a fingerprint.
WORDS = 4
#: Sets of up to this many shingles, of which a bit tells less, are sought in twice as many segments.
SHORT = 16
#: Standard deviations beyond the bits that differ at the limit where a pair is dropped unseen, and
#: the share of bits that differ at 0.8 in the worst case of short sets (4 and 5 shingles).
MAYBE, SHORT_SHARE = 3.7, 0.1875
#: Members of a block, and shingles of a block (8 bytes each); a task compares two blocks of a
#: group, by so many columns of their sets at once.
MEMBERS, SHINGLES, COLUMNS = 64, 1 << 20, 1 << 13
#: The number of fingerprints that segments are made for, whatever an input holds: what is found of a
#: pair does not depend on the other documents.
DESIGNED = 1 << 21
#: Documents whose hashes go to Python at once, some 8 bytes a word.
BATCH = 1000
#: Up to this many row keys (some 50 MB) are broadcast.
BROADCAST_ROWS = 500_000

_COLUMNS = [f"f{k}" for k in range(WORDS)]
_KEY = ["row", "row_more"]


def segments(total: int) -> tuple[int, int, int]:
    """(bits of a segment, bits in which it may differ, bits from one segment's start to the next).

    More fingerprints ask for longer segments, or chance would bring together a share of all pairs.
    A pair with a similarity of 0.8 meets in some segment with the probability 0.994 or 0.996.
    """
    return (16, 1, 16) if total <= 1 << 21 else (24, 2, 8)


def limits(similarity: float) -> tuple[int, int]:
    """Bits that may differ in a pair worth a look: of long sets, and where one has SHORT shingles at most.

    Two sets of one size with the Jaccard similarity s have the cosine 2s / (1 + s), and a bit of
    their fingerprints differs with the probability arccos(cosine) / pi.
    """
    n = 64 * WORDS
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    short = share * SHORT_SHARE / (math.acos(1.6 / 1.8) / math.pi)
    return tuple(math.ceil(n * p + MAYBE * math.sqrt(n * p * (1 - p))) for p in (share, short))


def wide_majority(hashes: pd.Series) -> pd.DataFrame:
    """(f0.., n) of each array: bits set in over half of its distinct hashes, and how many there are.

    Each word of the fingerprint sees the hashes through a mixing of its own.
    """
    out = np.zeros((len(hashes), WORDS), np.int64)
    sizes = np.zeros(len(hashes), np.int32)
    for k, h in enumerate(hashes):
        h = np.unique(np.asarray(h, "<i8")).view(np.uint64)
        sizes[k] = len(h)
        for w in range(WORDS):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), CHUNK_SHINGLES):
                x = h[at : at + CHUNK_SHINGLES] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k, w] = np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]
    return pd.DataFrame({**{c: out[:, w] for w, c in enumerate(_COLUMNS)}, "n": sizes})


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """The rows with the column ``hashes`` in the place of ``text``.

    Words are a column of their own, as the shingles read them many times.
    """
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, split_words(lower_ascii(F.col("text")), SPACE).alias("words")).select(*rest, shingle_hashes(F.col("words"), width).alias("hashes"))


def candidate_links(classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the rows (rep, n, f0..) as all pairs worth a look would.

    Each segment of the fingerprints is a trie. Two that differ in as many of a segment's bits as may
    differ are equal in one of its bytes, which are one more: rows meet by the first bits of each byte, so a
    row is sent once for each byte of a segment. Pairs that a segment brings together are worth a
    look if their whole fingerprints and their sizes allow the similarity. A task returns a spanning
    forest of its pairs, hung on the least rep, so a large group gives some edges a member, mostly
    the same ones in all segments, and never its pairs.
    """
    far, far_short = limits(similarity)
    wide, budget, step = segments(DESIGNED)
    if wide // 8 <= budget:
        raise ValueError(f"{budget} bits of {wide} may differ, which leaves no byte equal")
    depth = min(8, levels(classes.count(), block))
    starts = [*range(0, 64 * WORDS, step), *(range(8, 64 * WORDS, 16) if step == 16 else ())]
    octets_ = [F.shiftrightunsigned(F.col(_COLUMNS[k // 8]), 8 * (k % 8)).bitwiseAND(F.lit(255)) for k in range(8 * WORDS)]

    def first_bits(start: int, part: int):
        cell = F.shiftright(octets_[(start // 8 + part) % len(octets_)], 8 - depth)
        return cell if start % step == 0 else F.when(F.col("n") <= SHORT, cell)

    slots = [(start, part) for start in starts for part in range(wide // 8)]
    celled = classes.select("rep", "n", *_COLUMNS, F.posexplode(F.array(*[first_bits(*x) for x in slots])).alias("slot", "cell")).where("cell is not null")
    # At most 256 cells of a slot, whatever the input holds.
    blocks = celled.groupBy("slot", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = celled.join(F.broadcast(blocks), ["slot", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("slot", "cell", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") > F.col("other")).cast("tinyint").alias("side"), "rep", "n", *_COLUMNS)

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        (start, part), rows = slots[int(rows["slot"].iloc[0])], rows.sort_values("rep", kind="stable")
        words = np.ascontiguousarray(rows[_COLUMNS].to_numpy("<i8")).view(np.uint64)
        octets = words.view(np.uint8)
        top = np.zeros(len(rows), np.uint64)
        for k in range(wide // 8):
            top |= octets[:, (start // 8 + k) % octets.shape[1]].astype(np.uint64) << np.uint64(64 - wide + 8 * k)
        # Pairs that share a cell of an earlier byte meet there.
        earlier = [octets[:, (start // 8 + k) % octets.shape[1]] >> (8 - depth) for k in range(part)]
        rep, n, side = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
        order = np.argsort(top, kind="stable")
        left, right = order[side[order] == 0], order[side[order] == 1]
        # Not by the sides: a block may be empty.
        alone = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
        right = left if alone else right
        forest = Forest(len(rows))
        for i, j in trie_pairs(top[left], top[right], budget, alone, wide):
            a, b = left[i], right[j]
            for cell in earlier:
                a, b = a[new := cell[a] != cell[b]], b[new]
            able = (forest.root[a] != forest.root[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
            a, b = a[able], b[able]
            near = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) <= np.where(np.minimum(n[a], n[b]) <= SHORT, far_short, far)
            forest.add(a[near], b[near])
        child, root = forest.edges()
        return pd.DataFrame({"a": rep[child], "b": rep[root]})

    return met.groupBy("slot", "cell", "i", "j").applyInPandas(unit, "a bigint, b bigint")


def shared_sizes(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """How many members each set named by ``left`` shares with each of all sets.

    The sets are rows of a 0/1 matrix over their members, which is multiplied by parts of its
    columns, so memory follows the sets' sizes. Members of one set alone are left out.
    """
    _, member, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = (np.cumsum(seen > 1) - 1)[member]
    order = np.argsort(column, kind="stable")
    order = order[seen[member[order]] > 1]
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        out += part[left] @ part.T
    return out.astype(np.int64)


def linked(rows: pd.DataFrame, similarity: float, within: bool) -> pd.DataFrame:
    """Edges (a, b) that connect the rows (rep, root, side, n, set) as all their links would.

    Every row of side 0 is compared, as a set, with every row of side 1, and ``within`` with the
    others of side 0 too. Rows of one root are connected already.
    """
    rep, n, side = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
    forest = Forest(len(rows))
    _, first, same = np.unique(rows["root"].to_numpy(), return_index=True, return_inverse=True)
    forest.add(np.arange(len(rows)), first[same])
    before = forest.root.copy()
    left = np.flatnonzero(side == 0)
    shared = shared_sizes([np.asarray(s) for s in rows["set"]], left)
    link = shared * (1 + similarity) >= similarity * (n[left][:, None] + n[None, :]) - 1e-9
    link &= (side == 1)[None, :] | ((np.arange(len(rows))[None, :] > left[:, None]) & within)
    a, b = np.nonzero(link)
    forest.add(left[a], b)
    child = np.flatnonzero((before == np.arange(len(rows))) & (forest.root != before))
    return pd.DataFrame({"a": rep[child], "b": rep[forest.root[child]]})


def in_blocks(members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """The members (group, n, ..), without their sets, with their group's number of blocks and a block ``b`` by a hash of ``rep``."""
    sizes = members.groupBy("group").agg(_blocks(most).alias("blocks"))
    return table_copy(members.join(sizes, "group").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "members")


def _blocks(most: int):
    return F.ceil(F.greatest(F.count("*") / most, F.sum("n") / SHINGLES)).cast("int")


def group_links(members: DataFrame, similarity: float, most: int = MEMBERS) -> DataFrame:
    """Edges (a, b) that connect the rows (group, rep, n, blocks, b, set) as all links in a group would.

    First each block is compared with itself and with the group's first block, which connects
    nearly all of a group of copies. Then only what lies outside the group's largest component is
    compared with all of it: two members of that component are connected and need no comparison.
    So the work follows the members, and the square of a group only in so far as its members
    don't link. Sets are dealt by block and joined by member; what joins by group has none.
    """
    edges, columns = "a bigint, b bigint", ["rep", "root", "n", "set"]
    placed = members.withColumn("root", F.col("rep"))
    own = placed.select("group", F.col("b").alias("i"), F.lit(0).alias("side"), *columns)
    first = placed.where("b = 0 and blocks > 1").select("group", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("i"), F.lit(1).alias("side"), *columns)
    # Ranges even out what tasks get; hashes of few large units would not.
    units = own.union(first).repartitionByRange("group", "i").groupBy("group", "i")
    found = table_copy(units.applyInPandas(lambda rows: linked(rows, similarity, True), edges), "links")
    large = members.where("blocks > 1").select("group", "rep", "n", "blocks", "b")
    if not large.take(1):
        return found
    reach = components(found).select(F.col("node").alias("rep"), "root")
    rooted = table_copy(large.join(reach, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    by_root = rooted.groupBy("group", "root").agg(F.count("*").alias("size"))
    largest = by_root.groupBy("group").agg(F.max(F.struct("size", "root")).alias("most")).select("group", F.col("most.root").alias("main"))
    # Each join by group is written out, so that a large group can be split in it.
    rooted = table_copy(rooted.join(largest, "group").withColumn("outer", F.col("root") != F.col("main")).drop("main"), "sided")
    outers = rooted.where("outer").groupBy("group").agg(_blocks(most).alias("outers"))
    rooted = table_copy(rooted.join(outers, "group").drop("n"), "outers")
    wide = rooted.join(members.where("blocks > 1").select("rep", "n", "set"), "rep")
    one = wide.where("outer").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("outers")).cast("int"))
    one = one.select("group", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *columns)
    all_ = wide.select("group", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), *columns)
    units = one.union(all_).repartitionByRange("group", "i", "j").groupBy("group", "i", "j")
    return found.union(table_copy(units.applyInPandas(lambda rows: linked(rows, similarity, False), edges), "further"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, most: int = MEMBERS) -> DataFrame:
    """(doc_id, row, row_more, component_id, kept) for every row of the documents.

    Documents link when the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``similarity`` (A-Z lower-cased; fewer words: the whole sequence; none: the empty set,
    equal to itself only). Candidates come from SimHash fingerprints of 256 bits: a self-join over
    the trie of each segment brings together pairs that differ there in a bit or two at most, and
    connects them to groups. In a group every link rests on a comparison of the sets. Equal sets
    are one class first, so copies cost no pairs. A text's set of shingles is in one row, whatever
    its length.

    A component holds all that links reach, and its id is its least document id. ``row`` and
    ``row_more`` are hashes of a row's whole content, and kept is true for the row of a component
    that comes first by id, nulls last, and then by these: one row, or rows that are equal in all
    columns. Rows with equal ids and different texts are documents of their own. A component
    without any id has a null id. No rows give no rows.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *row_hashes(docs, *_KEY))
    schema = ", ".join([*(f"{c} bigint" for c in _COLUMNS), "n int"])
    marked = shingled(own, width).select("doc_id", *_KEY, F.pandas_udf(wide_majority, schema)("hashes").alias("f")).select("doc_id", *_KEY, "f.*")
    with arrow_rows(docs.sparkSession, BATCH):
        marked = table_copy(marked, "wide-simhash")
    sets = [*_COLUMNS, "n"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_KEY)).alias("best")
    classes = table_copy(marked.groupBy(*sets).agg(best).withColumn("rep", F.monotonically_increasing_id()), "classes")
    groups = components(table_copy(candidate_links(classes, similarity, block), "candidates"))
    members = classes.join(groups.select(F.col("node").alias("rep"), F.col("root").alias("group")), "rep").select("group", "rep", "n", *[F.col(f"best.{k}").alias(k) for k in _KEY])
    members = in_blocks(members, most)
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = shingled(own.join(wanted, _KEY).drop("doc_id"), width).select("group", "rep", "n", "blocks", "b", F.array_distinct("hashes").alias("set"))
    # Rows that are equal in all columns are one member.
    texts = table_copy(texts.dropDuplicates(["rep"]), "shingles")
    reach = components(group_links(texts, similarity, most)).withColumnRenamed("node", "rep")
    rooted = table_copy(classes.join(reach, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "roots")
    first = rooted.groupBy("root").agg(F.min("best").alias("first"))
    named = rooted.join(first, "root").select(*sets, "first")
    kept = F.col("first.row").eqNullSafe(F.col("row")) & F.col("first.row_more").eqNullSafe(F.col("row_more"))
    return marked.join(named, sets).select("doc_id", *_KEY, F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``similar_documents`` keeps, with all their columns; of equal rows, one."""
    kept = similar_documents(docs, **options).where("kept").select(*_KEY).distinct()
    return whole_rows(docs, *row_hashes(docs, *_KEY)).join(kept, _KEY, "left_semi").dropDuplicates(_KEY).select("doc.*")
