"""Near-duplicate documents: an exact similarity join on word shingles with prefix filtering, then connected classes.

Exact copies are collapsed first, so that a group of any number of copies costs one representative. Shingles (five words)
are ordered by rarity, as far as bitmaps of fixed size tell it; the first common shingle of two sets with a Jaccard similarity
of at least t has at most ``(1 - t) |S|`` places before it in the larger set and ``(1 - t) / (1 + t) |S|`` in the smaller one,
so only these prefixes are joined, where sizes and places allow the similarity. No candidate is dropped otherwise; candidates
are verified by their exact similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.membership import BITS, possibly_in
from cardloom.functions.words import with_shingles
from cardloom.session import bounded, cut

SIMILARITY = 0.8
SHINGLE = 5
#: Texts per part of a shingle that many texts hold.
HOT = 2_000
#: Members up to which sets are joined by groups of members.
SMALL = 32
#: Numbers of texts from which a shingle counts as more frequent.
LEVELS = (2, 4, 8, 16, 64, 512, 4096)


def exact_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies): documents with the same text form a class named by its smallest id. Null texts have none.

    Texts are compared by two independent 64-bit hashes and their length. A hot text is merged by partial aggregation; the
    members then join their class on a key that includes a salt of the document id.
    """
    keyed = documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_a"), F.xxhash64(F.reverse("text"), F.lit(7)).alias("_b"), F.length("text").alias("_n"))
    classes = keyed.groupBy("_a", "_b", "_n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    salted = classes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > 10_000, 15).otherwise(0))))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(16))).otherwise(0).cast("int")
    hot = classes.where(F.col("copies") > 10_000).select("_a", "_b", "_n", F.lit(True).alias("_hot"))
    marked = keyed.join(bounded(hot, 100_000), ["_a", "_b", "_n"], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn("_s", salt)
    return marked.join(salted, ["_a", "_b", "_n", "_s"]).select("doc_id", "class_id", "copies")


def similar_pairs(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, chosen: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b: pairs of documents whose shingle sets are at least that similar, of those in ``chosen.doc_id`` if
    given. Ids must be unique."""
    pairs = _candidates(_sets(documents, shingle), similarity, chosen)
    # the sets of candidates are made again from their texts; all sets are several times the size of the input
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())
    sets = _sets(possibly_in(documents, "doc_id", ids), shingle).join(ids.hint("merge"), "doc_id", "left_semi")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("_s").alias("_sa")), sets.select(F.col("doc_id").alias("b"), F.col("_s").alias("_sb"))
    # sizes of sets are estimated far too low, so the joins name their kind: no side may go through the driver
    scored = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("_i", F.size(F.array_intersect("_sa", "_sb")))
    scored = scored.withColumn("similarity", F.col("_i") / (F.size("_sa") + F.size("_sb") - F.col("_i")))
    return scored.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def _sets(documents: DataFrame, shingle: int) -> DataFrame:
    return with_shingles(documents.select("doc_id", "text"), ["doc_id"], "text", shingle).select("doc_id", F.array_distinct("_shingles").alias("_s"))


def _levels(sets: DataFrame) -> list[np.ndarray]:
    """Bitmaps over the low bits of members: those that at least so many sets hold, for each of ``LEVELS``. Their size is fixed."""
    counts = sets.select(F.explode("_s").alias("_m")).select(F.col("_m").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= LEVELS[0])
    placed = counts.select("_df", F.pmod("_h", F.lit(1 << BITS)).alias("_x")).select("_df", F.expr("_x div 64").cast("int").alias("_word"), F.expr("shiftleft(1L, cast(_x % 64 as int))").alias("_bit"))
    words = placed.groupBy("_word").agg(*[F.bit_or(F.when(F.col("_df") >= least, F.col("_bit")).otherwise(0)).alias(f"_l{k}") for k, least in enumerate(LEVELS)]).toArrow()
    out = []
    for k in range(len(LEVELS)):
        bits = np.zeros(1 << (BITS - 6), dtype=np.int64)
        bits[words["_word"].to_numpy()] = words[f"_l{k}"].to_numpy()
        out.append(bits.view(np.uint64))
    return out


def _prefixes(levels: Broadcast, similarity: float):
    """Rows (doc_id, _n, _pos, _h): the members of each set's prefix that other sets may hold, and their places in the order."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            ends = ends - ends[0]
            sizes = np.diff(ends)
            place = (flat & ((1 << BITS) - 1)).astype(np.uint64)
            word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            level = np.zeros(len(flat), dtype=np.int8)
            for bits in levels.value:
                level += ((bits[word] >> shift) & np.uint64(1)).astype(np.int8)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, level, owner))
            n, pos = sizes[owner], np.arange(len(flat)) - ends[:-1][owner]
            # members that no other set holds come first and use up places
            kept = (pos <= n * (1 - similarity) + 1e-6) & (level[order] > 0)
            yield pa.record_batch([batch.column(0).take(pa.array(owner[kept])), pa.array(n[kept].astype(np.int32)), pa.array(pos[kept].astype(np.int32)), pa.array(flat[order][kept])], names=["doc_id", "_n", "_pos", "_h"])

    return of


def _candidates(sets: DataFrame, similarity: float, chosen: DataFrame | None) -> DataFrame:
    """(a, b), a < b: all pairs of sets (doc_id, _s) of 64-bit members that may be that similar."""
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets))
    rare = sets.mapInArrow(_prefixes(levels, similarity), f"doc_id {dict(sets.dtypes)['doc_id']}, _n int, _pos int, _h long")
    if chosen is not None:
        rare = rare.join(chosen.hint("merge"), "doc_id", "left_semi")
    rare = cut(rare)
    # a shingle held by many texts is split: one side by a salt, the other sent to each of its parts, so no pair is lost
    parts = rare.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > HOT).select("_h", F.ceil(F.col("_c") / HOT).cast("int").alias("_parts"))
    split = rare.join(bounded(parts, 200_000), "_h", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # the first common member of a similar pair has few places before it, in the smaller set fewer than in the larger one
    share = similarity / (1 + similarity)
    small = split.where(F.col("_pos") <= F.col("_n") * (1 - 2 * share) + 1e-6)
    small = small.select(F.col("doc_id").alias("a"), F.col("_n").alias("_na"), F.col("_pos").alias("_pa"), "_h", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
    large = split.select(F.col("doc_id").alias("b"), F.col("_n").alias("_nb"), F.col("_pos").alias("_pb"), "_h", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int").alias("_salt"))
    sized = (F.struct("_na", "a") < F.struct(F.col("_nb").alias("_na"), F.col("b").alias("a"))) & (F.col("_na") >= F.col("_nb") * similarity)
    rest = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    met = small.join(large.hint("merge"), ["_h", "_salt"]).where(sized & (rest >= (F.col("_na") + F.col("_nb")) * share - 1e-6))
    return cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY, overlap: int = 1) -> DataFrame:
    """(a, b, similarity), a < b: pairs of sets (doc_id, _s) with at least that Jaccard similarity and so many common members."""
    return _met(sets, similarity, overlap).distinct()


def similar_forest(sets: DataFrame, similarity: float = SIMILARITY, overlap: int = 1) -> DataFrame:
    """(a, b): pairs of :func:`similar_sets` that connect the same sets as all of them do; each task leaves out those that close a circle."""
    pairs = _met(sets, similarity, overlap).select("a", "b")
    return pairs.mapInArrow(_forest, pairs.schema)


def _forest(batches):
    import pyarrow as pa

    root: dict = {}
    for batch in batches:
        kept = []
        for u, v in sorted(set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))):
            x, y = u, v
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            while (up := root.setdefault(y, y)) != y:
                root[y] = y = root[up]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((u, v))
        yield pa.record_batch([pa.array([e[k] for e in kept], batch.schema.types[k]) for k in (0, 1)], names=["a", "b"])


def _groups(members: str, size: int) -> Column:
    """Hashes of all groups of ``size`` of the array ``members``, each in the array's order."""
    places = F.sequence(F.lit(0), F.size(members) - 1)
    chosen = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(members, i).alias("h")))
    for _ in range(size - 1):
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter(places, lambda j: j > c["i"]), lambda j: F.struct(j.alias("i"), F.xxhash64(c["h"], F.get(members, j)).alias("h")))))
    return F.transform(chosen, lambda c: c["h"])


def _met(sets: DataFrame, similarity: float, overlap: int) -> DataFrame:
    """Pairs of similar sets, once for each group of rare members by which they met.

    Similar sets have ``m`` common members in prefixes that are longer by ``m - 1`` than those with one. So sets of up to ``SMALL`` members are joined by groups of ``m`` rare members, few of which are frequent, larger ones by single members.
    Rows carry their set, and those whose group no other set has are left out before they move.
    """
    m = min(overlap, 3)
    hashed = sets.select("doc_id", F.size("_s").alias("_n"), F.transform("_s", lambda w: F.xxhash64(w)).alias("_x"))
    each = hashed.select("doc_id", "_n", F.explode("_x").alias("_h"))
    common = each.groupBy("_h").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > 1)
    # members of one set only can make no pair; they still come first in the order, so they use up prefix places
    held = each.join(common.hint("merge"), "_h").groupBy("doc_id", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_h"))).alias("_e"))
    held = cut(held.select("doc_id", "_n", F.transform("_e", lambda e: e["_h"]).alias("_x")))
    spare = F.col("_n") - F.greatest(F.ceil(F.col("_n") * similarity - 1e-9), F.lit(overlap)) - (F.col("_n") - F.size("_x"))

    def keyed(size: int) -> DataFrame:
        rows = held.where(F.col("_n") <= SMALL) if size > 1 else held.where(F.col("_n") > SMALL * similarity - 1) if m > 1 else held
        rows = rows.withColumn("_p", F.slice("_x", 1, F.greatest(spare + size, F.lit(0)).cast("int"))).where(F.size("_p") >= size)
        return rows.select("doc_id", "_n", "_x", F.explode(F.array_distinct(_groups("_p", size))).alias("_g")).withColumn("_g", F.xxhash64("_g", F.lit(size)))

    rows = keyed(m).unionByName(keyed(1)) if m > 1 else keyed(1)
    counts = cut(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1))
    rows = possibly_in(rows, "_g", counts)
    # a group held by many sets is split: one side by a salt, the other sent to each of its parts, so no pair is lost
    parts = counts.where(F.col("_c") > HOT).select("_g", F.ceil(F.col("_c") / HOT).cast("int").alias("_parts"))
    split = rows.join(bounded(parts, 200_000), "_g", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = split.select(F.col("doc_id").alias("a"), F.col("_n").alias("_na"), F.col("_x").alias("_xa"), "_g", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int").alias("_salt"))
    b = split.select(F.col("doc_id").alias("b"), F.col("_n").alias("_nb"), F.col("_x").alias("_xb"), "_g", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
    sized = (F.col("a") < F.col("b")) & (F.col("_na") >= F.col("_nb") * similarity) & (F.col("_nb") >= F.col("_na") * similarity)
    met = a.join(b.hint("merge"), ["_g", "_salt"]).where(sized).select("a", "b", "_na", "_nb", F.size(F.array_intersect("_xa", "_xb")).alias("_i"))
    met = met.withColumn("similarity", F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i")))
    return met.where((F.col("similarity") >= similarity) & (F.col("_i") >= overlap)).select("a", "b", "similarity")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's connected component, by alternating large and small stars.

    Each round is two aggregations; the number of rounds grows with the logarithm of the longest chain. Rounds end when
    the edges no longer change, and each is materialised, so a lost executor repeats one round at most.
    """
    edges = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def near_duplicate_classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, links): every document with a text, its class and the number of similar texts that it has.

    A class is a connected group of similar texts, named by its smallest id; copies of a text belong to its class and share
    its links, which count different texts. Texts of fewer than five words are similar to their copies only.
    """
    classes = cut(exact_classes(documents))
    chosen = classes.where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    pairs = cut(similar_pairs(documents, similarity, chosen=chosen))
    links = pairs.select(F.col("a").alias("class_id")).unionAll(pairs.select("b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    groups = components(pairs).withColumnRenamed("node", "class_id")
    joined = classes.join(groups, "class_id", "left").join(links, "class_id", "left")
    return joined.select("doc_id", F.coalesce("component", "class_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
