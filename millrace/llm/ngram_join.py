"""N-gram Jaccard join by grouped prefixes, exact for components.

Every document is its set of distinct word shingles (64-bit hashes). A pair that links shares at least
needed(n) = ceil(T n) members of either side, so a shingle that no other set holds only counts against it.

1. Documents with equal sets collapse into one class; only classes go on.
2. Members that another set holds are counted for every set, packed (see _packed). A set with fewer than needed(n) of
   them links with nothing and goes no further; that leaves about the near copies.
3. What is left is sorted by (sets that hold the shingle, shingle), rarest first, one order for all sets. Two sets that
   link share one of the first n - needed(n) + 1 members; those that nobody shares come first and are skipped. Sets
   with identical prefixes and sizes collapse into one group, and only groups enter the index (token, group).
4. Each token sends its groups to the one with the fewest unshared members, and each group its members to its head:
   a row a group, not a pair. Pairs pass the filters of size, shared members and place, and are verified on whole sets.
   That gives components.
5. Where a token's groups still lie in several components groups are expanded to members, and members outside the
   token's largest component meet the others under the same filters and one more: with a parity signature of SIGNATURE bits a set, the number of
   bits in which two sets differ is at most the number of members in which they do. A pair is made at the first token
   it shares only. What passes is verified. No pair inside a known component is made, and no candidate is dropped.

Contract: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text with fewer words than a shingle is one shingle;
null or empty text, or text without words, has an empty set and links with nothing. Rows that share an id share its
node in join(); firsts() goes by rows, so that a text is never removed for another text of its id. A null id has no
node and a null component. Repeated rows stay in join(), one of them stays in firsts(); an empty table gives no rows;
only the id and the text are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _batch
from millrace.llm._batch import Words
from millrace.llm._graph import components
from millrace.llm._packed import shared_counts
from millrace.llm._spark import Shelf, among, small_batches

WIDTH, T = 5, 75  #: words in a shingle; likeness in percent
SIGNATURE = 512  #: bits


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, at = _batch.buffers(batch.column("text"))
    for lo, hi in _batch.slices(at):
        for i, own in enumerate(Words(data, at, lo, hi, lower=True).shingle_sets(WIDTH)):
            yield lo + i, own


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(own.sum(dtype=np.uint64).astype(np.int64)), int(_batch.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, lo, hi) of every row: set size and digest."""

    def run(batches):
        for batch in batches:
            got = np.zeros((batch.num_rows, 3), np.int64)
            for i, own in _sets(batch):
                got[i] = len(own), *_digest(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, got.T.copy())], names=["doc_id", "n", "lo", "hi"])

    return docs.mapInArrow(run, "doc_id long, n long, lo long, hi long")


def _values(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets of a batch for shared_counts."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    held: list[tuple[int, np.ndarray]] = []
    many = 0
    for i, own in _sets(batch):
        if len(own):
            held.append((i, own))
            many += len(own)
        if many > 400_000 or (held and i == batch.num_rows - 1):
            yield ids[[i for i, _ in held]].astype(np.int64), np.array([len(x) for _, x in held]), np.concatenate([x for _, x in held])
            held, many = [], 0


def _members(docs: DataFrame) -> DataFrame:
    """(s, n, members) of rows (doc_id, text, lo, hi, s, n): the whole set, where the text is the class's."""

    def run(batches):
        for batch in batches:
            lo, hi = (batch.column(c).to_numpy() for c in ("lo", "hi"))
            rows, found = [], []
            for i, own in _sets(batch):
                if _digest(own) == (lo[i], hi[i]):
                    rows.append(i)
                    found.append(own.view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            keep = batch.select(["s", "n"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["s", "n", "members"])

    return docs.mapInArrow(run, "s struct<node:long,sub:long>, n long, members array<long>")


def needed(n):
    return (T * n + 99) // 100


def _ordered(sets: DataFrame) -> DataFrame:
    """(s, n, r, p, k1, k2, members, signature) of rows (s, n, found): members by (count, token), prefix length and digest."""

    def run(batches):
        for batch in batches:
            lists = batch.column("found")
            flat = lists.flatten()
            count, token = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            r = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(r)), r)
            token = token[np.lexsort((token, count, row))]
            n = batch.column("n").to_numpy()
            p = r - needed(n) + 1
            begin = np.cumsum(r) - r
            front = np.arange(len(row)) - begin[row] < p[row]
            with np.errstate(over="ignore"):
                h = _batch.mix(token.view(np.uint64))
                k = []
                for x in (h, _batch.mix(h)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(front, x, np.uint64(0)), dtype=np.uint64)])
                    k.append((total[begin + r] - total[begin]).view(np.int64))
            bits = np.zeros((len(r), SIGNATURE), np.uint8)
            np.bitwise_xor.at(bits, (row, (h >> np.uint64(40)).astype(np.int64) % SIGNATURE), 1)
            words = np.packbits(bits, 1, "little").view(np.int64)
            offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            signature = pa.ListArray.from_arrays(offsets(np.full(len(r), SIGNATURE // 64)), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("s"), pa.array(n), pa.array(r), pa.array(p), *map(pa.array, k), pa.ListArray.from_arrays(offsets(r), pa.array(token)), signature],
                names=["s", "n", "r", "p", "k1", "k2", "members", "signature"],
            )

    return sets.mapInArrow(run, "s struct<node:long,sub:long>, n long, r long, p long, k1 long, k2 long, members array<long>, signature array<long>")


def _possible(x: str, y: str) -> Column:
    """The filters of size, shared members and place for rows of ``x`` and ``y``, each with n, r and the token's place i."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    least = F.lit(T) * (a("n") + b("n"))
    place = F.least(a("i"), b("i")) + 1 + F.least(a("r") - a("i") - 1, b("r") - b("i") - 1)
    sizes = F.lit(100) * F.least(a("n"), b("n")) >= F.lit(T) * F.greatest(a("n"), b("n"))
    return sizes & (F.lit(100 + T) * F.least(a("r"), b("r")) >= least) & (F.lit(100 + T) * place >= least)


def _alike(x: str, y: str) -> Column:
    """The signature filter: members in common are at most half of what both hold less the bits that differ."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    differ = sum((F.bit_count(a("signature")[k].bitwiseXOR(b("signature")[k])) for k in range(SIGNATURE // 64)), F.lit(0))
    return F.lit(100 + T) * (a("r") + b("r") - differ) >= F.lit(2 * T) * (a("n") + b("n"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs whose whole sets link."""
    side = lambda s, n, m: sets.select(F.col("s").alias(s), F.col("n").alias(n), F.col("members").alias(m))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return joined.where(F.lit(100 + T) * both >= F.lit(T) * (F.col("n") + F.col("m"))).select("a", "b")


def _links(sets: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) of the classes that link, from their ordered sets; steps 3 to 5."""
    keyed = sets.select("s", "n", "k1", "k2")
    groups = shelf.put(keyed.groupBy("n", "k1", "k2").agg(F.min("s").alias("head"), F.count("*").alias("many")))
    inside = keyed.join(groups.where("many > 1"), ["n", "k1", "k2"]).where("s <> head").select(F.col("head").alias("a"), F.col("s").alias("b"))
    rows = lambda df, *more: df.select("s", "n", "r", *more, F.posexplode(F.expr("slice(members, 1, int(p))")).alias("i", "token"))
    index = shelf.put(rows(sets.join(groups.select(F.col("head").alias("s")), "s", "left_semi")))
    entry = F.struct("s", "n", "r", "i")
    firsts = index.groupBy("token").agg(F.min_by(entry, F.struct((F.col("n") - F.col("r")) / F.col("n"), "s")).alias("t"), F.count("*").alias("c"))
    firsts = shelf.put(firsts.where("c > 1").select("token", "t.*"))
    met = index.alias("x").join(firsts.alias("y"), "token").where(F.col("x.s") != F.col("y.s")).where(_possible("x", "y"))
    tried = shelf.put(met.select(F.col("y.s").alias("a"), F.col("x.s").alias("b")).union(inside).distinct())
    links = shelf.put(_verified(tried, sets))
    shelf.drop(tried, index, firsts, groups)

    found = shelf.put(components(links, "a", "b", shelf))
    every = rows(sets.join(found.withColumnRenamed("node", "s"), "s", "left"), F.coalesce("root", "s").alias("root"))
    several = every.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    several = shelf.put(several)
    live = shelf.put(every.join(several, "token"))
    main = shelf.put(live.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main")))
    # Each set's live tokens in order: a pair is made where none before it is shared.
    own = live.groupBy("s", "n", "r", "root").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("own"))
    own = own.join(sets.select("s", "signature"), "s").select("*", F.transform("own", lambda o: o["token"]).alias("tokens"))
    spread = own.select("s", "n", "r", "root", "signature", "tokens", F.posexplode("own").alias("k", "o"))
    spread = spread.select("s", "n", "r", "root", "signature", F.expr("slice(tokens, 1, k)").alias("before"), "o.i", "o.token")
    spread = shelf.put(spread.join(main, "token"))
    shelf.drop(live, main, several)
    outside = spread.where("root <> main").alias("x")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.s") < F.col("y.s")))
    pairs = outside.join(spread.alias("y"), F.col("x.token") == F.col("y.token")).where(apart & _possible("x", "y") & _alike("x", "y") & ~F.arrays_overlap("x.before", "y.before"))
    more = shelf.put(_verified(shelf.put(pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))), sets))
    return components(links.union(more), "a", "b", shelf)


def _classes(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc_id, n, lo, hi, s, root) a row: digest, the class that holds the row's set, and the class that stands for its component."""
    small_batches(docs.sparkSession)
    known = shelf.put(_digests(docs))
    classes = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "lo", "hi").agg(F.min("doc_id").alias("node"))
    # An id whose rows hold different texts may stand for several classes.
    again = known.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("n", "lo", "hi")).alias("least"))
    sub = F.when(F.struct("n", "lo", "hi") == F.col("least"), F.lit(0).cast("long")).otherwise(F.xxhash64("n", "lo", "hi").bitwiseOR(F.lit(1)))
    classes = classes.join(again.withColumnRenamed("doc_id", "node"), "node").select("n", "lo", "hi", F.struct("node", sub.alias("sub")).alias("s"))
    classes = shelf.put(classes)

    total = known.agg(F.sum("n")).first()[0] or 0
    counts = shared_counts(docs.where("doc_id IS NOT NULL"), _values, total).withColumnRenamed("id", "doc_id")
    left = classes.withColumn("doc_id", F.col("s.node")).join(counts, "doc_id").where(F.lit(100) * F.col("shared") >= F.lit(T) * F.col("n"))
    left = shelf.put(left.select("doc_id", "s", "n", "lo", "hi"))
    whole = shelf.put(_members(among(docs, left, "doc_id")).dropDuplicates(["s"]))
    shelf.drop(left)
    rows = whole.select("s", "n", F.explode("members").alias("token"))
    counted = shelf.put(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    lists = rows.join(counted, "token").groupBy("s", "n").agg(F.collect_list(F.struct(F.col("c").alias("count"), "token")).alias("found"))
    sets = shelf.put(_ordered(lists.where(F.lit(100) * F.size("found") >= F.lit(T) * F.col("n"))))
    shelf.drop(whole, counted)
    roots = shelf.put(_links(sets, shelf))
    shelf.drop(sets)
    named = known.join(classes, ["n", "lo", "hi"], "left").join(roots.withColumnRenamed("node", "s"), "s", "left")
    return shelf.put(named.select("doc_id", "n", "lo", "hi", "s", F.coalesce("root", "s").alias("root")))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row."""
    shelf = Shelf(docs.sparkSession)
    named = _classes(_read(docs, id_col, text_col), shelf)
    ids = named.where("doc_id IS NOT NULL AND root.node <> doc_id").select(F.col("doc_id").alias("a"), F.col("root.node").alias("b"))
    whole = shelf.put(components(ids, "a", "b", shelf))
    out = named.join(whole.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "least"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component of texts: the one with the smallest id, of equal ids with the least digest, of equal rows any.

    Rows without an id, or without words, link with nothing and stay.
    """
    shelf = Shelf(docs.sparkSession)
    known = _classes(_read(docs, id_col, text_col), shelf).where("doc_id IS NOT NULL")
    named = known.where("n > 0")
    stay = shelf.put(named.groupBy("root").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("best")).select("best.*"))
    # An id of one row goes with it. The rows of an id that has several are looked at one by one.
    several = shelf.put(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    gone = named.join(stay, ["doc_id", "lo", "hi"], "left_anti").select("doc_id").union(several).distinct()
    key = "__id"
    own = docs.withColumn(key, F.col(id_col).cast("long"))
    rest = among(own, shelf.put(gone.withColumnRenamed("doc_id", key)), key, "left_anti").select(*docs.columns)
    some = among(own, several.withColumnRenamed("doc_id", key), key, "left_semi")
    some = shelf.put(some.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("whole")))
    best = _marked(some).join(stay.withColumn("stays", F.lit(True)), ["doc_id", "lo", "hi"], "left").where("n = 0 OR stays")
    best = best.groupBy("doc_id", "lo", "hi", F.when(F.col("n") == 0, F.col("row")).alias("each")).agg(F.min("row").alias("row"))
    return rest.unionByName(some.join(best.select("row"), "row", "left_semi").select("whole.*"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, lo, hi) of rows (doc_id, text, row)."""

    def run(batches):
        for batch in batches:
            got = np.zeros((batch.num_rows, 3), np.int64)
            for i, own in _sets(batch):
                got[i] = len(own), *_digest(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *map(pa.array, got.T.copy())], names=["doc_id", "row", "n", "lo", "hi"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row long, n long, lo long, hi long")
