"""Groups of near duplicates: SimHash by Golay keys, then overlapping word shingles by banded MinHash, verified exactly.

Documents are linked as ``simhash`` links them (fingerprints of three-word shingles that differ in two bits or fewer, found
by Golay-code fuzzy keys), and beyond that when the Jaccard similarity of their sets of five-word shingles is at least 0.8.
Exact copies meet in one node, the hash of the set; everything below works on distinct nodes. SimHash goes first: what
follows looks for links between its components only.

Candidate keys of the wider radius. ``BANDS`` bands of ``ROWS`` minima each. Two sets of similarity s share a band with probability s^4, so
of the pairs at exactly 0.8 all but 0.5904^24, three in a million, share one of 24; of more similar pairs, fewer are lost.

Verification. Sets are compared in full. A bucket is linked through stars first: one of its members against all others,
in the first round the one that meets most nodes over all its bands (the original of many edited copies), then one that
a hash of the bucket and the round puts first. Buckets whose members are in one component, by SimHash or since, are done, however
large. Among the nodes of the others the search is exact: pairs of different components that share one of their rarest shingles (a prefix
filter) are compared, so no link of a bucket is lost and common passages bring no pairs.

Defined cases: texts without words (null, empty, blank) are one node without keys; fewer words than a shingle are one
shingle; a row with null doc_id gets its node and component, but never names one (a component of null ids only has id
null); repeated rows are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard, written
from .common import LOWER_AZ, text_map
from .simhash import components, named_components, signed_fingerprint
from .simhash import links as fingerprint_links

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 4
STAR_ROUNDS = 2
PART = 256
HASH_CHUNK = 1 << 12

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
BAND_SEEDS = _random.integers(1 << 63, size=BANDS, dtype=np.uint64)
MIXER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER_AZ).split() if text else []
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(words) - size + 1))


def node(hashes: np.ndarray) -> int:
    """The set as a signed LONG; 0 for the empty one."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0
    return x - (1 << 64) if x >> 63 else x


def text_node(text: str | None, size: int = SHINGLE_WORDS) -> int:
    return node(shingle_set(text, size))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key a band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), HASH_CHUNK):
        least = np.minimum(least, (hashes[at : at + HASH_CHUNK, None] * FACTORS + OFFSETS).min(axis=0))
    keys = BAND_SEEDS.copy()
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * MIXER
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def nodes(docs: DataFrame, id_name: str, text_name: str, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the node), n (its shingles), keys, simhash: one row per document, no shuffle."""

    def make():
        def run(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, size) for t in texts]
            return [[node(s) for s in sets], [len(s) for s in sets], [band_keys(s) for s in sets], list(map(signed_fingerprint, texts))]

        return run

    return text_map(docs, F.col(text_name), [F.col(id_name).cast("long").alias("doc_id")], "fp long, n int, keys array<long>, simhash long", make)


def shingles_of(docs: DataFrame, id_name: str, text_name: str, wanted: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """fp, shingles: the sets of the ``wanted`` nodes (fp, rep). ``rep`` is the id of one row that has the node's text;
    nodes that have none, because their ids repeat or are null, are looked for among all rows."""

    def make():
        def run(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, size) for t in texts]
            return [[node(s) for s in sets], [s.view(np.int64) for s in sets]]

        return run

    text, own = F.col(text_name).cast("string"), F.col(id_name).cast("long")
    rows = docs.select(own.alias("id"), text.alias("text"))
    reps = wanted.filter("rep is not null").select(F.col("rep").alias("id"))
    found = text_map(rows.join(reps, "id", "left_semi"), F.col("text"), [], "fp long, shingles array<long>", make)
    other = wanted.filter("rep is null").select("fp")
    if other.isEmpty():
        return found
    named = text_map(rows, F.col("text"), [F.col("text")], "fp long", lambda: lambda texts: [[text_node(t, size) for t in texts]])
    one = named.join(other, "fp").groupBy("fp").agg(F.min("text").alias("text"))
    return found.unionByName(text_map(one, F.col("text"), [], "fp long, shingles array<long>", make))


def alike(similarity: float):
    """Whether sets of these sizes can be so similar."""
    return lambda n, m: F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets are at least so similar."""
    left, right = (sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"{x}s")) for x in "ab")
    both = F.size(F.array_intersect("as", "bs"))
    every = F.size("as") + F.size("bs") - both
    return pairs.join(right, "b").join(left, "a").filter(both >= every * F.lit(similarity) - 1e-9).select("a", "b")


def stars(members: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Distinct (a, b): one member of each bucket against those of other components. A bucket of many members is dealt
    over parts of about ``PART`` members, to each of which the one member goes."""
    order = F.xxhash64("fp", "key", F.lit(turn)) if turn else -F.col("met")
    parts = lambda c: F.ceil(c / PART).cast("int")
    first = members.groupBy("key").agg(F.min(F.struct(order, "fp", "n", "root")).alias("p"), F.max("c").alias("many"))
    first = first.select("key", "p", F.explode(F.sequence(F.lit(0), parts(F.col("many")) - 1)).alias("part"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("fp"), parts(F.col("c"))).cast("int"))
    pairs = dealt.join(first, ["key", "part"]).filter((F.col("root") != F.col("p.root")) & alike(similarity)(F.col("n"), F.col("p.n")))
    return pairs.select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")).distinct()


def across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of different components that share one of their rarest shingles, as all similar sets must.

    Of n shingles, at least s * n are in any set of similarity s, so one of the n - s * n + 1 rarest is. The first
    they share, at place i, leaves at most n - i in common (``enough``).
    """
    owners = members.select("fp", "n", "root").distinct()
    tokens = owners.join(sets, "fp").select("fp", "n", "root", F.explode("shingles").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"), (F.min("root") < F.max("root")).alias("shared"))
    least = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int") + 1
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("f", "t", "shared"))), 1, F.first(least))
    prefix = tokens.join(often, "t").groupBy("fp").agg(F.first("n").alias("n"), F.first("root").alias("root"), rarest.alias("rarest"))
    prefix, at = written(prefix.select("fp", "n", "root", F.posexplode("rarest").alias("i", "r")).filter("r.shared").select("fp", "n", "root", "i", "r.t"), "rarest")
    x, y = prefix.alias("x"), prefix.alias("y")
    apart = (F.col("x.t") == F.col("y.t")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
    enough = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) >= (F.col("x.n") + F.col("y.n")) * F.lit(similarity / (1 + similarity)) - 1e-9
    pairs = x.join(y, apart & enough & alike(similarity)(F.col("x.n"), F.col("y.n")))
    pairs = cut(pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct(), "pairs-across")
    discard(members.sparkSession, at)
    return pairs


def simhash_links(marks: DataFrame) -> tuple[DataFrame, str]:
    """(a, b) that connect the nodes of distinct ``marks`` (fp, simhash) as their fingerprints are, and where they are
    written. A node's texts may differ in fingerprint, by words that repeat; each of them counts."""
    spark = marks.sparkSession
    lowest, lowest_at = written(marks.groupBy(F.col("simhash").alias("mark")).agg(F.min("fp").alias("low")), "fingerprints")
    near, near_at = fingerprint_links(lowest.select(F.col("mark").alias("fp")))
    x, y = (lowest.select(F.col("mark").alias(k), F.col("low").alias(f"{k}_low")) for k in "ab")
    pairs = near.join(x, "a").join(y, "b").select("a_low", "b_low")
    equal = marks.join(lowest, F.col("simhash") == F.col("mark")).select("low", "fp")
    both = pairs.union(equal).toDF("a", "b").filter("a <> b")
    found = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    discard(spark, lowest_at, near_at)
    return found


def linked(
    distinct: DataFrame, marks: DataFrame, docs: DataFrame, id_name: str, text_name: str, size: int, similarity: float
) -> tuple[DataFrame, str]:
    """(node, root) of every node that is linked to another, and where it is written."""
    spark = docs.sparkSession
    found, found_at = simhash_links(marks)
    root_of, stars_at = components(found)
    old = [found_at, stars_at]
    rooted_by = lambda rows, roots: rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    parted = lambda rows: rows.join(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"), "key")
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    crowd, crowd_at = written(keyed.join(buckets, "key"), "band-members")
    met = crowd.groupBy("fp").agg(F.sum("c").alias("met"))
    rooted, rooted_at = written(rooted_by(crowd.join(met, "fp"), root_of), "met-members")
    discard(spark, crowd_at)
    members, members_at = written(parted(rooted), "open-members")
    discard(spark, rooted_at)
    wanted, wanted_at = written(members.select("fp").distinct().join(distinct.select("fp", "rep"), "fp"), "wanted-nodes")
    sets, sets_at = written(shingles_of(docs, id_name, text_name, wanted, size), "shingle-sets")
    discard(spark, wanted_at)
    open_, open_at = members, []
    for turn in range(STAR_ROUNDS + 1):
        pairs = stars(open_, similarity, turn) if turn < STAR_ROUNDS else across(open_, sets, similarity)
        found, at = written(found.union(verified(pairs, sets, similarity)), "links")
        old.append(at)
        root_of, stars_at = components(found)
        old.append(stars_at)
        if turn == STAR_ROUNDS:
            break
        # a bucket of two is compared already, and one in a single component has no link to find
        open_, at = written(parted(rooted_by(members.filter("c > 2").drop("root"), root_of)), "open-members")
        open_at.append(at)
        if open_.isEmpty():
            break
    root_of, at = written(root_of, "roots")
    discard(spark, members_at, sets_at, *open_at, *old)
    return root_of, at


def near_duplicates(
    docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """doc_id, fp, component_id, root: one row per document."""
    sketched, sketched_at = written(nodes(docs, id_name, text_name, size), "sketches")
    printed = cut(sketched.select("doc_id", "fp"), "nodes")
    grouped = sketched.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    single = printed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("fp")).filter("c = 1")
    reps = single.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct, distinct_at = written(grouped.join(reps, "fp", "left"), "distinct-nodes")
    marks, marks_at = written(sketched.select("fp", "simhash").distinct(), "node-fingerprints")
    discard(docs.sparkSession, sketched_at)
    root_of, roots_at = linked(distinct, marks, docs, id_name, text_name, size, similarity)
    named = named_components(distinct, root_of)
    discard(docs.sparkSession, distinct_at, marks_at, roots_at)
    return printed.join(named, "fp").select("doc_id", "fp", "component_id", "root")
