"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints. 64 bits by majority over the XXH64 of every word shingle. Exact copies meet in one distinct
fingerprint, whose representative is the smallest doc_id; everything below works on distinct fingerprints.

Candidate keys. A fingerprint is split into three segments of 22, 21 and 21 bits. At most two bits differ in all,
so by pigeonhole some segment is equal while the one after it (cyclically) differs in at most one bit. The perfect
Golay code [23, 12] decodes every 23-bit word to its one codeword within three bits; a segment's fuzzy keys are the
codeword indices of the segment and of all its one-bit neighbours: one key when it lies within two bits of its
codeword, else six. Segments one bit apart always share one. A join key is (which segment, its bits, fuzzy key of
the next segment).

Verification. In a bucket of at most ``PAIRS_BELOW`` fingerprints all pairs are compared inside one row and only
true links leave it. Fingerprints of larger buckets are linked through midpoints instead: two fingerprints at
distance two or less share one of their 65 words within one bit, a word has at most 65 fingerprints around it, and
any two of those are linked. So rows stay linear in the fingerprints however many near copies a group holds, and
no link between different fingerprints is lost.

Components. Alternating large-star and small-star rounds over the link table, each written to the shared
checkpoint folder; the number of rounds grows with the logarithm of a component's width.

Defined cases: no words (null, empty, blank) gives fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; a row with null doc_id gets its fingerprint and component, but never names one (a component
of null ids only has id null); repeated rows are reported each; an empty table gives no rows; whole texts count
however long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard, written
from .common import LOWER_AZ, fresh_name, quoted, table, text_map

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
#: (shift, width) of the segments, lowest bits first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS_BELOW = 64
HASH_CHUNK = 1 << 16


# ---- fingerprints -------------------------------------------------------------------------------------------


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set, highest bit first."""
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASH_CHUNK):
        part = hashes[at : at + HASH_CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER_AZ).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    majority = bit_counts(hashes) * 2 > n
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def signed_fingerprint(text: str | None) -> int:
    """The fingerprint as a LONG holds it."""
    x = fingerprint(text)
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_name: str, text_name: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed LONG): one row per document, no shuffle."""

    def make():
        return lambda texts: [list(map(signed_fingerprint, texts))]

    return text_map(docs, F.col(text_name), [F.col(id_name).cast("long").alias("doc_id")], "fp long", make)


# ---- Golay keys ---------------------------------------------------------------------------------------------

#: Generator polynomial of the perfect binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, CHECK_BITS = 0xC75, 23, 11


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the low 12 and high 11 bits of a word, error pattern of each syndrome)."""
    unit = []
    for i in range(LENGTH):
        rest = 1 << i
        for k in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - CHECK_BITS)
        unit.append(rest)
    part = np.zeros((2, 1 << 12), dtype=np.int64)
    for half in (0, 1):
        for i in range(12):
            if half * 12 + i < LENGTH:
                at = np.arange(1 << 12) >> i & 1
                part[half] ^= at * unit[half * 12 + i]
    error = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for a in range(LENGTH):
        for b in range(a, LENGTH):
            for c in range(b, LENGTH):
                places = {a, b, c}
                s = 0
                for x in places:
                    s ^= unit[x]
                error[s] = sum(1 << x for x in places)
    return part, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    part, error = golay_tables()
    syndrome = part[0][words & 0xFFF] ^ part[1][words >> 12]
    return (words ^ error[syndrome]) >> CHECK_BITS


def fuzzy_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Per word the codeword indices of itself and of its neighbours in the low ``width`` bits, sorted, with repeats."""
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int64)
    return np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for every candidate key of unsigned fingerprints."""
    rows, keys = [], []
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        index = fuzzy_indices(parts[j], SEGMENTS[j][1])
        new = np.ones(index.shape, dtype=bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        at, col = np.nonzero(new)
        rows.append(at)
        keys.append((np.int64(i) << 40) | (parts[i][at] << 12) | index[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def with_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key) rows, about sixteen a fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                rows, keys = candidate_keys(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(some[rows]), pa.array(keys)], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


# ---- links and components -----------------------------------------------------------------------------------


def links(distinct: DataFrame) -> tuple[DataFrame, str]:
    """Distinct (a, b), a < b, that connect exactly the fingerprints connected by distances of two bits or less, and
    where they are written."""
    keyed = with_keys(distinct)
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members, members_at = written(keyed.join(buckets, "key"), "golay-members")
    near = F.transform(
        F.col("fps"),
        lambda a: F.transform(
            F.filter(F.col("fps"), lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)),
            lambda b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )
    few = members.filter(F.col("n") <= PAIRS_BELOW).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b")
    crowded = members.filter(F.col("n") > PAIRS_BELOW).select("fp").distinct()
    around = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    met = (
        crowded.withColumn("flip", F.explode(around))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .filter(F.size("fps") > 1)
    )
    stars = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    found, at = written(pairs.union(stars).distinct(), "links")
    discard(distinct.sparkSession, members_at)
    return found, at


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root), every node of ``edges`` (a, b) with the smallest node of its component, and the table it reads."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last, last_at = None, None
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        # small star: a node and its lower neighbours move to the lowest of them
        lower = large.groupBy("b").agg(F.min("a").alias("low"))
        moved = large.join(lower, "b").select(F.col("low").alias("a"), F.col("a").alias("x"), F.col("b").alias("y"))
        small = moved.select("a", F.explode(F.array("x", "y")).alias("b")).filter("a < b").distinct()
        edges, at = written(small, "stars")
        if last_at:
            discard(edges.sparkSession, last_at)
        last_at = at
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:  # every edge joins a root to one of its nodes
            break
        last = state
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct(), last_at


def near_duplicates(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, fp, component_id, root: one row per document; ``root`` tells components apart even where ids repeat."""
    printed = cut(fingerprints(docs, id_name, text_name), "fingerprints")
    distinct, distinct_at = written(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found, links_at = links(distinct)
    root_of, roots_at = components(found)
    named = named_components(distinct, root_of)
    discard(docs.sparkSession, distinct_at, links_at, roots_at)
    return printed.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def named_components(distinct: DataFrame, root_of: DataFrame) -> DataFrame:
    """fp, component_id, root of distinct fingerprints (fp, first) and the roots of those that are linked, written down."""
    rooted = distinct.join(root_of, distinct["fp"] == root_of["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return cut(rooted.join(smallest, "root").select("fp", "component_id", "root"), "components")


def drop_near_duplicates(
    docs: DataFrame,
    id_name: str = "doc_id",
    text_name: str = "text",
    groups: Callable[[DataFrame, str, str], DataFrame] = near_duplicates,
    printed: Callable[[str | None], int] = signed_fingerprint,
) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id, with all its columns.

    ``groups`` names the groups as ``near_duplicates`` does, by what ``printed`` makes of a text;
    ``similar.near_duplicates`` has the wider radius.

    Defined cases: where a doc_id repeats, its rows are told apart by fingerprint, so a text of another group is no copy
    because of its id; of rows that repeat id and fingerprint one stays; of groups without any id one row stays.
    """
    found = cut(groups(docs, id_name, text_name), "near-duplicates")
    kept_id, kept_fp, mine, clear = (fresh_name(docs, x) for x in ("__kept_id", "__kept_fp", "__fp", "__clear"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp"))
    keepers = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.fp").alias(kept_fp))
    keepers = cut(keepers, "keepers")
    # a doc_id stays if its one row is a keeper, goes if none is, and is looked into if it has others as well
    kept = keepers.select(F.col(kept_id).alias("doc_id"), F.col(kept_fp).alias("fp"), F.lit(1).alias("keeps"))
    rows = found.select("doc_id", F.lit(0).alias("keeps")).unionByName(kept.select("doc_id", "keeps"))
    by_id = rows.groupBy("doc_id").agg((F.count(F.lit(1)) - F.sum("keeps")).alias("n"), F.sum("keeps").alias("k"))
    sorted_out = cut(by_id.filter("n > 1 or k = 0").select(F.col("doc_id").alias(kept_id), (F.col("k") > 0).alias(clear)), "ids-to-go")
    same = F.col(id_name).cast("long").eqNullSafe(F.col(kept_id))
    left = docs.join(sorted_out, same, "left_anti")
    several = sorted_out.filter(clear)
    if several.isEmpty():
        return left
    again = docs.join(several, same, "left_semi")
    carry = [F.col(quoted(c)) for c in again.columns]
    again = text_map(again, F.col(text_name), carry, f"{mine} long", lambda: lambda texts: [[printed(t) for t in texts]])
    chosen = again.join(keepers, same & (F.col(mine) == F.col(kept_fp)), "left_semi")
    once = chosen.withColumn(kept_id, F.col(id_name).cast("long")).dropDuplicates([kept_id, mine])
    return left.unionByName(once.select(*map(quoted, docs.columns)))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

