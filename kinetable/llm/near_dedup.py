"""MinHash near-dedup with odd sketches.

Each document's distinct five-word shingles are hashed once; ``BANDS`` x ``ROWS`` MinHash samples of them serve twice:
banded, they bring candidates together, and folded into a parity bitmap (an odd sketch) they let a pair be judged by
the population count of an XOR. Pairs whose sketches allow the similarity are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType

from kinetable.llm.common import map_arrow, packed
from kinetable.llm.components import components
from kinetable.session import staged

SHINGLE = 5
#: A pair of similarity 0.75 misses every band with probability (1 - 0.75^4)^40, about 2.5e-7.
BANDS, ROWS = 40, 4
#: Bits of the odd sketch, in 64-bit words. With k samples, |A xor B| of the samples is about -n/2 ln(1 - 2 z / n).
SKETCH_WORDS = 8
#: A pair is set aside unread only where its sketch puts the similarity below this; at 0.75 that is over 5 deviations off.
SKETCH_FLOOR = 0.55
#: Rows, and shingles, of one side of a block in the exhaustive pass over unresolved buckets, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 19
#: Members of a bucket's largest component that its other members meet before that pass.
PROBES = 4

_RNG = np.random.default_rng(20240501)
_MASKS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MULTS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_COEFS = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch_limit() -> int:
    """Most differing bits of two sketches that still allow the floor."""
    n, k = 64 * SKETCH_WORDS, BANDS * ROWS
    return int(np.ceil(n / 2 * (1 - np.exp(-2 * 2 * k * (1 - SKETCH_FLOOR) / n))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash, remembered for short words up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words, one hash of all; of none, nothing."""
    if not text:
        return np.zeros(0, np.uint64)
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space characters.
    h = np.fromiter(map(words.__getitem__, text.encode().lower().split()), np.uint64)
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        total += h[j: len(h) - k + 1 + j] * _COEFS[j]
    return np.unique(_mix(total))


def minhashes(s: np.ndarray) -> np.ndarray:
    """BANDS x ROWS samples: for each hash function, the least hash of the set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_MASKS), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i: i + 2048, None] ^ _MASKS
        part *= _MULTS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band, the band's number mixed in."""
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        out = _mix(out ^ rows[:, r]) + np.uint64(r + 1)
    return out.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: sample i with value v flips the bit that (i, v) hashes to."""
    at = _mix(m.astype(np.uint64) + (np.arange(len(m), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * SKETCH_WORDS)
    bits = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SIGNATURES = "node long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """One narrow pass over (node, text): set size, digest of the set, buckets and sketch."""

    def run(batches):
        words = _Words()
        for batch in batches:
            n, digest, buckets, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                if len(s):
                    m = minhashes(s)
                    digest.append(hashlib.sha256(s.tobytes()).digest()[:16])
                    buckets.append(bands(m))
                    sketch.append(odd_sketch(m))
                else:
                    digest.append(None)
                    buckets.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["node", "n_shingles", "digest", "bands", "sketch"])

    return map_arrow(docs, run, SIGNATURES)


def _allowed(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    """Set sizes and sketches leave room for a similarity of 0.75."""
    apart = F.lit(0)
    for i in range(SKETCH_WORDS):
        apart = apart + F.bit_count(F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i))))
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (apart <= _sketch_limit())


def _allowed_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return (
        pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
        .where(_allowed(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))).select("a", "b").distinct()
    )


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough. Texts are fetched for the documents in pairs only."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # The documents in pairs grow with the corpus, so no side here is ever broadcast, however few they are.
    texts = staged(docs.join(wanted.hint("merge"), "node", "left_semi").select("node", "text"), "near-texts")
    joined = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
    )

    def run(batches):
        words, last, sa = _Words(), object(), None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta = ta.as_py()
                if ta != last:
                    last, sa = ta, shingles(ta, words)
                sb = shingles(tb.as_py(), words)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(both > 0 and 100 * both >= 75 * (len(sa) + len(sb) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(joined, run, "a long, b long").distinct()


def _main(members: DataFrame) -> DataFrame:
    """For each bucket its largest component, and how many blocks its other members and all members make."""
    per = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = per.groupBy("bucket").agg(F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    return staged(main.select("bucket", F.col("m.comp").alias("main"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("rest"),
                              blocks(F.col("c"), F.col("s")).alias("whole")), "near-main")


def _with_texts(members: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Members with sketch, bands and text; where an id is repeated with different texts, with each of them."""
    nodes = members.select("node").distinct()
    texts = docs.join(nodes.hint("merge"), "node", "left_semi").select("node", "text")
    full = staged(texts.join(reps.select("node", "sketch", "bands").hint("merge"), "node"), "near-rest-texts")
    return members.join(full.hint("merge"), "node")


def _probe_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's members outside its largest component with ``PROBES`` members of that component."""
    m = staged(members.select("bucket", "node", "comp").join(_main(members), "bucket").select("bucket", "node", "comp", "main"), "near-probes")
    inside = m.where(F.col("comp") == F.col("main")).groupBy("bucket").agg(
        *[F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"].alias(f"p{k}") for k in range(PROBES)])
    tried = m.where(F.col("comp") != F.col("main")).join(inside, "bucket").select("node", F.explode(F.array(*[f"p{k}" for k in range(PROBES)])).alias("other"))
    return tried.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _rest_links(members: DataFrame) -> DataFrame:
    """Links that unresolved buckets still hold, found by comparing all members across components, in blocks.

    ``members``: bucket, node, comp, n, sketch, bands, text. In each bucket the members outside the largest component
    meet all members, block by block. A pair is looked at in the first bucket that holds both; sizes and sketches rule
    most out, full shingle sets decide the rest inside the task, and components that a link joins are one from then on.
    So a task emits fewer links than it holds components, whatever the number of similar pairs.
    """
    m = members.join(_main(members), "bucket").withColumns({
        "stray": F.col("comp") != F.col("main"),
        "i": F.pmod(F.xxhash64(F.lit(1), "node"), "rest").cast("int"), "j": F.pmod(F.xxhash64(F.lit(2), "node"), "whole").cast("int")})
    own = ("bucket", "node", "comp", "n", "sketch", "bands", "text", "stray")
    across = m.select(*own, F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("bi"), F.col("j").alias("bj"), F.lit(1).alias("side"))
    down = m.where("stray").select(*own, F.col("i").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("bj"), F.lit(0).alias("side"))
    limit = _sketch_limit()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words, links = _Words(), []
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if len(left) and len(right):
            sk, bands_ = (np.stack(right[c].to_list()).astype(np.int64) for c in ("sketch", "bands"))
            node, comp, n = (right[c].to_numpy(np.int64).copy() for c in ("node", "comp", "n"))
            stray, lcomp = right.stray.to_numpy(bool), left.comp.to_numpy(np.int64).copy()
            sets: dict[int, np.ndarray] = {}
            for k, x in enumerate(left.itertuples(index=False)):
                xb, mine = np.asarray(x.bands, np.int64), lcomp[k]
                apart = np.bitwise_count((sk ^ np.asarray(x.sketch, np.int64)).view(np.uint64)).sum(axis=1)
                ok = (comp != mine) & (~stray | (node > x.node)) & (apart <= limit) & (100 * np.minimum(n, x.n) >= 75 * np.maximum(n, x.n))
                at = np.flatnonzero(ok)
                at = at[xb[(bands_[at] == xb).argmax(axis=1)] == x.bucket]
                if not len(at):
                    continue
                own_set = shingles(x.text, words)
                for q in at.tolist():
                    if q not in sets:
                        sets[q] = shingles(right.text.iat[q], words)
                # Where an id has several texts, its sketch may be another's: the sets decide, and may be empty.
                at = np.array([q for q in at.tolist() if len(sets[q])], np.int64)
                if not len(own_set) or not len(at):
                    continue
                flat, sizes = np.concatenate([sets[q] for q in at.tolist()]), np.array([len(sets[q]) for q in at.tolist()])
                pos = np.minimum(np.searchsorted(own_set, flat), len(own_set) - 1)
                both = np.add.reduceat((own_set[pos] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                for q in at[100 * both >= 75 * (len(own_set) + sizes - both)].tolist():
                    if comp[q] != mine:
                        links.append((min(x.node, int(node[q])), max(x.node, int(node[q]))))
                        was = comp[q]
                        comp[comp == was] = mine
                        lcomp[lcomp == was] = mine
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return across.union(down).groupBy("bucket", "bi", "bj").applyInPandas(run, "a long, b long").distinct()


def _numbered(df: DataFrame, key: str, text: str) -> tuple[Column, DataFrame | None]:
    """Each row's node: its id, of any value, or where that is null a hash of its text that is no row's id. And the
    nodes of rows without id, if there are any."""
    own, t = F.col(f"`{key}`").cast(LongType()), F.col(f"`{text}`").cast(StringType())
    seed = 0
    while True:
        node = F.coalesce(own, F.xxhash64(F.lit(seed), t))
        unnamed = staged(df.where(own.isNull()).select(node.alias("node")).distinct(), "near-unnamed")
        if unnamed.isEmpty():
            return node, None
        if df.where(own.isNotNull()).select(own.alias("node")).join(unnamed.hint("merge"), "node", "left_semi").isEmpty():
            return node, unnamed
        seed += 1


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id (least id reachable over links), kept (doc_id is that id).

    Documents are linked where 100 * |A and B| >= 75 * |A or B| over their distinct shingles of lower-cased (A-Z) words;
    with fewer than five words the whole sequence is the one shingle; null, empty and blank texts are linked with nothing.

    Equal sets are one node, so copies are never paired. Then every bucket's members meet its least node; buckets whose
    members are in one component after that are done. In the others, members outside the largest component meet a few of
    it, and what is apart even then is compared exhaustively across components: no bucket is capped, and no group's pairs
    are all made. Rows with equal ids are one document: they share a component.
    Rows of null id belong to their text's component, which has null as its id if no member has one; such a row is kept
    if the component has no id. Other columns of ``df`` play no part.
    """
    node, unnamed = _numbered(df, key, text)
    out = _found(df.select(node.alias("node"), F.col(f"`{text}`").cast(StringType()).alias("text")), unnamed)
    return out.select(F.when(~F.col("unnamed"), F.col("node")).alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), "kept")


def _found(docs: DataFrame, unnamed: DataFrame | None) -> DataFrame:
    """Per row of ``docs`` (node, text): node, n_shingles, component (its least node), unnamed (the row has no id), least
    (the component's least id) and kept."""
    sig = staged(signatures(docs), "near-signatures")
    has = sig.where(F.col("digest").isNotNull())
    classes = staged(has.groupBy("digest").agg(F.min("node").alias("rep")), "near-classes")
    reps = staged(
        has.join(classes.hint("merge"), "digest").where(F.col("node") == F.col("rep")).select("node", "digest", F.col("n_shingles").alias("n"), "bands", "sketch")
        .dropDuplicates(["node", "digest"]).drop("digest"), "near-reps")

    # Round one: each bucket's members against its least node.
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = staged(
        rows.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "near-buckets")
    pairs = rows.join(buckets.hint("merge"), "bucket").where(F.col("node") > F.col("a")).select("a", F.col("node").alias("b")).distinct()
    pairs = staged(_allowed_pairs(pairs, reps), "near-pairs")
    links = staged(_confirmed(pairs, docs).union(_versions(has, classes)), "near-links")
    comps = components(links, "near-first")

    # Round two: buckets that still hold several components, first by probes and then in full.
    large = buckets.where(F.col("c") > 2).select("bucket")
    for step in ("probe", "rest"):
        known = reps.select("node", "n", "bands").join(comps, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"), "bands")
        wide = known.select("node", "n", "comp", F.explode("bands").alias("bucket")).join(large.hint("merge"), "bucket", "left_semi")
        wide = staged(wide, f"near-{step}-members")
        large = staged(wide.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where(F.col("x") < F.col("y")).select("bucket"), f"near-{step}-open")
        members = wide.join(large, "bucket", "left_semi")
        if step == "probe":
            more = _allowed_pairs(_probe_pairs(members), reps).join(pairs, ["a", "b"], "left_anti")
            found = _confirmed(staged(more, "near-probe-pairs"), docs)
        else:
            found = _rest_links(_with_texts(members, reps, docs))
        found = staged(found, f"near-{step}-links")
        if found.isEmpty():
            continue
        links = links.union(found)
        comps = components(links, f"near-{step}")

    found = staged(classes.join(comps, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component")), "near-found")
    out = sig.select("node", "n_shingles", "digest").join(found.hint("merge"), "digest", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    if unnamed is None:
        return out.withColumns({"unnamed": F.lit(False), "least": F.col("component"), "kept": F.col("node") == F.col("component")})
    # The least node may be one without id: components that hold such a node are named by their least id.
    out = staged(out.join(unnamed.hint("merge").withColumn("unnamed", F.lit(True)), "node", "left").withColumn("unnamed", F.coalesce("unnamed", F.lit(False))), "near-unnamed-found")
    mixed = out.where("unnamed").select("component").distinct()
    ids = out.where("not unnamed").join(mixed.hint("merge"), "component", "left_semi").groupBy("component").agg(F.min("node").alias("id"))
    names = staged(mixed.join(ids.hint("merge"), "component", "left").withColumn("mixed", F.lit(True)), "near-names")
    least = F.when(F.col("mixed"), F.col("id")).otherwise(F.col("component"))
    return out.join(names.hint("merge"), "component", "left").select(
        "node", "n_shingles", "component", "unnamed", least.alias("least"), F.when(F.col("unnamed"), F.lit(None).cast("long")).otherwise(F.col("node")).eqNullSafe(least).alias("kept"))


def _versions(has: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that hold the texts of one id together, where an id is repeated with different texts."""
    of = has.select("node", "digest").join(classes, "digest").select("node", "rep")
    several = of.groupBy("node").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where(F.col("x") < F.col("y")).select("node")
    return of.join(several, "node", "left_semi").where(F.col("node") != F.col("rep")).select(F.col("rep").alias("a"), F.col("node").alias("b"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the least of their component, with the columns of ``df``.

    Of a component without any id one row stays; rows of null id without words are all kept, as they are linked with nothing.
    """
    node, unnamed = _numbered(df, key, text)
    own = df.select(packed(df), node.alias("_node"))
    found = _found(own.select(F.col("_node").alias("node"), F.col(f"row.`{text}`").cast(StringType()).alias("text")), unnamed).where("kept")
    kept = found.where("not unnamed").select(F.col("node").alias("_node")).distinct()
    named = own.where(F.col(f"row.`{key}`").isNotNull()) if unnamed is not None else own
    out = named.join(kept, "_node", "left_semi").select("row")
    if unnamed is not None:
        bare = found.where("unnamed and (n_shingles = 0 or node = component)").select(F.col("node").alias("_node"), (F.col("n_shingles") > 0).alias("linked")).distinct()
        rest = staged(own.where(F.col(f"row.`{key}`").isNull()).join(bare.hint("merge"), "_node"), "near-bare")
        once = rest.where("linked").groupBy("_node").agg(F.first("row").alias("row")).select("row")
        out = out.union(once).union(rest.where("not linked").select("row"))
    return out.select("row.*")
