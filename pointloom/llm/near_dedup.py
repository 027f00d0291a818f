"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes; WORDS words unless told otherwise), a
   digest of that set, and a signature of BANDS * ROWS minima. Rows are told apart by doc_id, or, where ids repeat or are
   null, by numbers that are written with them; those with one digest are one class, for which its first row stands from here on.
2. Classes that share a band's minima are candidates. At similarity 0.8 a pair shares no
   band with probability (1 - 0.8 ** ROWS) ** BANDS, about 5e-6.
3. In each bucket all members are first compared with its smallest member. Signatures
   are compared in batches; after each batch a pair is dropped if, given its matches,
   the posterior probability of similarity 0.8 or more is under MISS. Survivors are
   compared exactly, on full shingle sets; a bucket's smallest member is sent once to each
   BLOCK of its pairs and hashed once there. Links give components.
4. In buckets that still hold several components, all pairs across components
   are compared the same way: those of small buckets as rows; large buckets are
   dealt in blocks, of bounded weight of text, of members outside the largest component against blocks of all members.
   Blocks are pruned by signatures alone; texts are fetched only for members that stand in a surviving pair, and
   only links leave a block. A pair is compared in the first band it shares.
   Pairs within a component need no comparison, as they cannot change the result.

So no bucket or group is capped, collected or multiplied out, and no link
between candidates is lost but at probability MISS. Rows of a key that holds over a thousandth of all
are joined by broadcast of one row a key (`join_groups`), so hot band keys and hot centers make no hot task.
Tables with texts and signatures are deleted from the shared folder once the result is written there.

Defined cases: null, empty and blank texts have no shingles and link with nothing; one
word is a set of one; repeated rows and equal texts are one class; every row is a document of its own, also where
doc_ids repeat or are null: a component has the smallest doc_id in it, and where all are null component_id is null and
the first row is kept; a very long text counts as several members of a block; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, join_groups, shared_dir, small_batches, written
from pointloom.llm.shingles import _mix, jaccard_linked, set_digest, shingle_sets, signature
from pointloom.operators.graph import connected_components

BANDS, ROWS = 40, 6
WORDS = 2  # of a shingle, for the query and the pipeline alike
PERCENT = 80
MISS = 1e-6
BATCH = 40  # minima compared before each look at the posterior
SMALL_BUCKET = 24
BLOCK = 256

_FEATURES = "at long, doc_id long, row long, n_shingles long, digest binary, sig binary, bands array<long>"
HEAVY = 2048  # shingles of a text that counts as one more member when blocks are dealt


def min_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches of n signature bytes with which a pair is kept.

    With a uniform prior, P(s >= t | m of n match) is the binomial P(X <= m) for n + 1
    trials at t. Bytes of unequal minima agree once in 256, which t includes.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        if total >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Positions of the rows of two signature matrices that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, a.shape[1], BATCH):
        if not len(alive):
            break
        end = min(k + BATCH, a.shape[1])
        matches = matches + (a[alive, k:end] == b[alive, k:end]).sum(axis=1)
        keep = matches >= min_matches(end, percent, miss)
        alive, matches = alive[keep], matches[keep]
    return alive


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = _mix(h ^ (rows[:, r] + np.uint64(r << 32)))
    return h.view(np.int64)


def features(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """at, doc_id, row, n_shingles, digest, sig (the low byte of each minimum), bands of rows (at, doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, max_bytes=1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)
            sigs = [signature(s, BANDS * ROWS) for s in sets]
            full = [len(s) > 0 for s in sets]
            columns = [
                *(batch.column(c) for c in ("at", "doc_id", "row")),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([g.astype(np.uint8).tobytes() if f else None for g, f in zip(sigs, full, strict=True)], pa.binary()),
                pa.array([band_keys(g) if f else [] for g, f in zip(sigs, full, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "row", "n_shingles", "digest", "sig", "bands"])

    return rows.select("at", "doc_id", "row", "text").mapInArrow(run, _FEATURES)


def bucket_members(reps: DataFrame, folder: str) -> DataFrame:
    """key, band, rep, weight, size and center (smallest rep) of all buckets with several members."""
    rows = reps.select("rep", "weight", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return written(join_groups(rows, written(sizes, f"{folder}/sizes"), ["key"], "size"), f"{folder}/members")


def _exact_links(batches: Iterator[pa.RecordBatch], percent: int, words: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (a, part, b, text) that come by (a, part), the text of a itself (b null) before those of its pairs."""
    group, centers = None, []
    for large in batches:
        for batch in small_batches(iter([large]), max_bytes=1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            linked = []
            for key, b, found in zip(zip(*(batch.column(c).to_pylist() for c in ("a", "part")), strict=True), batch.column("b").to_pylist(), sets, strict=True):
                if key != group:
                    group, centers = key, []
                if b is None:
                    centers.append(found)
                linked.append(b is not None and any(jaccard_linked(c, found, percent) for c in centers))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, miss: float, words: int, folder: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; any number of pairs may share their a."""
    pairs, sigs = written(pairs, f"{folder}/pairs"), reps.select("rep", "sig")
    ends = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("times")).join(sigs.toDF("a", "sig_a"), "a")
    with_sigs = join_groups(pairs.join(sigs.toDF("b", "sig_b"), "b"), written(ends, f"{folder}/ends"), ["a"], "times")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).take(pa.array(survivors(a, b, percent, miss)))

    likely = written(with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long"), f"{folder}/likely")
    parts = likely.groupBy("a").agg(F.count(F.lit(1)).alias("times")).withColumn("parts", F.ceil(F.col("times") / BLOCK).cast("int"))
    parts = written(parts, f"{folder}/parts")
    dealt = join_groups(likely, parts, ["a"], "times").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    others = dealt.join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text")
    own = parts.join(texts.toDF("a", "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    ordered = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(lambda batches: _exact_links(batches, percent, words), "a long, b long")


def _block_pairs(table: pa.Table, percent: int, miss: float) -> list[tuple[int, np.ndarray]]:
    """For each outsider of a block pair the members of other components that its signature doesn't rule out, likest first."""
    outsider = table.column("outsider").to_numpy(zero_copy_only=False).astype(bool)
    out, own = np.flatnonzero(outsider), np.flatnonzero(~outsider)
    if not len(out) or not len(own):
        return []
    n, band = table.num_rows, table.column("band")[0].as_py()
    rep, comp = (table.column(c).to_numpy() for c in ("rep", "component"))
    outside = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
    todo = []
    for i in out.tolist():
        # Pairs of two outsiders come up twice in a bucket; an earlier shared band has compared the pair already.
        others = own[(comp[own] != comp[i]) & ~(outside[own] & (rep[own] <= rep[i]))]
        others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)] if band else others
        others = others[survivors(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], percent, miss)]
        if len(others):
            todo.append((i, others[np.argsort(-(sig[others] == sig[i]).sum(axis=1), kind="stable")]))
    return todo


def _block_survivors(table: pa.Table, percent: int, miss: float) -> pa.Table:
    """The rows of a block pair that stand in any pair left to compare."""
    needed = sorted({x for i, others in _block_pairs(table, percent, miss) for x in (i, *others.tolist())})
    return table.take(pa.array(needed, pa.int64()))


def _block_links(table: pa.Table, percent: int, miss: float, words: int) -> pa.Table:
    """Links across components between the outsiders and the members of one block pair."""
    rep, comp, texts = (table.column(c).to_pylist() for c in ("rep", "component", "text"))
    names = {c: c for c in set(comp)}

    def root(c: int) -> int:
        while names[c] != c:
            c = names[c]
        return c

    sets = shingle_sets(texts, words)
    found: list[tuple[int, int]] = []
    for i, others in _block_pairs(table, percent, miss):
        for j in others.tolist():
            a, b = root(comp[i]), root(comp[j])
            if a != b and jaccard_linked(sets[i], sets[j], percent):
                names[max(a, b)] = min(a, b)
                found.append((rep[i], rep[j]))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_BLOCK_ROW = "key long, band int, rep long, component long, outside boolean, outsider boolean, row int, col int, sig binary, bands array<long>"


def across_components(members: DataFrame, components: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, miss: float, words: int, folder: str) -> DataFrame:
    """Links between members of one bucket that lie in different components."""
    labelled = members.join(components, members.rep == components.node, "left").select("key", "band", "rep", "weight", "size", "center", F.coalesce("component", "rep").alias("component"))
    labelled = written(labelled, f"{folder}/labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("times")).filter("low < high").select("key", "times")
    active = written(join_groups(labelled, written(mixed, f"{folder}/mixed"), ["key"], "times").drop("times"), f"{folder}/active")

    small = active.filter(F.col("size") <= SMALL_BUCKET).select("key", "rep", "center", "component")
    other = small.select("key", F.col("rep").alias("b"), F.col("component").alias("component_b"))
    met = small.join(other, "key").filter("component < component_b AND rep <> center AND b <> center")
    pairs = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    links = verify(pairs, reps, texts, percent, miss, words, f"{folder}/small")

    # Blocks are dealt by the weight of their texts, first with signatures alone; texts follow for what these leave.
    large = active.filter(F.col("size") > SMALL_BUCKET)
    counts = large.groupBy("key", "component").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("count"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("weight", "component")).alias("main"), F.max("weight").alias("most"), F.sum("weight").alias("all"), F.sum("count").alias("times"))
    placed = join_groups(large, written(main, f"{folder}/main"), ["key"], "times").withColumn("outside", F.col("component") != F.col("main"))
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    outside_blocks = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    at = F.xxhash64("rep")
    columns = ["key", "band", "rep", "component", "outside", "outsider", "row", "col"]
    outsiders = placed.filter("outside").withColumn("outsider", F.lit(True)).withColumn("row", F.pmod(at, outside_blocks).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), blocks - 1)))
    everyone = placed.withColumn("outsider", F.lit(False)).withColumn("col", F.pmod(at, blocks).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), outside_blocks - 1)))
    dealt = outsiders.select(*columns).unionByName(everyone.select(*columns)).join(reps.select("rep", "sig", "bands"), "rep")
    dealt = dealt.select(*[c.split()[0] for c in _BLOCK_ROW.split(", ")])
    left = written(dealt.groupBy("key", "row", "col").applyInArrow(lambda table: _block_survivors(table, percent, miss), _BLOCK_ROW), f"{folder}/survivors", compression="zstd")
    in_blocks = left.join(texts, "rep").groupBy("key", "row", "col").applyInArrow(lambda table: _block_links(table, percent, miss, words), "a long, b long")
    return links.unionByName(in_blocks)


def _numbered(docs: DataFrame, row: str | None, folder: str) -> DataFrame:
    """at, doc_id, row, text, where at tells rows apart and stays with its row: the doc_id if no two rows share one, else a given number of the row, else one that is written with it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    named = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("doc_id IS NULL OR rows > 1").isEmpty()
    if named or row:
        return rows.withColumn("at", F.col("doc_id" if named else "row"))
    return written(rows.withColumn("at", F.monotonically_increasing_id()), folder, compression="zstd")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, miss: float = MISS, folder: str | None = None, row: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; and, if a column row (a number of each row that a second scan gives again) is named, row and component, a number of its component that is never null."""
    folder = folder or shared_dir(docs.sparkSession, "near-dedup")
    work = f"{folder}/work"
    rows = _numbered(docs, row, f"{work}/rows")
    feats = written(features(rows, words), f"{work}/features")
    full = feats.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("at").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"))
    classes = written(classes, f"{work}/classes")
    weight = (1 + F.col("n_shingles") / HEAVY).cast("long").alias("weight")
    # Classes and members grow with the input: such joins sort and merge both sides at every size.
    reps = written(full.join(classes.select(F.col("rep").alias("at")).hint("merge"), "at", "left_semi").select(F.col("at").alias("rep"), weight, "sig", "bands"), f"{work}/reps")

    members = bucket_members(reps, work)
    wanted = members.select("rep").distinct()
    plain = rows.filter("text IS NOT NULL").select(F.col("at").alias("rep"), F.col("text").cast("binary").alias("text"))
    texts = written(plain.join(wanted.hint("merge"), "rep", "left_semi"), f"{work}/texts")
    discard(docs.sparkSession, f"{work}/rows")

    stars = members.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    first = written(verify(stars, reps, texts, percent, miss, words, f"{work}/stars"), f"{work}/links")
    components = written(connected_components(first, "a", "b", f"{work}/first"), f"{work}/components")
    more = written(across_components(members, components, reps, texts, percent, miss, words, f"{work}/across"), f"{work}/more-links")
    # Components merge along the later links.
    roots = components.select(F.col("node"), F.col("component"))
    ends = more.join(roots.toDF("a", "ca"), "a", "left").join(roots.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = written(connected_components(ends, "a", "b", f"{work}/second"), f"{work}/merged").toDF("component", "root")
    last = components.join(merged, "component", "left").select(F.col("node").alias("rep"), F.coalesce("root", "component").alias("root"))
    single = merged.join(components.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("rep"), "root")
    labels = last.unionByName(single)

    # A component has the smallest of its doc_ids, and a first row for the case that it has none.
    groups = written(classes.join(labels, "rep", "left").select("digest", "class_size", "rep", "least", F.coalesce("root", "rep").alias("root")), f"{work}/roots")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.min("rep").alias("first"), F.count(F.lit(1)).alias("times"))
    groups = join_groups(groups.select("digest", "class_size", "root"), written(named, f"{work}/named"), ["root"], "times").select("digest", "class_size", "component_id", "first")
    entries = full.select("at", "doc_id", "row", "n_shingles", "digest")
    linked = join_groups(entries, written(groups, f"{work}/groups"), ["digest"], "class_size").select("at", "doc_id", "row", "n_shingles", "component_id", "first")
    alone = feats.filter("n_shingles = 0").select("at", "doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("at").alias("first"))
    kept = F.when(F.col("component_id").isNull(), F.col("at") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = linked.unionByName(alone).withColumn("kept", kept).select("doc_id", "n_shingles", "component_id", "kept", *(["row", F.col("first").alias("component")] if row else []))
    result = written(found, f"{folder}/result")
    discard(docs.sparkSession, work)
    return result
