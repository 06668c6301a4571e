"""MinHash near-deduplication with star-shaped candidate edges.

One-permutation hashing: a document's shingle hashes fall into ``BINS`` bins by
their top bits and each bin keeps its least hash; an empty bin borrows from the
first non-empty bin in a fixed random order of its own (optimal densification).
Bands of ``ROWS`` bins are bucket keys.

Documents with equal shingle sets are one class, so copies never form pairs.
Within a bucket the classes are linked to the one with the least id, a star: as
many candidate edges as members.  Edges are filtered by set sizes (exact) and by
the share of equal signature bytes (six standard deviations below the limit), then
confirmed on full shingle sets, and joined into components.

A star can miss a link between two members that are both unlike its centre.  So
buckets that still hold several components get new centres for ``RESTARS`` rounds,
and what is still open goes through an exact prefix filter: shingles that occur in
one component only come first, then the others by rising frequency, and two
documents from different components can reach the limit only if they share one of
the first quarter of their shingles, with enough shingles behind it in both.
Members of a bucket that merely share boilerplate have rarer shingles in front, so
they never meet, and a frequent shingle's group is split over tasks in blocks.

Shingle hashes have 64 bits; the chance that two different shingles of a pair of
documents agree is below 1e-12 for texts of a million words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import binary_of, docs_of, drop_rows, keyed_docs, list_of, map_slices, runs, step, verdict
from blotter.operators.components import connected_components
from blotter.operators.grouped import map_groups

WORDS = 5
PERCENT = 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Rows of a shingle's group that meet in one task at once; rounds of new centres for buckets that are still open.
BLOCK, RESTARS = 512, 2
_U = np.uint64
#: Multipliers by place of a word in its shingle (odd, from the golden ratio's fraction).
PLACE = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(WORDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Row j: all bins in the random order in which bin j looks for a value, itself first.
ORDER = np.stack([np.r_[j, (o := np.random.default_rng(j).permutation(BINS))[o != j]] for j in range(BINS)])


def shingle_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles: windows of five words, or the whole of fewer."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = np.asarray(words.offsets).astype(np.int64)
    at -= at[0]
    coded = words.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    full = np.asarray(pc.binary_length(coded.dictionary)) > 0
    code = np.asarray(coded.indices)
    real = full[code] if len(code) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(real)])[at]
    h = table[code[real]] if len(code) else table
    n = len(h) - WORDS + 1
    windows = sum((h[i:n + i] * PLACE[i] for i in range(WORDS)), np.zeros(max(n, 0), np.uint64))
    windows = mix(windows + _U(WORDS))
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= WORDS:
            out.append(np.unique(windows[a:b - WORDS + 1]))
        elif b > a:
            out.append(mix((h[a:b] * PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures with optimal densification, a row per non-empty set."""
    least = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    shift = _U(64 - BINS.bit_length() + 1)
    for i, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # sorted: the first of a bin is its least
        least[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    for part in np.array_split(np.flatnonzero(~filled.all(axis=1)), max(1, len(sets) // 256)):
        if len(part):
            source = ORDER[np.arange(BINS), filled[part][:, ORDER].argmax(axis=2)]
            least[part] = np.take_along_axis(least[part], source, 1)
    return least


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros((len(signature), BANDS), np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, set_key, sig (a byte per bin), bands; null keys where there is no shingle."""

    def make():
        import xxhash

        def work(batch):
            sets = shingle_hashes(batch.column(1))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            some = n > 0
            signature = signatures([s for s in sets if len(s)])
            back = np.where(some, np.cumsum(some) - 1, -1)
            place = pa.array(back, mask=~some)
            keys = pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary())
            sig = binary_of((signature & _U(255)).astype(np.uint8).ravel(), np.arange(len(signature) + 1) * BINS)
            bands = list_of(band_keys(signature).ravel(), np.arange(len(signature) + 1) * BANDS, pa.int64())
            return {"doc_id": batch.column(0), "digest": batch.column(2), "n_shingles": n, "set_key": keys, "sig": sig.take(place), "bands": bands.take(place)}
        return work

    return map_slices(keyed_docs(docs), make, "doc_id long, digest string, n_shingles long, set_key binary, sig binary, bands array<long>")


def sizes_allow(a: str, b: str) -> F.Column:
    """Sets of these sizes can reach the limit at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def signatures_allow(sa: np.ndarray, sb: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share of equal bytes is not six standard deviations or more below the limit; n: the smaller set's size."""
    p = PERCENT / 100
    return (sa == sb).mean(axis=-1) >= p - 6 * np.sqrt(p * (1 - p) / np.minimum(n, BINS))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst) -> those whose full shingle sets reach the limit.

    Texts of the documents in question are moved once, to be cut into shingles; a pair then meets both sets.
    """
    ids = step(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "pair-ids")

    def make():
        return lambda batch: {"doc_id": batch.column(0), "hashes": [s.tobytes() for s in shingle_hashes(batch.column(1))]}

    sets = step(map_slices(docs_of(docs).join(ids, "doc_id", "left_semi"), make, "doc_id long, hashes binary"), "sets")

    def run(batches):
        for b in batches:
            src, dst = b.column(0), b.column(1)
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(s), len(t)) * 100 >= PERCENT * max(len(s), len(t), 1):
                    common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    ok[i] = 100 * common >= PERCENT * (len(s) + len(t) - common) and common > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([src.filter(keep), dst.filter(keep)], ["src", "dst"])

    left = sets.select(F.col("doc_id").alias("src"), F.col("hashes").alias("hs"))
    right = sets.select(F.col("doc_id").alias("dst"), F.col("hashes").alias("hd"))
    met = pairs.select("src", "dst").join(left, "src").join(right, "dst").select("src", "dst", "hs", "hd")
    return met.mapInArrow(run, "src long, dst long").distinct()


def star_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (centre, member) pairs whose sizes and signatures allow the limit."""
    return likely(members.filter("rep <> centre").select(F.least("centre", "rep").alias("src"), F.greatest("centre", "rep").alias("dst")).distinct(), classes)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of distinct (src, dst) whose sizes and signatures allow the limit."""
    light = classes.select("rep", "n", "sig")
    both = (pairs.join(light.select(F.col("rep").alias("src"), F.col("n").alias("ns"), F.col("sig").alias("ss")), "src")
            .join(light.select(F.col("rep").alias("dst"), F.col("n").alias("nd"), F.col("sig").alias("sd")), "dst")
            .filter(sizes_allow("ns", "nd")))

    def run(batches):
        for b in batches:
            if b.num_rows:
                sa, sb = (np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(i)]) for i in (2, 3))
                keep = pa.array(signatures_allow(sa, sb, np.minimum(np.asarray(b.column(4)), np.asarray(b.column(5)))))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])

    return both.select("src", "dst", "ss", "sd", "ns", "nd").mapInArrow(run, "src long, dst long").distinct()


def open_members(members: DataFrame, components: DataFrame) -> DataFrame:
    """(bucket, rep, component) of the buckets that hold several components."""
    comp = components.select(F.col("id").alias("rep"), "component")
    labelled = step(members.select("bucket", "rep").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return step(labelled.join(several, "bucket"), "open")


def new_stars(rows: DataFrame, turn: int) -> DataFrame:
    """(rep, centre) of open members and a new centre of their bucket, another one each turn; members of its component need no edge."""
    centres = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "component")).alias("c"))
    return rows.join(centres, "bucket").filter("component <> c.component").select("rep", F.col("c.rep").alias("centre"))


def prefixes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(shingle, rep, component, n, after): the shingles by which an open document can meet another component's.

    after: how many of the document's shingles that several components have come no earlier in the order (itself
    included).  A link needs 75 % of n in common, so a shingle with fewer behind it can not be the first common one.
    """
    ids = step(rows.select(F.col("rep").alias("doc_id"), "component").distinct(), "open-ids")

    def make():
        def work(batch):
            sets = shingle_hashes(batch.column(1))
            at = runs(np.fromiter(map(len, sets), np.int64, len(sets)))
            flat = np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)
            return {"rep": batch.column(0), "component": batch.column(2), "n": np.diff(at), "shingles": list_of(flat, at, pa.int64())}
        return work

    texts = docs_of(docs).join(ids, "doc_id").select("doc_id", "text", "component")
    sets = step(map_slices(texts, make, "rep long, component long, n long, shingles array<long>"), "open-sets")
    if not sets.groupBy("rep").count().filter("count > 1").isEmpty():  # repeated rows
        sets = sets.dropDuplicates(["rep"])
    each = sets.select("rep", "component", "n", F.explode("shingles").alias("shingle"))
    across = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle", "c")
    last_first = Window.partitionBy("rep").orderBy(F.desc("c"), F.desc("shingle"))
    return (each.join(across, "shingle").withColumn("after", F.row_number().over(last_first).cast("long"))
            .filter(100 * F.col("after") >= PERCENT * F.col("n")).select("shingle", "rep", "component", "n", "after"))


def rest_pairs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct pairs of open documents from different components that a prefix filter can not rule out; no link is missing.

    The first shingle in the order that a pair has in common has at least the whole intersection behind it in both
    sets, so a linked pair passes in that shingle's group.
    """
    front = step(prefixes(rows, docs), "prefixes")
    groups = (front.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
              .filter("lo <> hi").select("shingle", F.ceil(F.col("m") / BLOCK).cast("int").alias("g")))
    dealt = (front.join(groups, "shingle").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "after"))

    def pairs_of(group: pa.Table):
        own, rep, comp, n, after = (np.asarray(group.column(c)) for c in ("own", "rep", "component", "n", "after"))
        same_block = group.column("i")[0] == group.column("j")[0]
        src, dst = [], []
        for k in range(len(rep) - 1):
            rest = slice(k + 1, None)
            near = (comp[rest] != comp[k]) & ((100 + PERCENT) * np.minimum(after[rest], after[k]) >= PERCENT * (n[rest] + n[k]))
            if not same_block:
                near &= own[rest] != own[k]
            if near.any():
                other = rep[rest][near]
                src.append(np.minimum(rep[k], other))
                dst.append(np.maximum(rep[k], other))
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)}) if src else None

    return map_groups(dealt, ["shingle", "i", "j"], pairs_of, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row per input row (see ``classified``)."""
    return classified(docs).drop("digest")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, kept; a row per input row.

    component_id is the least doc_id that links of similarity >= 0.75 reach.  Texts without words are linked
    with nothing.  Rows that share an id are judged by their own texts, under that id; a row without an id is
    linked with nothing, has no component_id and is kept.
    """
    feats = step(features(docs), "minhash")
    linked = feats.filter("doc_id is not null and set_key is not null")
    classes = step(linked.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "digest")).alias("own"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("set_key", F.col("own.doc_id").alias("rep"), "own", "n", "sig", "bands"), "classes")
    text_hash = F.xxhash64("digest")
    texts, shared_ids = docs, not linked.groupBy("doc_id").agg(F.min(text_hash).alias("lo"), F.max(text_hash).alias("hi")).filter("lo <> hi").isEmpty()
    if shared_ids:  # of texts that share their least id, all but one of their classes get numbers of their own
        place = F.row_number().over(Window.partitionBy("rep").orderBy("set_key"))
        number = F.lit(-2**62) - F.pmod(F.xxhash64("set_key"), F.lit(2**61))
        classes = step(classes.withColumn("place", place).withColumn("rep", F.when(F.col("place") == 1, F.col("rep")).otherwise(number)).drop("place"), "classes")
        named = classes.select(F.col("own.doc_id").alias("doc_id"), F.col("own.digest").alias("digest"), "rep")
        texts = keyed_docs(docs).join(named, ["doc_id", "digest"]).select(F.col("rep").alias("doc_id"), "text")
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre <> last").drop("last")
    members = step(buckets.join(shared, "bucket"), "buckets")
    pairs = step(star_pairs(members, classes), "stars")
    links = step(confirm(pairs, texts), "links")
    components = step(connected_components(links), "components")
    for turn in range(RESTARS + 1):
        rows = open_members(members, components)
        if rows.isEmpty():
            break
        more = star_pairs(new_stars(rows, turn), classes) if turn < RESTARS else likely(rest_pairs(rows, texts), classes)
        more = step(more.join(pairs, ["src", "dst"], "left_anti"), "rest")
        if not more.isEmpty():
            pairs, links = pairs.unionByName(more), links.unionByName(step(confirm(more, texts), "links"))
            components = step(connected_components(links), "components")
    # every document: its class, the class's component
    by_class = classes.select("set_key", "rep", "own.doc_id").join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "set_key", "doc_id", F.coalesce("component", "rep").alias("component_id"))
    if shared_ids:
        least = by_class.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        by_class = by_class.join(least, "component_id").select("set_key", F.col("least").alias("component_id"))
    by_class = by_class.select("set_key", "component_id")
    out = feats.select("doc_id", "digest", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: the document with the least id of each group."""
    return drop_rows(docs, verdict(docs.sparkSession, lambda: classified(docs).filter("not kept").select("doc_id", "digest"), "near-copies"))
