"""N-gram Jaccard self-join: rare-first prefix filtering, then one verification for each pair.

Each text becomes the set of its word n-grams, as 64-bit hashes; texts of equal sets are one node. Steps:

1. Survivors. Two linked sets of sizes n and m have k hashes in common among the first n - least + k (and m - least + k)
   in any one order. Each text ships that prefix in order of hash, and each hash counts as shared if two nodes ship it;
   a node with fewer shared ones than any partner would need links with nothing and is done with.
2. Rare first. The survivors' hashes are counted exactly and each set is put in order of count; hashes that no other
   survivor holds come first and make no pair, so of a prefix only the shared hashes are posted. Two nodes can link only if
   they meet in a posting; at the first hash that they have in common the shared hashes from there on bound the overlap (positional filter, with the length filter).
3. Hubs. Links are wanted for components, so groups are not expanded into pairs: each node meets one pivot, the one of
   least share of own hashes among the pivots of its postings, for ROUNDS rounds; then all pairs that are still in
   different components meet, after postings that no other component can match are dropped by two minima.
   Pairs pass the suffix filter (the parities of hash counts in classes: each hash that only one set has changes one, so
   differing parities bound the overlap from above) and then have their whole sets compared, each pair once.

Hashes stand for n-grams: m different n-grams in one text, or in two that are compared, are miscounted with a chance below
m ** 2 / 2 ** 65; with 5e10 texts of 330 words that makes about one wrong text in ten thousand such corpora.

Defined results: a null or blank text has no n-grams, links with nothing and is its own component; a text of
fewer words than n is one n-gram; repeated rows share a component and are returned as often as given; rows
with a null identifier take part, and the component's identifier is the least that is not null; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buckets
from .runtime import bit_filter, discard, filter_hits, materialize, tidied

#: 64-bit words of a node's bit set.
LANES = 16
#: Rounds with one pivot for each node, before all remaining pairs.
ROUNDS = 2
#: A shipped prefix has one hash more for each so many hashes of its set.
SPARE = 8
#: Nodes that a task remembers, so that copies are shipped once.
SEEN = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]), dtype=np.uint64)
    return _powers, _inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams (A-Z folded, words split at ASCII white space)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    apart = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    edge = np.flatnonzero(apart[1:] != apart[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    powers, inverse = _tables(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)])
    words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    size = min(n, len(words))
    out, odd = np.full(len(words) - size + 1, size, np.uint64), 1
    for k in range(size):  # words are mixed already; each place has an odd factor of its own
        odd = odd * 0xD6E8FEB86659FD93 % (1 << 64)
        out += words[k : len(words) - size + 1 + k] * np.uint64(odd)
    return np.unique(_mix(out))


def _lanes(tokens: np.ndarray) -> np.ndarray:
    """The parities of the counts of hashes in 64 * LANES classes."""
    slot = ((tokens >> np.uint64(40)) % np.uint64(64 * LANES)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=64 * LANES) & 1).astype(np.uint8)).view(np.int64)


def _node(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _ref(node: bytes) -> int:
    """64 bits of a node's name, never 0."""
    return int.from_bytes(node[:8], "little", signed=True) or 1


def _prefix(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first hashes of a set, in order of hash; how many of them any partner has among its own first ones.

    Two linked sets have `least` common hashes, so prefixes of n - least + k have k. A partner is no smaller
    than `least`, and its k no less than that of a set of this size.
    """
    least = -(-percent * len(tokens) // 100)
    return tokens[: len(tokens) - least + 1 + len(tokens) // SPARE], 1 + least // SPARE


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield part, part.column(1).to_pylist()


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """For each row doc_id, n, node, ref and the bit set."""
    lanes = [f"b{k}" for k in range(LANES)]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, node binary, ref long, {', '.join(f'{b} long' for b in lanes)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            sets = [shingles(t, n) for t in texts]
            nodes = [_node(s) for s in sets]
            bits = np.array([_lanes(s) for s in sets]).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(nodes, pa.binary()), pa.array(map(_ref, nodes), pa.int64()), *[pa.array(bits[:, k]) for k in range(LANES)]], ["doc_id", "n", "node", "ref", *lanes]
            )

    return docs.mapInArrow(tidied(run), schema)


def _survivors(docs: DataFrame, nodes: DataFrame, total: int, n: int, percent: int) -> DataFrame:
    """The nodes with enough shared hashes in their shipped prefixes."""
    parts = buckets.count(total)

    def ship_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, refs, size = set(), [], [], 0
        for _, texts in _texts(batches):
            for t in texts:
                if len(s := shingles(t, n)) and (ref := _ref(_node(s))) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ref)
                    refs.append(ref)
                    tokens.append(_prefix(s, percent)[0])
                    size += len(tokens[-1])
            if size >= buckets.CHUNK:
                yield buckets.batch(buckets.shipped(tokens, refs, parts, 2))
                tokens, refs, size = [], [], 0
        if refs:
            yield buckets.batch(buckets.shipped(tokens, refs, parts, 2))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        refs, _ = buckets.shared(zip(rows["known"], rows["keys"], rows["refs"], rows["times"]), int(rows["bucket"].iloc[0]), 2)
        ref, k = np.unique(refs, return_counts=True)
        return pd.DataFrame({"ref": ref, "k": k})

    shipped = docs.mapInArrow(tidied(ship_out), buckets.SCHEMA)
    told = shipped.groupBy("bucket").applyInPandas(count, "ref long, k long").groupBy("ref").agg(F.sum("k").alias("k"))
    least = F.expr(f"1 + ceil({percent} * n / 100) div {SPARE}")
    return nodes.join(told, "ref").where(F.col("k") >= least).select("node", "ref", "owner", "n")


def _sets(docs: DataFrame, survivors: DataFrame, n: int) -> DataFrame:
    """The survivors' whole sets: node, ref, n, tokens."""
    texts = filter_hits(docs, bit_filter(survivors, "owner"), [F.col("doc_id")], "hit").where("hit").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            found = [s for t in texts if len(s := shingles(t, n))]
            if found:
                nodes = [_node(s) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "tokens"])

    found = texts.mapInArrow(tidied(run), "node binary, tokens array<long>").join(survivors.select("node", "ref", "n"), "node")
    return found.dropDuplicates(["node"]).select("node", "ref", "n", "tokens")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """The shared hashes of rarest-first prefixes: token, ref, n, rest (shared hashes of the set from there on), own (share of the others)."""
    rows = sets.select("ref", F.explode("tokens").alias("token"))
    counts = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "join-counts")
    held = rows.join(counts, "token").groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    held = held.join(sets.select("ref", "n"), "ref").withColumn("spare", F.expr(f"cast(size(held) - ceil({percent} * n / 100) as int)")).where("spare >= 0")
    own = F.expr("cast((n - size(held)) * 1000000L div n as int)")
    out = held.select("ref", "n", F.size("held").alias("size"), own.alias("own"), F.posexplode(F.slice("held", F.lit(1), F.col("spare") + 1)).alias("at", "c"))
    out = materialize(out.select(F.col("c.token").alias("token"), "ref", "n", (F.col("size") - F.col("at")).alias("rest"), "own"), "join-postings")
    discard(counts)
    return out


def _fits(na: str, ra: str, nb: str, rb: str, percent: int) -> Column:
    """The length filter and the positional filter, for the first common hash at these places of two prefixes."""
    return F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * least({ra}, {rb}) >= {percent} * ({na} + {nb})")


def _suffix_fits(a: str, b: str, percent: int) -> Column:
    """The suffix filter: at most (na + nb - differing bits) / 2 hashes are common."""
    differ = " + ".join(f"bit_count({a}.b{k} ^ {b}.b{k})" for k in range(LANES))
    return F.expr(f"{100 + percent} * ({a}.n + {b}.n - ({differ})) >= 2 * {percent} * ({a}.n + {b}.n)")


def _open(told: DataFrame) -> DataFrame:
    """The postings of hashes that nodes of different components have."""
    mixed = told.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).where("low <> top").select("token")
    return told.join(materialize(mixed, "join-mixed"), "token", "left_semi")  # written first, so that Spark may split a hot hash


def _matchable(held: DataFrame, percent: int) -> DataFrame:
    """The postings that some posting of another component of their hash may match, by its least n and its largest rest."""
    each = materialize(held.groupBy("token", "comp").agg(F.min("n").alias("n"), F.max("rest").alias("rest")), "join-each")
    best = materialize(each.groupBy("token").agg(F.min(F.struct("n", "comp")).alias("lo"), F.max(F.struct("rest", "comp")).alias("hi")), "join-best")
    # written, joined and written again, so that Spark may split a hot hash of the join and combines it before the next shuffle
    next_ = each.join(best, "token").select("token", "lo", "hi", F.expr("if(comp <> lo.comp, n, null)").alias("lo2"), F.expr("if(comp <> hi.comp, rest, null)").alias("hi2"))
    next_ = materialize(next_, "join-next")
    discard(each, best)
    both = materialize(next_.groupBy("token").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2")), "join-extremes")
    discard(next_)
    near = held.join(both, "token").withColumn("least_n", F.expr("if(comp = lo.comp, lo2, lo.n)")).withColumn("most", F.expr("if(comp = hi.comp, hi2, hi.rest)"))
    return near.where(F.expr(f"{100 + percent} * least(rest, most) >= {percent} * (n + least_n)")).select(*held.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, tokens: sets.select(F.col("node").alias(name), F.col("tokens").alias(tokens))
    full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return materialize(full.mapInArrow(tidied(similar), "a binary, b binary"), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Alternates the large-star and small-star steps until the edges are stars; each step is a minimum by
    key, combined before it is shuffled, and a join that splits hot keys.
    """
    edges, last = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "join-edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == last or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "join-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        old, edges = edges, materialize(small, "join-edges")
        discard(old, large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least identifier reachable by links).

    Two texts link when at least `percent` of a hundred of the hashes that either has are common.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_profile(docs, n), "join-profile")
    lanes = [f"b{k}" for k in range(LANES)]
    nodes = materialize(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("owner"), *[F.first(c).alias(c) for c in ("n", "ref", *lanes)]), "join-nodes")
    total = nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0

    survivors = materialize(_survivors(docs, nodes, total, n, percent), "join-survivors")
    sets = materialize(_sets(docs, survivors, n), "join-sets")
    postings = _postings(sets, percent)
    facts = materialize(nodes.join(survivors.select("node"), "node", "left_semi").select("node", "ref", F.struct("n", *lanes).alias("s")), "join-facts")
    discard(nodes, survivors)

    links, roots, tried = None, None, None
    for round_ in range(ROUNDS + 1):
        names = facts.select("ref", "node")
        if roots is not None:
            names = names.join(roots, "node", "left").select("ref", F.coalesce("root", "node").alias("node"))
        told = materialize(postings.join(names.select("ref", F.xxhash64("node").alias("comp")), "ref"), "join-told")
        # components only grow, so a hash whose nodes are all in one has no part in later rounds either
        held = materialize(_open(told), "join-held")
        discard(told, postings)
        postings = held.drop("comp")
        postings._quillspark_folder = held._quillspark_folder
        if round_ < ROUNDS:
            rank = F.col("own") if round_ == 0 else F.lit(0)
            pivots = held.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), F.xxhash64("ref", F.lit(round_)).alias("h"), "ref", "comp", "n", "rest")).alias("p"))
            pivots = materialize(pivots, "join-pivots")  # so that Spark may split a hot hash of the join
            met = held.join(pivots, "token").where("comp <> p.comp").where(_fits("n", "rest", "p.n", "p.rest", percent))
            met = met.groupBy("ref").agg(F.min("p").alias("p")).select("ref", F.col("p.ref").alias("other"))
        else:
            left = materialize(_matchable(held, percent), "join-left")
            x, y = left.alias("x"), left.alias("y")
            rule = (F.col("x.token") == F.col("y.token")) & F.expr("x.comp < y.comp") & _fits("x.n", "x.rest", "y.n", "y.rest", percent)
            met = x.join(y, rule).select(F.col("x.ref").alias("ref"), F.col("y.ref").alias("other"))
        # each pair once, before its bit sets are compared
        pairs = met.select(F.least("ref", "other").alias("i"), F.greatest("ref", "other").alias("j")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["i", "j"], "left_anti")
        pairs = materialize(pairs, "join-met")
        sided = lambda name, key: facts.select(F.col("ref").alias(key), F.col("node").alias(name), F.col("s").alias(f"s{name}"))
        likely = pairs.join(sided("a", "i"), "i").join(sided("b", "j"), "j").where(_suffix_fits("sa", "sb", percent)).select("a", "b")
        found = _verified(likely, sets, percent)
        links = found if links is None else materialize(links.union(found), "join-all-links")
        tried = pairs if tried is None else tried.union(pairs)
        roots = components(links)

    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node")
    rows = rows.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    rows = materialize(rows, "join-rows")
    discard(sets, facts, postings)
    least = materialize(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("component_id")), "join-least")
    linked = rows.where("n_shingles > 0").join(least, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
