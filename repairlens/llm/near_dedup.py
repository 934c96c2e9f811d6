"""MinHash near-duplicate detection by an inverted join on signature coordinates.

Texts with the same shingle set (by a 128-bit digest) form a class first. A class posts its
signature as tokens, one for each coordinate and value. A pair above the threshold agrees in
``least`` coordinates or more (``agreements`` finds it from the threshold: a pair at the
threshold agrees in fewer with a probability under 1e-6), so it shares one of the
``coords - least + 1`` rarest tokens of either side: only this prefix is posted, tokens that
nobody shares are skipped, and classes that share fewer than ``least`` tokens drop out.

In each posting list the member whose tokens are the most widely shared is the hub. For each
member and hub the colliding coordinates are counted over both whole signatures; pairs with
``least`` collisions or more are compared on full shingle sets, and links give components.
What this leaves open are pairs of a list whose members came into different components. These
members are joined exactly on their shingle sets: shingles are ordered by how many of them have
each, and a linked pair shares one among the rarest few per cent of both sets. So text that very
many pages have in common is never posted unless pages agree in nearly all else. Length, place
in the order and a byte of each signature coordinate thin the lists out before sets are
fetched and compared. A list of any length is dealt to pairs of blocks of bounded size. So no
list of pairs within a group is made, members that already hang together are never compared
with each other, and no link between different components is lost. Keys with many rows are
dealt to several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairlens.llm import shared
from repairlens.llm import textops as T
from repairlens.llm.components import components

_SEED = 7919

#: A pair at the threshold may agree in fewer coordinates than asked for with this probability at most.
MISSED = 5e-7


def agreements(percent: int, coords: int = 64) -> int:
    """The most coordinates that a pair at the threshold agrees in, but for a probability of MISSED."""
    share, below, least = percent / 100, 0.0, 0
    while least < coords:
        below += math.comb(coords, least) * share**least * (1 - share) ** (coords - least)
        if below > MISSED:
            break
        least += 1
    if not least:
        raise ValueError(f"{coords} coordinates are too few for pairs of {percent} %")
    return least


def _factors(coords: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _coordinates(hashes: np.ndarray, heads: np.ndarray, coords: int) -> np.ndarray:
    """The least permuted hash of each set for each coordinate; heads: where sets begin."""
    return np.stack([np.minimum.reduceat(hashes * f, heads) for f in _factors(coords)], axis=1)


def _sets(batches, size: int):
    """(rows, hashes of distinct shingles in ascending order per text, their second hashes, how many)."""
    for rows, data, offs in T.text_slices(batches, "text"):
        data = T.LOWER[data]
        starts, ends, firsts = T.word_spans(data, offs, T.NON_SPACE)
        grams = T.Grams(T.word_hashes(data, starts, ends, 2))
        words = np.diff(firsts)
        k = np.minimum(words, size)
        n = np.where(words > 0, words - k + 1, 0)
        at, text = T.ragged(firsts[:-1], n), np.repeat(np.arange(len(words)), n)
        to = at + np.repeat(k, n)
        hashes = grams.spans(at, to)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield rows, hashes[new], grams.spans(at, to, 1)[order[new]], np.bincount(text[new], minlength=len(words))


def signatures(docs: DataFrame, size: int = 5, coords: int = 64) -> DataFrame:
    """keyed() rows -> (doc_id, id, row, n, s1, s2, sig): size of the shingle set, its 128-bit digest, and a token for each coordinate and value."""

    def run(batches):
        for rows, hashes, other, n in _sets(batches, size):
            some = n > 0
            heads = (np.cumsum(n) - n)[some]
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig = np.zeros((len(heads), coords), np.uint64)
            if len(heads):
                s1[some], s2[some] = np.add.reduceat(T.mix(hashes, 21), heads), np.add.reduceat(T.mix(other, 22), heads)
                sig = _coordinates(hashes, heads, coords)
                sig = T.mix(sig + (np.arange(coords, dtype=np.uint64) * _factors(coords)[0])[None, :])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), rows.column(3), pa.array(n, pa.int64()), pa.array(T.signed(s1)), pa.array(T.signed(s2)), T.list_column(T.signed(sig.ravel()), np.where(some, coords, 0))],
                ["doc_id", "id", "row", "n", "s1", "s2", "sig"],
            )

    return docs.select("doc_id", "text", "id", "row").mapInArrow(run, "doc_id long, id long, row long, n long, s1 long, s2 long, sig array<long>")


def classes_of(sigs: DataFrame) -> DataFrame:
    """(rep, s1, s2, n, copies, low, id, row, sig): one row a class of equal shingle sets, with a number, its least doc_id and the key of a row that holds it."""
    named = sigs.where("n > 0 AND doc_id IS NOT NULL")
    grouped = named.groupBy("s1", "s2", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "id", "row")).alias("top"), F.first("sig").alias("sig"))
    return shared.written(grouped.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", "copies", F.col("top.doc_id").alias("low"), "top.id", "top.row", "sig"), "classes")


def posting_lists(classes: DataFrame, coords: int, least: int) -> DataFrame:
    """(token, rep, score): the rarest shared tokens of each class, as many as the pigeonhole needs."""
    posts = classes.select("rep", F.explode("sig").alias("token"))
    tokens = shared.written(posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    ranked = shared.spread_join(posts, tokens, ["token"], shared.frequent_keys(tokens, ["token"], "df"), ["rep"])
    ranked = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"), F.sum(F.log2("df")).alias("score"))
    need = F.lit(coords - least + 1 - coords) + F.size("t")
    return ranked.withColumn("need", need).where("need > 0").select("rep", F.round("score", 6).alias("score"), F.explode(F.expr("slice(t, 1, need)")).alias("p")).select("p.token", "rep", "score")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(x, h): each member of a written table of lists with the list's hub, once."""
    hubs = lists.groupBy("token").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("top"), F.count("*").alias("members")).where("members > 1").select("token", (-F.col("top.minus")).alias("h"), "members")
    hubs = shared.written(hubs, "hubs")
    return shared.spread_join(lists, hubs.drop("members"), ["token"], shared.frequent_keys(hubs, ["token"], "members"), ["rep"]).where("rep <> h").select(F.col("rep").alias("x"), "h").distinct()


def beside(pairs: DataFrame, of: DataFrame, frequent: DataFrame | None) -> DataFrame:
    """pairs (x, h) with the value of both, from (rep, value): as mine and theirs."""
    mine = pairs.join(of.toDF("x", "mine").hint("merge"), "x")
    return shared.spread_join(mine, of.toDF("h", "theirs"), ["h"], frequent, ["x"]).select("x", "h", "mine", "theirs")


def matches(pairs: DataFrame, classes: DataFrame, least: int, frequent: DataFrame | None) -> DataFrame:
    """Those of pairs (x, h) whose signatures collide in ``least`` coordinates or more."""
    collisions = F.size(F.filter(F.zip_with("mine", "theirs", lambda a, b: a == b), lambda same: same))
    return beside(pairs, classes.select("rep", "sig"), frequent).where(collisions >= least).select("x", "h")


def _linked(percent: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets are linked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compared(percent: int, batches):
    """The linked ones of pairs, from their sets (columns 2 and 3)."""
    for batch in batches:
        yield batch.select([0, 1]).filter(pa.array([_linked(percent, *(np.asarray(batch.column(c)[i].values) for c in ("mine", "theirs"))) for i in range(len(batch))], pa.bool_()))


def open_members(pairs: DataFrame, labels: DataFrame, sizes: DataFrame, frequent: DataFrame | None) -> DataFrame | None:
    """(rep, n, component) of the members of hub groups that lie in several components. None if there is no such group."""
    known = sizes.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("component"))
    every = pairs.select("x", "h").unionByName(pairs.select(F.col("h").alias("x"), "h").distinct())
    sided = shared.written(every.join(known.toDF("x", "n", "component").hint("merge"), "x"), "sided")
    groups = shared.written(sided.groupBy("h").agg(F.expr("min(component) <> max(component)").alias("open")).where("open").select("h"), "open")
    if shared.fits(groups, 0):
        return None
    return shared.written(shared.spread_join(sided, groups, ["h"], frequent, ["x"]).select(F.col("x").alias("rep"), "n", "component").distinct(), "open-members")


def _reach(percent: int, n: Column) -> tuple[Column, Column]:
    """How many of its rarest shingles a set of n must post to be found by larger ones, and must look up to find smaller ones."""
    ceil = lambda up, down: F.expr(f"({up} + {down} - 1) DIV {down}")
    return n - ceil(f"{2 * percent} * n", str(100 + percent)) + 1, n - ceil(f"{percent} * n", "100") + 1


def prefix_posts(members: DataFrame, of: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """(token, members, rep, n, component, at, index, sketch): the rarest shared shingles of each open member under which members of different components stand.

    Two linked sets share a shingle among the first ones of each in the order of rarity: as many
    as _reach() says for the smaller set (index) and the larger one. ``at`` is the place in that
    order; shingles that no other member has come first and aren't posted. sketch has a byte of
    each signature coordinate.
    """
    tokens = members.select("rep").join(of.hint("merge"), "rep").select("rep", F.explode("set").alias("token"))
    held = shared.written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    ranked = shared.spread_join(tokens, held, ["token"], shared.frequent_keys(held, ["token"], "df"), ["rep"])
    ranked = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).join(members.hint("merge"), "rep")
    index, probe = _reach(percent, F.col("n"))
    alone = F.col("n") - F.size("t")
    posted = ranked.withColumn("few", F.greatest(F.least(probe - alone, F.size("t")), F.lit(0)).cast("int")).where("few > 0")
    posted = posted.select("rep", "n", "component", alone.alias("alone"), index.alias("reach"), F.posexplode(F.slice("t", 1, F.col("few"))).alias("k", "t"))
    posted = posted.select(F.col("t.token").alias("token"), "rep", "n", "component", (F.col("alone") + F.col("k")).alias("at"), F.expr("alone + k < reach").alias("index"))
    posted = shared.written(posted, "posted")
    groups = posted.groupBy("token").agg(F.count("*").alias("members"), F.expr("min(component) <> max(component)").alias("open"), F.max("index").alias("found")).where("open AND found").drop("open", "found")
    groups = shared.written(groups, "groups")
    if shared.fits(groups, 0):
        return None
    kept = shared.spread_join(posted, groups, ["token"], shared.frequent_keys(groups, ["token"], "members"), ["rep"])
    sketch = F.transform("sig", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte"))
    return kept.join(classes.select("rep", sketch.alias("sketch")).hint("merge"), "rep")


def _pairs_of(percent: int, least: int, rows: list) -> list[tuple[int, int]]:
    """Pairs of one posting list, or of two blocks of it, that length, place and sketch leave possible."""
    rep, n, component, at, index, own, i, j, sketch = (np.concatenate(c) for c in zip(*rows))
    first = np.flatnonzero(own == i[0])
    second = first if i[0] == j[0] else np.flatnonzero(own == j[0])
    out = []
    for a in first:
        others = second[second > a] if i[0] == j[0] else second
        others = others[component[others] != component[a]]
        smaller = (n[others] < n[a]) | ((n[others] == n[a]) & (rep[others] < rep[a]))
        low, high = np.minimum(n[others], n[a]), np.maximum(n[others], n[a])
        left = np.minimum(n[others] - at[others], n[a] - at[a])
        ok = np.where(smaller, index[others], index[a]) & (100 * low >= percent * high) & ((100 + percent) * left >= percent * (low + high))
        others = others[ok]
        if len(others):
            others = others[(sketch[others] == sketch[a]).sum(axis=1) >= least]
            out += [(min(int(rep[a]), int(rep[b])), max(int(rep[a]), int(rep[b]))) for b in others]
    return out


def _candidates(percent: int, least: int, batches):
    """The pairs of each list; rows of a list or pair of blocks stand together and are worked on when the last has come."""
    key, rows = None, []

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["x", "h"])

    for batch in batches:
        if not len(batch):
            continue
        token, i, j = (batch.column(c).to_numpy() for c in ("token", "i", "j"))
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "component", "at", "index", "own", "i", "j")]
        sketch = batch.column("sketch")
        cols.append(sketch.flatten().to_numpy().reshape(len(batch), -1))
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(batch))):
            now = (token[lo], i[lo], j[lo])
            if now != key and rows:
                yield out(_pairs_of(percent, least, rows))
                rows = []
            key = now
            rows.append([c[lo:hi] for c in cols])
    if rows:
        yield out(_pairs_of(percent, least, rows))


def open_links(posts: DataFrame, of: DataFrame, percent: int, least: int, block: int) -> DataFrame:
    """(a, b): linked pairs of different components among prefix_posts(). Long lists are dealt to pairs of blocks, each in one task; sets are fetched for the pairs that are left."""
    spark = posts.sparkSession
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = posts.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = shared.written(dealt.select("token", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "rep", "n", "component", "at", "index", "sketch"), "dealt")
    parts = shared.partitions(spark, dealt.count(), 20_000)
    found = dealt.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lambda b: _candidates(percent, least, b), "x long, h long")
    pairs = shared.written(found.distinct(), "candidates")
    many = not shared.fits(pairs, shared.KEY_ROWS)  # else no key can have more
    often = {side: shared.frequent_keys(pairs.groupBy(side).agg(F.count("*").alias("pairs")), [side], "pairs") if many else None for side in ("x", "h")}
    both = shared.spread_join(pairs, of.toDF("x", "mine"), ["x"], often["x"], ["h"])
    both = shared.spread_join(both, of.toDF("h", "theirs"), ["h"], often["h"], ["x"]).select("x", "h", "mine", "theirs")
    return shared.written(both.mapInArrow(lambda b: _compared(percent, b), "x long, h long").toDF("a", "b"), "links")


def links(docs: DataFrame, classes: DataFrame, size: int = 5, coords: int = 64, percent: int = 80, block: int = 2_048) -> DataFrame:
    """(node, component) of the classes that are linked with others; docs are keyed()."""
    least = agreements(percent, coords)
    pairs = shared.written(hub_pairs(shared.written(posting_lists(classes, coords, least), "lists")), "pairs")
    members = pairs.select(F.explode(F.array("x", "h")).alias("rep")).distinct()
    wanted = shared.written(classes.select("rep", "id", "row", "n").join(members.hint("merge"), "rep"), "wanted")
    frequent = shared.frequent_keys(pairs.groupBy("h").agg(F.count("*").alias("pairs")), ["h"], "pairs")

    def sets(batches):
        for rows, hashes, _, n in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), T.list_column(T.signed(np.concatenate([np.sort(T.signed(p)) for p in np.split(hashes, np.cumsum(n)[:-1])]) if len(hashes) else hashes), n)], ["id", "row", "set"])

    held = shared.sized_join(docs, wanted.select("id", "row"), ["id", "row"], "left_semi", 500_000).dropDuplicates(["id", "row"]).select("doc_id", "text", "id", "row")
    of = shared.written(held.mapInArrow(sets, "id long, row long, set array<long>").join(wanted.select("rep", "id", "row").hint("merge"), ["id", "row"]).select("rep", "set"), "sets")
    stars = beside(shared.written(matches(pairs, classes, least, frequent), "matches"), of, frequent)
    labels = shared.written(components(shared.written(stars.mapInArrow(lambda b: _compared(percent, b), "x long, h long").toDF("a", "b"), "links")), "labels")
    members = open_members(pairs, labels, wanted.select("rep", "n"), frequent)
    if members is None:
        return labels
    posts = prefix_posts(members, of, classes, percent)
    rest = None if posts is None else open_links(posts, of, percent, least, block)
    return labels if rest is None or shared.fits(rest, 0) else components(rest.unionByName(labels.toDF("a", "b")))


def judged(docs: DataFrame, size: int = 5, coords: int = 64, percent: int = 80) -> DataFrame:
    """near_duplicates() of keyed() docs, with their id and row."""
    sigs = shared.written(signatures(docs, size, coords), "signatures")
    classes = classes_of(sigs)
    groups = shared.written(links(docs, classes, size, coords, percent).join(classes.select(F.col("rep").alias("node"), "low").hint("merge"), "node"), "groups")
    lows = shared.written(groups.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("nodes")), "lows")
    named = shared.spread_join(groups.select("node", "component"), lows.drop("nodes"), ["component"], shared.frequent_keys(lows, ["component"], "nodes"), ["node"]).select(F.col("node").alias("rep"), "least")
    reps = shared.written(classes.select("s1", "s2", "n", "copies", "rep", "low").join(named.hint("merge"), "rep", "left").select("s1", "s2", "n", "copies", F.coalesce("least", "low").alias("component")), "reps")
    some = sigs.select("doc_id", "id", "row", "n", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("s1")).alias("s1"), "s2")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return (
        shared.spread_join(some, reps.drop("copies"), ["s1", "s2", "n"], shared.frequent_keys(reps, ["s1", "s2", "n"], "copies"), ["id", "row"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "id", "row")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_duplicates(docs: DataFrame, size: int = 5, coords: int = 64, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id and kept (it is the least id of its component).

    Texts without words (null, empty or white space) are linked with nothing. Rows with a null id
    stay and have no component. Rows are judged each by its own text: rows that repeat an id with
    other texts have the component of their text, equal rows the same result. Other columns of
    docs are ignored. An empty table gives no rows.
    """
    return judged(shared.keyed(docs), size, coords, percent).select("doc_id", "n_shingles", "component_id", "kept")
