"""Jaccard self-join on word n-grams by partitioning the universe.

Sets are compared in size bands. A band fixes a number of segments; a token's
hash names its segment. Two sets with Jaccard of at least ``num / den``, the
smaller of them in the band, differ in at most H tokens. A segment with
allocation 1 is indexed by its digest, one with allocation 2 also by the digests
of its one-deletion neighbours; when the allocations sum to H + 1, equal or
one-deletion-apart segments must exist in some place (pigeonhole). Allocations
are chosen per band by a cost model fed with the number of sets in the band and
the overlap of unrelated sets, both counted over all documents.

``spare`` extra segments of allocation 1 allow a set to leave out up to ``spare``
empty ones (allocation 0), which would match those of unrelated sets: a similar
pair agrees in segments worth ``spare + 1``, so in more than the empty ones.
Further ``extra`` segments raise that to ``spare + extra + 1``, so similar sets
have at least ``need`` (about ``extra + 1``) signatures in common. A set with fewer
that any other set has can link with none, and each set leaves out its ``need - 1``
most frequent signatures: of those that a similar pair has in common the rarest
stays on both sides. So what a third of all documents share makes no groups.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BLANKS_LOWER, Repeated, components, mix64, ngram_hashes, slices, small, stage, text_words

#: Ratio of the largest to the least size in a band.
BAND = 1.3
#: Share of one set's tokens in an unrelated set, where it is not measured; only costs depend on it.
OVERLAP = 0.001
#: Cost of comparing a set with one that shares a signature, in signatures.
COMPARE = 20
#: One extra segment for so many tokens in which similar sets can differ.
EXTRA = 8
#: Groups of at most so many sets with one signature have all their pairs compared.
WHOLE = 4
#: Pairs of a hub in one place.
HUB = 100
#: Bits of the parities that bound how many tokens two sets differ in.
PARITY = 512
PARITIES = [f"p{i}" for i in range(PARITY // 64)]
#: Tokens in fewer sets are rare alike; so many others are told apart at most; sets with a token in one place.
FEW, OFTEN, SHARED = 16, 500_000, 1_000
#: One token in so many is counted to measure the overlap of unrelated sets.
PROBE = 256


def shingles(texts, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct hashes of each text's word n-grams, in two lanes (the second in the first's order).

    Fewer words than ``n`` make one shingle; none make the empty set.
    """
    out = []
    for one, two in text_words(texts, BLANKS_LOWER, 2):
        k = min(n, len(one)) or 1
        first, at = np.unique(ngram_hashes(one, k), return_index=True)
        out.append((first, ngram_hashes(two, k, 1)[at]))
    return out


def token_sets(texts, n: int) -> list[np.ndarray]:
    """The first lane of ``shingles``."""
    return [np.unique(ngram_hashes(x, min(n, len(x)) or 1)) for (x,) in text_words(texts, BLANKS_LOWER)]


# --------------------------------------------------------------------------
# Bands and allocation


@cache
def band_of(size: int) -> tuple[int, int]:
    """The least and largest size of the band that holds ``size`` (at least 1)."""
    lo = 1
    while True:
        hi = max(lo, int(lo * BAND))
        if size <= hi:
            return lo, hi
        lo = hi + 1


def allocation(lo: int, hi: int, sets: float, num: int, den: int, overlap: float = OVERLAP) -> tuple[int, int, int, int]:
    """(segments with allocation 2, segments with allocation 1, spare ones, extra ones) of a band.

    The cost of a choice is the signatures of a set, and a comparison for each of
    them that some unrelated set shares, taking token counts of segments as Poisson.
    """
    most = hi * (den - num) // num  # tokens in which two such sets can differ
    best = None
    for two in sorted({0, (most + 1) // 4, (most + 1) // 2}):
        extra = most // EXTRA
        one = most + 1 - 2 * two + extra
        spare = 0
        for _ in range(20):
            mean = (one + spare) * math.exp(-lo / (two + one + spare))
            need = math.ceil(mean + 3 * math.sqrt(mean)) if mean > 0.01 else 0
            if need <= spare:
                break
            spare = need
        m = two + one + spare
        s = lo / m
        same = math.exp(-2 * s * (1 - overlap)) - math.exp(-2 * s) * (spare > 0)
        shared = (one + spare) * -math.expm1(-sets * same) + two * (1 + s) * -math.expm1(-sets * same * (1 + s))
        cost = one + spare + two * (1 + s) + COMPARE * shared
        if best is None or cost < best[0]:
            best = cost, two, one - extra, spare, extra
    return best[1:]


def _place_hash(lo: int, segment: np.ndarray) -> np.ndarray:
    return mix64(segment.astype(np.uint64) + np.uint64(lo << 24))


def signatures(tokens: np.ndarray, plan: dict[int, tuple[int, int, int, int]], num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """Signatures of a set in its own band and in the band below, if a similar smaller set can lie there.

    Each as (band, signatures that a linked set has in common with it, distinct signatures).
    """
    out = []
    size = len(tokens)
    lo, hi = band_of(size)
    mixed = mix64(tokens)
    while hi * den >= num * size:  # a set of this band can be similar
        two, one, spare, extra = plan[lo]
        m = two + one + spare + extra
        segment = ((mixed >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        count = np.bincount(segment, minlength=m)
        place = _place_hash(lo, np.arange(m))
        body = mix64(mixed)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, body)
        whole = mix64(total + place)
        bare = (count == 0) & (np.arange(m) >= two)
        found = [whole[~bare] if bare.sum() <= spare else whole]
        if two:  # the first segments also by their one-deletion neighbours
            near = segment < two
            found.append(mix64(total[segment[near]] - body[near] + place[segment[near]]))
        need = (extra + 2) // 2 if two else extra + 1
        out.append((lo, need, np.concatenate(found)))
        if lo == 1:
            break
        lo, hi = band_of(lo - 1)
    return out


# --------------------------------------------------------------------------
# The join


def membership(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, tag, n, rep, probe``: set size, least id among documents with an equal set (null without words), some tokens."""

    def run(batches):
        for batch in slices(batches):
            sets = shingles(batch.column("text"), n)
            sizes = pa.array([len(x) for x, _ in sets], pa.int64())
            digests = [pa.array([int(np.add.reduce(s[lane]).view(np.int64)) if len(s[0]) else 0 for s in sets], pa.int64()) for lane in (0, 1)]
            probe = pa.array([x[x % np.uint64(PROBE) == 0].view(np.int64) for x, _ in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), sizes, *digests, probe], ["doc_id", "tag", "n", "a", "b", "probe"])

    sets = stage(docs.mapInArrow(run, "doc_id long, tag long, n long, a long, b long, probe array<long>"), "sets")
    reps = sets.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    with_rep = sets.join(small(stage(reps, "reps")), ["n", "a", "b"], "left")
    return stage(with_rep.select("doc_id", "tag", "n", F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc_id"))).alias("rep"), "probe"), "membership")


def _plan(members: DataFrame, num: int, den: int) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """The allocation of every band, and about how many signatures it makes."""
    sets = members.filter("n > 0 and doc_id = rep")
    bands = sets.groupBy(F.floor(F.log("n") / math.log(BAND)).alias("g")).agg(F.count("*").alias("sets"), F.max("n").alias("most"), F.sum("n").alias("tokens")).collect()
    count, tokens = sum(r.sets for r in bands), sum(r.tokens for r in bands)
    pairs = sets.select(F.explode("probe").alias("token")).groupBy("token").count().agg(F.sum(F.expr("double(count) * (count - 1)"))).first()[0]
    overlap = PROBE * (pairs or 0.0) / max(count - 1, 1) / max(tokens, 1)
    weight = {r.g: float(r.sets) for r in bands}  # one row for each power of BAND
    plan, keys = {}, 0.0
    for lo, hi in _bands(max((r.most for r in bands), default=0)):
        here = weight.get(int(math.log(lo) / math.log(BAND)), 1.0)
        plan[lo] = two, one, spare, extra = allocation(lo, hi, here, num, den, min(overlap, 0.5))
        keys += 2 * here * (one + spare + extra + two * (1 + hi / (two + one + spare + extra)))
    return plan, int(keys)


def _set_keys(text, n: int, plan, num: int, den: int):
    """The signatures of each text, as ``signatures`` gives them."""
    return [signatures(x, plan.value, num, den) if len(x) else [] for x in token_sets(text, n)]


def _signature_rows(docs: DataFrame, n: int, plan, num: int, den: int, probe) -> DataFrame:
    """``key, rep, band, need`` of the signatures that other sets may have, for sets with enough of them."""

    def run(batches):
        for batch in slices(batches):
            counts, keys, bands, needs = [], [], [], []
            for found in _set_keys(batch.column("text"), n, plan, num, den):
                counts.append(0)
                for lo, need, x in found:
                    x = x[probe(x)]
                    if len(x) >= need:
                        counts[-1] += len(x)
                        keys.append(x)
                        bands.append(np.full(len(x), lo))
                        needs.append(np.full(len(x), need))
            if keys:
                rep = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), rep, pa.array(np.concatenate(bands)), pa.array(np.concatenate(needs))], ["key", "rep", "band", "need"])

    return docs.mapInArrow(run, "key long, rep long, band long, need long")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, size, p0.., tokens``: the sets of the documents in ``ids``, sorted 64-bit hashes; an id may have several.

    ``p0..`` are ``PARITY`` bits: how many tokens hash to each, odd or even. Sets
    differ in at least as many tokens as bits.
    """

    def run(batches):
        for batch in slices(batches):
            sets = token_sets(batch.column("text"), n)
            full = [i for i, x in enumerate(sets) if len(x)]  # a repeated id may have texts without words
            sets = [sets[i] for i in full]
            odd = np.zeros((len(sets), PARITY), np.uint8)
            for row, x in zip(odd, sets, strict=True):
                row[:] = np.bincount((mix64(x) >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
            bits = np.packbits(odd, axis=1).view(np.int64)
            size = pa.array([len(x) for x in sets], pa.int64())
            tokens = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full, pa.int64())), size, *(pa.array(np.ascontiguousarray(c)) for c in bits.T), tokens], ["id", "size", *PARITIES, "tokens"])

    picked = docs.join(small(stage(ids.select(F.col("id").alias("doc_id")).distinct(), "ids")), "doc_id", "left_semi")
    return stage(picked.select("doc_id", "text").mapInArrow(run, f"id long, size long, {', '.join(f'{c} long' for c in PARITIES)}, tokens binary"), "tokens")


def _side(sizes: DataFrame, side: str) -> DataFrame:
    return sizes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", *PARITIES)))


def _room(a: str, b: str, num: int, den: int) -> Column:
    """Sizes and parities of two sides allow a link: sets that link differ in ``(1 - t) / (1 + t)`` of their sizes at most."""
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    bits = sum((F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in PARITIES[1:]), F.bit_count(F.col(f"{a}_p0").bitwiseXOR(F.col(f"{b}_p0"))))
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (bits * (den + num) <= (x + y) * (den - num))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard of ``num / den``, by their exact intersection.

    The id with more pairs is the pair's hub. The other's tokens travel to the
    hub's, which stand in several places when it has many pairs, and are read
    after them; so no row holds two sets and a hub's pairs are many tasks.
    """
    sizes = small(stage(sets.drop("tokens"), "sizes"))
    for c in ("a", "b"):
        pairs = pairs.join(_side(sizes, c), c)
    pairs = stage(pairs.filter(_room("a", "b", num, den)).select("a", "b").distinct(), "sized")
    degree = small(stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count(), "degree"))
    for c in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("id").alias(c), F.col("count").alias(f"n{c}")), c)
    first = F.col("na") >= F.col("nb")
    pairs = stage(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id")), "hubs")
    parts = small(stage(pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {HUB}) as int)").alias("parts")), "parts"))
    known = small(sets.select("id", "tokens"))
    member = pairs.join(parts, "hub").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).join(known, "id").select("hub", "part", F.lit(1).alias("turn"), "id", "tokens")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(known.withColumnRenamed("id", "hub"), "hub")
    rows = hubs.select("hub", "part", F.lit(0).alias("turn"), F.col("hub").alias("id"), "tokens").unionByName(member)
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "turn")

    def run(batches):
        place, own = None, []
        for batch in slices(batches):
            out = []
            for hub, part, turn, i, tokens in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "turn", "id")), batch.column("tokens"), strict=True):
                x = np.frombuffer(tokens.as_py(), np.uint64)
                if (hub, part) != place:
                    place, own = (hub, part), []
                if turn == 0:
                    own.append(x)
                    continue
                for y in own:
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    if both * den >= (len(x) + len(y) - both) * num:
                        out.append((min(hub, i), max(hub, i)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _with_component(rows: DataFrame, links: DataFrame, column: str, name: str) -> DataFrame:
    c = links.select(F.col("id").alias(column), F.col("component").alias(name))
    return rows.join(small(c), column, "left").withColumn(name, F.coalesce(name, column))


def _groups(rows: DataFrame) -> DataFrame:
    """``key, rep, size, l1, order``: the sets that share a signature, their number, the most central one and its order.

    A set leaves out its ``need - 1`` most frequent signatures. Sets that share most
    signatures with others are central: in a cloud of near copies that is the text
    the others were made from, which links to most of them.
    """

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        return rows.join(small(stage(sizes, "sizes")), "key")

    w = W.partitionBy("rep", "band")
    placed = shared(rows).select("*", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("size"), "key")).alias("place"))
    rows = stage(placed.filter("n >= need and place >= need").select("key", "rep").distinct(), "rarest")
    rows = stage(shared(rows), "grouped")
    central = rows.groupBy("rep").agg(F.sum("size").alias("central"))
    rows = rows.join(small(stage(central, "central")), "rep")
    leader = rows.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("order"), F.col("rep").alias("l1"))).alias("l")).select("key", "l.l1", "l.order")
    return rows.select("key", "rep", "size").join(small(stage(leader, "leaders")), "key")


def similar_documents(docs: DataFrame, *, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` (of the text as it is) for every document.

    Documents link when their sets of word ``n``-grams have a Jaccard of at least
    ``num / den``; ``component_id`` is the least id reachable over links, itself
    included. Words are lower-cased (A-Z) and stand between blanks.

    Equal sets are one class from the start, so copies cost one row each. A set is
    first compared with the most central of its groups' leaders, then with those
    leaders to which it is not connected yet. In groups of up to four the other
    pairs follow where they are still apart; in larger ones only those pairs that
    share one of their rarest tokens and that sizes and parities do not rule out.

    Null, empty and blank texts have no shingles and link with nothing. Rows that
    share an id are one document, which has all their links. A row without an id
    takes the component of equal sets, or null; it adds no links. Repeated rows repeat.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("tag"), t.cast("binary").alias("text"))
    members = membership(d, n)
    plan, keys = _plan(members, num, den)
    shared = spark.sparkContext.broadcast(plan)  # a few numbers for each power of BAND

    copies = members.filter("doc_id <> rep").select("doc_id", "tag").distinct()
    reps = d.filter("doc_id is not null").join(small(stage(copies, "copies")), ["doc_id", "tag"], "left_anti").select("doc_id", "text")
    repeated = Repeated(reps, lambda batch: [np.concatenate([k for *_, k in x]) for x in _set_keys(batch.column("text"), n, shared, num, den) if x], keys)
    rows = stage(repeated.only(_signature_rows(reps, n, shared, num, den, repeated.probe())), "signatures")
    groups = stage(_groups(rows), "groups")
    sets = _sets(reps, groups.select(F.col("rep").alias("id")), n)

    pair = F.least("l1", "rep").alias("a"), F.greatest("l1", "rep").alias("b")
    led = groups.filter("rep <> l1")
    best = led.groupBy("rep").agg(F.min(F.struct("order", "l1"))["l1"].alias("l1"))
    best = stage(best.select(*pair).distinct(), "best")
    one = members.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a < most")
    same_id = members.join(small(stage(one, "same-id")).select("doc_id", "a"), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = stage(_linked(best, sets, num, den).unionByName(same_id), "links")
    label = stage(components(links), "components")
    others = _apart(led.select(*pair).distinct(), label).join(best, ["a", "b"], "left_anti")
    links = stage(links.unionByName(_linked(others, sets, num, den)), "links")
    label = stage(components(links), "components")
    # groups of up to WHOLE members: their other pairs; larger ones: what rare tokens, sizes and parities leave open
    few = groups.filter(f"size <= {WHOLE} and rep <> l1").select("key", "rep")
    rest = few.join(few.select("key", F.col("rep").alias("other")), "key").filter("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    rest = _apart(rest.distinct(), label).unionByName(_open_pairs(groups.filter(f"size > {WHOLE}"), sets, label, num, den)).distinct()
    new = stage(_linked(stage(rest, "pairs"), sets, num, den), "links")
    if not new.isEmpty():
        label = stage(components(links.unionByName(new)), "components")

    out = _with_component(members.withColumn("node", F.coalesce("rep", "doc_id")), label, "node", "component_id")
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.col("tag").alias("text_hash"))


def _bands(most: int):
    lo = 1
    while lo <= most:
        lo, hi = band_of(lo)
        yield lo, hi
        lo = hi + 1


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    both = _with_component(_with_component(pairs, label, "a", "ca"), label, "b", "cb")
    return both.filter("ca <> cb").select("a", "b")


def _open_pairs(groups: DataFrame, sets: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of large groups that are not connected yet and may link.

    Sets that link differ in so few tokens that they share one of their rarest (see
    ``_rarest``), whatever else they share: what brought a large group together, such
    as a line that stands in many documents, makes no pairs. Sizes and parities are
    part of the join, so pairs that they rule out make no rows. The sets with a token
    that many share are dealt out to several tasks.
    """
    c = _with_component(groups, label, "rep", "c")
    parts = c.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    member = c.join(small(stage(parts, "parts")), "key", "left_semi").select(F.col("l1").alias("lead"), "rep", "c").distinct()
    member = _with_component(member, label, "lead", "cl").groupBy(F.col("rep").alias("id")).agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("cl")).alias("apart"))
    own = stage(sets.join(small(stage(member, "open")), "id"), "open-sets")
    rare = stage(_rarest(own, num, den), "rare")
    x = rare.filter("apart").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    y = rare.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = (t.select("token", "part", F.col("id").alias(k), F.col("c").alias(f"c{k}"), F.col("apart").alias(f"apart_{k}"), *(F.col(v).alias(f"{k}_{v}") for v in ("size", *PARITIES))) for t, k in ((x, "x"), (y, "y")))
    once = (F.col("x") < F.col("y")) | ~F.col("apart_y")
    both = x.join(y, (x["token"] == y["token"]) & (x["part"] == y["part"]) & (F.col("cx") != F.col("cy")) & once & _room("x", "y", num, den))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rarest(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``sets`` once for each of their rarest ``token``s, with the ``parts`` that those with it are dealt out to.

    Sets with a Jaccard of ``num / den`` differ from their larger one in less than
    ``most + 1`` tokens, so they share one of each other's first ``most + 1`` in any
    one order of all tokens. Here those in fewest sets come first. Tokens in a few
    sets count as rare alike, so that the others can be sent to all tasks.
    """

    def every(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(t.as_py(), np.int64) for t in batch.column("tokens")]))], ["token"])

    counts = sets.select("tokens").mapInArrow(every, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(f"n >= {FEW}")
    counts = stage(counts, "often")
    least = max(FEW, (counts.agg(F.sum("n")).first()[0] or 0) // OFTEN)
    often = counts.filter(F.col("n") >= least).toArrow()  # OFTEN rows at most
    token, n = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(token)
    sent = sets.sparkSession.sparkContext.broadcast((token[order], n[order]))
    kept = [f for f in sets.schema if f.name != "tokens"]

    def run(batches):
        known, n = sent.value
        for batch in slices(batches):
            tokens, times = [], []
            for t in batch.column("tokens"):
                x = np.frombuffer(t.as_py(), np.uint64)
                count = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    count = np.where(known[at] == x, n[at], 0)
                first = np.lexsort((x, count))[: len(x) * (den - num) // den + 1]
                tokens.append(x[first])
                times.append(count[first])
            rows = pa.array(np.repeat(np.arange(len(tokens)), [len(x) for x in tokens]))
            parts = pa.array((np.concatenate(times) // SHARED + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(rows) for f in kept), pa.array(np.concatenate(tokens).view(np.int64)), parts], [*(f.name for f in kept), "token", "parts"])

    return sets.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["token long", "parts int"]))
