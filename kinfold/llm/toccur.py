"""Similarity join of shingle sets by T-occurrence search with DivideSkip.

Sets of sizes n and m have a Jaccard similarity of ``percent`` hundredths only if they share T = ceil(percent * (n + m) / (100 + percent)) shingles.
A set is searched in inverted lists, one a shingle: of its own lists the L < T longest are left out, the short ones are merged by a heap, and a
document found in at least T - L of them is looked up in the long ones by binary search until T is reached or out of reach.

Over a cluster the longest lists are left out at once: with L = T - k any partner lies in k = ``SHARED`` of the short lists, so a document posts only the n - T + k shingles that
come first in one order of all shingles, the frequent ones last.  (Every order gives the same links.  Frequent are those seen in several documents of a
chunk, counted over all chunks, of which at most ``FREQUENT`` are known to all tasks, the cut being made by a histogram; and those whose short list turns out longer than ``SMALL``.)
A list of at most ``SMALL`` documents gives its few pairs, which go on if they meet in k lists; in a longer list all stand beside its first document.  A pair that shares k lists either
shares a longer one or has k small ones, so none is lost.  Documents that meet so, directly or through others, form a group; there are few of them, and most are small.  Groups are dealt
over packs of about ``PACK`` shingles, and a pack is searched with its own inverted lists, where the lengths of lists are exact.  A document looks only
for links to components it isn't in yet, so copies never give all their pairs.

A group over a pack's size is cut into pieces.  Each piece is searched, then the first documents of all pieces' components are searched together.  Of two
documents of a list that are still in different components, one isn't in the list's main component: that one is searched in all the pieces where its lists have others.
No pair is left out, whatever a group's size, and no task holds more than a piece and a share of the documents that ask.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import prepare, stored, text_chunks
from kinfold.llm.minmax import shingle_hashes
from kinfold.operators.graphs import components
from kinfold.plans.lineage import discard

#: Short lists that a pair must share, and the documents of a list whose pairs are counted.
SHARED, SMALL = 6, 8
#: Shingles in a pack, frequent shingles that all tasks know, and how heavily the merged lists weigh against the probed ones.
PACK, FREQUENT, MU = 1_000_000, 1 << 21, 0.01
#: Bytes of text hashed at once.
CHUNK_BYTES = 8_000_000


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, s1, s2`` for each row: size and 128-bit mark of its set; besides, rows ``shingle, df`` (n null) of those in two or more documents of a chunk."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_chunks(batches, 1, CHUNK_BYTES):
            shingles, n = shingle_hashes(some.column(1), width)
            stop = np.cumsum(n)
            marks = [xxhash.xxh3_128_intdigest(shingles[e - k : e].tobytes()) for e, k in zip(stop.tolist(), n.tolist(), strict=True)]
            s1, s2 = [(m >> 64) - (1 << 63) for m in marks], [(m & ((1 << 64) - 1)) - (1 << 63) for m in marks]
            ordered = np.sort(shingles)
            heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            df = np.diff(np.concatenate((heads, [len(ordered)])))
            often = df > 1
            seen, df = ordered[heads[often]].view(np.int64), df[often]
            blank = pa.nulls(len(seen), pa.int64())
            whole = [pa.concat_arrays([a, b]) for a, b in zip([some.column(0), *(pa.array(x, pa.int64()) for x in (n, s1, s2))], [blank] * 4, strict=True)]
            rest = [pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(x, pa.int64())]) for x in (seen, df)]
            yield pa.RecordBatch.from_arrays([*whole, *rest], ["doc_id", "n", "s1", "s2", "shingle", "df"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(make, "doc_id bigint, n bigint, s1 bigint, s2 bigint, shingle bigint, df bigint")


def frequent(prints: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the smallest power of two that at most ``most`` of them reach in count, and each one's power: 5 bytes each.

    They are told by their upper 32 bits; another shingle with the same bits counts as frequent too, in all documents alike, which only changes the order.
    """
    counts = stored(prints.where("n is null").groupBy("shingle").agg(F.floor(F.log2(F.sum("df"))).cast("int").alias("k")), "counts")
    # At most 64 rows.
    sizes = {r.k: r.n for r in counts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut, held = 64, 0
    while cut > 0 and (held := held + sizes.get(cut - 1, 0)) <= most:
        cut -= 1
    rows = counts.where(F.col("k") >= cut).groupBy(F.shiftrightunsigned("shingle", 32).alias("bits")).agg(F.max("k").alias("k")).toArrow()
    bits, power = rows.column("bits").to_numpy().astype(np.uint32), rows.column("k").to_numpy().astype(np.uint8)
    order = np.argsort(bits)
    return bits[order], power[order]


def required(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any similar one."""
    return -(-percent * n // 100)


def prefix_size(n, percent: int):
    """Shingles of a set of n (a number or an array) that are posted: n - T + k, with k ``SHARED``, or T where that is less."""
    least = (percent * n + 99) // 100
    return n - least + np.minimum(SHARED, least)


def postings(texts: DataFrame, width: int, percent: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, shingle``: the short lists that each document is in, those of its first shingles (``prefix_size``), frequent ones last.

    In the order of all shingles the ``known`` ones come last, by their count.  With columns ``lo`` and ``hi`` the shingles of these places in the order are given instead.
    """
    told = texts.sparkSession.sparkContext.broadcast(known)
    cut = "hi" in texts.columns
    columns = ["doc_id", "text", *(("lo", "hi") if cut else ())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, power = told.value
        for some in text_chunks(batches, 1, CHUNK_BYTES):
            shingles, n = shingle_hashes(some.column(1), width)
            first = np.cumsum(n) - n
            lo, hi = (np.minimum(n, some.column(c).to_numpy()) for c in ("lo", "hi")) if cut else (np.zeros_like(n), prefix_size(n, percent))
            weight = np.zeros(len(shingles), np.int64)
            if len(often):
                bits = (shingles >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(often, bits), len(often) - 1)
                weight = np.where(often[at] == bits, power[at], 0).astype(np.int64)
            # Within a document the hashes are in order, and so they stay where counts are equal.
            order = np.arange(len(shingles))
            for d in np.unique(np.repeat(np.arange(len(n)), n)[np.flatnonzero(weight)]).tolist():
                order[first[d] : first[d] + n[d]] = first[d] + np.argsort(weight[first[d] : first[d] + n[d]], kind="stable")
            short = hi - lo
            take = order[np.repeat(first + lo - (np.cumsum(short) - short), short) + np.arange(int(short.sum()))]
            ids = some.column(0).take(pa.array(np.repeat(np.arange(len(n)), short)))
            for at in range(0, len(take), 200_000):
                yield pa.RecordBatch.from_arrays([ids.slice(at, 200_000), pa.array(shingles[take[at : at + 200_000]].view(np.int64))], ["doc_id", "shingle"])

    return texts.select(*columns).mapInArrow(make, "doc_id bigint, shingle bigint")


def short_lists(texts: DataFrame, sizes: DataFrame, width: int, percent: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``postings`` in the order that puts the longest lists last, or more: after a first round those of more than ``SMALL`` documents are left out wherever a document has others.

    What was posted stays, but for the rows of long lists.  A document that lost some looks beyond the places it posted, twice as far as it lacks lists and some more, in the end by as many as it
    posts, and posts all that aren't long there, until it has enough or no more shingles: a handful of rounds, of which the later ones see few.  One without enough takes its long rows back: the
    long shingles that it needs are the first in the order, and those it posted.  So each document posts at least its first shingles in one order of all, which is all that the search needs.
    """
    posted = stored(postings(texts, width, percent, known), "postings")
    long = stored(posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > SMALL).select("shingle"), "long")
    heavy = stored(posted.join(long, "shingle", "left_semi").select("doc_id", "shingle"), "heavy")
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    size = (F.col("n") - least + F.least(F.lit(SHARED), least)).cast("bigint")
    held = heavy.groupBy("doc_id").agg(F.count_distinct("shingle").alias("long"))
    # An id of several texts looks at all their shingles and takes its long rows back.
    several = F.col("n") != F.col("least")
    now = held.join(sizes, "doc_id").select("doc_id", "n", size.alias("need"), "long", F.when(several, 0).otherwise(size).cast("bigint").alias("seen"), several.alias("several"))
    now = stored(now, "looking")
    lacks = F.col("need") - F.col("seen") + F.col("long")
    more, without = [], []
    while True:
        without.append(now.where(((lacks > 0) | F.col("several")) & (F.col("seen") >= F.col("n"))).select("doc_id"))
        ahead = now.where(((lacks > 0) | F.col("several")) & (F.col("seen") < F.col("n")))
        if ahead.isEmpty():
            break
        until = F.when(F.col("several"), F.col("n")).otherwise(F.least("n", F.col("seen") + 2 * lacks + (4 if not more else F.col("need")))).cast("bigint")
        ahead = ahead.withColumn("until", until)
        looked = postings(texts.join(ahead.select("doc_id", F.col("seen").alias("lo"), F.col("until").alias("hi")), "doc_id"), width, percent, known)
        more.append(stored(looked.join(long, "shingle", "left_anti").select("doc_id", "shingle").distinct(), "more"))
        got = more[-1].groupBy("doc_id").agg(F.count(F.lit(1)).alias("got"))
        left = F.col("long") + F.col("until") - F.col("seen") - F.coalesce("got", F.lit(0))
        now = stored(ahead.join(got, "doc_id", "left").select("doc_id", "n", "need", left.cast("bigint").alias("long"), F.col("until").alias("seen"), "several"), "looking")
    kept = posted.join(long, "shingle", "left_anti").select("doc_id", "shingle")
    for some in more:
        kept = kept.unionAll(some)
    for some in without:
        kept = kept.unionAll(heavy.join(some, "doc_id", "left_semi").select("doc_id", "shingle"))
    out = stored(kept, "postings")
    for done in (posted, heavy, *more):
        discard(done)
    return out


class Pack:
    """Documents searched one after another in the inverted lists of those before, component by component."""

    def __init__(self, sets: list[np.ndarray], ids: list[int], percent: int):
        self.ids, self.percent, self.n = ids, percent, [len(s) for s in sets]
        # A shingle of one document only is in no list that another could meet.
        all_, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        cuts = np.cumsum(self.n)[:-1]
        self.sets = [shared[p[count[p] > 1]].tolist() for p in np.split(number, cuts)]
        self.up = list(range(len(sets)))
        #: For each component its lists: shingle -> places of its documents, ascending; and for each shingle the components that have it.
        self.lists: dict[int, dict[int, list[int]]] = {}
        self.having: dict[int, set[int]] = {}
        self.members: dict[int, list[int]] = {}

    def root(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = c = self.up[self.up[c]]
        return c

    def similar(self, a: int, b: int) -> bool:
        both = len(set(self.sets[a]).intersection(self.sets[b]))
        return 100 * both >= self.percent * (self.n[a] + self.n[b] - both)

    def need(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def add(self, d: int) -> None:
        """Put a document into the lists, as a component of its own."""
        self.lists[d] = {s: [d] for s in self.sets[d]}
        self.members[d] = [d]
        for s in self.sets[d]:
            self.having.setdefault(s, set()).add(d)

    def join(self, a: int, b: int) -> None:
        """Make one component of two, the smaller lists into the larger."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.up[b] = a
        mine = self.lists[a]
        for s, places in self.lists.pop(b).items():
            if (had := mine.get(s)) is None:
                mine[s] = places
            elif had[-1] < places[0]:
                had += places
            else:
                mine[s] = sorted(had + places)
            self.having[s].discard(b)
            self.having[s].add(a)
        self.members[a] += self.members.pop(b)

    def search(self, d: int) -> list[int]:
        """One similar document of each component that has one, the document's own left out."""
        least, own, found = required(self.n[d], self.percent), self.root(d), []
        # The components that share enough shingles at all.
        shares: dict[int, int] = {}
        left = len(self.sets[d])
        for s in self.sets[d]:
            for c in self.having.get(s, ()):
                # One that is first met when too few shingles are left can't reach the number.
                if c in shares or left >= least:
                    shares[c] = shares.get(c, 0) + 1
            left -= 1
        for c, many in shares.items():
            if c != own and many >= least and (partner := self._in_component(d, c, least)) is not None:
                found.append(partner)
        return found

    def _in_component(self, d: int, c: int, least: int) -> int | None:
        head = self.members[c][0]
        if self.similar(d, head):
            return head
        if len(self.members[c]) == 1:
            return None
        mine = self.lists[c]
        lists = sorted((mine[s] for s in self.sets[d] if s in mine), key=len)
        # DivideSkip: the longer the longest list, the fewer are left to the probes.
        away = min(least - 1, int(least / (MU * np.log2(len(lists[-1]) + 1) + 1)), len(lists))
        short, long = lists[: len(lists) - away], lists[len(lists) - away :]
        enough, run, last = least - away, 0, -1
        for place in heapq.merge(*short):
            run, last = (run + 1, last) if place == last else (1, place)
            if run == enough and self._probe(d, place, short, long):
                return place
        return None

    def _probe(self, d: int, place: int, short: list[list[int]], long: list[list[int]]) -> bool:
        """Is the document at ``place`` in enough of all lists?  It is looked up in them by binary search."""
        need = self.need(self.n[d], self.n[place])
        both = 0
        for k, one in enumerate((*short, *long)):
            at = bisect_left(one, place)
            both += at < len(one) and one[at] == place
            if both >= need:
                return True
            if both + len(short) + len(long) - k - 1 < need:
                return False
        return False


def searched(rows: DataFrame, keys: list[str], width: int, percent: int) -> DataFrame:
    """Links (id1, id2) that join what is similar in each group of ``keys``; rows (doc_id, text, asks, comp).

    Documents with the same ``comp``, where it isn't null, are one component already.  Rows whose ``asks`` is false only are searched in.
    """

    def search(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        for texts in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(some["text"], pa.string())], ["text"])]), 0, CHUNK_BYTES):
            shingles, n = shingle_hashes(texts.column(0), width)
            parts += np.split(shingles, np.cumsum(n)[:-1])
        ids, asks, comps = some["doc_id"].tolist(), some["asks"].to_numpy(bool), some["comp"].tolist()
        # Those only searched in come first, smaller sets before larger ones.
        order = sorted((i for i in range(len(ids)) if len(parts[i])), key=lambda i: (bool(asks[i]), len(parts[i]), ids[i]))
        if not order:
            return pd.DataFrame(got, columns=["id1", "id2"], dtype="int64")
        pack, known = Pack([parts[i] for i in order], [ids[i] for i in order], percent), {}
        for d, i in enumerate(order):
            pack.add(d)
            if comps[i] == comps[i] and comps[i] is not None:
                if comps[i] in known:
                    pack.join(d, known[comps[i]])
                known[comps[i]] = d
            if asks[i]:
                for other in pack.search(d):
                    pack.join(d, other)
                    got.append((pack.ids[d], pack.ids[other]))
        return pd.DataFrame(got, columns=["id1", "id2"], dtype="int64")

    # One shuffle; of rows that are given twice one goes on to Python.
    dealt = rows.select(*keys, "doc_id", "text", "asks", "comp", F.xxhash64("text").alias("h")).repartition(*keys).dropDuplicates([*keys, "doc_id", "h", "asks"])
    return dealt.groupBy(*keys).applyInPandas(search, "id1 bigint, id2 bigint")


def _groups(posted: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The lists with two or more documents as (shingle, doc_id), and (doc_id, grp) of the documents that meet in enough of them."""
    seen = posted.groupBy("shingle").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), F.count(F.lit(1)).alias("df"))
    seen = stored(seen.where("head < tail"), "seen")
    # The two of a list of two are known from its ends.
    two = seen.where("df = 2").select("shingle", F.explode(F.array("head", "tail")).alias("doc_id"))
    more = stored(posted.join(seen.where("df > 2"), "shingle"), "lists")
    small = more.where(F.col("df") <= SMALL)
    one, other = small.select("shingle", F.col("doc_id").alias("id1")), small.select("shingle", F.col("doc_id").alias("id2"))
    pairs = one.join(other, "shingle").where("id1 < id2").select("id1", "id2").unionAll(seen.where("df = 2").select("head", "tail"))
    pairs = pairs.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("both"))
    # Sets of few shingles share fewer.
    least = F.ceil(F.lit(percent) * F.col("least") / 100).cast("int")
    few = stored(sizes.where(least < SHARED).select("doc_id", least.alias("k")), "few")
    side = lambda i: few.select(F.col("doc_id").alias(f"id{i}"), F.col("k").alias(f"k{i}"))
    enough = F.least(F.lit(SHARED), "k1", "k2")
    pairs = pairs.join(side(1), "id1", "left").join(side(2), "id2", "left").where(F.col("both") >= enough).select("id1", "id2")
    stars = more.where((F.col("df") > SMALL) & (F.col("doc_id") != F.col("head"))).select(F.col("head").alias("id1"), F.col("doc_id").alias("id2")).distinct()
    met = components(pairs.unionAll(stars))
    return more.select("shingle", "doc_id").unionAll(two), met.select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))


def links(texts: DataFrame, sizes: DataFrame, posted: DataFrame, width: int, percent: int, pack: int = PACK) -> DataFrame:
    """(id1, id2) whose components are those of all similar pairs; texts (doc_id, text), sizes (doc_id, n, least: of one row), posted as ``postings`` gives it."""
    lists, met = _groups(posted, sizes, percent)
    met = stored(met.join(sizes, "doc_id"), "met")
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packs = max(1, -(-total // pack))
    room = met.groupBy("grp").agg(F.ceil(F.sum("n") / pack).cast("bigint").alias("pieces"))
    placed = met.join(room, "grp").select("doc_id", "grp", "pieces", F.when(F.col("pieces") > 1, F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(packs))).alias("pack"))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(-1).cast("bigint"))
    placed = stored(placed.withColumn("piece", piece), "placed")
    bodies = stored(texts.join(placed, "doc_id").select("doc_id", "text", "grp", "pieces", "pack", "piece"), "bodies")
    none, yes = F.lit(None).cast("bigint").alias("comp"), F.lit(True).alias("asks")
    done = stored(searched(bodies.select("pack", "piece", "doc_id", "text", yes, none), ["pack", "piece"], width, percent), "links")
    big = stored(bodies.where("pieces > 1"), "large")
    if big.isEmpty():
        return done
    # The first documents of the pieces' components meet.
    own = big.select("doc_id", "grp", "pieces", "piece").distinct()

    def with_comp(so_far: DataFrame, rows: DataFrame) -> DataFrame:
        found = components(so_far)
        return rows.join(found, rows["doc_id"] == found["node"], "left").select(rows["*"], F.coalesce("component", "doc_id").alias("comp"))

    own = stored(with_comp(done, own), "own")
    firsts = own.groupBy("grp", "piece", "comp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    firsts = stored(firsts, "firsts")
    # In shares of about as many documents as a piece has.
    shares = own.groupBy("grp").agg((F.count(F.lit(1)) / F.max("pieces")).alias("held")).join(firsts.groupBy("grp").agg(F.count(F.lit(1)).alias("many")), "grp")
    shares = shares.select("grp", F.ceil(F.col("many") / F.col("held")).cast("bigint").alias("shares"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("shares")).alias("share")
    heads = big.join(firsts.select("doc_id"), "doc_id").join(shares, "grp").select("grp", share, "doc_id", "text", yes, none)
    done = stored(done.union(searched(heads, ["grp", "share"], width, percent)), "links")
    # What a list still holds of different components.
    own = stored(with_comp(done, own.drop("comp")), "own")
    here = lists.join(own, "doc_id")
    mixed = here.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("many"))
    main = mixed.groupBy("shingle").agg(F.max(F.struct("many", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("shingle", F.col("top.comp").alias("main"))
    here = stored(here.join(main, "shingle").select("shingle", "doc_id", "grp", "piece", "comp", "main"), "mixed")
    asking = here.where("comp <> main").select("shingle", "doc_id", F.col("comp").alias("asker"))
    where = here.groupBy("shingle", "grp", "piece").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    routes = asking.join(where, "shingle").where("low <> high or low <> asker").select("doc_id", "grp", "piece").distinct()
    routes = stored(routes, "routes")
    if routes.isEmpty():
        return done
    comps = own.select("doc_id", "comp").distinct()
    left = big.join(comps, "doc_id").join(routes.select("grp", "piece").distinct(), ["grp", "piece"], "left_semi")
    crowd = routes.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("askers"))
    # A task holds a piece and as many askers as a piece has documents, about.
    many = own.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("held")).join(crowd, ["grp", "piece"]).select("grp", "piece", F.ceil(F.col("askers") / F.col("held")).cast("bigint").alias("shares"))
    every = left.join(many, ["grp", "piece"]).select("grp", "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "doc_id", "text", F.lit(False).alias("asks"), "comp")
    asked = big.drop("grp", "piece").join(comps, "doc_id").join(routes, "doc_id").join(many, ["grp", "piece"])
    asked = asked.select("grp", "piece", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("shares")).alias("share"), "doc_id", "text", yes, "comp")
    return done.union(stored(searched(every.unionByName(asked), ["grp", "piece", "share"], width, percent), "links"))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, pack: int = PACK, most: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set are its distinct word shingles (A-Z lower-cased; fewer words than ``width`` are one shingle); two documents link when 100 * intersection >=
    percent * union.  A component is named by its smallest doc_id.  A text without words (null, empty, blanks) links with nothing.
    Rows sharing a doc_id are one document if their sets are equal; otherwise each row's set may link and all of them are joined.
    A row without a doc_id gets component_id null.  An empty table gives no rows; texts of any length count with all their shingles; other columns, whatever their names, are not read.
    """
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, width), "fingerprints")
    rows = prints.where("n is not null").select("doc_id", "n", "s1", "s2")
    some = rows.where("n > 0 and doc_id is not null")
    # Equal sets are one document from the start; a minimum taken before the shuffle, so thousands of copies meet as a few rows.
    reps = stored(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "representatives")
    heads = reps.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = stored(reps.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n").alias("n"), F.min("n").alias("least")), "sizes")
    posted = short_lists(texts.join(heads, "doc_id", "left_semi"), sizes, width, percent, frequent(prints, most))
    found = links(texts, sizes, posted, width, percent, pack)
    same = some.join(reps, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("id1"), F.col("doc_id").alias("id2"))
    final = components(found.union(same))
    out = rows.join(final, rows["doc_id"] == final["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
