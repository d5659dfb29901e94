"""The older library path: one-to-one matches, blocks, k-mer identity, weights, their variants and formats."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.sequence import pack, packed_mismatches
from tagloom.operators.anchors import NO_LIMIT, TOLERANCE, find_anchors, parts
from tagloom.operators.digest import BIN_BITS, canonical_kmers, kmer_bins, kmers
from tagloom.operators.enzymes import LONGEST_TAG, Enzyme, resolve
from tagloom.operators.postings import BLOCK, numbered, shared_counts, shared_places
from tagloom.operators.synteny import block_sizes, match_length
from tagloom.sources.scratch import stored

MATCH = "query string, reference string, enzyme string, q_contig long, q_pos long, r_contig long, r_pos long, mm int, gap_diff long"
#: Matches across enzymes name the reference tag's too.
MATCHES = MATCH + ", r_enzyme string"
#: The detour of a candidate on other contigs than the last match.
ELSEWHERE = 1 << 62


class _Places:
    """The places (contig, position, enzyme) of one reference tag; ``used`` ones are stepped over, each once."""

    def __init__(self, places: list[tuple], used: set) -> None:
        self.at, self.used = sorted(places), used
        self.up, self.down = list(range(len(places) + 1)), list(range(len(places) + 1))

    def _step(self, way: list[int], k: int, end: int, by: int) -> int:
        seen = []
        while k != end:
            if way[k] != k:
                to = way[k]
            elif self.at[k - (by < 0)] in self.used:
                to = k + by
            else:
                break
            seen.append(k)
            k = to
        for x in seen:
            way[x] = k
        return k

    def free(self, k: int) -> int:
        """The first free place from k on, or their number."""
        return self._step(self.up, k, len(self.at), 1)

    def best(self, contig: int | None, target: int) -> tuple | None:
        """(detour, place) of the free place nearest to a target on a contig, the first of equal ones; the first free place at all where there is none or no contig."""
        found = []
        if contig is not None:
            k = bisect_left(self.at, (contig, target))
            right, left = self.free(k), self._step(self.down, k, 0, -1) - 1
            if right < len(self.at) and self.at[right][0] == contig:
                found.append((self.at[right][1] - target, self.at[right]))
            if left >= 0 and self.at[left][0] == contig:
                # of several places at one position the first
                place = self.at[self.free(bisect_left(self.at, self.at[left][:2]))]
                found.append((target - place[1], place))
        if not found:
            k = self.free(0)
            found = [(ELSEWHERE, self.at[k])] if k < len(self.at) else []
        return min(found, default=None)


def _greedy(key: tuple, used: set, places) -> list[tuple]:
    """Matches of one genome pair from (query place and enzyme, its candidates as (differs, mm, ``_Places`` over used)) in query order."""
    out, last = [], None
    for (qc, qp, enzyme), candidates in places:
        best, beside = None, last is not None and last[0] == qc
        contig, target = (last[2], last[3] + qp - last[1]) if beside else (None, 0)
        for differs, mm, own in candidates:
            if best and best[:2] < (differs, mm):
                continue
            found = own.best(contig, target)
            if found:
                best = min(best or (2,), (differs, mm, *found))
        if best:
            rc, rp, r_enzyme = best[3]
            used.add(best[3])
            gap = best[2] if beside and last[2] == rc else 0
            out.append((*key, enzyme, qc, qp, rc, rp, best[1], gap, r_enzyme))
            last = (qc, qp, rc, rp)
    return out


def match_tags(anchors: DataFrame) -> DataFrame:
    """The matches of ``match_all`` from forward anchors, within one enzyme: one query place, one reference place."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by_place = pdf.sort_values(["q_contig", "q_pos", "r_contig", "r_pos"]).groupby(["q_contig", "q_pos"], sort=True)
        used: set = set()
        rows = _greedy(key, used, (((*at, g.enzyme.iloc[0]), [(int(mm > 0), mm, _Places([(rc, rp, e)], used)) for rc, rp, mm, e in zip(g.r_contig, g.r_pos, g.mm, g.enzyme)]) for at, g in by_place))
        # the enzyme of a match is that of the anchor taken
        return pd.DataFrame([(*r[:2], r[9], *r[3:9]) for r in rows], columns=[x.split()[0] for x in MATCH.split(", ")])

    return anchors.where("orient = '+'").groupBy("query", "reference").applyInPandas(run, MATCH)


def match_all(tags: DataFrame, pairs: DataFrame | None = None, panel: list[Enzyme] | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """Greedy one-to-one matches of forward tags of each pair, whatever their enzymes and however often they occur.

    Without ``pairs`` (query, reference) each two genomes that hold close tags are a
    pair, the smaller name the query. Two tags are compared over the shorter one's bases. In the order of places
    (then enzyme names) a query tag takes, of the reference tags still free and
    within ``tolerance``, one that is equal to it when both are packed, else the
    one with the fewest mismatches; of equal ones that nearest to where the last
    match leads, then the first. The choice depends on the matches before, so a
    pair of genomes is one group. gap_diff is the difference of the steps since
    the last match on the same contigs. Distinct tags are compared, each once; a
    pair of them brings the list of its places on either side, so copies add rows
    to neither the join nor the shuffle.
    """
    known = resolve() if panel is None else panel
    own = tags.where(F.col("enzyme").isin([e.name for e in known])).select("genome_id", "enzyme", "contig_id", "position", "tag")
    lengths = sorted({min(e.tag_len, LONGEST_TAG) for e in known})
    levels = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.col("len"))
    x = own.select("tag").distinct().select("tag", F.length("tag").alias("len"), pack(F.col("tag")).alias("x")).select("*", F.explode(levels).alias("level"))
    # the first bases that a comparison at this level takes
    mask = F.when(F.col("level") >= 32, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.col("level")) - 1)
    cut = x.withColumn("y", F.col("x").bitwiseAND(mask))
    cut = cut.select("tag", "len", "x", "y", "level", F.inline(parts(F.col("y"), F.col("level"), tolerance)))
    o = cut.withColumnsRenamed({"tag": "other", "len": "o_len", "x": "o_x", "y": "o_y"})
    close = cut.join(o, ["level", "part", "bits"]).where(F.least("len", "o_len") == F.col("level")).withColumn("mm", packed_mismatches(F.col("y"), F.col("o_y"))).where(F.col("mm") <= tolerance)
    close = close.select("tag", "other", "mm", (F.col("x") != F.col("o_x")).cast("int").alias("differs")).distinct()
    places = own.groupBy("genome_id", "tag").agg(F.collect_list(F.struct(F.col("contig_id").alias("contig"), F.col("position").alias("pos"), "enzyme")).alias("places"))
    q = places.select(F.col("genome_id").alias("query"), "tag", F.col("places").alias("q_places"))
    r = places.select(F.col("genome_id").alias("reference"), F.col("tag").alias("other"), F.col("places").alias("r_places"))
    if pairs is None:
        both = q.join(close, "tag").join(r, "other").where("query < reference")
    else:
        both = q.join(pairs.select("query", "reference"), "query").join(close, "tag").join(r, ["reference", "other"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        known: dict[str, _Places] = {}
        at: dict[tuple, list] = {}
        for other, mm, differs, q_places, r_places in zip(pdf.other, pdf.mm, pdf.differs, pdf.q_places, pdf.r_places):
            if other not in known:
                known[other] = _Places([(x["contig"], x["pos"], x["enzyme"]) for x in r_places], used)
            for x in q_places:
                at.setdefault((x["contig"], x["pos"], x["enzyme"]), []).append((differs, mm, known[other]))
        rows = _greedy(key, used, ((place, at[place]) for place in sorted(at)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHES.split(", ")])

    return both.select("query", "reference", "other", "mm", "differs", "q_places", "r_places").groupBy("query", "reference").applyInPandas(run, MATCHES)


def unmatched(tags: DataFrame, matches: DataFrame, side: str = "q", role: str = "query") -> DataFrame:
    """Tags of one side that no match has."""
    m = matches.select(F.col(role).alias("genome_id"), "enzyme", F.col(f"{side}_contig").alias("contig_id"), F.col(f"{side}_pos").alias("position")).distinct()
    return tags.join(m, ["genome_id", "enzyme", "contig_id", "position"], "left_anti")


def _places(tags: DataFrame) -> DataFrame:
    """genome_id, contig_id, position, held (enzyme, tag) and content, which tells what is held, of each place."""
    held = tags.groupBy("genome_id", "contig_id", "position").agg(F.array_sort(F.collect_set(F.struct("enzyme", "tag"))).alias("held"))
    return stored(held.withColumn("content", F.array_join(F.transform("held", lambda x: F.concat(x.enzyme, F.lit(":"), x.tag)), ",")), "places")


def _content_anchors(kinds: DataFrame, name: str) -> DataFrame:
    """The anchors, of whatever number, between places of each two contents (named query and reference, each in both roles)."""
    zero = F.lit(0).cast("long")
    t = stored(kinds.select(F.col(name).alias("genome_id"), zero.alias("contig_id"), zero.alias("position"), F.lit(1).alias("n"), F.inline("held")), "tags")
    return find_anchors(t, t, max_occurrence=NO_LIMIT, max_bucket=NO_LIMIT)


def unmatched_queries(tags: DataFrame) -> DataFrame:
    """Tags that have no anchor, of whatever number, in a genome of a later name.

    The places that hold the same tags have the same anchors, so that anchors are found
    between distinct contents of places, and a content knows the last genome that has it:
    copies add rows to no join of tags.
    """
    place = ["genome_id", "contig_id", "position"]
    held = _places(tags)
    kinds = stored(held.groupBy("content").agg(F.max("genome_id").alias("top"), F.first("held").alias("held")), "contents")
    found = _content_anchors(kinds, "content")
    tops = kinds.select(F.col("content").alias("reference"), "top")
    last = found.join(tops, "reference").groupBy(F.col("query").alias("content"), "enzyme").agg(F.max("top").alias("last"))
    known = held.select(*place, "content").join(last, "content").where("genome_id < last").select(*place, "enzyme")
    return tags.join(known, [*place, "enzyme"], "left_anti")


def weighted_pairs(matches: DataFrame, scheme: str = "synteny", tolerance: int = 5000, panel: list[Enzyme] | None = None) -> DataFrame:
    """query, reference, raw_ani, weighted_ani (percent), n_tags: each match weighs by itself, its identity being over the longer of its tags.

    uniform 1; synteny the root of the number of tags of its chained block; position
    1 + sin(p / (max(p, 1) + 1)) of its query place p; gap 1 - min(|gap|, 10) / 20.
    """
    weight = {"uniform": F.lit(1.0), "synteny": F.sqrt(F.col("n_tags") if scheme == "synteny" else F.lit(1)), "position": 1 + F.sin(F.col("q_pos") / (F.greatest("q_pos", F.lit(1)) + 1)), "gap": 1 - F.least(F.abs("gap_diff"), F.lit(10)) / 20}[scheme]
    m = block_sizes(matches, tolerance) if scheme == "synteny" else matches
    m = m.select("query", "reference", (100 * (1 - F.col("mm") / match_length(m, panel))).alias("ani"), weight.alias("w"))
    return m.groupBy("query", "reference").agg(F.avg("ani").alias("raw_ani"), (F.sum(F.col("ani") * F.col("w")) / F.sum("w")).alias("weighted_ani"), F.count(F.lit(1)).alias("n_tags"))


def confidence(n_tags: Column, af_min: Column) -> Column:
    return (1 - F.exp(-n_tags / 100)) * F.sqrt(af_min)


def contig_mash(anchors: DataFrame) -> DataFrame:
    """For each query contig the reference contig with the most anchors (then the smaller number), and its mean mismatches."""
    n = anchors.groupBy("query", "reference", "q_contig", "r_contig").agg(F.count(F.lit(1)).alias("n"), F.avg("mm").alias("mean_mm"))
    return n.groupBy("query", "reference", "q_contig").agg(F.max_by(F.struct("r_contig", "n", "mean_mm"), F.struct("n", -F.col("r_contig"))).alias("b")).select("query", "reference", "q_contig", "b.r_contig", "b.n", "b.mean_mm")


#: Places that a content's anchors reach, from which on contigs are compared by what they hold of it rather than one by one.
COMMON = 64


def contig_mash_all(tags: DataFrame) -> DataFrame:
    """``contig_mash`` of all anchors of each two genomes (query < reference), of whatever number, without a row for an anchor.

    The anchors of two contigs are those between the contents of their places. Contents whose
    anchors reach up to ``COMMON`` places meet place by place, which is at most so many rows for
    a place. What a contig holds of the other contents is its profile, and two profiles have
    the same anchors wherever they stand: each two are counted once, and a genome's best contig
    for a profile is the first of those whose profile has the most. A contig that also shares a
    rarer content has more than its profile says and is counted with both; any other is no
    better than the best by profiles, so that the better of the two is the best of all.
    """
    held = _places(tags.where("genome_id is not null"))
    kinds = stored(held.groupBy("content").agg(F.count(F.lit(1)).alias("places"), F.first("held").alias("held")).withColumn("id", F.monotonically_increasing_id()), "contents")
    near = stored(_content_anchors(kinds, "id").groupBy(F.col("query").alias("a"), F.col("reference").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("mm").alias("mm")), "near")
    reach = near.join(kinds.select(F.col("id").alias("b"), "places"), "b").groupBy(F.col("a").alias("id")).agg((F.sum("places") > COMMON).alias("common"))
    reach = stored(reach, "reach")
    own = held.join(kinds.select("content", "id"), "content").groupBy("genome_id", "contig_id", "id").agg(F.count(F.lit(1)).alias("n"))
    own = stored(own.join(reach, "id"), "own")
    edges = near.join(reach.withColumnsRenamed({"id": "a", "common": "a_common"}), "a").join(reach.withColumnsRenamed({"id": "b", "common": "b_common"}), "b")
    edges = stored(edges.withColumn("common", F.col("a_common") & F.col("b_common")), "edges")

    sums = [F.sum(F.col("a_n") * F.col("b_n") * F.col(x)).alias(as_) for x, as_ in (("k", "n"), ("mm", "mm"))]
    best = F.max_by(F.struct("r_contig", "n", "mm"), F.struct("n", -F.col("r_contig"))).alias("best")

    # profiles, and the anchors of each two of them
    profiles = own.where("common").groupBy("genome_id", "contig_id").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("held"))
    profiles = stored(profiles.withColumn("text", F.sha2(F.to_json("held"), 256)), "profiles")
    distinct = stored(profiles.groupBy("text").agg(F.first("held").alias("held")).withColumn("profile", F.monotonically_increasing_id()), "distinct")
    profiles = stored(profiles.join(distinct.select("text", "profile"), "text").select("genome_id", "contig_id", "profile"), "numbered")
    parts_ = distinct.select("profile", F.inline("held"))
    both = parts_.withColumnsRenamed({"profile": "p", "id": "a", "n": "a_n"}).join(edges.where("common"), "a").join(parts_.withColumnsRenamed({"profile": "q", "id": "b", "n": "b_n"}), "b")
    both = stored(both.groupBy("p", "q").agg(*sums), "pairs")
    holders = profiles.groupBy(F.col("profile").alias("q"), F.col("genome_id").alias("reference")).agg(F.min("contig_id").alias("r_contig"))
    top = both.join(holders, "q").groupBy("p", "reference").agg(best).select("p", "reference", "best.*")
    q = profiles.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), F.col("profile").alias("p"))
    columns = ["query", "reference", "q_contig", "r_contig", "n", "mm"]
    by_profile = q.join(top, "p").where("query < reference").select(columns)

    # contigs that share a rarer content, with what their profiles add
    known = own.join(profiles.withColumnsRenamed({"genome_id": "g", "contig_id": "c"}), (F.col("genome_id") == F.col("g")) & F.col("contig_id").eqNullSafe(F.col("c")), "left")
    known = stored(known.select("genome_id", "contig_id", "id", "n", "profile"), "known")
    of = lambda x, y, z: known.select(F.col("genome_id").alias(y), F.col("contig_id").alias(f"{y[0]}_contig"), F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("profile").alias(z))
    met = of("a", "query", "p").join(edges.where("not common"), "a").join(of("b", "reference", "q"), "b").where("query < reference")
    met = stored(met.groupBy("query", "reference", "q_contig", "r_contig").agg(*sums, F.first("p").alias("p"), F.first("q").alias("q")), "met")
    more = both.withColumnsRenamed({"n": "more_n", "mm": "more_mm"})
    added = met.where("p is not null and q is not null").join(more, ["p", "q"], "left").withColumn("n", F.col("n") + F.coalesce("more_n", F.lit(0))).withColumn("mm", F.col("mm") + F.coalesce("more_mm", F.lit(0)))
    found = by_profile.unionByName(added.select(columns)).unionByName(met.where("p is null or q is null").select(columns))
    found = found.groupBy("query", "reference", "q_contig").agg(best)
    return found.select("query", "reference", "q_contig", "best.r_contig", "best.n", (F.col("best.mm") / F.col("best.n")).alias("mean_mm"))


def kmer_containment(contigs: DataFrame, k: int = 15) -> DataFrame:
    """query, reference, shared, n_query, containment, kmer_ani of genomes by their distinct canonical k-mers; only pairs that share one.

    Up to ``BLOCK`` genomes are met bin by bin of the k-mers, k at most 15; more, or longer k-mers, by posting lists.
    """
    names = stored(contigs.select(F.col("genome_id").cast("string").alias("name")).na.drop().distinct(), "names")
    genomes = names.count()
    if 0 < genomes <= BLOCK and k <= 15:
        ids = stored(numbered(names, genomes).select("name", F.col("idx").alias("number")), "ids")
        own = contigs.join(F.broadcast(ids), contigs.genome_id.cast("string") == ids.name).select("number", "seq")
        n = stored(shared_places(kmer_bins(own, k), genomes, 1 << min(BIN_BITS, 2 * k)), "shared")
        of = lambda number, name: ids.select(F.col("number").cast("long").alias(number), F.col("name").alias(name))
        n = n.join(of("i", "query"), "i").join(of("j", "reference"), "j")
        sizes = n.where("i = j").select("query", F.col("n").alias("n_query"))
        shared = n.where("i < j").select("query", "reference", F.col("n").alias("shared"))
    else:
        own = stored(kmers(contigs, k).select("genome_id", "kmer").distinct(), "kmers")
        sizes = own.groupBy(F.col("genome_id").alias("query")).agg(F.count(F.lit(1)).alias("n_query"))
        shared = shared_counts(own, "genome_id", ["kmer"])
    c = F.col("shared") / F.col("n_query")
    return shared.join(sizes, "query").select("query", "reference", "shared", "n_query", c.alias("containment"), F.pow(c, F.lit(1.0 / k)).alias("kmer_ani"))


_BIN = 8192
#: Bases of a span up to which a block's k-mers are one row's work; longer spans are met by bins.
SHORT_SPAN = 1 << 15


def _counts(spans: DataFrame, contigs: DataFrame, ids: list[str], k: int) -> DataFrame:
    """``block_kmers`` of blocks whose spans (side, genome_id, contig_id, lo, hi) are short: the sequences are cut out, and a row has those of both sides."""
    cut = spans.join(contigs.select("genome_id", "contig_id", "seq"), ["genome_id", "contig_id"])
    cut = cut.select(*ids, F.struct("side", F.col("seq").substr((F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("seq")).alias("piece"))
    both = cut.groupBy(*ids).agg(F.collect_list("piece").alias("pieces"))
    names = ["n_query", "n_reference", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for row in batch.column("pieces"):
                own = {"q": [np.zeros(0, np.int64)], "r": [np.zeros(0, np.int64)]}
                for piece in row:
                    own[piece["side"].as_py()].append(canonical_kmers(piece["seq"].as_py(), k))
                q, r = (np.unique(np.concatenate(own[x])) for x in "qr")
                counts.append((len(q), len(r), len(np.intersect1d(q, r, assume_unique=True))))
            columns = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in columns]], [*batch.schema.names[:-1], *names])

    schema = T.StructType([*both.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])
    return both.mapInArrow(run, schema).where("n_query + n_reference > 0")


def block_kmers(spans: DataFrame, contigs: DataFrame, ids: list[str], k: int = 15) -> DataFrame:
    """ids, n_query, n_reference, shared: distinct canonical k-mers within each block's span on either side, and those of both.

    spans: ids (query and reference among them), q_contig, q_start, q_end, r_contig,
    r_start, r_end, the ends included; they are cut at the contigs' ends, and a span
    of no more than k bases has no k-mer. Blocks of short spans bring their sequences, once a
    block; in the others k-mers meet spans by bins of places, so that
    neither a long contig nor a contig of many blocks is one task's.
    """
    sides = []
    for side, genome in (("q", "query"), ("r", "reference")):
        sides.append(spans.select(*ids, F.lit(side).alias("side"), F.col(genome).alias("genome_id"), F.col(f"{side}_contig").alias("contig_id"), F.col(f"{side}_start").alias("lo"), F.col(f"{side}_end").alias("end"), F.greatest(F.col("q_end") - F.col("q_start"), F.col("r_end") - F.col("r_start")).alias("size")))
    c = contigs.select("genome_id", "contig_id", "length")
    s = sides[0].unionByName(sides[1]).where(F.col("end") + 1 > F.col("lo") + k).join(c, ["genome_id", "contig_id"]).withColumn("lo", F.least("lo", "length")).withColumn("hi", F.least(F.col("end") + 1, F.col("length")))
    s = s.where(F.col("hi") > F.col("lo") + k)
    short = _counts(s.where(F.col("size") < SHORT_SPAN), contigs, ids, k)
    s = s.where(F.col("size") >= SHORT_SPAN).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / _BIN), F.floor((F.col("hi") - k) / _BIN))))
    own = contigs.join(s.select("genome_id", "contig_id").distinct(), ["genome_id", "contig_id"], "left_semi")
    at = kmers(own, k, places=True).withColumn("bin", F.floor(F.col("position") / _BIN))
    j = s.join(at, ["genome_id", "contig_id", "bin"]).where(F.col("position").between(F.col("lo"), F.col("hi") - k))
    of = lambda x: F.max((F.col("side") == x).cast("int")).alias(x)
    per = j.groupBy(*ids, "kmer").agg(of("q"), of("r"))
    long = per.groupBy(*ids).agg(F.sum("q").alias("n_query"), F.sum("r").alias("n_reference"), F.sum(F.col("q") * F.col("r")).alias("shared"))
    return short.unionByName(long)


def block_kmer_identity(spans: DataFrame, contigs: DataFrame, ids: list[str], weight: str = "n_tags", k: int = 15) -> DataFrame:
    """query, reference, kmer_ani: 1 + ln(shared / smaller set) / k of each block, weighted by its tags; blocks without k-mers on both sides do not count.

    Shares under 1e-9 count as that; the identity lies between 0 and 1. Pairs without such a block have no row.
    """
    n = block_kmers(spans, contigs, ids, k).where("n_query > 0 and n_reference > 0").join(spans.select(*ids, F.greatest(F.col(weight), F.lit(1)).alias("w")), ids)
    share = F.greatest(F.least(F.col("shared") / F.least("n_query", "n_reference"), F.lit(1.0)), F.lit(1e-9))
    local = F.greatest(F.least(1 + F.log(share) / k, F.lit(1.0)), F.lit(0.0))
    return n.groupBy("query", "reference").agg((F.sum(local * F.col("w")) / F.sum("w")).alias("kmer_ani"))


def tag_identity(a: Column, b: Column, length: int = 32) -> Column:
    """Share of equal bases of two tags."""
    return 1 - packed_mismatches(pack(a), pack(b), length) / length


def block_paf(blocks_: DataFrame) -> DataFrame:
    """Blocks as PAF lines with mapping quality 60."""
    span = F.greatest(F.col("q_end") - F.col("q_start"), F.col("r_end") - F.col("r_start")) + 32
    return blocks_.select(F.concat_ws("\t", "query", "q_contig", "q_start", "q_end", F.lit("+"), "reference", "r_contig", "r_start", "r_end", (F.col("n_tags") * 32).cast("string"), span.cast("string"), F.lit("60")).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each result row as a JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
