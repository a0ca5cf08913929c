"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A pattern can supply its words up to
``max_copies`` times; the k-th copy costs more than the one before (convex), so flow repeats a pattern only when nothing
fresher is left. Sources ask for their targets. The flow on this small graph says how many words of each pattern to take;
documents are then taken in a seeded order until the pattern's words are met.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import stored, whole_text

WEIGHTS, MAX_COPIES, SEED = (5, 2, 1), 3, 17
#: Most patterns the driver takes (a row of a few numbers each).
MAX_PATTERNS = 100_000
#: Documents of one sorted range of a pattern, about; ranges that are summed up together.
RANGE_DOCS, RANGES = 2000, 32


def code_point_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, total: int, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> dict:
    """Words wanted of each source: shares of ``total`` by weight, none above ``max_copies`` times the source's size.

    What is above is shared again, by weight, among the sources below their limit.
    """
    weight = {s: weights[i % len(weights)] for i, s in enumerate(code_point_order(sizes))}
    fixed: dict = {}
    while len(fixed) < len(sizes):
        rest = total - sum(fixed.values())
        open_weight = sum(w for s, w in weight.items() if s not in fixed)
        shares = {s: rest * w / open_weight for s, w in weight.items() if s not in fixed}
        above = {s: float(max_copies * sizes[s]) for s, share in shares.items() if share > max_copies * sizes[s]}
        if not above:
            return fixed | shares
        fixed |= above
    return fixed


def route(patterns: list[tuple[tuple, int]], wanted: dict, max_copies: int = MAX_COPIES) -> dict[tuple[int, int], int]:
    """Min-cost flow: words sent from pattern i to source j (both by position).

    ``patterns``: (sources, words). The k-th copy of a pattern costs 2k - 1 a word. Shortest paths are repeated on the
    residual graph until the targets are met or nothing more can be sent.
    """
    names = code_point_order(wanted)
    place = {s: j for j, s in enumerate(names)}
    n, start, end = len(patterns) + len(names) + 2, len(patterns) + len(names), len(patterns) + len(names) + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(u: int, v: int, c: int, price: int) -> int:
        for a, b, k, p in ((u, v, c, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b)
            cap.append(k)
            cost.append(p)
        return len(to) - 2

    routes = {}
    for i, (members, size) in enumerate(patterns):
        for k in range(1, max_copies + 1):
            arc(start, i, size, 2 * k - 1)
        for s in members:
            routes[i, place[s]] = arc(i, len(patterns) + place[s], size * max_copies, 0)
    for j, s in enumerate(names):
        arc(len(patterns) + j, end, round(wanted[s]), 0)
    height = [0] * n
    while True:
        dist, via = {start: 0}, {}
        heap, seen = [(0, start)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            for e in out[u]:
                if cap[e] > 0 and (new := d + cost[e] + height[u] - height[to[e]]) < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if end not in dist:
            break
        far = dist[end]
        height = [h + min(dist.get(v, far), far) for v, h in enumerate(height)]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        sent = min(cap[e] for e in path)
        for e in path:
            cap[e] -= sent
            cap[e ^ 1] += sent
    return {key: cap[e ^ 1] for key, e in routes.items() if cap[e ^ 1]}


def mix_sources(
    df: DataFrame, members: Column | None = None, text: str = "text", doc_id: str = "doc_id", weights=WEIGHTS,
    max_copies: int = MAX_COPIES, seed: int = SEED, max_patterns: int = MAX_PATTERNS, range_docs: int = RANGE_DOCS,
) -> DataFrame:
    """Add ``_size`` (words), ``_copies`` (times the row is taken), ``_source_size`` and ``_target`` to the rows of ``df``.

    ``members`` is an array of the sources a row belongs to (default: the ``source`` column; null is a source);
    ``_source_size`` and ``_target`` are those of the first. Rows of a pattern are taken in the order of a seeded hash of
    ``doc_id`` until its words are met, and then the largest row that still fits. The rule is a few numbers per pattern,
    so the rows themselves are not shuffled.

    The driver holds one row per pattern, at most ``max_patterns``; with more the job fails, for then the sources need
    grouping first. Rows without words are taken as often as their neighbours, which adds no words. Repeated rows of one
    id are taken alike. Null ids are rows like others; an empty table gives no rows.
    """
    session, id_type = df.sparkSession, df.schema[doc_id].dataType.simpleString()
    members = F.array(F.col("source")) if members is None else members
    rows = df.withColumns(
        {
            "_members": F.array_sort(F.array_distinct(members)),
            "_size": F.regexp_count(whole_text(text), F.lit("[^ \\t-\\r]+")).cast("long"),
            "_at": F.struct(F.xxhash64(F.col(doc_id), F.lit(seed)).alias("h"), F.col(doc_id).alias("id")),
        }
    ).withColumn("_pattern", F.to_json("_members"))
    slim = stored(rows.select("_pattern", "_members", "_size", "_at"))
    sums = stored(
        slim.groupBy("_pattern").agg(F.first("_members").alias("members"), F.sum("_size").alias("words"), F.count(F.lit(1)).alias("docs"))
    )
    if (found := sums.count()) > max_patterns:
        raise ValueError(f"{found} membership patterns; the driver takes {max_patterns}")
    patterns = sorted(sums.collect(), key=lambda r: r["_pattern"])
    sizes: dict = defaultdict(int)
    for r in patterns:
        for s in r["members"]:
            sizes[s] += r["words"]
    wanted = targets(sizes, sum(r["words"] for r in patterns), weights, max_copies)
    flow: dict = defaultdict(int)
    for (i, _), sent in route([(tuple(r["members"]), r["words"]) for r in patterns], wanted, max_copies).items():
        flow[i] += sent
    # whole copies of a pattern, and the words of one more
    whole = {r["_pattern"]: divmod(flow[i], r["words"]) if r["words"] else (0, 0) for i, r in enumerate(patterns)}
    ranges = max(1, sum(r["docs"] for r in patterns) // range_docs)

    def table(records, schema: str) -> DataFrame:
        return F.broadcast(session.createDataFrame(records, schema))

    # the range of hashes in which the words of the last copy run out
    in_range = F.least(F.floor((F.col("_at.h") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("long")
    slim = slim.withColumn("_range", in_range)
    rest = table([(p, part) for p, (_, part) in whole.items()], "_pattern string, _rest long")
    # running sums over a pattern's ranges in two levels: a large source has too many ranges for one task
    held = slim.groupBy("_pattern", "_range").agg(F.sum("_size").alias("_held")).withColumn("_many", F.floor(F.col("_range") / float(RANGES)))
    many = held.groupBy("_pattern", "_many").agg(F.sum("_held").alias("_all"))
    earlier = Window.partitionBy("_pattern").orderBy("_many").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("_pattern", "_many", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    inside_many = F.sum("_held").over(Window.partitionBy("_pattern", "_many").orderBy("_range"))
    held = held.withColumn("_to", inside_many).join(many, ["_pattern", "_many"]).withColumn("_to", F.col("_to") + F.col("_before"))
    edge = held.join(rest, "_pattern").filter((F.col("_to") > F.col("_rest")) & (F.col("_to") - F.col("_held") <= F.col("_rest")))
    edges = [(e["_pattern"], e["_range"], e["_rest"] - e["_to"] + e["_held"]) for e in edge.collect()]
    inside = slim.join(table(edges, "_pattern string, _range long, _left long"), ["_pattern", "_range"])
    used = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_at"))
    fits = inside.withColumn("_used", used).filter("_used <= _left").groupBy("_pattern").agg(F.max("_at").alias("last"), F.max("_used").alias("used"))
    last = {r["_pattern"]: (r["last"], r["used"]) for r in fits.collect()}
    rule = []
    for p, at, left in edges:
        (h, row_id), used_words = last.get(p, ((None, None), 0))
        rule.append((p, whole[p][0], at, p in last, h, row_id, left - used_words))
    rule_schema = f"_pattern string, _whole int, _edge long, _some boolean, _h long, _id {id_type}, _missing long"
    before = (F.col("_range") < F.col("_edge")) | (
        (F.col("_range") == F.col("_edge")) & F.col("_some") & (F.col("_at") <= F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")))
    )
    behind = slim.join(table(rule, rule_schema), "_pattern").filter(~before & (F.col("_size") > 0) & (F.col("_size") <= F.col("_missing")))
    fill = behind.groupBy("_pattern").agg(F.max(F.struct("_size", "_at")).alias("best"))
    fillers = [(r["_pattern"], r["best"]["_at"]["h"], r["best"]["_at"]["id"]) for r in fill.collect()]
    filler = table(fillers, f"_pattern string, _fh long, _fid {id_type}")
    info = table([(s is None, s or "", sizes[s], float(wanted[s])) for s in wanted], "_null boolean, _name string, _source_size long, _target double")
    chosen = rows.withColumn("_range", in_range).join(table(rule, rule_schema), "_pattern", "left").join(filler, "_pattern", "left")
    is_filler = (F.col("_at.h") == F.col("_fh")) & F.col("_at.id").eqNullSafe(F.col("_fid"))
    copies = F.coalesce(F.col("_whole") + before.cast("int") + (~before & F.coalesce(is_filler, F.lit(False))).cast("int"), F.lit(0))
    first = F.get("_members", 0)
    chosen = chosen.withColumns({"_copies": copies, "_null": first.isNull(), "_name": F.coalesce(first, F.lit(""))}).join(info, ["_null", "_name"], "left")
    return chosen.select(*df.columns, "_size", "_copies", "_source_size", "_target")
