"""Exact n-gram Jaccard join with set-relation skipping.

1. Equal sets are one node (their 128-bit prints are equal). A slice of texts sends a set once, however often it holds it;
   what several slices send of one set is added up to one row for each shingle before sets meet.
2. Index lists. If |A & B| >= t |A | B| then A lacks at most K(n) = (1 - t) n of its n shingles in B. Of both sets the
   K + K / 4 + 1 shingles of least hash (the portion) therefore have K(least possible partner) / 4 + 1 in common, and
   these sets have a common shingle among their first ones in any order. The order is by frequency, rare first, so a
   set whose first shingles occur nowhere else has no partner and leaves the search; others are in the lists of their
   first shingles. Frequencies are counted by hash buckets: slices of texts send each distinct shingle once.
3. Block skip. A list is a block of sets of one shingle with its least size known: sets that stand in it at a position
   beyond which too few shingles of the portion are left for that size are skipped.
4. Answers from a similar set's answers. The least set of a list leads it; lists of one leader make one group, which all
   pairs of those lists are in. There, sets are reduced to what they add to the leader and what they lack of it, and
   |A & B| = |L| - |lacks A| - |lacks B| + |both lack| + |both add|: no pair is counted from whole sets. Groups up to
   MEMBERS sets are done at once. Larger ones are cut into blocks which all hold the leader; sets that got into its
   component have each other's answers and are skipped as pairs, the others meet the rest block by block.

Links are decided on whole shingle sets. A task gives a spanning forest of its links, so what it emits grows with its sets
and not with its pairs, but in a group over MEMBERS whose sets mostly aren't linked, sets are sent to a task for each block
that they meet. No list, group or number of partners is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.components import components
from threadloom.llm.shared import discard, documents, small_side, stored, unused
from threadloom.llm.shingles import shingle_sets
from threadloom.llm.wordgrid import mix, slices, words

WORDS, PERCENT = 4, 85
MEMBERS, ELEMENTS = 1024, 2 << 20  # sets, and shingles of sets, in one block of a group
BUCKET, OWNERS = 250_000, 8 << 20  # portion shingles in a hash bucket (more for a large corpus), and in one part of it
INDEX_BYTES = 4 << 20  # text in a slice that counts its distinct shingles
SET_BYTES = 1 << 20  # text in a slice whose sets are taken one by one, so that its length is a matter of memory only
SPARSE = 6  # holders up to which a shingle's pairs of sets are listed one by one


def lacking(n, percent: int):
    """K(n): most shingles that a set of n may lack in a partner."""
    return (100 - percent) * n // 100


def portion(n, percent: int):
    return lacking(n, percent) + lacking(n, percent) // 4 + 1


def _sql(rule, n: Column, percent: int) -> Column:
    k = F.floor((100 - percent) * n / 100)
    return k if rule is lacking else k + F.floor(k / 4) + 1


def _least_common(n: Column, percent: int) -> Column:
    """Portion shingles that a set of n has in common with any partner at least."""
    return F.floor(F.floor((100 - percent) * F.ceil(n * percent / 100) / 100) / 4) + 1


def _packed(values: np.ndarray) -> bytes:
    """48-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' 48-bit numbers, and how many each row has."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in column.to_pylist()]
    out = np.zeros((sum(map(len, raw)), 8), np.uint8)
    if raw:
        out[:, :6] = np.concatenate(raw)
    return out.view("<u8").ravel(), np.array([len(x) for x in raw], np.int64)


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Set size and a 128-bit print of the set."""
        for b in slices(batches, most=SET_BYTES):
            s = shingle_sets(words(b.column("text")), size)
            yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(s.sizes), pa.array(s.prints(1)), pa.array(s.prints(2))], ["doc_id", "key", "n_shingles", "f1", "f2"])

    return run


def _indexed(size: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Portions of the distinct sets of a slice by bucket: distinct values, how many sets have each, and which."""
        for b in slices(batches, most=INDEX_BYTES):
            s = shingle_sets(words(b.column("text")), size)
            f1, n = s.prints(1), s.sizes
            fresh = np.zeros(len(n), dtype=bool)
            fresh[np.unique(f1, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(n)), n)
            rank = np.arange(len(owner)) - s.first[:-1][owner]
            at = np.flatnonzero((rank < portion(n, percent)[owner]) & fresh[owner])
            value, owner = s.values[at] >> np.uint64(16), owner[at]
            bucket = (mix(value) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((value, bucket))
            value, owner, bucket = value[order], owner[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1)) if buckets < 4096 else None
            starts = np.flatnonzero(np.diff(cut)) if cut is not None else np.unique(bucket, return_index=True)[1]
            spans = [(int(cut[k]), int(cut[k + 1])) for k in starts] if cut is not None else list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]))
            out = {"bucket": [], "values": [], "times": [], "owner": [], "ids": []}
            for a, z in spans:
                distinct, times = np.unique(value[a:z], return_counts=True)
                ids, own = np.unique(owner[a:z], return_inverse=True)
                for name, x in (("bucket", int(bucket[a])), ("values", _packed(distinct)), ("times", times.astype("<u4").tobytes()), ("owner", own.astype("<u4").tobytes()), ("ids", f1[ids].astype("<i8").tobytes())):
                    out[name].append(x)
            if out["bucket"]:
                salt = np.full(len(out["bucket"]), int(f1[fresh][0]) & 0x7FFFFFFF)
                yield pa.record_batch([pa.array(out["bucket"], pa.int32()), pa.array(salt, pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("values", "times", "owner", "ids"))], ["bucket", "salt", "values", "times", "owner", "ids"])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """The values of one bucket that more than one set has, with their numbers of sets."""
    value, _ = _unpacked(table.column("values"))
    times = _numbers(table.column("times"), "<u4")
    distinct, at = np.unique(value, return_inverse=True)
    total = np.bincount(at.ravel(), weights=times, minlength=len(distinct)).astype(np.uint64)
    keep = total > 1
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "values": pa.array([_packed(distinct[keep])], pa.binary()), "total": pa.array([np.minimum(total[keep], 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary()), "owners": pa.array([int(total.sum())], pa.int64())})


def _shared(rows: pa.Table, known: pa.Table) -> pa.Table:
    """(f1, h, total) of the shared values of one part of a bucket."""
    value, n = _unpacked(rows.column("values"))
    shared, _ = _unpacked(known.column("values"))
    total, times = _numbers(known.column("total"), "<u4"), _numbers(rows.column("times"), "<u4")
    ids, owner = rows.column("ids").to_pylist(), rows.column("owner").to_pylist()
    if not len(shared) or not len(value):
        return pa.table({c: pa.array([], pa.int64()) for c in ("f1", "h", "total")})
    at = np.searchsorted(shared, value)
    at[at == len(shared)] = 0
    hit = shared[at] == value
    f1 = np.concatenate([np.frombuffer(x, "<i8")[np.frombuffer(o, "<u4")] for x, o in zip(ids, owner)])
    pick = np.repeat(hit, times)
    return pa.table({"f1": f1[pick], "h": np.repeat(value, times)[pick].astype(np.int64), "total": np.repeat(total[at], times)[pick].astype(np.int64)})


def postings(row: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(h, node, n, pos): the lists of each set's first portion shingles, rare first, that other sets have too."""
    total = nodes.agg(F.sum(_sql(portion, F.col("n"), percent))).first()[0] or 0
    buckets = max(1, -(-int(total) // min(max(BUCKET, int(total) // 1000), 32 * BUCKET)))
    rows = row.mapInArrow(_indexed(size, percent, buckets), "bucket int, salt int, values binary, times binary, owner binary, ids binary")
    known = stored(rows.select("bucket", "values", "times").groupBy("bucket").applyInArrow(_frequencies, "bucket int, values binary, total binary, owners long"), "set-frequencies")
    known = known.withColumn("parts", F.ceil(F.col("owners") / OWNERS).cast("int"))
    hot = F.broadcast(known.where("parts > 1").select("bucket", "parts"))  # a row for each OWNERS portion shingles at most
    rows = rows.join(hot, "bucket", "left").withColumn("part", F.pmod("salt", F.coalesce("parts", F.lit(1))))
    spread = known.select("bucket", "values", "total", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    shared = rows.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInArrow(_shared, "f1 long, h long, total long")
    shared = shared.groupBy("f1", "h").agg(F.max("total").alias("total"))  # copies in several slices are one set
    by = Window.partitionBy("f1", "node")
    placed = shared.join(nodes.select("f1", "node", "n"), "f1").withColumns({"others": _sql(portion, F.col("n"), percent) - F.count("*").over(by), "rank": F.row_number().over(by.orderBy("total", "h"))})
    pos = F.col("others") + F.col("rank") - 1
    keep = pos <= _sql(portion, F.col("n"), percent) - _least_common(F.col("n"), percent)
    return stored(placed.where(keep).select("h", "node", "n", pos.cast("int").alias("pos")), "set-postings")


def groups(lists: DataFrame, percent: int) -> DataFrame:
    """(node, leader) of every set in a list whose first, the least of the list, is leader; less what positions exclude."""
    lead = lists.groupBy("h").agg(F.min(F.struct("n", "node")).alias("lead"), F.count("*").alias("sets")).where("sets > 1").select("h", F.col("lead.n").alias("least"), F.col("lead.node").alias("leader"))
    k = F.floor(F.floor((100 - percent) * F.col("least") / 100) / 4) + 1
    left = _sql(portion, F.col("n"), percent) - F.col("pos")
    return stored(lists.join(lead, "h").where(F.col("node") != F.col("leader")).where(left >= k).select("node", "leader").distinct(), "set-groups")


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SET_BYTES):
            s = shingle_sets(words(b.column("text")), size)
            yield pa.record_batch([b.column("node"), pa.array(s.sizes), b.column("places"), pa.array([s.of(i).tobytes() for i in range(b.num_rows)], pa.binary())], ["node", "n", "places", "elements"])

    return run


def _common(sets: list[np.ndarray], base: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, from what the sets lack of base and add to it."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    value = np.concatenate(sets)
    at = np.searchsorted(base, value)
    at[at == len(base)] = 0
    inside = base[at] == value
    lack = np.ones((m, len(base)), dtype=np.float32)
    lack[row[inside], at[inside]] = 0
    n_lack = lack.sum(axis=1)
    lack = lack[:, lack.sum(axis=0) > 1]
    common = len(base) - n_lack[:, None] - n_lack[None, :] + lack @ lack.T
    np.fill_diagonal(common, len(base) - n_lack)
    added, row = value[~inside], row[~inside]
    order = np.argsort(added, kind="stable")
    added, row = added[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], added[1:] != added[:-1]])) if len(added) else np.zeros(0, np.int64)
    holders = np.diff(np.append(begin, len(added)))
    for k in range(2, SPARSE + 1):
        of = begin[holders == k]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(common, (row[of + i], row[of + j]), 1)
                np.add.at(common, (row[of + j], row[of + i]), 1)
    dense = np.flatnonzero(holders > SPARSE)
    for a in range(0, len(dense), 4096):
        pick = dense[a : a + 4096]
        n = holders[pick]
        column = np.repeat(np.arange(len(pick)), n)
        cells = np.zeros((m, len(pick)), dtype=np.float32)
        cells[row[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[pick], n)], column] = 1
        cells = cells @ cells.T
        np.fill_diagonal(cells, 0)
        common += cells
    return common


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A spanning forest of the links between sets of different components in one block of a group."""
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        n, comp = (table.column(c).to_numpy()[at] for c in ("n", "comp"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("elements").take(pa.array(at)).to_pylist()]
        first = np.arange(len(node))
        if len(node) > 1:
            lead = np.flatnonzero(node == table.column("leader")[0].as_py())
            common = _common(sets, sets[lead[0] if len(lead) else int(np.argmin(n))])
            linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comp[:, None] != comp[None, :])
            while True:  # the least node that each one reaches
                least = np.minimum(first, np.where(linked, first[None, :], len(node)).min(axis=1))
                least = least[least]
                if (least == first).all():
                    break
                first = least
        moved = np.flatnonzero(first != np.arange(len(node)))
        return pa.table({"a": node[moved].astype(np.int64), "b": node[first[moved]].astype(np.int64)})

    return run


def _compare(row: DataFrame, nodes: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """places (node, leader, p, q, comp): links among the sets of each (leader, p, q), computed from their texts."""
    places = stored(places, "set-places")
    wanted = places.groupBy("node").agg(F.collect_list(F.struct("leader", "p", "q", "comp")).alias("places")).join(nodes.select("node", "doc", "key"), "node")
    wanted = small_side(wanted.withColumnRenamed("key", "its"), places.count(), 80)
    text = row.join(wanted, (F.col("key") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "places", "text")
    sets = text.mapInArrow(_elements(size), "node long, n long, places array<struct<leader:long,p:int,q:int,comp:long>>, elements binary")
    sets = sets.select("node", "n", "elements", F.explode("places").alias("at")).select("at.*", "node", "n", "elements")
    edges = stored(sets.groupBy("leader", "p", "q").applyInArrow(_links(percent), "a long, b long"), "set-links")
    discard(places)
    return edges


def _blocks(count: str, elements: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / MEMBERS), F.ceil(F.col(elements) / ELEMENTS), F.lit(1)).cast("int")


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prints (doc_id, key, n_shingles, f1, f2) of every row; nodes (node, f1, f2, n, doc, key), the distinct sets, each with
    a row that has it; edges (a, b) between nodes, which connect exactly what the links between sets connect.

    percent is 60 at least."""
    if percent < 60:
        raise ValueError("the portions of the search need 60 percent at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    prints = stored(row.mapInArrow(_prints(size), "doc_id long, key long, n_shingles long, f1 long, f2 long"), "set-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = prints.where("n_shingles > 0").groupBy("f1", "f2").agg(F.max("n_shingles").alias("n"), least.alias("least"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", F.col("least.doc_id").alias("doc"), F.col("least.key").alias("key")), "set-nodes")
    lists = postings(row, nodes, size, percent)
    member = groups(lists, percent)
    member = member.union(member.select("leader", "leader").distinct()).join(nodes.select("node", "n"), "node")
    sized = stored(member.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).select("leader", _blocks("sets", "elements").alias("blocks")).where("blocks > 1"), "set-large")
    n_large = sized.count()  # a row for each MEMBERS places of sets, or ELEMENTS shingles of them, at most
    member = stored(member.join(small_side(sized, n_large, 40), "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "set-members")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    block = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    edges = _compare(row, nodes, member.select("node", "leader", F.explode(block).alias("p")).select("node", "leader", "p", F.col("p").alias("q"), F.col("node").alias("comp")), size, percent)
    if not n_large:
        return prints, nodes, edges
    comp = stored(components(edges), "set-components")
    of = lambda name: comp.select(F.col("id").alias(name), F.col("component").alias(f"{name}_in"))
    lead = small_side(sized.join(of("leader"), "leader", "left").select("leader", F.coalesce("leader_in", "leader").alias("its")), n_large, 40)
    large = member.where("blocks > 1").join(of("node"), "node", "left").withColumn("comp", F.coalesce("node_in", "node")).join(lead, "leader")
    large = large.select("node", "leader", "n", "comp", (F.col("comp") != F.col("its")).alias("apart"))
    one = lambda c, apart: F.coalesce(F.sum(F.when(F.col("apart") == apart, c)), F.lit(0))
    sides = large.groupBy("leader").agg(one(F.lit(1), False).alias("in_n"), one(F.col("n"), False).alias("in_e"), one(F.lit(1), True).alias("out_n"), one(F.col("n"), True).alias("out_e")).where("out_n > 0")
    sides = sides.select("leader", _blocks("in_n", "in_e").alias("inner"), _blocks("out_n", "out_e").alias("outer"))
    large = large.join(small_side(sides, n_large, 40), "leader")
    own = F.when(F.col("apart"), F.col("inner") + F.pmod(F.xxhash64("node"), F.col("outer"))).otherwise(F.pmod(F.xxhash64("node"), F.col("inner"))).cast("int")
    partners = F.sequence(F.when(F.col("apart"), 0).otherwise(F.col("inner")), F.col("inner") + F.col("outer") - 1)
    met = large.select("node", "leader", "comp", own.alias("own"), F.explode(partners).alias("other"))
    met = met.select("node", "leader", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "comp")
    return prints, nodes, edges.union(_compare(row, nodes, met, size, percent))


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """prints with doc and text, the least id (null last) and text hash of the component; some is null for rows without
    shingles."""
    prints, nodes, edges = links(docs, size, percent)
    comp = components(edges).withColumnRenamed("id", "node")
    named = stored(nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "set-named")
    least = stored(named.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("least")), "set-least")
    named = named.select("f1", "f2", "component").join(least, "component").select("f1", "f2", F.col("least.doc").alias("doc"), F.col("least.key").alias("text"), F.lit(True).alias("some"))
    return prints.join(named, ["f1", "f2"], "left")


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A null or empty text has no shingles and links with nothing; fewer words than a shingle are one shingle. Rows count
    by their texts: those that repeat an id link each for itself. component_id is the least id of the component, null if
    all of its ids are. Other columns are ignored; an empty table gives no rows."""
    return _placed(docs, size, percent).select("doc_id", "n_shingles", F.when(F.col("some"), F.col("doc")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, less all of a component but the one of least id (of equal ids the least text hash).

    Rows are told apart by id and text: a null or repeated id is no reason to go, a repeated row is. Rows without
    shingles are no copies of anything and stay. Columns may have any names; an empty table stays empty."""
    placed = stored(_placed(docs, size, percent).where("some").select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("text"))).alias("stays")), "set-placed")
    gone = placed.where("not stays").select("doc_id", "key")
    again = stored(placed.where("stays").groupBy("doc_id", "key").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "key"), "set-again")
    id_, key, nth = unused("id_", docs), unused("key_", docs), unused("nth_", docs)
    bare = unused("bare_", docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), key: F.xxhash64(text)})

    def meets(other: DataFrame, how: str, of: DataFrame) -> DataFrame:
        side = small_side(other.select(F.col("doc_id").alias(nth), F.col("key").alias(bare)), other.count(), 40)
        return of.join(side, (F.col(key) == F.col(bare)) & F.col(id_).eqNullSafe(F.col(nth)), how)

    rows = meets(gone, "left_anti", rows)
    if not again.isEmpty():
        twice = meets(again, "left_semi", rows)
        once = twice.withColumn(nth, F.row_number().over(Window.partitionBy(id_, key).orderBy(key))).where(F.col(nth) == 1).drop(nth)
        rows = meets(again, "left_anti", rows).unionByName(once)
    return rows.select(docs.columns)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at Jaccard 0.85 of four-word shingles; see jaccard_components for nulls and ties."""
    return jaccard_components(documents(spark, sf_dir))
