"""The prefix trie of conversations, by union-find over the LCP edges of sorted neighbours.

A conversation is the sequence of its turns' digests.  Distinct sequences are sorted and
dealt by ranges.  In each range neighbours are joined by edges as deep as their longest
common prefix; taken from the deepest on, every edge merges two components, and a merge
below both of them makes a branching node.  Between branching nodes a path of single
children carries the same conversations, so its nodes follow from prefix sums.

A range knows all of a node but where the node goes on beyond the range: such nodes lie on
the path of its first or of its last sequence.  The range's forest is contracted to those
two paths, with what hangs on them summed, and adjacent forests are merged, GROUP at a
time, by the same union-find over the paths, until one is left.  No task sees more than a
range or GROUP pairs of paths.

Defined cases: null role or text is empty; a null turn comes first, turns of equal number
stand in the order of their digests; rows without a conv_id belong to no conversation;
repeated rows are turns of their own; an empty table has no nodes; extra columns are
ignored.  A conversation's digests (16 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, durable

#: Conversations that share their first turns, and how many turns at most.
FAMILY, SHARED = 20, 4
#: Forests that one task merges.
GROUP = 64
#: Conversation ids that are joined to one piece of a list of ends.
PIECE = 4096
EMPTY = hashlib.sha256().hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, base, turns): a row for each conversation, turns as structs of turn, key and words in order; base is the conversation whose first turns it may share."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"),
        (conv - conv % FAMILY).alias("base"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("key"),
            F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).cast("long").alias("words"),
        ).alias("t"),
    )
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, words) of every conversation after its first h turns became those of its family's first, h = crc32(conv_id) % 4."""
    family = Window.partitionBy("base")
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, SHARED - 1)), ignorenulls=True).over(family)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    rows = sequences(conversations).withColumns({"head": head, "h": h})
    none = F.slice("turns", 1, 0)
    rows = rows.withColumn("turns", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))))
    return rows.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))


def _piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each sequence's list, which come sorted; only the running digest is held."""
    kind = pa.schema([("sid", pa.string()), ("ends", pa.string())])
    held, running = None, None
    for batch in batches:
        for sid, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sid != held:
                if running:
                    yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([running.hexdigest()])], schema=kind)
                held, running = sid, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([running.hexdigest()])], schema=kind)


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(keys, words, n, conv, ends), written: a row for each different sequence with its conversations' number, smallest id and digest of their sorted ids.

    Ids are joined in pieces of PIECE ids' width before they meet, so a sequence that any
    share of the conversations repeats comes as few rows, and its digest runs over them.
    """
    sid = F.sha2(F.array_join(F.transform("keys", F.hex), "").cast("binary"), 256)
    placed = rows.withColumns({"sid": sid, "piece": F.floor(F.col("conv_id") / PIECE)})
    joined = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = placed.groupBy("sid", "piece").agg(joined.alias("ids"), F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words"))
    pieces = durable(pieces)
    found = pieces.groupBy("sid").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("pieces"), F.first("keys").alias("keys"), F.first("words").alias("words"), F.first("ids").alias("ids")
    )
    found = durable(found)
    several = found.where("pieces > 1").select("sid")
    running = pieces.join(several, "sid", "left_semi").select("sid", "ids", "piece").repartition("sid").sortWithinPartitions("sid", "piece")
    digests = running.select("sid", "ids").mapInArrow(_piece_digests, "sid string, ends string")
    alone = found.where("pieces = 1").withColumn("ends", F.sha2(F.col("ids").cast("binary"), 256))
    columns = ["keys", "words", "n", "conv", "ends"]
    out = durable(alone.select(*columns).union(found.where("pieces > 1").join(digests, "sid").select(*columns)))
    discard(pieces, found)
    return out


# -- one forest ------------------------------------------------------------------------

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest binary, parent_digest binary"
_HANGS = "array<struct<depth: long, n: long, conv: long, children: long, leaves: long, saved: long, ends: string>>"
_OUT = f"{_NODE}, forest long, side int, keys array<binary>, words array<long>, hangs {_HANGS}"
_HANG = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("digest", pa.binary()), ("parent_digest", pa.binary()), ("forest", pa.int64()), ("side", pa.int32())]
    + [("keys", pa.list_(pa.binary())), ("words", pa.list_(pa.int64())), ("hangs", pa.list_(_HANG))]
)


def merge_components(depth: list[int], lcp: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Depth, parent (-1 for the top), first and last item of each node of the contracted trie over sorted items.

    The first nodes are the items themselves; lcp[i] is the common prefix of items i - 1 and
    i.  Edges are taken by descending depth, from left to right among equals, so the left
    component's top may already be the node at that depth, and the right one's never is.
    """
    depth, m = list(depth), len(depth)
    parent, low, high = [-1] * m, list(range(m)), list(range(m))
    joined, top = list(range(m)), list(range(m))

    def find(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    for e in sorted(range(1, m), key=lambda e: -lcp[e]):
        a, b = find(e - 1), find(e)
        u, v, at = top[a], top[b], lcp[e]
        if depth[u] != at:
            parent[u] = len(depth)
            depth.append(at)
            parent.append(-1)
            low.append(low[u])
            u = len(depth) - 1
            high.append(-1)
        parent[v], high[u] = u, high[v]
        joined[b], top[a] = a, u
    return depth, parent, low, high


def _prefix_digests(keys: list[bytes]) -> list[bytes]:
    running, out = hashlib.sha256(), []
    out.append(running.digest())
    for k in keys:
        running.update(k)
        out.append(running.digest())
    return out


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def forest(paths: list[tuple[list[bytes], list[int]]], hangs: list[list[tuple]], number: int, close: bool, known: bool) -> Iterator[pa.RecordBatch]:
    """Nodes that are whole, and unless ``close`` the two paths that hold the others.

    paths: sorted, distinct (keys, words); hangs: for each its (depth, n, conv, children,
    leaves, saved, ends) by depth, the last at its end.  known: nodes get their digests.
    """
    if not paths:
        return
    shared = [-1] + [_common(a[0], b[0]) for a, b in zip(paths, paths[1:], strict=False)]
    # What hangs where paths run together belongs to the first of them.
    owned: list[dict[int, list[tuple]]] = [{} for _ in paths]
    for j, mine in enumerate(hangs):
        for hang in mine:
            k = j
            while hang[0] <= shared[k]:
                k -= 1
            owned[k].setdefault(hang[0], []).append(hang)
    item_path, item_depth, lcp, at_end = [], [], [], []
    for j, mine in enumerate(owned):
        for d in sorted(mine):
            lcp.append(shared[j] if not item_path or item_path[-1] != j else item_depth[-1])
            item_path.append(j)
            item_depth.append(d)
        at_end.append(len(item_path) - 1)
    # The end of a path that is the beginning of the next one is an item of its own; of others lcp may reach back over several.
    depth, parent, low, high = merge_components(item_depth, lcp)
    size = len(depth)
    first, last = (-1, -1) if close else (at_end[0], at_end[-1])
    is_open = [low[v] <= first <= high[v] or low[v] <= last <= high[v] for v in range(size)]
    sums = [np.concatenate(([0], np.cumsum(np.array(w, np.int64)))) for _, w in paths]
    n, conv, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    ends: list[str | None] = [None] * size
    for i, (j, d) in enumerate(zip(item_path, item_depth, strict=True)):
        for _, n1, conv1, children1, leaves1, saved1, ends1 in owned[j][d]:
            n[i] += n1
            conv[i] = conv1 if conv[i] is None else conv[i] if conv1 is None else min(conv[i], conv1)
            children[i] += children1
            leaves[i] += leaves1
            saved[i] += saved1
            ends[i] = ends1 or ends[i]
    for v in sorted(range(size), key=lambda v: -depth[v]):
        u = parent[v]
        if is_open[v]:
            continue
        leaves[v] = leaves[v] if children[v] else 1
        if u >= 0:
            sofar = sums[item_path[low[v]]]
            n[u] += n[v]
            conv[u] = conv[v] if conv[u] is None else min(conv[u], conv[v])
            children[u] += 1
            leaves[u] += leaves[v]
            saved[u] += saved[v] + (n[v] - 1) * int(sofar[depth[v]] - sofar[depth[u]])
    ways = {} if not known and close else {j: _prefix_digests(paths[j][0]) for j in (range(len(paths)) if known else {0, len(paths) - 1})}
    yield from _closed([v for v in range(size) if not is_open[v]], depth, parent, low, item_path, n, conv, children, leaves, saved, ends, is_open, sums, ways, known)
    if close:
        return
    kept = []
    for side, j, end in ((0, 0, first), (1, len(paths) - 1, last)):
        if side and len(paths) == 1:
            break
        on = [v for v in range(size) if low[v] <= end <= high[v] and not (side and low[v] <= first <= high[v])]
        mine = [(depth[v], n[v], conv[v], children[v], leaves[v], saved[v], ends[v]) for v in sorted(on, key=lambda v: depth[v])]
        kept.append((j, [dict(zip(_HANG.names, h, strict=True)) for h in mine if h[1] or h[3] or h[6]]))
    sides = len(kept)
    none = {f.name: pa.nulls(sides, f.type) for f in _ARROW}
    none |= {"forest": pa.array([number] * sides, pa.int64()), "side": pa.array(range(sides), pa.int32())}
    none |= {"keys": pa.array([paths[j][0] for j, _ in kept], _ARROW.field("keys").type), "words": pa.array([list(paths[j][1]) for j, _ in kept], _ARROW.field("words").type)}
    none["hangs"] = pa.array([h for _, h in kept], _ARROW.field("hangs").type)
    yield pa.RecordBatch.from_arrays([none[f.name] for f in _ARROW], schema=_ARROW)


def _closed(whole, depth, parent, low, item_path, n, conv, children, leaves, saved, ends, is_open, sums, ways, known) -> Iterator[pa.RecordBatch]:
    """Rows of whole nodes and of the nodes above them on their ways, up to the next branching node."""
    for start in range(0, len(whole), 1 << 14):
        some = whole[start : start + (1 << 14)]
        v = np.array(some, np.int64)
        top = np.array([depth[parent[x]] if parent[x] >= 0 else -1 for x in some], np.int64)
        end = np.array([depth[x] for x in some], np.int64)
        each = end - top
        stop = np.cumsum(each)
        row = np.repeat(np.arange(len(v)), each)
        d = top[row] + 1 + np.arange(int(stop[-1])) - (stop - each)[row]
        get = lambda values: np.array([values[x] for x in some], np.int64)
        members, ids, is_end = get(n), get(conv), d == end[row]
        till = np.array([sums[item_path[low[x]]][depth[x]] for x in some], np.int64)
        above = np.concatenate([sums[item_path[low[x]]][np.maximum(np.arange(t, e), 0)] for x, t, e in zip(some, top.tolist(), end.tolist(), strict=True)])
        begin = d == top[row] + 1
        up = [parent[x] for x in some]
        known_up = np.array([conv[u] if u >= 0 and not is_open[u] else 0 for u in up], np.int64)
        no_up = np.array([u < 0 or is_open[u] for u in up])
        lost = begin & no_up[row]
        parents = pa.array(np.where(begin, known_up[row], ids[row]), mask=lost)
        end_list = [ends[x] or EMPTY for x in some]
        r, e = row.tolist(), is_end.tolist()
        mark = pa.nulls(len(r), pa.binary())
        if known:
            mark = pa.array([ways[item_path[low[some[k]]]][x] for k, x in zip(r, d.tolist(), strict=True)], pa.binary())
        up_mark = pa.array([ways[item_path[low[up[k]]] if known else 0 if item_path[low[up[k]]] == 0 else max(ways)][depth[up[k]]] if x and up[k] >= 0 else None for k, x in zip(r, lost.tolist(), strict=True)], pa.binary())
        size = len(r)
        columns = {
            "conv_id": pa.array(ids[row]), "depth": pa.array(d), "parent_conv_id": parents, "n_convs": pa.array(members[row]),
            "n_children": pa.array(np.where(is_end, get(children)[row], 1)), "n_leaves": pa.array(get(leaves)[row]),
            "saved_tokens": pa.array(get(saved)[row] + (members[row] - 1) * (till[row] - above)),
            "ends_sha256": pa.array([end_list[k] if x else EMPTY for k, x in zip(r, e, strict=True)]), "digest": mark, "parent_digest": up_mark,
        }
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


# -- the whole trie --------------------------------------------------------------------


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, hangs = [], []
    for batch in batches:
        for keys, words, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            paths.append((keys, words))
            hangs.append([(len(keys), n, conv, 0, 0, 0, ends)])
    yield from forest(paths, hangs, TaskContext.get().partitionId(), close=False, known=False)


def _merger(group: int, close: bool):
    def merge(some: pa.Table) -> pa.Table:
        rows = sorted(some.to_pylist(), key=lambda r: (r["forest"], r["side"]))
        paths = [(r["keys"], r["words"]) for r in rows]
        hangs = [[tuple(h[k] for k in _HANG.names) for h in r["hangs"]] for r in rows]
        return pa.Table.from_batches(forest(paths, hangs, rows[0]["forest"] // group, close, known=True), _ARROW)

    return merge


def conversation_trie(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie_of(rebuilt(conversations), group)


def trie_of(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """The trie of any (conv_id, keys, words), with distinct conv_ids."""
    distinct = distinct_sequences(rows)
    dealt = distinct.repartitionByRange("keys").sortWithinPartitions("keys")
    level = durable(dealt.mapInArrow(_ranges, _OUT))
    levels = [level]
    while True:
        open_paths = level.where("forest is not null")
        most = open_paths.agg(F.max("forest")).first()[0]
        if most is None:
            break
        close = most < group
        grouped = open_paths.groupBy(F.floor(F.col("forest") / group).alias("g"))
        level = durable(grouped.applyInArrow(_merger(group, close), _OUT))
        levels.append(level)
        if close:
            break
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = levels[0].where("forest is null")
    for more in levels[1:]:
        nodes = nodes.union(more.where("forest is null"))
    late = nodes.where("digest is not null").select(F.col("digest").alias("found"), F.col("conv_id").alias("above"))
    direct = nodes.where("parent_digest is null").select(*names)
    missing = nodes.where("parent_digest is not null").join(late, F.col("parent_digest") == F.col("found"))
    discard(distinct)
    return direct.union(missing.withColumn("parent_conv_id", F.col("above")).select(*names))
