"""Near-duplicate documents: HyperMinHash candidates, confirmed on full shingle sets, and their connected components.

Exact copies of a shingle set are one class from the start. Classes meet in buckets (equal bands of registers, and equal
prefix hashes of small sets). Instead of all pairs of a bucket, first each member is tried with the centre of each of
its buckets; from then on only members of different components are compared, block by block. So a large group of copies
makes as many pairs as it has members, and yet no bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyperminhash as H
from ._batches import map_arrow, slices
from ._store import materialize
from .components import connected_components

WIDTH = 5
PERCENT = 80
#: Members of a bucket that are compared with others in one block.
BLOCK = 256
#: Ids that are broadcast at most, to pick texts; with more, texts are dealt by id.
BROADCAST_IDS = 1_000_000


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, hash (of the text), n (set size), cls (128-bit digest of the set, null if empty), regs, keys (by which
    candidates meet) of each row."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = H.shingle_sets(part.column("text").to_pylist(), width)
            regs = H.registers(sets)
            keys = H.candidate_keys(sets, regs, percent)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                ],
                names=["doc_id", "hash", "n", "cls", "regs", "keys"],
            )

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), run, "doc_id long, hash long, n long, cls binary, regs binary, keys array<long>")


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, H.REGISTERS)


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) whose registers promise a similarity of ``least``, with their estimate."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(batches):
        for b in batches:
            est = H.estimate(*(_registers(b.column(f"regs_{c}")) for c in "xy"), *(b.column(f"n_{c}").to_numpy() for c in "xy"))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(est)], names=["x", "y", "est"]).filter(pa.array(est >= least))

    return map_arrow(both.select("x", "y", "n_x", "n_y", "regs_x", "regs_y"), run, "x long, y long, est double")


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(one) + len(two) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (x, y) whose full shingle sets are similar enough."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")

    def run(batches):
        for b in slices(batches, "text_x"):
            one, two = b.column("text_x").to_pylist(), b.column("text_y").to_pylist()
            own = list(dict.fromkeys([*one, *two]))
            sets = dict(zip(own, H.shingle_sets(own, width)))
            keep = [_similar(s, t, percent) for s, t in zip(map(sets.get, one), map(sets.get, two))]
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "x long, y long")


def _open_buckets(own: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, node, root) of the buckets that span several components, and these buckets (key, main, n_main, n_all).

    Buckets are tables of their own before they are joined, so that a large one's members can be dealt to many tasks.
    """
    sizes = own.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    sizes = materialize(sizes.where("n_main < n_all"), f"{name}-sizes")
    return materialize(own.join(sizes.select("key"), "key", "left_semi"), name), sizes


def _open_units(members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that span several components, dealt into units (u) of two blocks that are to be compared.

    A bucket's largest component is dealt into blocks, and so are its other members; the blocks of the others are
    compared with each other and with those of the largest, which are never compared among themselves.
    """
    own = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    own, sizes = _open_buckets(own, "open-members")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    rows = own.join(sizes, "key").select(
        "key", "node", "root", (F.col("root") == F.col("main")).alias("is_main"),
        blocks(F.col("n_main")).alias("mains"), blocks(F.col("n_all") - F.col("n_main")).alias("others"),
    )
    lot = F.xxhash64("node", "key")
    b = F.when(F.col("is_main"), F.pmod(lot, F.col("mains"))).otherwise(F.pmod(lot, F.col("others"))).cast("int")
    count = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    units = F.when(F.col("is_main"), count("others", lambda i: unit(1, i, F.col("b")))).otherwise(
        F.concat(count("mains", lambda j: unit(1, F.col("b"), j)), count("others", lambda j: unit(0, F.least(F.col("b"), j), F.greatest(F.col("b"), j))))
    )
    rows = rows.withColumn("b", b).select("key", "node", "root", "is_main", "b", F.explode(units).alias("unit"))
    return rows.select(F.xxhash64("key", "unit").alias("u"), "node", "root", "is_main", "b", F.col("unit.kind").alias("kind"))


def _by_unit(rows: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` each unit's rows, which are one Arrow table; yields record batches."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            u = t.column("u").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(u)) + 1).tolist(), len(u)]
            for i, j in zip(cuts, cuts[1:]):
                if j - i > 1:
                    yield from compare(t.slice(i, j - i).combine_chunks())

        for batch in batches:
            u = batch.column("u").to_numpy()
            # The last unit of a batch may go on in the next one.
            last = int(np.searchsorted(u, u[-1])) if len(u) else 0
            if last:
                held.append(batch.slice(0, last))
                yield from flush()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flush()

    return map_arrow(rows.repartition("u").sortWithinPartitions("u"), run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    main, b = t.column("is_main").to_numpy(zero_copy_only=False), t.column("b").to_numpy()
    if t.column("kind")[0].as_py():
        return np.flatnonzero(~main), np.flatnonzero(main)
    return np.flatnonzero(b == b.min()), np.flatnonzero(b == b.max())


def _estimates(t: pa.Table, regs: np.ndarray, n: np.ndarray, least: float, percent: int):
    """(row, other rows, their estimates) of likely pairs across components."""
    root = t.column("root").to_numpy()
    left, right = _sides(t)
    for a in left.tolist():
        r = right[(root[right] != root[a]) & (100 * np.minimum(n[right], n[a]) >= percent * np.maximum(n[right], n[a]))]
        if len(r):
            est = H.estimate(regs[a][None, :], regs[r], np.full(len(r), n[a]), n[r])
            if (est >= least).any():
                yield a, r[est >= least], est[est >= least]


_UNIT = "u long, node long, root long, is_main boolean, b int, kind int"


def _across(members: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (x, y) between members of one bucket in different components.

    Units are first thinned by registers to the members with a likely partner across components; these bring their texts
    and are compared in full, the likeliest partner first, until a member has one link to each other component.
    """
    least = percent / 100 - H.slack(percent)
    units = _open_units(members, roots, classes).join(classes.select("node", "n", "regs"), "node")

    def thin(t: pa.Table):
        keep = np.zeros(len(t), dtype=bool)
        for a, r, _ in _estimates(t, _registers(t.column("regs")), t.column("n").to_numpy(), least, percent):
            keep[a] = keep[r] = True
        if keep.any():
            yield from t.select(["u", "node", "root", "is_main", "b", "kind"]).filter(pa.array(keep)).combine_chunks().to_batches()

    likely = materialize(_by_unit(units.select("u", "node", "root", "is_main", "b", "kind", "n", "regs"), thin, _UNIT), "likely-members")

    def confirm(t: pa.Table):
        sets = H.shingle_sets(t.column("text").to_pylist(), width)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        root, node = t.column("root").to_pylist(), t.column("node").to_pylist()
        found = []
        for a, r, est in _estimates(t, H.registers(sets), n, least, percent):
            linked = set()
            for j in r[np.argsort(-est, kind="stable")].tolist():
                if root[j] not in linked and _similar(sets[a], sets[j], percent):
                    linked.add(root[j])
                    found.append((node[a], node[j]))
        if found:
            x, y = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    whole = likely.join(texts, "node").select("u", "node", "root", "is_main", "b", "kind", "text")
    return _by_unit(whole, confirm, "x long, y long")


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and of each class (cls) its root and the component's least doc_id (null if none is set)."""
    least = percent / 100 - H.slack(percent)
    sketches = materialize(sketch(docs, width, percent), "sketches")
    # A class goes by a number of its own; its text is that of its row with the least id.
    row = F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "hash")
    classes = sketches.where("n > 0").groupBy("cls").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "cls", "row.doc_id", "row.hash", "n", "regs", "keys")
    classes = materialize(classes, "classes")

    keys = classes.select("node", F.explode("keys").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "key")).alias("centre")).where("size > 1").select("key", "centre"), "buckets")
    members = materialize(keys.join(buckets, "key"), "members")

    meeting = members.select("node").distinct()
    n_meeting = meeting.count()
    wanted = classes.select("node", "doc_id", "hash").join(F.broadcast(meeting) if n_meeting <= BROADCAST_IDS else meeting, "node")
    wanted = F.broadcast(wanted) if n_meeting <= BROADCAST_IDS else wanted
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.hash") == F.col("w.hash"))
    texts = materialize(rows.join(wanted.alias("w"), same).select("node", "text"), "texts")
    if texts.count() > n_meeting:  # rows that are equal in id and text
        texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    pairs = members.where("node <> centre").select(F.col("node").alias("x"), F.col("centre").alias("y")).distinct()
    links = materialize(_confirmed(_likely(pairs, classes, least), texts, width, percent), "links")
    roots = connected_components(links, "x", "y")

    more = materialize(_across(members, roots, classes, texts, width, percent), "links")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), "x", "y")

    of = classes.select("cls", "node", "doc_id").join(roots, "node", "left").select("cls", "doc_id", F.coalesce("root", "node").alias("root"))
    heads = materialize(of.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("root", "component_id"), "heads")
    of = of.join(heads, "root", "left").select("cls", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
    return sketches, of


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Link documents whose ``width``-word shingle sets have ``percent`` hundredths of their union in common.

    Shingles are of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words is one shingle. A null or
    empty text, or one without words, links to nothing and is kept. Rows that share a document id are judged apart, each
    by its own text. A row with a null id links as any other, but is never a component's head; it is kept only if no row
    of its component has an id. No rows give no rows. Further columns are not carried.

    Returns doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id is component_id).
    """
    sketches, of = _components(docs, width, percent)
    found = sketches.select("doc_id", "n", "cls").join(of, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` of which no two are near duplicates as ``near_duplicates`` has it; all columns stay.

    Of a group, the row with the smallest id stays (a null one only if there is no other), at equal ids that with the
    smallest hash of its text; of rows equal in both, that with the smallest hash of all its columns. Rows without words
    all stay.
    """
    sketches, of = _components(docs, width, percent)
    row = F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "hash")
    rows = sketches.where("n > 0").select("cls", "doc_id", "hash").join(of.select("cls", "root"), "cls")
    groups = rows.groupBy("root").agg(F.min(row).alias("head"), F.count("*").alias("n")).where("n > 1").select("root", "head")
    groups = materialize(groups, "groups")
    grouped = rows.join(groups, "root").select("doc_id", "hash", F.col("head").eqNullSafe(row).alias("is_head"))
    grouped = materialize(grouped.groupBy("doc_id", "hash").agg(F.max("is_head").alias("is_head"), F.count("*").alias("n")).where("NOT is_head OR n > 1"), "grouped")

    d, g = docs.withColumn(_HASH, F.xxhash64("text")).alias("d"), grouped.alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{_HASH}") == F.col("g.hash"))
    # A grouped row's text has words, so rows without any never meet a group.
    left = d.join(g, same, "left_anti").select(docs.columns)
    again = grouped.where("is_head")
    if again.isEmpty():
        return left
    repeated = d.join(again.alias("g"), same, "left_semi")
    once = repeated.groupBy("doc_id", _HASH).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return left.unionByName(once)


#: A column name of no table.
_HASH = "_hash_of_the_text_"
