"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric. In a text corpus nearly all distances are 1, so the first pivots are
single shingles: a document belongs to the regions of its rarest shingles, as many as a partner at
distance r or less cannot all miss. Each document is then measured against a document pivot of its regions:
those within r are its cell and in one component with it, and only pairs of different components matter.
A region with many members outside its largest component gets another pivot; of the largest component only
members stay whose distance to the pivot is within r of another's (triangle inequality). What is left is
the next region, and so on; small regions, and those that some levels of pivots leave, are compared.

Equal sets are one class from the start, and regions with the same largest component are compared
together, so the work follows the number of different texts and not the square of a group's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.components import components
from locuskey.llm.scratch import Tables, blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import Words, chunks, expand, expand_ordered, finalise, give_back, shingle_sets, squeeze, squeeze_ordered, text_buffers

#: Parquet bytes of documents in a block.
BLOCK_BYTES = 4 << 20
#: Members outside a region's largest component up to which it is compared without another pivot.
LEAF = 1024
#: Levels of pivots; what they leave is compared in tiles, however large.
DEPTH = 3
#: Sides of a tile: members outside the largest component, and all members.
TILE = (256, 512)
#: Parts in which a region is summed up, so that no task gets a large one whole.
SALTS = 16


def _class_key(hashes: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    if not len(hashes):
        return b""
    both = np.array([np.sum(hashes), np.bitwise_xor.reduce(finalise(hashes + np.uint64(len(hashes))))], np.uint64)
    return finalise(both).tobytes()


def _sets(column, width: int):
    data, offsets = text_buffers(column)
    for a, b in chunks(data, offsets):
        yield from shingle_sets(Words(data, offsets[a : b + 1], lower=True), width)


def _keys(width: int):
    def run(batches):
        for batch in batches:
            sets = list(map(lambda s: (len(s), _class_key(s)), _sets(batch.column(1), width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([k or None for _, k in sets], pa.binary())],
                names=["_id", "n", "class"],
            )

    return run


def _first_of_class(width: int, blocks: int):
    """Each task passes a set's first text on, to the block that all equal sets go to; a batch's texts for a block are compressed together."""

    def run(batches):
        seen = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            raw, ends = memoryview(data), offsets.tolist()
            lots: dict[int, tuple[list, list]] = {}
            for i, s in enumerate(_sets(batch.column(0), width)):
                key = _class_key(s)
                if key and key not in seen:
                    seen.add(key)
                    keys, texts = lots.setdefault(int.from_bytes(key[:7], "little") % blocks, ([], []))
                    keys.append(key)
                    texts.append(raw[ends[i] : ends[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(lots), pa.int64()), pa.array([b"".join(k) for k, _ in lots.values()], pa.binary()), pa.array([squeeze(t) for _, t in lots.values()], pa.binary())],
                names=["_block", "_classes", "_texts"],
            )
            del raw, data, batch, lots
            give_back()

    return run


class _Block:
    """The different sets of a block, all their shingles, and how these lie in the ranges."""

    def __init__(self, table: pa.Table, width: int, ranges: int):
        first: dict[bytes, bytes] = {}
        for keys, blob in zip(table.column("_classes").to_pylist(), table.column("_texts").to_pylist(), strict=True):
            for i, text in enumerate(expand(blob)):
                first.setdefault(keys[16 * i : 16 * i + 16], text)
        self.keys = list(first)
        self.sets = list(_sets(pa.array(list(first.values()), pa.binary()), width))
        self.all, self.counts = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]), return_counts=True)
        lot = ((self.all >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.flatnonzero(np.diff(lot)) + 1
        edges = [0, *cut.tolist(), len(lot)] if len(lot) else [0]
        self.parts = {int(lot[a]): (a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)}


def _send(width: int, ranges: int):
    # So many high bits that a range has 32 or 33 of its own: two shingles that share them only look less rare than they are.
    drop = np.uint64(max(0, 32 - ranges.bit_length()))

    def run(key, table):
        block = _Block(table, width, ranges)
        parts = list(block.parts.items())
        return pa.table(
            {
                "_range": pa.array([r for r, _ in parts], pa.int64()),
                "_block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "_high": pa.array([squeeze_ordered(block.all[a:b] >> drop) for _, (a, b) in parts], pa.binary()),
                "_counts": pa.array([np.minimum(block.counts[a:b], 255).astype(np.uint8).tobytes() for _, (a, b) in parts], pa.binary()),
            }
        )

    return run


def _frequencies(table):
    highs = [expand_ordered(x) for x in table.column("_high").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("_counts").to_pylist()])
    different, where = np.unique(np.concatenate(highs), return_inverse=True)
    total = np.minimum(np.bincount(where, weights=counts, minlength=len(different)), 2**32 - 1).astype(np.uint32)[where]
    out, at = [], 0
    for high in highs:
        own = total[at : at + len(high)]
        shared = own > 1
        out.append((np.packbits(shared).tobytes(), own[shared].tobytes()) if shared.any() else (None, None))
        at += len(high)
    return pa.table(
        {
            "_block": table.column("_block"),
            "_range": table.column("_range"),
            "_shared": pa.array([a for a, _ in out], pa.binary()),
            "_df": pa.array([b for _, b in out], pa.binary()),
        }
    ).filter(pa.array([a is not None for a, _ in out], pa.bool_()))


def _prefixes(width: int, ranges: int, least: int):
    def run(docs, answers):
        block = _Block(docs, width, ranges)
        give_back()
        df = np.ones(len(block.all), np.uint32)
        for r, shared, own in zip(*(answers.column(c).to_pylist() for c in ("_range", "_shared", "_df")), strict=True):
            a, b = block.parts[r]
            df[a:b][np.unpackbits(np.frombuffer(shared, np.uint8), count=b - a).astype(bool)] = np.frombuffer(own, np.uint32)
        keys, sizes, unshared, sets, prefixes = [], [], [], [], []
        for key, s in zip(block.keys, block.sets, strict=True):
            d = df[np.searchsorted(block.all, s)]
            n = len(s)
            # A partner shares least % of this set at least, so it cannot miss all of so many shingles.
            alone = int(np.count_nonzero(d == 1))
            room = n - -(-least * n // 100) + 1 - alone
            if room <= 0:
                continue
            common = np.flatnonzero(d > 1)
            common = common[np.lexsort((s[common], d[common]))[:room]]
            if len(common):
                keys.append(key)
                sizes.append(n)
                unshared.append(alone)
                sets.append(s.view(np.int64))
                prefixes.append(s[common].view(np.int64))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)), pa.array(np.concatenate([*x, np.zeros(0, np.int64)])))
        return pa.table({"class": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int64()), "alone": pa.array(unshared, pa.int64()), "hashes": lists(sets), "prefix": lists(prefixes)})

    return run


def _leaf(least: int):
    """Links of some tiles between members of different groups: in each tile only those that join what no link before them joins."""

    def run(key, table):
        table = table.combine_chunks()
        keys, groups = (np.array(table.column(c).to_pylist(), object) for c in ("class", "group"))
        size, alone = (np.asarray(table.column(c)) for c in ("n", "alone"))
        probe, base = (np.asarray(table.column(c).cast(pa.int8())).astype(bool) for c in ("_probe", "_base"))
        tiles = np.array([hash(x) for x in zip(*(table.column(c).to_pylist() for c in ("major", "_i", "_j")), strict=True)])
        hashes = table.column("hashes").combine_chunks()
        ends, flat_all = np.asarray(hashes.offsets), np.asarray(hashes.values)
        order = np.argsort(tiles, kind="stable")
        a, b = [], []
        for tile in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1):
            rows = tile[base[tile]]
            if not len(rows):
                continue
            # Postings of the base side: which rows have a shingle.
            sizes = (ends[rows + 1] - ends[rows]).astype(np.int64)
            flat = np.concatenate([flat_all[ends[i] : ends[i + 1]] for i in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            by_hash = np.argsort(flat, kind="stable")
            flat, owner = flat[by_hash], owner[by_hash]
            names, label = np.unique(groups[tile], return_inverse=True)
            joined = dict(zip(tile.tolist(), label.tolist(), strict=True))
            known = np.array([joined[i] for i in rows.tolist()])
            into = np.arange(len(names))
            for i in tile[probe[tile]]:
                n = int(ends[i + 1] - ends[i])
                # What the sizes and the shingles that are in one set only leave possible.
                most = np.minimum(size[rows] - alone[rows], n - alone[i])
                other = (into[known] != into[joined[i]]) & (100 * most >= least * (sizes + n - most))
                if not other.any():
                    continue
                s = flat_all[ends[i] : ends[i + 1]]
                low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                count = high - low
                total = int(count.sum())
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
                both = np.bincount(owner[at], minlength=len(rows))
                linked = np.flatnonzero(other & (100 * both >= least * (sizes + n - both)))
                different, sample = np.unique(into[known[linked]], return_index=True)
                a += [keys[i]] * len(sample)
                b += keys[rows[linked[sample]]].tolist()
                into[np.isin(into, different)] = into[joined[i]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _salt(of: str = "class") -> Column:
    return F.pmod(F.xxhash64(of, F.lit(9)), F.lit(SALTS)).cast("int").alias("_salt")


def _all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _in_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """``rows`` with what ``regions`` has of their region, a large region in parts."""
    return rows.withColumn("_salt", _salt()).join(_all_salts(regions), ["region", "_salt"]).drop("_salt")


def _once(members: DataFrame, minor: Column, keep: list[str]) -> DataFrame:
    """Of regions with the same members, one: region, pivot (the least member that is ``minor``) and the columns ``keep``, which a region's rows share.

    A region is summed up in SALTS parts, which are then put together.
    """
    h = F.xxhash64("class")
    parts = members.groupBy("region", _salt()).agg(
        F.count("*").alias("size"),
        F.min(F.when(minor, F.col("class"))).alias("pivot"),
        F.max("class").alias("last"),
        F.bit_xor(h).alias("x"),
        F.bit_xor(F.xxhash64(h, F.lit(1), "class")).alias("y"),
        F.min("alone").alias("least_alone"),
        *[F.max(c).alias(c) for c in keep],
    )
    whole = {"size": F.sum, "pivot": F.min, "last": F.max, "x": F.bit_xor, "y": F.bit_xor, "least_alone": F.min} | dict.fromkeys(keep, F.max)
    shape = parts.groupBy("region").agg(*[f(c).alias(c) for c, f in whole.items()])
    return shape.where("size > 1 and pivot is not null").groupBy(*whole).agg(F.min("region").alias("region")).select("region", "pivot", "least_alone", *keep)


def _join_regions(members: DataFrame, sets: DataFrame, tables: Tables, least: int, leaf: int, depth: int) -> DataFrame:
    """(node, root): the components of all links between classes that share a region.

    A member's group is the component that it is known to be in; only pairs of different groups are still
    to be found. Each level measures a region's members against a pivot, then groups grow, regions of one
    group are done, and of a region's largest group only those stay that can be within the radius of another's.
    """
    radius = 1 - least / 100

    def measure(pairs: DataFrame) -> DataFrame:
        """(pivot, class) with their distance and whether they link: a written table. Joins of plain scans, so that a pivot of many can be split."""
        measured = (
            pairs.join(sets.select("class", F.col("hashes").alias("_a")), "class")
            .join(sets.select(F.col("class").alias("pivot"), F.col("hashes").alias("_b")), "pivot")
            .select("pivot", "class", F.size(F.array_intersect("_a", "_b")).cast("long").alias("both"), (F.size("_a") + F.size("_b")).cast("long").alias("sum"))
            .select("pivot", "class", F.expr(f"100 * both >= {least} * (sum - both)").alias("near"), (1 - F.col("both") / (F.col("sum") - F.col("both"))).alias("d"))
        )
        return tables.write(measured, "distances")

    def near(measured: DataFrame) -> DataFrame:
        return measured.where("near").select(F.col("pivot").alias("a"), F.col("class").alias("b"))

    def grown(rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with the component that each class is known to be in."""
        known = roots.select(F.col("node").alias("class"), "root")
        return rows.join(known, "class", "left").select("region", "class", "n", "alone", *columns, F.coalesce("root", "class").alias("group"))

    # Shingles that a document shares with none are missing from any both, and a partner's are in no either of it less.
    possible = F.expr(f"100 * (n - alone) >= {least} * (n + least_alone)")
    state = _in_regions(members, _once(members, F.lit(True), [])).where(possible).drop("least_alone")
    state = tables.write(state, "regions")
    # Each class is first measured against one pivot, the least of all its regions: that joins most of what belongs together.
    roots = components(near(measure(state.where("class <> pivot").groupBy("class").agg(F.min("pivot").alias("pivot")))), tables)
    members = tables.write(grown(state), "members")
    for level in range(depth + 1):
        counts = members.groupBy("region", "group").agg(F.count("*").alias("m"))
        major = counts.groupBy("region").agg(F.max(F.struct("m", "group")).alias("most"), F.sum("m").alias("size"), F.count("*").alias("groups")).where("groups > 1")
        major = major.select("region", F.col("most.group").alias("major"), (F.col("size") - F.col("most.m")).alias("n_minor"))
        state = tables.write(_in_regions(members, major), "regions")
        small = F.lit(level == depth) | (F.col("n_minor") <= leaf)
        leaves, large = state.where(small), state.where(~small)
        n_leaves, n_large = state.agg(F.count_if(small), F.count_if(~small)).first()
        found = [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        if n_leaves:
            found.append(_join_leaves(leaves, sets, tables, least))
        if n_large:
            pivots = _once(large, F.col("group") != F.col("major"), ["major"]).drop("least_alone", "major")
            large = tables.write(_in_regions(large, pivots), "large")
            measured = measure(large.where("class <> pivot").select("pivot", "class").distinct())
            found.append(near(measured))
        if len(found) > 1:
            links = found[0]
            for x in found[1:]:
                links = links.unionByName(x)
            roots = components(links, tables)
        if not n_large:
            break
        rest = tables.write(grown(large.drop("group", "major", "n_minor").join(measured, ["pivot", "class"]), "d"), "grown")
        counts = rest.groupBy("region", "group").agg(F.count("*").alias("m"), F.min("d").alias("low"), F.max("d").alias("high"))
        major = counts.groupBy("region").agg(F.max(F.struct("m", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1").select("region", F.col("most.group").alias("major"))
        others = counts.join(major, "region").where(F.col("group") != F.col("major")).groupBy("region", "major").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        in_window = (F.col("group") != F.col("major")) | ((F.col("d") + radius + 1e-9 >= F.col("low")) & (F.col("d") - radius - 1e-9 <= F.col("high")))
        members = tables.write(_in_regions(rest, others).where(in_window).select("region", "class", "n", "alone", "group"), "members")
    return roots


def _join_leaves(state: DataFrame, sets: DataFrame, tables: Tables, least: int) -> DataFrame:
    """Links of regions, those outside the largest group against all.

    Regions with the same largest group have much the same members, so they are joined together: each class
    once for a tile, in tiles of bounded sides that are dealt over lots of bounded size.
    """
    rows = state.groupBy("major", "class", "group").agg(F.max(F.col("group") != F.col("major")).alias("_minor"), F.max("n").alias("n"), F.max("alone").alias("alone"))
    rows = tables.write(rows, "leaves")
    # A member of the largest group only counts if one of the others can be its partner, and the other way round.
    sizes = rows.groupBy("major").agg(
        F.ceil(F.count_if("_minor") / TILE[0]).alias("_np"), F.ceil(F.count("*") / TILE[1]).alias("_nb"), F.min("alone").alias("_alone"), *[f(F.when(F.col("_minor"), F.col("n"))).alias(c) for f, c in ((F.min, "_low"), (F.max, "_high"))]
    )
    sized = rows.withColumn("_salt", _salt()).join(_all_salts(sizes), ["major", "_salt"])
    sized = sized.where(f"100 * (n - alone) >= {least} * (n + _alone) and 100 * n >= {least} * _low and {least} * n <= 100 * _high")
    here = lambda salt, n: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    spot = lambda i, j: F.struct(i.alias("_i"), j.alias("_j"))
    i, j = here(1, "_np"), here(2, "_nb")
    spots = F.concat(F.when(F.col("_minor"), F.transform(every("_nb"), lambda x: spot(i, x))).otherwise(F.array().cast("array<struct<_i:bigint,_j:bigint>>")), F.transform(every("_np"), lambda x: spot(x, j)))
    rows = sized.withColumn("_spot", F.explode(F.array_distinct(spots))).select("major", "class", "group", "n", "alone", "_spot._i", "_spot._j", (F.col("_minor") & (F.col("_spot._i") == i)).alias("_probe"), (F.col("_spot._j") == j).alias("_base"))
    rows = tables.write(rows, "tiles")
    lots = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1000))
    full = rows.join(sets.select("class", "hashes"), "class").withColumn("_lot", F.pmod(F.xxhash64("major", "_i", "_j"), F.lit(lots)))
    return tables.write(full.groupBy("_lot").applyInArrow(_leaf(least), "a binary, b binary"), "leaf-links")


def _add_key(width: int):
    def run(batches):
        for batch in batches:
            keys = [_class_key(s) or None for s in _sets(batch.column("_text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), pa.array(keys, pa.binary())], names=["_row", "_text", "class"])

    return run


def _classes(docs: DataFrame, id_col: str, text: str, width: int, least: int, leaf: int, depth: int, block_bytes: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(_id, n, class) of every row, and (class, _first, root, component_id) of every class; both written tables."""
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    blocks = blocks_for(own, block_bytes)
    keys = tables.write(own.mapInArrow(_keys(width), f"_id {own.schema['_id'].dataType.simpleString()}, n long, class binary"), "classes")
    texts = own.select("_text").mapInArrow(_first_of_class(width, blocks), "_block long, _classes binary, _texts binary").repartition(tasks_for(blocks), "_block")
    sent = texts.groupBy("_block").applyInArrow(_send(width, blocks), "_range long, _block long, _high binary, _counts binary")
    answers = sent.groupBy("_range").applyInArrow(_frequencies, "_block long, _range long, _shared binary, _df binary")
    sets = texts.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_prefixes(width, blocks, least), "class binary, n long, alone long, hashes array<long>, prefix array<long>")
    sets = tables.write(sets, "sets")
    members = sets.select(F.explode("prefix").alias("region"), "class", "n", "alone")
    roots = _join_regions(members, sets, tables, least, leaf, depth)
    firsts = keys.where("n > 0").groupBy("class").agg(F.min("_id").alias("_first"))
    rooted = firsts.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "_first", F.coalesce("root", "class").alias("root"))
    rooted = tables.write(rooted, "rooted")
    # Written, so that the join's sides are plain scans and a large component can be split.
    least_id = tables.write(rooted.groupBy("root").agg(F.min("_first").alias("component_id")), "least")
    return keys, tables.write(rooted.join(least_id, "root"), "labels")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: int = 80, leaf: int = LEAF, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, and component_id, the smallest id reachable by links, its own included.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and made sets of ``width``-word
    shingles (a shorter text: its whole word sequence). Two documents link when 100 * |both| >=
    ``least`` * |either|; a document without words, or with a null text, links with nothing and has
    its own id as component. Rows are documents of their own; repeated rows link with each other.
    A null id is never a component's id unless all the component's ids are null. Other columns are
    not returned.
    """
    send_package(docs.sparkSession)
    keys, labels = _classes(docs, id_col, text, width, least, leaf, depth, block_bytes, Tables(docs.sparkSession))
    out = keys.join(labels.select("class", "component_id"), "class", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: int = 80, leaf: int = LEAF, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component of ``similar_documents``: that with the least id.

    Rows that repeat that id with the same words count once; documents without words all stay.
    """
    send_package(docs.sparkSession)
    _, labels = _classes(docs, id_col, text, width, least, leaf, depth, block_bytes, Tables(docs.sparkSession))
    chosen = labels.where(F.col("_first").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("class").alias("class"), F.first("component_id").alias("_id")).select("class", "_id")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = T.StructType([*rows.schema.fields, T.StructField("class", T.BinaryType())])
    keyed = rows.mapInArrow(_add_key(width), kind)
    own = F.col("_row").getField(id_col)
    with_words = keyed.where("class is not null").withColumn("_own", own)
    kept = with_words.join(chosen.withColumnRenamed("class", "_class"), (F.col("class") == F.col("_class")) & F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    kept = kept.dropDuplicates(["class"]).select("_row", "_text").unionByName(keyed.where("class is null").select("_row", "_text"))
    return kept.select(*[F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
