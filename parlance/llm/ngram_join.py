"""Jaccard join on word shingles by token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.llm.common import U64, Words, components, free, keys_within, mix64, quoted, shingles, ship, small, text_chunks, written

SLOT_BITS = 20  # slots of the frequency sketch, whatever the data
RARE = 4  # tokens in the slot of a rare token at most, whatever the data: its buckets stay small
FREQUENT = 16.0  # from so many times the mean on, tokens go last in the order
BITS = 512  # of a set's short parity bitmap; the long one has four to eight bits a token
SPLIT = 2048  # members of a bucket that one group compares
SLICE = 512 << 10  # bytes of text that a task makes sets of at a time
LIGHT = 4  # members of a bucket whose pairs are rows at once
LOWEST = 4  # signatures of a node that tell where its pairs were looked at before
TOGETHER = 4_000_000  # tokens of the sets that one group verifies


def doc_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    w = Words(data, offs)
    return shingles(w.hashes(), w.first, n)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared tokens that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Slot counts over the sets of all documents: one fixed-size array per
    task, summed by slot range in two steps, so no group grows with the
    number of tasks squared or holds more than a slice of the slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for _, data, offs in text_chunks(batches, limit=SLICE):
            sets = doc_sets(data, offs, n)
            slots += np.bincount((np.concatenate(sets) >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        if slots.any():
            parts = slots.reshape(64, -1)
            salt = int(mix64(np.array([slots.sum()], np.uint64))[0] % U64(16))
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([salt] * 64, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "salt", "counts"])

    def add(rows):
        total = sum(np.frombuffer(c, np.int64) for c in rows.counts)
        return rows.head(1).assign(counts=[total.tobytes()])

    schema = "part int, salt int, counts binary"
    got = texts.mapInArrow(count, schema).groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect()
    slots = np.zeros((64, (1 << SLOT_BITS) // 64), np.int64)  # 8 MB, whatever the data
    for r in got:
        slots[r.part] = np.frombuffer(r.counts, np.int64)
    return slots.ravel()


def frequency_classes(slots: np.ndarray) -> np.ndarray:
    """0 for rare tokens, 1 for others, or 2 + the logarithm of their slot's excess."""
    ratio = slots / max(slots.mean(), 1.0)
    often = np.where(ratio < FREQUENT, 1, 2 + np.log2(np.maximum(ratio / FREQUENT, 1.0)))
    return np.where(slots <= RARE, 0, often).astype(np.int8)


def signatures(s: np.ndarray, cls: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set, from its tokens in the order (class, hash), rare
    tokens first.

    A set x and a similar one with a and b tokens of their own have
    100(|x| - a) >= percent(|x| + b): x has at most e = |x| - ceil(t|x|) own
    ones, and 2a + b is largest for a = e. If their first shared token is
    rare, it stands within the first e + 1 and is a signature by itself. Else
    all r rare tokens are the set's own, and all shared ones are frequent. Of
    the a + b - r + 1 places between the first a + b - r + 2 shared ones, one
    at least has no own token of either set in it, so these two are neighbours
    in both sets: neighbours among the first 2a + b - 2r + 2 frequent tokens
    are combinations of two. Their number grows with the set, not its square,
    and unrelated sets that share a token by chance seldom share its neighbour.

    Below three quarters, similar sets can share too few tokens for that;
    there every two of the first e - r + 2 frequent ones are combined. Sets of
    one token equal only themselves.
    """
    size = len(s)
    own = size - -(-percent * size // 100)
    order = np.argsort(cls, kind="stable")
    head, kind = s[order], cls[order]
    rare = int((kind == 0).sum())
    single = head[: min(rare, own + 1)]
    if rare > own:
        return single
    either = 2 * own + ((100 - percent) * size - 100 * own) // percent
    often = head[rare : rare + either - 2 * rare + 2] if percent >= 75 else head[rare : own + 2]
    if percent >= 75:
        i = np.arange(len(often) - 1)
        j = i + 1
    else:
        i, j = np.triu_indices(len(often), 1)
    both = mix64(often[i] * U64(3) + mix64(often[j] + U64(1)))
    return np.concatenate([single, both])


def parity(s: np.ndarray) -> np.ndarray:
    """Long bitmap of a set: a bit per token class, set if the set has an odd
    number of tokens of the class. Its length is a power of two."""
    bits = max(BITS, 1 << (4 * len(s) - 1).bit_length())
    c = np.bincount((mix64(s) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((c & 1).astype(np.uint8)).view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The bitmap with fewer classes: of classes that become one, parities add up."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def most_overlap(na, nb, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of shared tokens. A token that only one set has flips one
    bit, so bitmaps x and y differ in no more bits than the sets in tokens."""
    return (na + nb - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)) // 2


def bitmaps(cells: list) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint64).reshape(len(cells), -1)


_PROFILE = "n long, k1 long, k2 long, bits binary, wide binary, sigs array<long>"


def _profile(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document its set's size, key, bitmap and signatures. A task
    gives the signatures of equal sets once."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(frequency_classes(sketch(rows.select("text"), n)))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, seen = sent.value, set()
        for part, data, offs in text_chunks(batches, limit=SLICE):
            out = []
            for s in doc_sets(data, offs, n):
                k = set_key(s)
                # others can be similar only where there is room for a token more or less
                new = len(s) > 1 and (100 - percent) * len(s) >= percent and k not in seen
                if new:
                    if len(seen) > 500_000:  # forgetting only costs repeated signatures
                        seen.clear()
                    seen.add(k)
                sig = signatures(s, cls[(s >> U64(64 - SLOT_BITS)).astype(np.int64)], percent).view(np.int64) if new else None
                wide = parity(s) if new else None
                out.append((len(s), *k, folded(wide, BITS // 64).tobytes() if new else None, wide.tobytes() if new else None, sig))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["id", "th", "n", "k1", "k2", "bits", "wide", "sigs"],
            )

    schema = rows.select("id").schema.add("th", "long")
    for f in StructType.fromDDL(_PROFILE):
        schema = schema.add(f)
    return rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def _members(own: DataFrame) -> DataFrame:
    """(sig, m, c, n): nodes by signature, where a signature has m > 1 nodes.
    Only signature and node go through the one shuffle of all signatures."""
    each = own.select(F.explode("sigs").alias("sig"), "c")
    each = each.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("m > 1")
    few = written(each, "members")
    sizes = written(own.select("c", F.col("n").cast("int").alias("n")), "sizes")
    return few.join(small(sizes), "c").select("sig", "m", "c", "n")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """In every bucket, by size: link each member to the one before it and to
    the first one whose size could be similar to it; a member too large for
    that one becomes the next first. Two pairs a member at most; the state is
    two rows per bucket, however many members it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = lead = lead_size = last = None
        for b in batches:
            out_a, out_b = [], []
            for s, c, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if s != sig or 100 * lead_size < percent * n:
                    sig, lead, lead_size = s, c, n
                else:
                    out_a.append(lead)
                    out_b.append(c)
                    if last != lead:
                        out_a.append(last)
                        out_b.append(c)
                last = c
            a, b_ = np.array(out_a, np.int64), np.array(out_b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b_)), pa.array(np.maximum(a, b_))], names=["a", "b"])

    ordered = members.select("sig", "c", "n").repartition("sig").sortWithinPartitions("sig", "n", "c")
    return ordered.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _could_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes, short bitmaps and long bitmaps do not rule out."""

    def sides(col: str) -> tuple[DataFrame, DataFrame]:
        return tuple(nodes.select(F.col("c").alias(k), F.col("n").alias("n" + k), F.col(col).alias("v" + k)) for k in "ab")

    def bound(na, nb, va: list, vb: list) -> np.ndarray:
        if len({len(v) for v in va + vb}) == 1:
            return most_overlap(na, nb, bitmaps(va), bitmaps(vb))
        out = np.empty(len(na), np.int64)
        for r, (p, q) in enumerate(zip(va, vb)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            w = min(len(p), len(q))
            out[r] = most_overlap(na[r], nb[r], folded(p, w), folded(q, w))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            na, nb = col["na"].to_numpy(), col["nb"].to_numpy()
            ok = bound(na, nb, col["va"].to_pylist(), col["vb"].to_pylist()) >= least_overlap(na, nb, percent)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(ok))

    for c in ("bits", "wide"):
        x, y = sides(c)
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long")
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose sets, computed again from the texts, are similar enough."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    who = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = written(nodes.select("c", "th", "k1", "k2").join(who, "c"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for _, data, offs in text_chunks(batches, limit=SLICE):
            out = []
            for s in doc_sets(data, offs, n):
                k = set_key(s)
                if k not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(k)
                    out.append((*k, np.sort(s.view(np.int64))))
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], names=["k1", "k2", "s"])

    texts = keys_within(rows.select(F.xxhash64("text").alias("th"), "text"), wanted, "th")
    found = texts.select("text").mapInArrow(sets, "k1 long, k2 long, s array<long>")
    full = written(found.join(wanted.select("c", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["c"]).select("c", "s"), "sets")
    # a set goes once to the group of all pairs that hang together
    hangs = components(pairs)
    sizes = hangs.join(nodes.select("c", "n"), F.col("v") == F.col("c")).groupBy("component").agg(F.sum("n").alias("m"))
    hangs = written(hangs.join(sizes, "component"), "hangs")
    at = pairs.join(hangs, F.col("a") == F.col("v")).select(F.col("component").alias("g"), F.col("m").alias("gm"), "a", "b")
    sets_at = full.join(hangs, F.col("c") == F.col("v")).select(F.col("component").alias("h"), F.col("m").alias("hm"), "c", "s")

    def check(own: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        by = {c: np.asarray(s) for c, s in zip(own.c, own.s)}
        ok = [_similar(by[a], by[b], percent) for a, b in zip(want.a, want.b)]
        return want.loc[np.array(ok, bool), ["a", "b"]]

    one = sets_at.where(F.col("hm") <= TOGETHER).groupBy("h").cogroup(at.where(F.col("gm") <= TOGETHER).groupBy("g")).applyInPandas(check, "a long, b long")
    # where too many tokens hang together, pairs are joined to their sets one by one
    x, y = (sets_at.where(F.col("hm") > TOGETHER).select(F.col("c").alias(k), F.col("s").alias("s" + k)) for k in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    two = at.where(F.col("gm") > TOGETHER).select("a", "b").join(x, "a").join(y, "b").where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    return written(one.union(two), "links")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Both sorted and without repeats."""
    at = np.searchsorted(x, y)
    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _across(members: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that are not connected yet and could be similar:
    every such pair is looked at. Buckets whose members are connected drop
    out; a bucket of more than SPLIT members is compared by pairs of blocks,
    so that a group stays small however many members there are. Members of
    all but the smallest buckets bring their bitmaps, so that what these rule
    out is never a row, and their lowest signatures: a pair that shares one
    below the bucket's own was looked at in that bucket."""
    at = members.join(comps, F.col("c") == F.col("v"), "left").select("sig", "c", "n", "m", F.coalesce("component", "c").alias("comp"))
    mixed = at.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    at = written(at.join(mixed, "sig"), "mixed")
    low = at.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOWEST).alias("low"))
    light = at.where(F.col("m") <= LIGHT).withColumn("bits", F.lit(None).cast("binary")).withColumn("low", F.lit(None).cast("array<bigint>"))
    rows = light.unionByName(at.where(F.col("m") > LIGHT).join(nodes.select("c", "bits"), "c").join(low, "c"))
    blocks = F.ceil(F.col("m") / SPLIT).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "n", "comp", "bits", "low")

    def compare(group: dict[str, np.ndarray], bits: list[bytes], lows: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, n, comp, mine = group["c"], group["n"], group["comp"], group["mine"]
        apart = group["i"][0] != group["j"][0]
        v = bitmaps(bits) if bits[0] is not None else None
        if v is not None:  # signatures below this bucket's; the bucket's own stands for none
            own = int(group["sig"][0])
            low = np.array([[*(g if g < own else own for g in x), *[own] * (LOWEST - len(x))] for x in lows], np.int64)
        last = np.searchsorted(n, 100 * n // percent, "right")
        for r in range(len(c) - 1):
            s = slice(r + 1, int(last[r]))
            ok = comp[s] != comp[r]
            if apart:
                ok &= mine[s] != mine[r]
            k = np.flatnonzero(ok) + r + 1
            if len(k) and v is not None:
                k = k[most_overlap(n[r], n[k], v[r], v[k]) >= least_overlap(n[r], n[k], percent)]
                before = low[r][low[r] < own]
                if len(k) and len(before):
                    k = k[~np.isin(low[k], before).any(1)]
            if len(k):
                yield np.full(len(k), c[r]), c[k]

    names = ["sig", "i", "j", "mine", "c", "n", "comp", "bits", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, size = None, [], 0

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for got in [batches, None]:  # at the end, the last group
            for t in map(lambda x: pa.Table.from_batches([x]), got) if got is not None else [None]:
                rest = t if rest is None else rest if t is None else pa.concat_tables([rest, t])
                if rest is None or not rest.num_rows:
                    continue
                col = {k: rest.column(k).to_numpy() for k in names[:-2]}
                bits, lows = rest.column("bits").to_pylist(), rest.column("low").to_pylist()
                new = np.concatenate([[True], (col["sig"][1:] != col["sig"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])])
                bounds = np.append(np.flatnonzero(new), len(new)).tolist()
                if t is not None:
                    bounds = bounds[:-1]  # the last group may go on
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    if hi - lo > 1:
                        for pair in compare({k: x[lo:hi] for k, x in col.items()}, bits[lo:hi], lows[lo:hi]):
                            held.append(pair)
                            size += len(pair[0])
                            if size > 50_000:
                                yield batch()
                                size = 0
                rest = rest.slice(bounds[-1])
        yield batch()

    ordered = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "c")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_shingles`` (distinct n-word shingles) and
    ``component_id`` (smallest id reachable by links). Two documents link
    when 100 x shared >= percent x union of their shingle sets.

    Equal sets are one node. First each bucket of a signature links its
    members to few leaders, which connects large groups of copies in one
    linear step; then every pair of a bucket that is still unconnected and
    not ruled out by sizes or bitmaps is verified. No link
    between different texts is lost, and connected members are not expanded
    into pairs.

    Null and empty texts have no shingles and link with nothing; fewer than n
    words make one shingle; repeated rows and ids are documents each; a null
    id counts as larger than all others and never names a component that has
    an id; other columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    prof = written(_profile(rows, n, percent).withColumn("row", F.monotonically_increasing_id()), "profiles")
    keys = prof.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min(F.when(F.col("sigs").isNotNull(), F.col("row"))).alias("c"))
    keys = written(keys, "classes")
    own = keys_within(prof.withColumnRenamed("row", "c"), keys.where("c IS NOT NULL"), "c")
    nodes = own.select("c", "n", "th", "k1", "k2", "bits", "wide")
    members = _members(own)
    free(rows.sparkSession)
    first = _verified(_could_link(_stars(members, percent), nodes, percent), nodes, rows, n, percent)
    free(rows.sparkSession)
    second = _verified(_could_link(_across(members, nodes, components(first), percent), nodes, percent), nodes, rows, n, percent)
    free(rows.sparkSession)
    comps = components(first.union(second))
    at = keys.join(comps, F.col("c") == F.col("v"), "left").select("k1", "k2", "id", "component")
    low = at.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("low"))
    at = written(at.join(low, "component", "left").select("k1", "k2", F.coalesce("low", "id").alias("low")), "components")
    out = prof.select("id", "n", "k1", "k2").join(at, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "id")).otherwise(F.col("id")).alias("component_id"))
