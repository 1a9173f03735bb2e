"""Near duplicates by a chosen-path join over word shingles (operator 5).

A document is the set of its shingles of five words. Sets are first embedded as minhashes, so that
each has the same number of tokens and two sets share a token with the probability of their Jaccard
similarity. The join then splits the table recursively: at each node of a run some tokens are chosen,
by a hash of the node, 1 / similarity of them on average and one at least, and each chosen token
sends the sets that share its value into one child. A bucket that is small is compared by brute force;
a large one is split further, down to a fixed depth, and there compared in blocks of bounded size.
Runs are repeated until the recall that is asked for is reached at that depth, by ``runs_for``.

A pair that meets in several buckets is looked at in the first one only, which both sides can tell
from their lists of buckets, so no pair is ever written out. Its similarity there is estimated by the
shared minhashes, and verified on the whole shingle sets if the estimate is within four standard
deviations of the threshold. A bucket hands on, for each of its members, the number of verified links
and the smallest member it hangs together with: one row per member, however many pairs there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm import words
from ratewell.llm.components import components
from ratewell.session import ARROW_BYTES, materialize

TOKENS = 64
BUCKET = 256
DEPTH = 4
BLOCK = 512
#: Shingles of a block's sets that are held at once.
BLOCK_SHINGLES = 1_500_000
RECALL = 0.9999
SEED = 11

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(cut: list[list[str]], seen: words.WordRows, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than ``width`` are one shingle."""
    ids, sizes = seen.rows(cut)
    value = seen.table[ids] if len(ids) else np.zeros(0, np.uint64)
    h = np.zeros(max(0, len(value) - width + 1), np.uint64)
    for k in range(width):
        h = (h + value[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(32)
    at = words.bounds(sizes)
    for i, n in enumerate(sizes.tolist()):
        if n >= width:
            yield np.unique(h[at[i] : at[i] + n - width + 1])
        elif n:
            own = np.uint64(n)
            for v in value[at[i] : at[i + 1]]:
                own = np.uint64(((int(own) + int(v)) * int(_MIX)) & 0xFFFFFFFFFFFFFFFF)
                own ^= own >> np.uint64(32)
            yield np.array([own], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def word_hashes(ws: list[str]) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in ws])
    return np.frombuffer(raw, "<u8").astype(np.uint64)


def minhashes(sets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(sets), 8192):
        part = (sets[s : s + 8192, None] * factors) >> np.uint64(32)
        out = np.minimum(out, part.min(0).astype(np.uint32))
    return out


def factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def _texts(batches: Iterable, column: int) -> Iterator[tuple[object, list[str]]]:
    for batch in batches:
        for s in range(0, batch.num_rows, 1024):
            b = batch.slice(s, 1024)
            yield b, [(t or "").lower() for t in b.column(column).to_pylist()]


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """id, body (a hash of the text), digest of the shingle set, its size and its minhashes."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa

        seen, f = words.WordRows(word_hashes), factors()
        for b, texts in _texts(batches, 2):
            digest, size, tokens = [], [], []
            for _, cut in words.split_batches(texts):
                for s in shingle_sets(cut, seen, width):
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    size.append(len(s))
                    tokens.append(minhashes(s, f).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(tokens, pa.binary())],
                names=["id", "body", "digest", "size", "tokens"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, body long, digest binary, size int, tokens binary")


def runs_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall`` at ``depth``."""
    rate = 1 / similarity
    meet = 1.0
    for _ in range(depth):
        # children are about Poisson, but at least one; each keeps the pair and meets further down
        miss = 1 - similarity * meet
        lost = math.exp(-rate) * miss + math.exp(-rate * (1 - miss)) - math.exp(-rate)
        meet = 1 - lost
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def root_tokens(run: int, similarity: float) -> list[int]:
    """Tokens that run's root chooses; the same for all sets."""
    draw = np.random.default_rng(1000 * SEED + run).random(TOKENS)
    chosen = np.flatnonzero(draw < 1 / (similarity * TOKENS))
    return chosen.tolist() or [int(draw.argmin())]


def _token(i: int) -> Column:
    return F.substring("tokens", 4 * i + 1, 4)


def _children(similarity: float) -> Column:
    """Paths of the children of the node in ``path``."""
    numbers = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    draws = F.transform(numbers, lambda i: F.struct(F.pmod(F.xxhash64("path", i), F.lit(1 << 20)).alias("draw"), i.alias("i")))
    least = F.array_min(draws)
    cut = int((1 << 20) / (similarity * TOKENS))
    chosen = F.filter(draws, lambda d: (d["draw"] < cut) | (d["i"] == least["i"]))
    return F.transform(chosen, lambda d: F.xxhash64("path", d["i"], F.substring(F.col("tokens"), F.lit(4) * d["i"] + 1, F.lit(4))))


def leaves(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(path, digest, n) of all buckets that hold two sets or more and are not split further."""
    paths = [
        F.xxhash64(F.lit(run), F.lit(i), _token(i)) for run in range(runs_for(similarity, recall)) for i in root_tokens(run, similarity)
    ]
    level = sets.where("size > 0").select("digest", F.explode(F.array(*paths)).alias("path"))
    out = None
    for depth in range(1, DEPTH + 1):
        level = materialize(level, "paths")
        count = level.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        inside = level.join(count.where("n > 1"), "path")
        last = depth == DEPTH
        done = inside if last else inside.where(F.col("n") <= BUCKET)
        done = materialize(done, "leaves")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        large = inside.where(F.col("n") > BUCKET).select("digest", "path")
        if large.isEmpty():
            break
        level = large.join(sets.select("digest", "tokens"), "digest").select("digest", F.explode(_children(similarity)).alias("path"))
    return out


def candidate_pairs(tokens: np.ndarray, paths: list[np.ndarray], path: int, side: np.ndarray, cross: bool, least: int) -> np.ndarray:
    """Pairs of a block that look similar and have no earlier bucket in common, as a square mask."""
    m = len(tokens)
    same = np.zeros((m, m), np.uint8)
    for k in range(tokens.shape[1]):
        same += tokens[:, k][:, None] == tokens[:, k][None, :]
    mask = np.triu(same >= least, 1)
    if cross:
        mask &= side[:, None] != side[None, :]
    if mask.any():
        earlier = [p[p < path] for p in paths]
        values, at = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(values):
            own = np.zeros((m, len(values)), np.float32)
            own[np.repeat(np.arange(m), [len(p) for p in earlier]), at] = 1
            mask &= (own @ own.T) == 0
    return mask


def shared_counts(sets: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
    """How many shingles the pairs in ``mask`` share."""
    rows, cols = np.nonzero(mask)
    out = np.zeros(mask.shape, np.int64)
    if len(rows) <= 2 * len(sets):
        for i, j in zip(rows.tolist(), cols.tolist()):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = count[at] > 1
    number = np.cumsum(count > 1) - 1
    at, owner = number[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = int((count > 1).sum())
    for s in range(0, total, 4096):
        a, b = np.searchsorted(at, (s, s + 4096))
        own = np.zeros((len(sets), min(4096, total - s)), np.float32)
        own[owner[a:b], at[a:b] - s] = 1
        out += (own @ own.T).astype(np.int64)
    return out


def _grouped(batches: Iterable, keys: int) -> Iterator[dict]:
    """Consecutive rows with equal first columns, as columns of Python values."""
    names, held, at = None, None, None
    for batch in batches:
        names = names or batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        group = list(zip(*columns[:keys])) if batch.num_rows else []
        begin = 0
        for i in range(1, len(group) + 1):
            if i == len(group) or group[i] != group[begin]:
                part = [c[begin:i] for c in columns]
                if held is not None and at == group[begin]:
                    held = [a + b for a, b in zip(held, part)]
                else:
                    if held is not None:
                        yield dict(zip(names, held))
                    held, at = part, group[begin]
                begin = i
    if held is not None:
        yield dict(zip(names, held))


def _mask(group: dict, least: int) -> np.ndarray:
    tokens = np.frombuffer(b"".join(group["tokens"]), "<u4").reshape(len(group["tokens"]), TOKENS)
    paths = [np.array(p, np.int64) for p in group["paths"]]
    cross = group["i"][0] != group["j"][0]
    return candidate_pairs(tokens, paths, group["path"][0], np.array(group["block"]), cross, least)


def _by_block(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Run over rows of one block at a time, in order."""
    near = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "digest")
    return near.mapInArrow(run, schema)


def links(docs: DataFrame, sets: DataFrame, similarity: float, width: int, recall: float, key: str, text: str) -> DataFrame:
    """(digest, links, hub) for each set and block in which it has verified links."""
    least = math.ceil(TOKENS * similarity - 4 * math.sqrt(TOKENS * similarity * (1 - similarity)))
    leaf = leaves(sets, similarity, recall)
    lists = leaf.groupBy("digest").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # a few per run
    full = leaf.join(lists, "digest").join(sets.select("digest", "tokens", "size"), "digest")
    weight = full.groupBy("path").agg(F.sum(F.col("size").cast("long")).alias("weight"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    spread = full.join(weight, "path").withColumn("blocks", blocks)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "block", "tokens", "paths"
    )

    def likely(batches):
        import pyarrow as pa

        for g in _grouped(batches, 3):
            if len(g["digest"]) < 2:
                continue
            mask = _mask(g, least)
            take = pa.array(np.flatnonzero(mask.any(0) | mask.any(1)))
            if len(take):
                columns = [pa.array(v, t) for v, t in zip(g.values(), _types(pa))]
                yield pa.RecordBatch.from_arrays([c.take(take) for c in columns], names=list(g))

    shape = "path long, i int, j int, digest binary, block int, tokens binary, paths array<long>"
    likely_rows = materialize(_by_block(spread, likely, shape), "candidates", arrow_bytes=ARROW_BYTES)

    one = likely_rows.select("digest").distinct().join(sets.select("digest", "id", "body"), "digest")
    body = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_body"), F.col(text).cast("string").alias("t"))
    chosen = body.join(one, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_body") == F.col("body")))
    chosen = chosen.groupBy("digest").agg(F.min("t").alias("t"))  # repeated rows

    def whole(batches):
        import pyarrow as pa

        seen = words.WordRows(word_hashes)
        for b, texts in _texts(batches, 1):
            out = [s.astype("<u8").tobytes() for _, cut in words.split_batches(texts) for s in shingle_sets(cut, seen, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["digest", "shingles"])

    shingles = materialize(chosen.mapInArrow(whole, "digest binary, shingles binary"), "shingles", arrow_bytes=ARROW_BYTES)

    def verify(batches):
        import pyarrow as pa

        for g in _grouped(batches, 3):
            mask = _mask(g, least)
            own = [np.frombuffer(s, "<u8") for s in g["shingles"]]
            size = np.array([len(s) for s in own])
            shared = shared_counts(own, mask)
            linked = mask & (shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9)
            linked |= linked.T
            n = linked.sum(1)
            hub = np.arange(len(n))  # rows are in order of digest: the first is the smallest
            while True:
                low = np.where(linked, hub[None, :], len(n)).min(1, initial=len(n))
                new = np.minimum(hub, low)
                new = np.minimum(new, new[new])
                if (new == hub).all():
                    break
                hub = new
            at = np.flatnonzero(n)
            if len(at):
                digest = [g["digest"][k] for k in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(n[at], pa.int64()), pa.array([g["digest"][hub[k]] for k in at], pa.binary())],
                    names=["digest", "links", "hub"],
                )

    ready = likely_rows.join(shingles, "digest").select(*likely_rows.columns, "shingles")
    verified = _by_block(ready, verify, "digest binary, links long, hub binary")
    return materialize(verified, "verified", arrow_bytes=ARROW_BYTES)


def _types(pa) -> list:
    return [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]


def join(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, body, class_id, set_id, copies, links.

    Words are what stands between blanks, in lower case. ``set_id`` is the smallest key of the rows
    with the same shingles and ``copies`` their number; ``links`` counts the other shingle sets whose
    Jaccard similarity is at least ``similarity``; ``class_id`` is the smallest key of all that hang
    together by such links. ``body`` is a hash of the text, which tells rows of one key apart.
    Null and empty texts have the empty set: they are copies of each other and linked to nothing. A
    null key is the largest. An empty table gives no rows.
    """
    signed = materialize(signatures(docs, width, key, text), "signatures", arrow_bytes=ARROW_BYTES)
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "body"))
    sets = signed.groupBy("digest").agg(
        first.alias("first"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("tokens").alias("tokens")
    )
    sets = sets.select("digest", "first.id", "first.body", "copies", "size", "tokens")
    sets = materialize(sets, "sets")
    verified = links(docs, sets, similarity, width, recall, key, text)
    degree = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    near = components(verified.select(F.col("digest").alias("a"), F.col("hub").alias("b")))
    known = sets.select("digest", F.col("id").alias("set_id"), "copies").join(degree, "digest", "left")
    known = known.join(near.withColumnRenamed("node", "digest"), "digest", "left")
    known = known.withColumn("component", F.coalesce("component", "digest"))
    classes = known.groupBy("component").agg(F.min("set_id").alias("class_id"))
    known = known.join(classes, "component").select("digest", "class_id", "set_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    known = materialize(known, "classes")
    return signed.select(F.col("id").alias(key), "body", "digest").join(known, "digest").drop("digest")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest key of their class, with all their columns.

    Of rows that share the key, the one with the smallest text hash stays, and of equal rows one.
    """
    found = join(docs, similarity, width, RECALL, key, text)
    own = found.where(F.col(key).eqNullSafe(F.col("class_id")))
    own = own.groupBy(F.col("class_id").alias("id")).agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("rows"))
    own = materialize(own, "kept")
    # a row is one column, so that none of its names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(F.col(key).alias("row_id"), F.xxhash64(F.col(text)).alias("row_body"), row)
    at = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_body") == F.col("body"))
    kept = marked.join(own.where("rows = 1"), at, "left_semi").select("row.*")
    several = own.where("rows > 1")
    if several.isEmpty():  # the same rows either way: only saves a scan
        return kept
    rest = marked.join(several, at, "left_semi")
    rest = rest.groupBy("row_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(rest.select("row.*"))
