"""Near-duplicates by MinHash and a multi-index Hamming join.

Every distinct shingle set gets a signature of ``K`` minima, cut to b bits each. Two
sets at similarity 0.8 differ in about K/5 of the places; pairs that differ in at most
``T`` places are guaranteed to be found: the signature is split into chunks, and by the
pigeonhole principle some chunk i holds at most e_i differences when the (e_i + 1) sum
to T + 1 or more. So each chunk is entered once for every choice of e_i places to be
left out (``index_keys``), and pairs that share a key are the candidates. At 0.8 a pair
lies beyond T with a probability of about 2e-5.

Nothing is ever paired up within a bucket:
1. sets that are equal are one class, represented by its smallest id (combined before
   the shuffle, however large the class);
2. in each bucket every class is compared, on full sets, with one pivot only: the class
   that meets most others, which in a group of edited copies is nearest to their source;
3. two classes that are near the pivot are linked only if they share edits: with D the
   symmetric difference from the pivot, similarity 0.8 means 9 |Dx xor Dy| <= |x| + |y|,
   and pairs without a common edit that are this close are both linked to the pivot
   already. Edits are joined by prefix filtering, rarest first, so copies with edits of
   their own never meet. Similarity is a metric: what is at 0.6 or more to the pivot can
   only be linked to what is at 0.4 or more, so it is done with this bucket;
4. the classes far from the pivot get a second pivot, and what is far from both meets
   block by block on signatures, where only pairs within T places are checked further."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import LOWER, bound_batches, mix, shingles, span_hashes, text_slices, words
from locatext.session import release, written

#: Places of a signature and bits of each.
K, BITS = 64, 16
#: Places in which a pair may differ to be surely found.
T = 27
CHUNK = 4
SIMILARITY, NEAR, CLOSE = 80, 60, 40
#: Pivots a bucket gets before its remaining classes meet in blocks.
PIVOTS = 2
#: Classes of an unresolved bucket or of a pivot's neighbourhood in one block.
BLOCK = 2048
#: Bytes of texts whose sets a worker holds at once while it compares them (or one pair).
COMPARE_BYTES = 2 << 20


def _choices() -> list[tuple[int, ...]]:
    """For each index key the places it keeps: the first chunks allow one error, as many
    as it takes for the (e_i + 1) to sum to T + 1, the others none."""
    chunks = [tuple(range(a, a + CHUNK)) for a in range(0, K, CHUNK)]
    loose = T + 1 - len(chunks)
    return [keep for i, chunk in enumerate(chunks) for keep in combinations(chunk, CHUNK - (i < loose))]


KEYS = _choices()
_rng = np.random.default_rng(20240917)
_MULTIPLY = (_rng.integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, K, dtype=np.uint64) | np.uint64(1)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, row offsets) by slices."""
    for lo, hi, offs, buf in text_slices(column):
        low = LOWER[buf]
        starts, ends, first = words(low, offs)
        h, at = shingles(span_hashes(low, starts, ends), first, k)
        parts = [np.unique(h[at[i] : at[i + 1]]) for i in range(hi - lo)]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        yield lo, hi, np.concatenate(parts) if parts else h, np.concatenate([[0], np.cumsum(sizes)])


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """K minima of each non-empty set, cut to BITS bits."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, K), dtype=np.uint16)
    buffer = np.empty_like(x)
    for j in range(K):
        np.bitwise_xor(x, _XOR[j], out=buffer)
        np.multiply(buffer, _MULTIPLY[j], out=buffer)
        low = np.minimum.reduceat(buffer, at[:-1])
        low *= np.uint32(0x9E3779B1)
        out[:, j] = low >> np.uint32(32 - BITS)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The index keys of each signature: rows x len(KEYS) 64-bit numbers."""
    parts = mix(signature.astype(np.uint64) + _PLACE[None, :])
    out = np.empty((len(signature), len(KEYS)), dtype=np.uint64)
    for i, keep in enumerate(KEYS):
        out[:, i] = parts[:, list(keep)].sum(axis=1, dtype=np.uint64) + np.uint64(i + 1)
    return mix(out)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, h, at in sets_of(batch.column("text"), k):
                n = np.diff(at)
                some = np.flatnonzero(n > 0)
                sig: list[bytes | None] = [None] * (hi - lo)
                code = np.zeros((2, hi - lo), dtype=np.int64)
                if len(some):
                    where = np.concatenate([at[some], [at[-1]]])
                    for i, s in zip(some.tolist(), signatures(h, where), strict=True):
                        sig[i] = s.tobytes()
                    m = mix(h.copy())
                    code[0, some] = np.add.reduceat(h, at[some]).view(np.int64)
                    code[1, some] = np.add.reduceat(m, at[some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(code[0]), pa.array(code[1]), pa.array(sig, pa.binary())], names=["id", "n", "c0", "c1", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sig = np.frombuffer(b"".join(x.as_py() for x in part.column("sig")), dtype=np.uint16).reshape(-1, K)
            keys = index_keys(sig).view(np.int64)
            ids = np.repeat(part.column("cls").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "cls"])


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted column ``key`` whose key another row has, in one pass."""
    held: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        if held is not None and batch.num_rows:
            # The last row of a batch waits for the first of the next.
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        same[0] = before is not None and before == key[0]
        before = key[-2] if len(key) > 1 else before
        yield batch.slice(0, len(key) - 1).filter(pa.array((same[1:] | same[:-1])[:-1]))
        held = batch.slice(len(key) - 1)
    if held is not None and before is not None and before == held.column("key")[0].as_py():
        yield held


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def sets(ids: pa.Array, texts: pa.Array) -> list[np.ndarray]:
        """The rows' sets; a pivot that comes again is read once."""
        _, first, back = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        own = [h[at[i] : at[i + 1]] for _, _, h, at in sets_of(texts.take(pa.array(first)), k) for i in range(len(at) - 1)]
        return [own[i] for i in back]

    for batch in batches:
        size = np.add(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb")))
        rounds = np.flatnonzero(np.diff(np.cumsum(size) // COMPARE_BYTES)) + 1
        for at, end in zip([0, *rounds.tolist()], [*rounds.tolist(), batch.num_rows], strict=True):
            part = batch.slice(at, end - at)
            rows: list[list] = [[], [], [], [], []]
            for x, y in zip(sets(part.column("a"), part.column("ta")), sets(part.column("b"), part.column("tb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked, near, close = (100 * both >= s * union for s in (SIMILARITY, NEAR, CLOSE))
                edits = np.setxor1d(x, y, assume_unique=True).view(np.int64) if close else None
                for c, v in zip(rows, (len(y), linked, near, close, edits), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=["a", "b", "n", "linked", "near", "close", "edits"])


_COMPARED = "a long, b long, n long, linked boolean, near boolean, close boolean, edits array<long>"


def common_edits(rows: list[tuple[int, int, int, np.ndarray]]) -> set[tuple[int, int]]:
    """Linked pairs of different components among classes around one pivot, given as
    (class, component, set size, edits): those whose common edits o satisfy
    18 o >= g(x) + g(y) with g = 9 |edits| - size. Exact, by prefix filtering: a pair
    that needs o common edits shares one of each side's |edits| - o + 1 rarest."""
    if len(rows) < 2:
        return set()
    flat = np.concatenate([r[3] for r in rows])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = np.split(rank[code], np.cumsum([len(r[3]) for r in rows])[:-1])
    frequent = np.sort(count)  # by rank
    g = [9 * len(r[3]) - r[2] for r in rows]
    low = sorted({r[1]: v for v, r in sorted(zip(g, rows, strict=True), key=lambda x: -x[0])}.items(), key=lambda x: x[1])[:2]
    index: dict[int, list[int]] = {}
    found: set[tuple[int, int]] = set()
    for i, (cls, component, _, edits) in enumerate(rows):
        other = next((v for c, v in low if c != component), None)
        if other is None:
            continue
        need = max(1, -(-(g[i] + other) // 18))
        mine = ranks[i] = np.sort(ranks[i])
        seen: set[int] = set()
        for r in mine[: len(edits) - need + 1].tolist() if need <= len(edits) else ():
            if frequent[r] < 2:
                continue
            for j in index.get(r, ()):
                if j not in seen and rows[j][1] != component:
                    seen.add(j)
                    if 18 * len(np.intersect1d(mine, ranks[j], assume_unique=True)) >= g[i] + g[j]:
                        found.add((min(cls, rows[j][0]), max(cls, rows[j][0])))
            index.setdefault(r, []).append(i)
    return found


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``common_edits`` of rows sorted by pivot and pair of blocks."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        pairs = common_edits(rows)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        edits = batch.column("edits")
        for k, r in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "i", "j", "b", "component", "n")), strict=True)):
            if r[:3] != now:
                if rows:
                    yield flush(rows)
                now, rows = r[:3], []
            rows.append((*r[3:], edits[k].values.to_numpy()))
    if rows:
        yield flush(rows)


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``pairs`` (a, b: ids) compared on full shingle sets, made from the texts: these
    take half the room of their sets in a shuffle. Both sides grow with the corpus, so
    they are merged at every size and never broadcast."""
    both = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return written(both.mapInArrow(lambda batches: _compare(batches, k), _COMPARED), "near-compared")


def components(links: DataFrame, label: str = "near-components", rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable, for every id in ``links`` (a, b). Large
    stars are made smaller and small stars smaller still until nothing changes; each
    round is written, as a lost executor must not replay the ones before."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), label)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        new = written(small, label)
        before, after = (df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first() for df in (edges, new))
        release(edges)
        edges = new
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within T places, block against block."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        a, b = ([r for r in rows if r[2] == block] for block in rows[0][3:5])
        found: set[tuple[int, int]] = set()
        if a and b:
            sb = np.stack([np.frombuffer(r[6], np.uint16) for r in b])
            cb, ib = np.array([r[5] for r in b]), np.array([r[1] for r in b])
            for r in a:
                s = np.frombuffer(r[6], np.uint16)
                near = np.flatnonzero((cb != r[5]) & ((sb != s).sum(axis=1) <= T))
                found.update((min(r[1], i), max(r[1], i)) for i in ib[near].tolist())
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "cls", "block", "i", "j", "component", "sig")), strict=True):
            if (r[0], r[3], r[4]) != now:
                if rows:
                    yield flush(rows)
                now, rows = (r[0], r[3], r[4]), []
            rows.append(r)
    if rows:
        yield flush(rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable
    over links, itself included), kept (id = component_id). Texts without words (and
    nulls) have no shingles and no links. Ids must be integers that do not repeat: rows
    that repeat an id are one document to the links, and each comes back. A null id is
    linked with nothing (its component_id is null, kept is true). Other columns are not
    read. Links hold where 100 * intersection >= 80 * union of the full sets."""
    src = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = written(src.mapInArrow(_sets(shingle), "id long, n long, c0 long, c1 long, sig binary"), "near-signatures")
    known = made.where("n > 0 AND id IS NOT NULL")
    code = ["n", "c0", "c1"]
    classes = written(known.groupBy(*code).agg(F.min("id").alias("cls"), F.min("sig").alias("sig")), "near-classes")

    index = classes.select("cls", "sig").mapInArrow(_keys, "key long, cls long")
    # Every class has all KEYS: however large a bucket, its key is a small part of the rows.
    met = written(index.repartition("key").sortWithinPartitions("key").mapInArrow(_met_twice, "key long, cls long"), "near-buckets")
    shared = met.join(met.groupBy("key").agg(F.count("*").alias("size")), "key")
    degree = shared.groupBy("cls").agg(F.sum("size").alias("degree"))
    rest = shared.join(degree, "cls").select("key", "cls", "degree")
    candidates = shared.select(F.col("cls").alias("id")).distinct()
    texts = written(src.where("id IS NOT NULL").join(candidates.hint("merge"), "id", "left_semi"), "near-texts")

    links = around = None
    for _ in range(PIVOTS):
        top = rest.groupBy("key").agg(F.max(F.struct("degree", (-F.col("cls")).alias("minus"))).alias("top"), F.count("*").alias("held")).where("held > 1")
        named = written(rest.join(top.select("key", (-F.col("top.minus")).alias("pivot")), "key").where("cls <> pivot"), "near-named")
        known = compared(written(named.select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct(), "near-pairs"), texts, shingle)
        rest = named.join(known.where("near").select(F.col("a").alias("pivot"), F.col("b").alias("cls")), ["pivot", "cls"], "left_anti").select("key", "cls", "degree")
        linked, open_pivots = known.where("linked").select("a", "b"), known.where("close AND NOT linked").select("a").distinct()
        near = known.where("close").join(open_pivots, "a", "left_semi").select("a", "b", "n", "edits")
        links = linked if links is None else links.unionByName(linked)
        around = near if around is None else around.unionByName(near)

    found = components(links).select(F.col("id").alias("b"), "component")
    in_blocks = lambda df, group, member: df.join(df.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")), group).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    # A block meets every other once, as (i, j) with i <= j.
    around = around.join(found, "b", "left").withColumn("component", F.coalesce("component", "b"))
    around = in_blocks(around, "a", "b").repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    more = around.mapInArrow(_edits, "a long, b long")

    far = rest.join(found.withColumnRenamed("b", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = far.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    far = in_blocks(written(far.join(mixed, "key", "left_semi"), "near-far"), "key", "cls")
    far = far.join(classes.select("cls", "sig"), "cls").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    last = compared(written(far.mapInArrow(_meet, "a long, b long").distinct(), "near-more"), texts, shingle).where("linked").select("a", "b")
    found = components(links.unionByName(more).unionByName(last))

    of_class = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select(*code, F.coalesce("component", "cls").alias("component"))
    out = made.join(of_class, code, "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
