"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full sets to confirm.

A document's set is its distinct K-word shingles (lower-cased A-Z, ASCII white space between words).  SAMPLES
MinHash values of it give BANDS band keys.  BINS further MinHash samples, the least hash of each of BINS equal parts
of the hash range, are folded into one parity bitmap of SKETCH_BITS, the odd sketch: each sample flips one bit.
Equal samples flip the same bit, so the population count of two sketches' XOR estimates how many samples differ, the
more precisely the fewer do.  Candidates whose bits differ in SIGMAS standard errors more than the threshold lets expect go;
all others are confirmed on the full sets.  Documents of equal sets are one node throughout.

At 40 bands of 5 rows a pair at similarity 0.8 is no candidate with probability 1.3e-7, and one whose sketches
mislead by five standard errors has 3e-7.

Ids may be of any type with an order.  Defined results: a text of fewer than K words is one shingle, its whole
sequence; null, empty and wordless texts have no shingles and are linked with nothing; repeated rows of one id are one
document (its least set by size, then digests, counts); rows with a null id are left out; of equal sets all documents
share the least id, so there are no ties; texts of any length count whole; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm import kernel
from barloom.llm.arrow import free_name, map_batches
from barloom.llm.groups import active_of, link
from barloom.llm.shared import Scratch, small

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BINS = 8192
SKETCH_BITS = 2048
SIGMAS = 5.0
SLACK = 0.25
BLOCK_ROWS = 1024


def shingles(t: kernel.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's bounds in them."""
    s, e, wo = t.words(kernel.SPACED)
    h = kernel.word_hashes(t.b, s, e)
    g, at, go = kernel.ngrams(h, wo, k)
    size = np.diff(wo)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            w = h[wo[d] : wo[d + 1]]
            extra[i] = kernel.ngrams(w, np.array([0, len(w)]), len(w))[0][0]
        where = go[short]
        g = np.insert(g, where, extra)
        grown = np.diff(go)
        grown[short] = 1
        go = np.concatenate([[0], np.cumsum(grown)])
    g = g.copy()
    one = np.ones(len(g), bool)
    for a, b in zip(go[:-1].tolist(), go[1:].tolist(), strict=True):
        if b - a > 1:
            g[a:b].sort()
            np.not_equal(g[a + 1 : b], g[a : b - 1], out=one[a + 1 : b])
    count = kernel.span_sums(one, go)
    return g[one], np.concatenate([[0], np.cumsum(count)])


def signatures(g: np.ndarray, go: np.ndarray) -> dict[str, np.ndarray]:
    """For each non-empty text: its digest in two parts, band keys, odd sketch and number of samples in it."""
    full = np.flatnonzero(np.diff(go) > 0)
    start = go[full]
    mul, step = kernel.constants(SAMPLES, 3), kernel.constants(BANDS, 29)
    bands = np.zeros((BANDS, len(full)), np.uint64)
    if not len(full):
        none = np.empty(0, np.uint64)
        return {"full": full, "d1": none, "d2": none, "bands": bands.T, "sketch": np.empty((0, SKETCH_BITS // 64), np.uint64), "samples": np.empty(0, np.int64)}
    with np.errstate(over="ignore"):
        made = np.empty_like(g)
        for i in range(SAMPLES):
            b = i // ROWS
            bands[b] = kernel.mix(bands[b] ^ (np.minimum.reduceat(np.multiply(g, mul[i], out=made), start) + step[b]))
        part = g >> np.uint64(64 - BINS.bit_length() + 1)
        least = np.ones(len(g), bool)
        least[1:] = part[1:] != part[:-1]
        least[start] = True
        own = kernel.owners(go)[least]
        row = np.searchsorted(full, own)
        bit = (kernel.mix(g[least] ^ np.uint64(0x3C3C3C3C5A5A5A5A)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(row * SKETCH_BITS + bit, minlength=len(full) * SKETCH_BITS).reshape(len(full), SKETCH_BITS) & 1
        sketch = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
        d1, d2 = digests(g, start)
    return {"full": full, "d1": d1, "d2": d2, "bands": bands.T, "sketch": sketch, "samples": np.bincount(row, minlength=len(full))}


def _lists(x: np.ndarray, which: np.ndarray, n: int) -> pa.Array:
    """Rows of x as lists at the places `which` of n; null elsewhere."""
    size = np.zeros(n, np.int32)
    size[which] = x.shape[1]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    gone = np.ones(n, bool)
    gone[which] = False
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), mask=pa.array(gone))


def _sign(docs: DataFrame, k: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n, at = batch.num_rows, 0
        longs = {c: np.zeros(n, np.int64) for c in ("n", "samples", "d1", "d2")}
        which, bands, sketch = [np.empty(0, np.int64)], [np.empty((0, BANDS), np.uint64)], [np.empty((0, SKETCH_BITS // 64), np.uint64)]
        for t in kernel.slices(batch.column(1)):
            g, go = shingles(t, k)
            s = signatures(g, go)
            longs["n"][at : at + t.n] = np.diff(go)
            for c in ("samples", "d1", "d2"):
                longs[c][at + s["full"]] = s[c].view(np.int64)
            which.append(at + s["full"])
            bands.append(s["bands"])
            sketch.append(s["sketch"])
            at += t.n
        which = np.concatenate(which)
        return {"id": batch.column(0)} | longs | {"bands": _lists(np.concatenate(bands), which, n), "sketch": _lists(np.concatenate(sketch), which, n)}

    longs = T.ArrayType(T.LongType())
    fields = [docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "samples", "d1", "d2")), T.StructField("bands", longs), T.StructField("sketch", longs)]
    return map_batches(docs, run, fields)


def digests(g: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each non-empty text, two sums over its set."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(kernel.mix(g), start), np.add.reduceat(kernel.mix(g ^ np.uint64(0x5555AAAA5555AAAA)), start)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out, bounds, ds = [], [np.zeros(1, np.int64)], np.zeros((2, batch.num_rows), np.uint64)
        for t in kernel.slices(batch.column(1)):
            g, go = shingles(t, k)
            out.append(g.view(np.int64))
            bounds.append(go[1:] + bounds[-1][-1])
            if len(full := np.flatnonzero(np.diff(go) > 0)):
                ds[:, t.first + full] = digests(g, go[full])
        values = np.concatenate(out) if out else np.empty(0, np.int64)
        return {"id": batch.column(0), "d1": ds[0].view(np.int64), "d2": ds[1].view(np.int64), "items": pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(values))}

    return map_batches(docs, run, [docs.schema["id"], T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


def likely(a: str, b: str, percent: int) -> Column:
    """Whether two sketches' facts (n, samples, sketch) leave room for a similarity of percent; see ``room``."""
    x, y, j, bits = F.col(a), F.col(b), percent / 100, float(SKETCH_BITS)
    u = sum((F.bit_count(x["sketch"][i].bitwiseXOR(y["sketch"][i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    union = (x["n"] + y["n"]) / F.lit(1 + j)
    free = lambda f: F.lit(1.0) - f["samples"] / F.lit(float(BINS))
    beyond = lambda f: F.greatest(union - f["n"], F.lit(0.0))
    filled = sum((f["samples"] + F.lit(float(BINS)) * free(f) * (1 - F.exp(-beyond(f) / F.lit(float(BINS)))) for f in (x, y)), F.lit(0.0)) / 2
    drift = sum((beyond(f) * free(f) * (1 - free(f)) for f in (x, y)), F.lit(0.0)) / 4
    m = F.greatest(x["samples"] + y["samples"] - 2 * j * filled, F.lit(0.0))
    e4 = F.exp(-4 * m / F.lit(bits))
    agree = j * (1 - j) * filled * F.greatest(1 - filled / union, F.lit(0.0)) + j * j * drift
    spread = F.greatest(F.lit(bits / 4) * (1 - e4) - m * e4, F.lit(0.0)) + 4 * e4 * agree
    most = F.lit(bits / 2) * (1 - F.exp(-2 * m / F.lit(bits))) + F.lit(SIGMAS) * F.sqrt(spread + 4 * SLACK) + 2 * SLACK
    sizes = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    return sizes & ((u <= most) | (most >= bits / 2))


def room(n: np.ndarray, samples: np.ndarray, u: np.ndarray, percent: int) -> np.ndarray:
    """The same in numpy; n and samples: two rows of pairs, u: the bits that differ.

    At the threshold the union has all / (1 + j) shingles; those not in one text fill parts of the hash range that are
    free of it as balls fill bins, and a share j of the filled parts agrees; m samples that differ leave about bits / 2 (1 - exp(-2 m / bits)) bits of u.
    The variance is that of the bitmap and of the shingles that share a part.  Where the bound reaches bits / 2, what
    unlike texts have, the sketches can't tell and every pair of fitting sizes stays.
    """
    j, bits = percent / 100, float(SKETCH_BITS)
    union = n.sum(0) / (1 + j)
    free, beyond = 1 - samples / BINS, np.maximum(union - n, 0)
    filled = (samples + BINS * free * (1 - np.exp(-beyond / BINS))).sum(0) / 2
    drift = (beyond * free * (1 - free)).sum(0) / 4
    m = np.maximum(samples.sum(0) - 2 * j * filled, 0)
    e4 = np.exp(-4 * m / bits)
    spread = np.maximum(bits / 4 * (1 - e4) - m * e4, 0) + 4 * e4 * (j * (1 - j) * filled * np.maximum(1 - filled / union, 0) + j * j * drift)
    most = bits / 2 * (1 - np.exp(-2 * m / bits)) + SIGMAS * np.sqrt(spread + 4 * SLACK) + 2 * SLACK
    return (100 * n.min(0) >= percent * n.max(0)) & ((u <= most) | (most >= bits / 2))


def pairs_within(active: DataFrame, look: DataFrame, percent: int, scratch: Scratch, block: int = BLOCK_ROWS) -> DataFrame:
    """Likely pairs (a, b) of different groups in each bucket of active (bucket, id, comp); look: (id, n, samples, sketch, bands).

    A bucket of more than block members is dealt into blocks, and each two blocks are a piece of work, so that no
    task holds more than two; sketches are compared in numpy, and a pair comes from its first common band alone.
    """
    blocks = scratch.put("blocks", active.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id", F.lit(41)), F.col("blocks")).cast("int")
    dealt = active.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp")
    rows = keyed.join(look, "id").select("bucket", "i", "j", "own", "id", "comp", "n", "samples", "sketch", "bands")
    words = SKETCH_BITS // 64
    id_type = look.schema["id"].dataType
    kind = to_arrow_type(id_type)

    def compare(key: tuple[int, int, int], own: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bucket, i, j = key
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        tile = max(1, (1 << 19) // max(1, len(right)))
        for at in range(0, len(left), tile):
            rows_ = left[at : at + tile]
            u = np.zeros((len(rows_), len(right)), np.int32)
            for w in range(words):
                u += np.bitwise_count(x["sketch"][rows_, w][:, None] ^ x["sketch"][right, w][None, :])
            r, c = np.nonzero(x["comp"][rows_][:, None] != x["comp"][right][None, :])
            a, b = rows_[r], right[c]
            keep = (x["id"][a] < x["id"][b]) if i == j else np.ones(len(a), bool)
            a, b, u = a[keep], b[keep], u[r[keep], c[keep]]
            keep = room(np.stack([x["n"][a], x["n"][b]]), np.stack([x["samples"][a], x["samples"][b]]), u, percent)
            a, b = a[keep], b[keep]
            if len(a):
                first = (x["bands"][a] == x["bands"][b]).argmax(1)
                keep = x["bands"][a, first] == bucket
                out.append((x["id"][a[keep]], x["id"][b[keep]]))
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (zip(*out, strict=True) if out else ((), ())))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        schema = pa.schema([("a", kind), ("b", kind)])
        held: pa.Table | None = None

        def flush(t: pa.Table, last: bool):
            """Works on all whole groups of t; gives what is left."""
            t = t.combine_chunks()
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            stop = len(edges) - 1 if last else len(edges) - 2
            x = {c: t.column(c).to_numpy() for c in ("id", "comp", "n", "samples", "own")}  # ids of other types than numbers as objects
            for c, width in (("sketch", words), ("bands", BANDS)):
                x[c] = t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)
            left, right = [], []
            for g in range(stop):
                s = slice(edges[g], edges[g + 1])
                if edges[g + 1] - edges[g] > 1:
                    a, b = compare(tuple(keys[edges[g]].tolist()), x["own"][s], {c: v[s] for c, v in x.items()})
                    left.append(a)
                    right.append(b)
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], kind) for v in (left, right)], schema=schema)
            return made, None if last else t.slice(edges[stop])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 4 * block:
                made, held = flush(held, False)
                yield made
        if held is not None and held.num_rows:
            yield flush(held, True)[0]

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)]))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (least id that links reach), kept (it is that id).

    Linked: 100 * shared >= percent * all shingles of both.
    """
    return _near_duplicates(docs, Scratch(docs.sparkSession, "neardup"), k, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, scratch: Scratch, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    signed = scratch.put("signed", _sign(docs, k))
    facts = ["n", "d1", "d2", "samples", "bands", "sketch"]
    single = signed.groupBy("id").agg(F.min(F.struct(*facts)).alias("s")).select("id", *(f"s.{c}" for c in facts))
    single = scratch.put("single", single) if signed.groupBy("id").count().where("count > 1").limit(1).count() else signed
    reps = scratch.put("reps", single.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("samples", "bands", "sketch"))))
    members = reps.select("id", F.explode("bands").alias("bucket"))
    look = reps.select("id", F.struct("n", "samples", "sketch").alias("facts"))

    def verify(pairs: DataFrame, step: int) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        full = scratch.put(f"sets-{step}", _sets(docs.join(ids, "id", "left_semi"), k).groupBy("id").agg(F.min(F.struct(F.size("items").alias("n"), "d1", "d2", "items")).alias("s")).select("id", "s.items"))
        a, b = (full.select(F.col("id").alias(x), F.col("items").alias(f"x{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("xa", "xb")))
        return both.where(100 * F.col("shared") >= percent * (F.size("xa") + F.size("xb") - F.col("shared")))

    all_ = reps.select("id", "n", "samples", "sketch", "bands")
    groups = link(active_of(members, scratch), look, lambda a, b: likely(a, b, percent), verify, scratch, lambda active: pairs_within(active, all_, percent, scratch))
    nodes = reps.select("n", "d1", "d2", F.col("id").alias("rep")).join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    nodes = scratch.put("of", nodes)
    out = single.select("id", "n", "d1", "d2").join(nodes, ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("comp", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each group does; of several rows of its id one whose text is
    least stays.  Rows with a null id stay."""
    scratch = Scratch(docs.sparkSession, "neardup")
    key = free_name(docs, "gone_id")
    judged = scratch.put("judged", _near_duplicates(docs, scratch, k, percent, id_col, text_col).select(F.col(id_col).alias(key), "kept"))
    scratch.drop_but("judged")
    own = F.col(f"`{id_col}`")
    out = docs.join(small(judged.where("not kept").select(key)), own == F.col(key), "left_anti")
    twice = scratch.put("twice", docs.where(own.isNotNull()).groupBy(own.alias(key)).count().where("count > 1").select(key))
    if not twice.limit(1).count():
        return out
    place = free_name(docs, "place")
    order = Window.partitionBy(own).orderBy(F.col(f"`{text_col}`").asc_nulls_first(), *(F.col(f"`{f.name}`").cast("string") for f in docs.schema.fields if f.name != text_col))
    first = out.join(twice, own == F.col(key), "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return out.join(twice, own == F.col(key), "left_anti").unionByName(first)
