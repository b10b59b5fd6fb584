"""Near duplicates by SuperMinHash signatures, bands, verification on whole sets, and union-find.

Each shingle deals the slots of a signature to itself in a random order of its own: at level j it offers the value j + r to
the slot that its permutation has at place j. A slot keeps the smallest offer. As a shingle never offers to a slot twice and
its offers get larger level by level, the slots of one signature depend on each other in a way that lowers the variance of
the estimate, most for small sets. Offers of a level are smaller than those of the next, so a document is done at the level
where its last slot fills (early stopping): large ones after the first, a document of one shingle after all.

Signatures are cut into bands; sets that agree in a whole band are candidates. Each set of a band is paired with the band's
smallest one; links are confirmed on full sets and united. Where members of a band are then still in different components,
those outside its largest component are compared with all others, in short lists as pairs, in long ones in blocks of shares
of the list, so that no candidate is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import ensure_checkpoint_dir, table, text_bytes, text_slices, with_row_ids
from helixmill.llm.ngram_jaccard import components, mix, packed_texts, set_names, shingles, verified, with_components

WORDS, PERCENT = 3, 85
#: A pair of 85 % agrees in none of 30 bands of 6 with a probability of (1 - 0.85^6)^30 = 7e-7.
BANDS, ROWS = 30, 6
#: Up to this level a permutation's entry is found through the earlier swaps, from it on in a table.
DIRECT = 8
#: Lists up to this long are compared as pairs; the others in blocks, of shares of about so many sets or shingles at most.
FEW, SHARE, SHARE_SHINGLES = 16, 512, 200_000
U = np.uint64
LEVEL, BAND = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
LAST = U((1 << 64) - 1)


def signatures(h: np.ndarray, d: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The SuperMinHash signatures of n documents with the shingle hashes h of the documents d; empty documents have all ones."""
    out = np.full(n * slots, LAST, U)
    empty = np.ones(n * slots, bool)
    left = np.arange(len(h))  # shingles of documents with empty slots
    swaps: list[np.ndarray] = []
    deal = np.empty((0, slots), np.int16)
    for j in range(slots):
        if not len(left):
            break
        x = mix(h[left] + U(j * int(LEVEL) % (1 << 64)))
        k = j + (((x & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)
        if j < DIRECT:
            slot = k
            for i in range(j - 1, -1, -1):  # the last swap that touched the place, and what stood there before it
                slot = np.where(swaps[i] == slot, i, slot)
            swaps.append(k)
        else:
            at = np.arange(len(left))
            slot = deal[at, k].astype(np.int64)
            deal[at, k] = deal[at, j]
        place = d[left] * slots + slot
        fresh = empty[place]
        np.minimum.at(out, place[fresh], x[fresh])
        empty[place[fresh]] = False
        open_ = empty.reshape(n, slots).any(axis=1)
        on = open_[d[left]]
        if not on.all():
            left = left[on]
            swaps = [s[on] for s in swaps]
            deal = deal[on] if j >= DIRECT else deal
        if j == DIRECT - 1:
            deal = np.tile(np.arange(slots, dtype=np.int16), (len(left), 1))
            at = np.arange(len(left))
            for i, s in enumerate(swaps):
                deal[at, i], deal[at, s] = deal[at, s], deal[at, i]
            swaps = []
    return out.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A number for each band of each signature; bands of different places never agree but by chance."""
    parts = signature.reshape(len(signature), bands, rows)
    total = np.arange(bands, dtype=U)[None, :] * BAND
    for i in range(rows):
        total = mix(total + parts[:, :, i])
    return total


def sets_and_bands(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A row a document (key, own, set, size), with the keys of the bands where its set is new to the batch."""
    for batch in batches:
        seen = np.empty(0, np.int64)
        for part in text_slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            h, d = shingles(data, offsets, words)
            name, size = set_names(h, d, part.num_rows)
            fresh = np.zeros(part.num_rows, bool)
            fresh[np.unique(name, return_index=True)[1]] = True
            fresh &= ~np.isin(name, seen) & (size > 0)
            seen = np.concatenate((seen, name[fresh]))
            number = np.cumsum(fresh) - 1
            on = fresh[d]
            keys = band_keys(signatures(h[on], number[d[on]], int(fresh.sum()), bands * rows), bands, rows).view(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(fresh, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("own"), pa.array(name), pa.array(size), lists], ["key", "own", "set", "size", "bands"])


def root_of(up: dict[int, int], x: int) -> int:
    """The root of x in a forest of parents; ways are halved as they are walked."""
    while (y := up.setdefault(x, x)) != x:
        up[x] = up.setdefault(y, y)
        x = up[x]
    return x


def united(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as forests: each block of links by union-find, its members linked with the smallest of their tree."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            up: dict[int, int] = {}

            for a, b in zip(batch.column("a")[lo : lo + most].to_pylist(), batch.column("b")[lo : lo + most].to_pylist()):
                a, b = root_of(up, a), root_of(up, b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            pairs = [(root_of(up, x), x) for x in list(up) if root_of(up, x) != x]
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def group_links(links: DataFrame) -> DataFrame:
    """(set, comp) by union-find inside the partitions, then over their forests, which have fewer links."""
    return components(links.mapInArrow(united, "a long, b long").distinct().checkpoint())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `docs`: key, n_shingles, component_id (the smallest key reachable by links, its own included), kept.

    Texts are lower-cased in A-Z and divided at ASCII white space; a set is the distinct runs of `words` words, or all words if
    they are fewer; null, empty and blank texts have an empty set, no link and are kept. Rows link if 100 * common shingles are
    at least percent * all shingles of the two; candidates share a band of `rows` slots, links are confirmed on whole sets.
    kept: the key is its component's smallest. Rows with equal texts link; rows that share a key but not the text are documents
    of their own. A null key counts as the smallest number, -2^63. Other columns are dropped whatever their names. An empty
    table gives an empty result. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    named = with_row_ids(docs.select(F.col(key).cast("long").alias("own"), F.col(text).alias("text")), "own")
    frame = named.select(F.col("_id").alias("key"), "own", "text")
    schema = "key long, own long, set long, size long, bands array<long>"
    whole = frame.mapInArrow(lambda b: sets_and_bands(b, words, bands, rows), schema).checkpoint()
    found, frame = whole.select("key", "own", "set", "size"), frame.select("key", "text")
    reps = found.where("size > 0").groupBy("set").agg(F.min("key").alias("key"))
    places = whole.where(F.size("bands") > 0).select(F.explode("bands").alias("band"), "set", "size")
    heads = places.groupBy("band").agg(F.min("set").alias("first"), F.max("set").alias("last")).where("first <> last").select("band", "first").checkpoint()
    members = places.join(heads, "band").select("band", "first", "set", "size").distinct().checkpoint()
    star = members.where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct().checkpoint()
    links = verified(star, reps, frame, words, percent)
    comps = group_links(links)
    lists = _open_lists(members, comps).checkpoint()
    if not lists.isEmpty():
        few = lists.where(F.col("n") <= FEW)
        pairs = _pairs_of(few, percent).checkpoint()
        more_links = _linked_in_blocks(lists.where(F.col("n") > FEW), reps, frame, words, percent)
        links = links.unionByName(verified(pairs, reps, frame, words, percent)).unionByName(more_links)
        comps = group_links(links)
    out = with_components(found, comps, key)
    return out.withColumn("kept", F.coalesce(F.col(key), F.lit(-(2**63))) == F.col("component_id"))


def _open_lists(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (band, first, set, size, comp, minor) of bands that meet in several components, with the band's members and shingles, all and minor ones.

    minor: outside the band's largest component. Each link that is still missing has a minor member in some band.
    """
    labelled = members.join(comps, "set", "left").select("band", "first", "set", "size", F.coalesce("comp", "set").alias("comp"))
    sizes = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    top = F.max(F.struct("n", "w", "comp"))
    open_ = sizes.groupBy("band").agg(top.alias("top"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("comps > 1")
    own = open_.select("band", F.col("top.comp").alias("most"), "n", "w", (F.col("n") - F.col("top.n")).alias("minor_n"), (F.col("w") - F.col("top.w")).alias("minor_w"))
    return labelled.join(own, "band").withColumn("minor", F.col("comp") != F.col("most")).drop("most")


def _pairs_of(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists: each minor member with all of another component and of like size, less those with the band's first."""
    minor = lists.where("minor").select("band", F.col("set").alias("x"), F.col("size").alias("m"), F.col("comp").alias("own"))
    alike = (100 * F.least("m", "size") >= percent * F.greatest("m", "size")) & (F.col("own") != F.col("comp"))
    once = ~F.col("minor") | (F.col("x") < F.col("set"))
    both = minor.join(lists, "band").where(alike & once & (F.col("x") != F.col("first")) & (F.col("set") != F.col("first")))
    return both.select(F.least("x", "set").alias("a"), F.greatest("x", "set").alias("b")).distinct()


def _linked_in_blocks(lists: DataFrame, reps: DataFrame, frame: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of long lists: minor members and all members are dealt to shares, and each two shares meet in a block of bounded size.

    So no task holds a list, and no row stands for a pair: a text travels once to each block of its share.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = lambda n, w: F.ceil(F.greatest(F.col(n) / SHARE, F.col(w) / SHARE_SHINGLES)).cast("int")
    dealt = lists.withColumns({"rows": shares("minor_n", "minor_w"), "columns": shares("n", "w")})
    every = F.sequence(F.lit(0), F.col("rows") - 1), F.sequence(F.lit(0), F.col("columns") - 1)
    share = lambda c: F.array(F.pmod(F.xxhash64("set"), F.col(c)).cast("int"))
    all_ = dealt.select("band", F.explode(every[0]).alias("i"), share("columns")[0].alias("j"), F.lit(False).alias("asks"), "set", "comp")
    asks = dealt.where("minor").select("band", share("rows")[0].alias("i"), F.explode(every[1]).alias("j"), F.lit(True).alias("asks"), "set", "comp")
    texts = packed_texts(lists.select("set").distinct(), reps, frame)
    placed = all_.unionByName(asks).join(texts, "set").repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return placed.mapInArrow(lambda b: block_links(b, words, percent), "a long, b long").checkpoint()


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many numbers each array of a has in common with each of b; arrays have no repeats. `width` numbers at a time."""
    va, vb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)))

    def placed(v: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place in shared, array) of the shared numbers, by place."""
        at, own = np.searchsorted(shared, v), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        on = at < len(shared)
        on[on] = shared[at[on]] == v[on]
        order = np.argsort(at[on], kind="stable")
        return at[on][order], own[on][order]

    (ca, ra), (cb, rb) = placed(va, a), placed(vb, b)
    for lo in range(0, len(shared), width):
        w = min(width, len(shared) - lo)
        sides = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            i, j = np.searchsorted(c, (lo, lo + w))
            m = np.zeros((n, w), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def block_links(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, asks, set, comp, packed) by block; of each block the links that unite different components."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, sides, out = None, ([], []), []

    def close() -> None:
        asks, all_ = sides
        if asks and all_:
            counts = common_counts([x[2] for x in asks], [x[2] for x in all_])
            n, m = (np.array([len(x[2]) for x in s], np.float64) for s in (asks, all_))
            comp = [np.array([x[1] for x in s]) for s in (asks, all_)]
            linked = (100 * counts >= percent * (n[:, None] + m[None, :] - counts)) & (comp[0][:, None] != comp[1][None, :])
            up: dict[int, int] = {}
            for p, q in np.argwhere(linked).tolist():
                a, b = root_of(up, asks[p][1]), root_of(up, all_[q][1])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((asks[p][0], all_[q][0]))
        asks.clear()
        all_.clear()

    def rows() -> pa.RecordBatch:
        a, b = zip(*out) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for *block, asks, name, comp, data in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "asks", "set", "comp", "packed"))):
            if block != at:
                close()
                at = block
            raw = np.frombuffer(unpack(data), np.uint8)
            sides[0 if asks else 1].append((name, comp, shingles(raw, np.array([0, len(raw)]), words)[0]))
        yield rows()
    close()
    yield rows()


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
